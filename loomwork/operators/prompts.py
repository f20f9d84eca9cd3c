"""Prompt suites for object-centred image benchmarks, drawn by hashes and deduplicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.parsers import plural, with_article

# Colours, number words and relations of the prompts, and the object that has no colour.
COLOURS = ("red", "orange", "yellow", "green", "blue", "purple", "pink", "brown", "black", "white")
COUNTS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
RELATIONS = ("left of", "right of", "above", "below")
PERSON = "person"
TASKS = ("two_object", "counting", "colors", "position", "color_attr")


def _number(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")


def _pick(items: Column, key: Column) -> Column:
    return F.get(items, (_number(key) % F.size(items)).cast("int"))


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def item(noun: Column, count: Column | None = None, colour: Column | None = None, position: Column | None = None) -> Column:
    """An object that an image must hold; ``position`` is its relation to the object of index ``target``."""
    none = F.lit(None).cast("string")
    return F.struct(
        noun.alias("class"),
        (F.lit(1) if count is None else count).cast("int").alias("count"),
        (none if colour is None else colour).alias("color"),
        (none if position is None else position).alias("position"),
        (F.lit(None) if position is None else F.lit(0)).cast("int").alias("target"),
    )


def drawn(draws: DataFrame, nouns: list[str], seed: int, most: int = 4) -> DataFrame:
    """(tag, i, prompt, include, exclude): for every draw ``i`` a prompt of each task.

    Two nouns of a prompt differ, as do two colours; coloured objects are never a
    person; a count of 2 to ``most`` excludes one object more.  All nouns but one
    are left to choose from by taking a place behind the first one's, so no list
    is built a row.
    """
    if not 2 <= most < len(COUNTS):
        raise ValueError(f"counts go from 2 to {len(COUNTS) - 1}")
    things = [n for n in nouns if n != PERSON]
    if len(things) < 2:
        raise ValueError("prompts need two nouns beside a person")
    rows = draws.select("i", F.explode(_array(TASKS)).alias("tag"))
    key = lambda part: F.concat_ws(":", F.lit(str(seed)), "tag", F.col("i").cast("string"), F.lit(part))

    def two(values: list[str], a: str, b: str) -> tuple[Column, Column]:
        """Two different values: the second stands 1 to n - 1 places behind the first."""
        first = _number(key(a)) % len(values)
        second = (first + 1 + _number(key(b)) % (len(values) - 1)) % len(values)
        return F.get(_array(values), first.cast("int")), F.get(_array(values), second.cast("int"))

    coloured = F.col("tag").isin("colors", "color_attr")
    plain, bare, tones = two(nouns, "a", "b"), two(things, "a", "b"), two(list(COLOURS), "c1", "c2")
    known = rows.withColumns({
        "a": F.when(coloured, bare[0]).otherwise(plain[0]),
        "b": F.when(coloured, bare[1]).otherwise(plain[1]),
        "c1": tones[0],
        "c2": tones[1],
        "n": (2 + _number(key("n")) % (most - 1)).cast("int"),
        "rel": _pick(_array(RELATIONS), key("rel")),
    })
    A, B, C1, C2, N, REL = (F.col(x) for x in ("a", "b", "c1", "c2", "n", "rel"))
    photo = lambda *parts: F.concat(F.lit("a photo of "), *parts)
    say = {
        "two_object": (photo(with_article(A), F.lit(" and "), with_article(B)), F.array(item(A), item(B))),
        "counting": (photo(F.get(_array(COUNTS), N), F.lit(" "), plural(A)), F.array(item(A, N))),
        "colors": (photo(with_article(C1), F.lit(" "), A), F.array(item(A, colour=C1))),
        "position": (photo(with_article(A), F.lit(" "), REL, F.lit(" "), with_article(B)), F.array(item(B), item(A, position=REL))),
        "color_attr": (photo(with_article(C1), F.lit(" "), A, F.lit(" and "), with_article(C2), F.lit(" "), B), F.array(item(A, colour=C1), item(B, colour=C2))),
    }
    prompt = F.coalesce(*[F.when(F.col("tag") == tag, p) for tag, (p, _) in say.items()])
    include = F.coalesce(*[F.when(F.col("tag") == tag, i) for tag, (_, i) in say.items()])
    exclude = F.when(F.col("tag") == "counting", F.array(F.struct(A.alias("class"), (N + 1).alias("count"))))
    return known.select("tag", "i", prompt.alias("prompt"), F.to_json(include).alias("include"), F.to_json(exclude).alias("exclude"))


def deduplicated(prompts: DataFrame) -> DataFrame:
    """Of prompts that ask for the same the first stays."""
    first = prompts.groupBy("tag", "include").agg(F.min_by(F.struct("prompt", "exclude"), "i").alias("_f"))  # in partial sums, so no task holds a group
    return first.select("tag", "_f.prompt", "include", "_f.exclude")


def suite(spark: SparkSession, nouns: list[str], per_task: int, seed: int, most: int = 4) -> DataFrame:
    """(tag, prompt, include, exclude): each noun once, then so many prompts of every other task, without repeats."""
    singles = spark.createDataFrame([(i, n) for i, n in enumerate(nouns)], "i long, a string")
    a = F.col("a")
    single = singles.select(F.lit("single_object").alias("tag"), "i", F.concat(F.lit("a photo of "), with_article(a)).alias("prompt"), F.to_json(F.array(item(a))).alias("include"), F.lit(None).cast("string").alias("exclude"))
    many = drawn(spark.range(per_task).select(F.col("id").alias("i")), nouns, seed, most)
    return deduplicated(single.unionByName(many))
