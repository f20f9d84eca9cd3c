"""Scores out of judges' texts that are nearly JSON: the first balanced object, repairs, and what stands in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.expr import let
from loomwork.functions.parsers import number_of, strip

DELIMITER = "||V^=^V||"


def balanced_object(text: Column) -> Column:
    """The first ``{...}`` whose braces balance, not counting those in double-quoted texts inside it; null without one.

    One fold over the characters; it keeps a depth, where the object began and
    ended, and whether it stands in a quoted text or behind a backslash.
    """
    start = F.struct(*[F.lit(v).alias(n) for n, v in (("at", 0), ("depth", 0), ("begin", -1), ("end", -1), ("quoted", False), ("escaped", False))])

    def step(s: Column, c: Column) -> Column:
        inside = s["depth"] > 0
        mark = inside & ~s["escaped"] & (c == '"')
        counts = ~s["quoted"] & (s["end"] < 0)
        opens = counts & (c == "{")
        closes = counts & inside & (c == "}")
        depth = s["depth"] + F.when(opens, F.lit(1)).when(closes, F.lit(-1)).otherwise(F.lit(0))
        return F.struct(
            (s["at"] + 1).alias("at"),
            depth.alias("depth"),
            F.when(opens & ~inside, s["at"]).otherwise(s["begin"]).alias("begin"),
            F.when(closes & (s["depth"] == 1), s["at"]).otherwise(s["end"]).alias("end"),
            F.when(mark & (s["end"] < 0), ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            (s["quoted"] & ~s["escaped"] & (c == "\\")).alias("escaped"),
        )

    characters = F.filter(F.split(text, ""), lambda c: c != "")
    return let(F.aggregate(characters, start, step), lambda s: F.when(s["end"] >= 0, F.substring(text, s["begin"] + 1, s["end"] - s["begin"] + 1)))


def repaired_json(text: Column) -> Column:
    """Commas before a closing bracket go, bare keys get quotes, and quotes inside texts get a backslash; well-formed texts stay."""
    fixed = F.regexp_replace(text, r'(?<![\\{\[,:])(?<![{\[,:]\s{1,8})"(?!\s*[,:}\]])', r'\\"')
    fixed = F.regexp_replace(fixed, r",(\s*[}\]])", "$1")
    fixed = F.regexp_replace(fixed, r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", r'$1"$2"$3')
    return F.when(F.try_parse_json(text).isNotNull(), text).when(F.try_parse_json(fixed).isNotNull(), fixed)


def _object(text: Column) -> Column:
    """The text itself, its first balanced object, or either repaired, whichever is JSON first; null if none is."""
    block = balanced_object(text)
    whole = F.when(F.try_parse_json(text).isNotNull() & strip(text).startswith("{"), text)
    return F.coalesce(whole, let(block, lambda b: F.coalesce(F.when(F.try_parse_json(b).isNotNull(), b), repaired_json(b))))


def dual_scores(text: Column, keys: tuple[str, str] = ("instruction_score", "knowledge_score")) -> Column:
    """Each ``<stem>_score`` with its ``<stem>_reasoning``, from the text's object, else each from its own name in the text.

    In an object a score that isn't there is 0 and one that is null, or no
    number, is null; found by name it is 1 to 5.
    """

    def of(json: Column) -> Column:
        fields = []
        for score in keys:
            stem = score.removesuffix("_score")
            why = f"{stem}_reasoning"
            given = number_of(F.get_json_object(json, f"$.{score}"))
            missing = ~F.array_contains(F.json_object_keys(json), score)
            named = F.nullif(F.regexp_extract(text, rf'(?i)"?{stem}[_\s]*score"?\s*:\s*([1-5])', 1), F.lit("")).cast("int")
            said = F.regexp_extract(text, rf'(?is)"?{why}"?\s*:\s*"(.*?)(?<!\\)"', 1)
            known = json.isNotNull() & (F.coalesce(F.size(F.json_object_keys(json)), F.lit(0)) > 0)
            fields += [
                F.when(known & missing, F.lit(0)).when(known, given.cast("int")).otherwise(named).alias(score),
                F.when(known, F.get_json_object(json, f"$.{why}")).otherwise(F.nullif(strip(said), F.lit(""))).alias(why),
            ]
        return F.struct(*fields)

    return let(_object(text), of)


def viescore_list(text: Column, field: str = "score") -> Column:
    """A judge's scores as doubles: from the text between two delimiters, from first to last brace, a list of numbers in brackets, or a whole number of 0 to 10.

    The JSON is repaired if it must be; a single score is a list of one.
    """
    cut = F.split(text, F.lit(r"\Q" + DELIMITER + r"\E"))
    between = F.when(F.size(cut) == 3, F.get(cut, F.lit(1)))
    braced = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    body = F.replace(strip(F.coalesce(between, braced)), F.lit("\n"), F.lit(""))

    def of(json: Column) -> Column:
        value = F.get_json_object(json, f"$.{field}")
        one = number_of(value)
        return F.coalesce(F.from_json(value, "array<double>"), F.when(one.isNotNull(), F.array(one)))

    listed = F.regexp_extract(text, r"(\[\s*\d+(?:\.\d+)?(?:\s*,\s*\d+(?:\.\d+)?)*\s*\])", 1)
    bare = strip(text)
    by_list = F.when(body.isNull() & (listed != ""), F.from_json(listed, "array<double>"))
    by_number = F.when(body.isNull() & bare.rlike(r"^(?:\d|10)\z"), F.array(bare.cast("double")))
    return F.coalesce(let(repaired_json(body), of), by_list, by_number)
