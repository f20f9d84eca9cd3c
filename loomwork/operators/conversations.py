"""Conversations: roles, placeholders, question-answer pairs and chat-template segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.ordering import hashed

# The chat template and its image tokens.
SYSTEM = "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\n"
TURN = "<|im_end|>\n<|im_start|>assistant"
IMAGE_TOKENS = {"<vit_image>": "vit", "<dino_image>": "dino", "<vae_image>": "vae"}
RECONSTRUCT = "Reconstruct the 3D scene."


def last_pair(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, question, answer): the last user and the last assistant text."""
    by = lambda role: F.max_by("text", F.when(F.col("role") == role, F.col("turn")))
    return turns.groupBy(conv).agg(by("user").alias("question"), by("assistant").alias("answer"))


def first_pair(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, question, answer): the texts at positions 0 and 1."""
    w = Window.partitionBy(conv).orderBy("turn")
    placed = turns.withColumn("_p", F.row_number().over(w) - 1)
    at = lambda i: F.max(F.when(F.col("_p") == i, F.col("text")))
    return placed.filter("_p < 2").groupBy(conv).agg(at(0).alias("question"), at(1).alias("answer"))


def normalised(turns: DataFrame) -> DataFrame:
    """user and human become human, all else gpt; empty texts become null."""
    return turns.withColumn("speaker", F.when(F.col("role").isin("user", "human"), "human").otherwise("gpt")).withColumn("value", F.nullif("text", F.lit("")))


def with_placeholder(normal: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Puts ``<image>`` and a line feed before the first human turn of conversations without the placeholder."""
    w = Window.partitionBy(conv)
    has = F.max(F.coalesce(F.contains("value", F.lit("<image>")), F.lit(False)).cast("int")).over(w)
    first = F.row_number().over(w.orderBy(F.when(F.col("speaker") == "human", 0).otherwise(1), "turn")) == 1
    marked = normal.withColumn("_has", has).withColumn("_first", first & (F.col("speaker") == "human"))
    value = F.when((F.col("_has") == 0) & F.col("_first"), F.concat(F.lit("<image>\n"), F.coalesce("value", F.lit("")))).otherwise(F.col("value"))
    return marked.withColumn("value", value).drop("_has", "_first")


def normalised_list(conversation: Column) -> Column:
    """The same for an array of structs with from/value or role/content fields."""
    return F.transform(
        conversation,
        lambda t: F.struct(
            F.when(F.coalesce(t["from"], t["role"]).isin("user", "human"), "human").otherwise("gpt").alias("from"),
            F.nullif(F.coalesce(t["value"], t["content"]), F.lit("")).alias("value"),
        ),
    )


def template_segments(question: Column, answer: Column, task: str | None = None) -> Column:
    """Ordered (type, loss, value) segments of the chat template: text between image tokens, the answer alone with loss."""
    asked = F.concat(F.lit(RECONSTRUCT), question) if task == "geo" else question
    marks = "|".join(IMAGE_TOKENS)
    cut = F.split(F.regexp_replace(asked, f"({marks})", "\u0001$1\u0001"), "\u0001")
    kind = F.lit("text")
    seg = lambda t, k, loss: F.struct(k.alias("type"), F.lit(loss).alias("loss"), t.alias("value"))

    def one(p: Column) -> Column:
        k = kind
        for token, name in IMAGE_TOKENS.items():
            k = F.when(p == token, F.lit(name)).otherwise(k)
        return seg(p, k, False)

    parts = F.transform(F.filter(cut, lambda p: p != ""), one)
    head, turn = (F.array(seg(F.lit(t), kind, False)) for t in (SYSTEM, TURN))
    reply = F.array(seg(F.concat(F.lit("\n"), answer), kind, True))
    return F.concat(head, parts, turn, F.when(F.char_length(answer) > 0, reply).otherwise(F.slice(reply, 1, 0)))


def segments(pairs: DataFrame, key: str, question: str = "question", answer: str = "answer", task: str | None = None) -> DataFrame:
    """(key, pos, type, loss, value, start): one row a segment, with running character offsets."""
    texts = [F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))]
    out = pairs.select(key, F.posexplode(template_segments(*texts, task)).alias("pos", "s")).select(key, "pos", "s.*")
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("start", F.coalesce(F.sum(F.char_length("value")).over(before), F.lit(0)))


def two_passes(pairs: DataFrame, key: str, question: str = "question", answer: str = "answer") -> DataFrame:
    """Pass 1 asks for the reconstruction, pass 2 for the answer: (key, pass, pos, type, loss, value, role)."""
    q, a = F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))
    first, second = template_segments(F.lit("<dino_image>"), F.lit(""), "geo"), template_segments(q, a)
    both = pairs.select(key, F.explode(F.array(F.struct(F.lit(1).alias("pass"), first.alias("s")), F.struct(F.lit(2).alias("pass"), second.alias("s")))).alias("x"))
    out = both.select(key, "x.pass", F.posexplode("x.s").alias("pos", "s")).select(key, "pass", "pos", "s.*")
    role = F.when(F.col("loss"), "answer").when(F.col("type") != "text", "image").when(F.col("value") == SYSTEM, "system").otherwise("question")
    return out.withColumn("role", role)


def without_loss(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Conversations in which no turn is trainable."""
    return turns.groupBy(conv).agg(F.count_if(F.col("role") == "assistant").alias("n")).filter("n = 0").select(conv)


def placeholder_elements(text: Column, images: int) -> Column:
    """(type, value) elements of a text cut at ``<image>``; only the first ``images`` placeholders are image slots."""
    parts = F.split(text, "<image>")
    slot = lambda i: F.when((i > 0) & (i <= images), F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("value")))).otherwise(
        F.array().cast("array<struct<type:string,value:string>>")
    )
    text_of = lambda p: F.when(p != "", F.array(F.struct(F.lit("text").alias("type"), p.alias("value")))).otherwise(
        F.array().cast("array<struct<type:string,value:string>>")
    )
    return F.flatten(F.transform(parts, lambda p, i: F.concat(slot(i), text_of(p))))


def expanded_placeholder(text: Column, frames: Column) -> Column:
    """The first ``<image>`` (or ``<video>``) once per frame; before the text if there is none."""
    plain = F.replace(text, F.lit("<video>"), F.lit("<image>"))
    at = F.instr(plain, "<image>")
    many = F.repeat(F.lit("<image>"), frames.cast("int"))
    inside = F.concat(F.substring(plain, F.lit(1), at - 1), many, F.substring(plain, at + 7, F.char_length(plain)))
    return F.when(at > 0, inside).otherwise(F.concat(many, F.lit("\n"), plain))


def placeholders_match(text: Column, images: Column) -> Column:
    return F.regexp_count(text, F.lit("<image>")) == F.size(images)


def lettered(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char(65 + i), F.lit(". "), o)), "\n")


def prompt(system: str, form: str, question: Column, options: Column) -> Column:
    return F.concat_ws("\n", F.lit(system), F.lit(form), question, lettered(options))


def two_options(text: Column) -> Column:
    """The texts of ``(a) x (b) y``."""
    parts = F.split(text, r"\(b\)")
    return F.array(F.trim(F.replace(F.get(parts, F.lit(0)), F.lit("(a)"), F.lit(""))), F.trim(F.get(parts, F.lit(1))))


def edit_window(images: Column, steps: Column, key: Column, most: int = 3) -> Column:
    """A hashed run of an edit chain: (start, end, instruction), at most ``most`` steps, instructions joined."""
    n = F.size(images)
    start = (hashed(key, F.lit("start")) % F.greatest(n - 1, F.lit(1))).cast("int")
    room = F.least(F.lit(most), n - 1 - start)
    end = start + 1 + (hashed(key, F.lit("end")) % F.greatest(room, F.lit(1))).cast("int")
    said = F.transform(F.slice(steps, start + 1, end - start), lambda s: F.get(s, (hashed(key, F.array_join(s, "|")) % F.size(s)).cast("int")))
    return F.struct(start.alias("start"), end.alias("end"), F.array_join(said, ". ").alias("instruction"))
