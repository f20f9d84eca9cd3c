"""Chat formatting by prefix-target expansion, with a reversible template and a loss mask.

Every assistant turn becomes an example of its own: all turns up to it as
context, and only that reply trainable.  Turns after the last reply (or all
turns of a conversation without one) become a last example without a target, so
the output holds every turn.

The template is ``<turn role="R">TEXT</turn>`` and a line feed per turn.  Inside
R and TEXT a backslash is written as two, and ``<``, ``>``, ``"`` as a backslash
and l, g, q; so no text can hold a mark of the template, and every text can be
read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The escapes, in the order that they are applied.
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), (">", "\\g"), ('"', "\\q"))
_BACK = {b[1]: a for a, b in ESCAPES}
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r'<turn role="([^"<>]*)">([^<>]*)</turn>\n')


def escaped(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, last, text, loss_start, loss_end) with spans in code points, end exclusive.

    ``last`` marks the example that holds all turns.
    Turns stand in order of (turn, role, text), nulls first; null roles and texts
    count as empty.  ``loss_start`` and ``loss_end`` are null in the last example
    if it has no target.  Repeated rows are turns of their own; null conv_ids are
    one conversation; columns beside these four aren't read.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit('<turn role="'), escaped(t["role"]), F.lit('">'))
    written = lambda t: F.concat(head(t), escaped(t["text"]), F.lit("</turn>\n"))
    parts = turns.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == "assistant").alias("target"),
                F.char_length(head(t)).alias("head"),
                F.char_length(escaped(t["text"])).alias("body"),
                written(t).alias("written"),
            ),
        ).alias("parts"),
    )
    numbered = F.transform("parts", lambda p, i: F.struct(F.when(p["target"], i).alias("i"), p["target"].alias("target")))
    targets = F.transform(F.filter(numbered, lambda p: p["target"]), lambda p: p["i"])
    rest = F.when(F.get("parts", F.size("parts") - 1)["target"], F.array().cast("array<int>")).otherwise(F.array(F.lit(None).cast("int")))
    exploded = parts.withColumn("ends", F.concat(targets, rest)).select("conv_id", "parts", F.size("ends").alias("n"), F.posexplode("ends").alias("example", "at"))
    upto = F.when(F.col("at").isNull(), F.size("parts")).otherwise(F.col("at") + 1)
    texts = exploded.withColumn("shown", F.slice("parts", F.lit(1), upto)).select(
        "conv_id",
        "example",
        (F.col("example") == F.col("n") - 1).alias("last"),
        F.array_join(F.transform("shown", lambda p: p["written"]), "").alias("text"),
        F.when(F.col("at").isNotNull(), F.get("parts", "at")).alias("goal"),
    )
    end = F.char_length("text") - len("</turn>\n")
    return texts.select(
        "conv_id",
        "example",
        "last",
        "text",
        F.when(F.col("goal").isNotNull(), end - F.col("goal.body")).cast("long").alias("loss_start"),
        F.when(F.col("goal").isNotNull(), end).cast("long").alias("loss_end"),
    )


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; anything beside turns is an error."""
    found, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        found.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return found


def digests(formatted: DataFrame) -> DataFrame:
    """What :func:`examples` wrote, read back: one row per conversation.

    Every example is read by itself; only its reply, and of the last one, which
    has all turns, their digest, meet in the conversation's row.  An example that
    isn't made of turns is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, texts, starts, ends = (batch.column(c).to_pylist() for c in ("last", "text", "loss_start", "loss_end"))
            turns = [read_turns(t) for t in texts]
            whole = ["".join(f"{r}\n{t}\n" for r, t in own) if is_last else None for own, is_last in zip(turns, last)]
            cols = {
                "conv_id": batch.column("conv_id"),
                "example": batch.column("example"),
                "n_turns": pa.array(map(len, turns), pa.int64()),
                "turns_sha256": pa.array([None if w is None else hashlib.sha256(w.encode()).hexdigest() for w in whole], pa.string()),
                "loss": pa.array([None if a is None else unescaped(t[a:b]) for t, a, b in zip(texts, starts, ends)], pa.string()),
                "chars": pa.array(map(len, texts), pa.int64()),
            }
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    schema = "conv_id bigint, example int, n_turns bigint, turns_sha256 string, loss string, chars bigint"
    found = formatted.select(F.col("conv_id").cast("bigint").alias("conv_id"), "example", "last", "text", "loss_start", "loss_end").mapInArrow(read, schema)
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda e: F.coalesce(e["loss"], F.lit(""))), "")
    return found.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.coalesce(F.sum(F.char_length("loss")), F.lit(0)).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )


#: The same digests in SQL, over the registered table ``conversations`` and conversation -7.
DIGESTS_SQL = r"""WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
 length(role) + length(text) + length('<turn role=""></turn>') + 1 + length(regexp_replace(role || text, '[^\\<>"]', '', 'g')) AS chars FROM given),
u AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
 (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant' OR i = n) AS n_examples FROM u GROUP BY conv_id"""
