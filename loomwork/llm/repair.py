"""Conversation structure repair: the cheapest edits that make the roles of a conversation follow a grammar.

Role initials must read ``(s?(ua)+)?``: nothing, or an optional system turn and
pairs of user and assistant.  A forward Viterbi pass over the four states of
that grammar (nothing yet, system, user, assistant) carries the least
(cost, audit string) of each state: Keep 0, Rerole to user or assistant 2,
Delete 3 (the only edit of a blank or repeated turn), and after each turn's
layer at most two Inserts of an empty user or assistant turn, 2 each.  An
undeleted turn whose text breaks off adds 1.  Audits are the edits' initials;
equal costs go to the ASCII-least audit.  Two audits of one state and layer with
equal costs have as many turns and inserts, so none is a prefix of the other and
comparing them early is safe.

Order: by turn, nulls first; equal turns by role, text.  A null conv_id is a
conversation of its own; null roles and texts are one space.  Repeated rows are
turns of their own.  Columns beside conv_id, turn, role and text aren't read.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: The role initial that must come after each state; a system turn may also come first.
FOLLOWS = {"": "u", "s": "u", "u": "a", "a": "u"}
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Turns between two looks for edits that all states agree on.
SETTLE = 64

REPORT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
)


@dataclass
class Repair:
    """The pass over one conversation's turns, in order.

    Edits that the audits of all states begin with are final: their turns are
    handed on and forgotten, so a conversation of any length is a stream that
    holds the turns since then.
    """

    live: dict = field(default_factory=dict)
    waiting: deque = field(default_factory=deque)
    settled: list = field(default_factory=list)
    role: str = ""
    digest: object = None
    cost: int = 0

    def __post_init__(self) -> None:
        self.live = self._closed({"": (0, "")})
        self.digest, self._first = hashlib.sha256(), True

    @staticmethod
    def _closed(layer: dict) -> dict:
        """The layer after up to two inserts, without states that can't be on a cheapest path."""
        for _ in range(2):
            for state, (cost, audit) in list(layer.items()):
                to, more = FOLLOWS[state], (cost + INSERT, audit + "I")
                if to not in layer or more < layer[to]:
                    layer[to] = more
        # what may follow a system turn may follow an assistant, and a conversation not begun can only save the Delete of a system turn
        least = layer["a"][0]
        for state, saved in (("s", 0), ("", DELETE)):
            if state in layer and layer[state][0] > least + saved:
                del layer[state]
        return layer

    def add(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        layer: dict = {}

        def reach(state: str, cost: int, audit: str) -> None:
            if state not in layer or (cost, audit) < layer[state]:
                layer[state] = (cost, audit)

        first, extra = role[:1], TRUNCATED if truncated else 0
        for state, (cost, audit) in self.live.items():
            reach(state, cost + DELETE, audit + "D")
            if not must_go:
                to = FOLLOWS[state]
                reach(to, cost + REROLE + extra, audit + "R")
                if first == to or (first == "s" and state == ""):
                    reach(first, cost + KEEP + extra, audit + "K")
        self.live = self._closed(layer)
        self.waiting.append((role, text))
        if len(self.waiting) >= SETTLE:
            self._settle(commonprefix([audit for _, audit in self.live.values()]))

    def _settle(self, edits: str) -> None:
        for edit in edits:
            role, text = ("", "") if edit == "I" else self.waiting.popleft()
            if edit == "D":
                continue
            if edit != "K":
                role = ROLES[FOLLOWS[self.role]]
            self.role = role[:1]
            self.digest.update(f"{'' if self._first else chr(10)}{role}:{text}".encode())
            self._first = False
        self.settled.append(edits)
        self.live = {s: (cost, audit[len(edits) :]) for s, (cost, audit) in self.live.items()}

    def finish(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of the repaired turns); call it once, after the last turn."""
        cost, audit = min(self.live[state] for state in ("", "a") if state in self.live)
        self._settle(audit)
        return cost, "".join(self.settled), self.digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by crc32 of ``conv_id:turn``; a row that is dropped stays as a mark of its conversation.

    (conv_id, turn, role, text, copy, dropped); nulls in the key, roles and texts are one space.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), name("role").alias("role"), name("text").alias("text"), kind.alias("kind")
    )
    copies = F.sequence(F.lit(0), F.when(F.col("kind") == 3, F.lit(1)).otherwise(F.lit(0)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 0, F.lit("")).otherwise(text).alias("text"),
        F.explode(copies).alias("copy"),
        (F.col("kind") == 0).alias("dropped"),
    )


def fault(text: Column, repeats: Column) -> Column:
    """A turn's first fault: blank, duplicate, truncated, or null."""
    bare = F.rtrim(text, F.lit(WHITE_SPACE))
    return F.when(bare == "", "blank").when(repeats, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, copy, dropped): its faults, gaps and cheapest repair.

    Rows are dealt by conversation once; which role and text came before is a
    window in the same partitioning, which spills to disk, and the Viterbi pass
    reads the sorted rows as a stream.  The result holds one SHA-256 over a whole
    conversation, which has no parallel form, so a conversation is read by one
    task, but never held by it.
    """
    seen = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.asc_nulls_first("turn"), "copy")
    dealt = rows.repartition("conv_id").withColumn("fault", fault(F.col("text"), F.row_number().over(seen) > 1))
    ordered = dealt.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = None
        for batch in batches:
            done = []
            for conv, turn, role, text, dropped, wrong in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if fold is None or fold.conv != conv:
                    if fold is not None:
                        done.append(fold.row())
                    fold = _Conversation(conv)
                if not dropped:
                    fold.add(turn, role, text, wrong)
            yield _batch(done)
        if fold is not None:
            yield _batch([fold.row()])

    return ordered.select("conv_id", "turn", "role", "text", "dropped", "fault").mapInArrow(run, REPORT)


class _Conversation:
    """Counts of one conversation beside its repair."""

    def __init__(self, conv):
        self.conv, self.repair = conv, Repair()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.turn = self.initial = None
        self.turns = self.illegal = 0

    def add(self, turn, role: str, text: str, wrong: str | None) -> None:
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if wrong:
            self.faults[wrong] += 1
        self.repair.add(role, text, wrong in ("blank", "duplicate"), wrong == "truncated")

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.turns
        cost, audit, digest = self.repair.finish()
        return (self.conv, gaps, *self.faults.values(), self.illegal, cost, audit, digest)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in REPORT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _plus(state: str, cost: int | str, edit: str) -> str:
    """SQL of a state after one more edit: a state is its cost in ten digits and its audit, so texts compare as (cost, audit)."""
    return f"(lpad((left({state}, 10)::INTEGER + {cost})::VARCHAR, 10, '0') || substr({state}, 11) || '{edit}')"


def _repair_sql() -> str:
    back = "least(z, s, a)"
    keep = lambda state, initial: f"CASE WHEN NOT must_go AND initial = '{initial}' THEN {_plus(state, 'extra', 'K')} END"
    rerole = lambda state: f"CASE WHEN NOT must_go THEN {_plus(state, '2 + extra', 'R')} END"
    z1, s1 = _plus("z", 3, "D"), f"least({_plus('s', 3, 'D')}, {keep('z', 's')})"
    u1 = f"least({_plus('u', 3, 'D')}, {keep(back, 'u')}, {rerole(back)})"
    a1 = f"least({_plus('a', 3, 'D')}, {keep('u', 'a')}, {rerole('u')})"
    return rf"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
 [ascii(x) for x in string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')] AS bytes FROM conversations),
k AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295::BIGINT], bytes),
 lambda c, b: list_reduce(list_concat([xor(c, b::BIGINT)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS kind FROM c),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
 CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
 row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM d),
f AS (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM n),
r AS (SELECT *, fault IN ('blank', 'duplicate') AS must_go, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS extra,
 lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM f),
v AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '0000000000' AS z, NULL::VARCHAR AS s, '0000000002I' AS u, '0000000004II' AS a FROM conversations
 UNION ALL SELECT conv_id, i, z, s, u2, least(a1, {_plus('u2', 2, 'I')}) FROM (SELECT *, least(u1, {_plus('least(z, s, a1)', 2, 'I')}) AS u2 FROM (
  SELECT v.conv_id, r.i, {z1} AS z, {s1} AS s, {u1} AS u1, {a1} AS a1 FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i + 1))),
b AS (SELECT conv_id, arg_max(least(z, a), i) AS best FROM v GROUP BY conv_id),
e AS (SELECT conv_id, left(best, 10)::BIGINT AS cost, substr(best, 11) AS audit FROM b),
l AS (SELECT conv_id, p, audit[p] AS edit FROM e, unnest(range(1, length(audit) + 1)) t(p)),
m AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS place FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
t AS (SELECT m.*, r.role, r.text, r.initial, coalesce(bool_or(edit = 'K' AND place = 1 AND initial = 's') OVER (PARTITION BY m.conv_id), false) AS headed
 FROM m LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.i = m.i),
o AS (SELECT conv_id, string_agg((CASE WHEN edit = 'K' THEN role WHEN (place - headed::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS whole
 FROM t WHERE edit <> 'D' GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
 count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM e.conv_id"""


#: Damage and repair in SQL, over the registered table ``conversations``.
REPAIR_SQL = _repair_sql()
