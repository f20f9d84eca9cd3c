import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from loomwork.llm import filter_audit, queries, repair, sharding
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


# --- filter interaction audit


def brute_audit(docs, labels):
    """Every document through every order, one at a time."""
    first = {}
    for d, t, _ in docs:
        key = (d is not None, d or 0)
        first[t or ""] = min(first.get(t or "", key), key)
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    out = defaultdict(Counter)
    shapley = Counter()
    for d, t, lang in docs:
        t, part = t or "", lang or ""
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", t) if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": first[t] < (d is not None, d or 0),
        }
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for i, f in enumerate(order, 1):
                c = out[part, order, i]
                c["redundant"] += gone and fails[f]
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                if fails[f] and not gone:
                    gone = True
                    shapley[part, f] += 1
                    c["removed"] += 1
                    c["good_lost"] += d in good and d is not None
                    c["toxic_lost"] += d in toxic and d is not None
                c["kept"] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(*k, *(c[n] for n in names), shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_odd_rows_equals_brute_force(spark, odd):
    rows = [(1, 1, 0), (1, 0, 1), (5, 1, None), (6, None, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(odd, labels)
    assert {tuple(r) for r in got.select(AUDIT).collect()} == brute_audit([r[:3] for r in ODD], rows)
    assert got.count() == 120 * 5 * len({r[2] or "" for r in ODD})


def test_audit_of_marks_capitals_and_copies(spark):
    text = "ABC " * 10 + "word " * 300
    docs = [(3, text, "en"), (1, text, "fr"), (2, text + "#", "en"), (4, text, "en"), (1, text, "fr"), (5, "ÉÉ caps", None), (8, "A$", "")]
    labels = [(4, 1, 0), (2, 0, 1)]
    got = filter_audit.audit(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert {tuple(r) for r in got.select(AUDIT).collect()} == brute_audit(docs, labels)


def test_audit_of_nothing(spark, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(empty, labels).count() == 0


# --- sharding


def check_shards(out, docs, shards):
    counts = Counter(r["shard"] for r in out)
    assert len(out) == len(docs) and all(0 <= s < shards for s in counts)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    key = lambda d: (d is None, d)
    want = sorted((key(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((key(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == want
    return counts


def spread(spark, rows, shards):
    """Shards of (id, text) rows, and each text's number of shards."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = sharding.sharded(docs, shards).collect()
    check_shards(out, rows, shards)
    texts = {d: t or "" for d, t in rows}
    found = defaultdict(set)
    for r in out:
        found[texts[r["doc_id"]]].add(r["shard"])
    return {t: len(s) for t, s in found.items()}


def test_groups_stay_whole_where_they_fit(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for g in range(60):
        for _ in range(rng.choice([2, 2, 3, 5, 9])):
            rows.append((n, f"copy {g}"))
            n += 1
    rows += [(n + i, f"single {i}") for i in range(200)]
    rng.shuffle(rows)
    assert set(spread(spark, rows, 24).values()) == {1}


def test_giant_groups_take_as_few_shards_as_can_hold_them(spark):
    rows = [(i, "giant") for i in range(400)] + [(1000 + i, f"pair {i // 2}") for i in range(600)]
    found = spread(spark, rows, 24)  # 41 or 42 rows a shard
    assert found.pop("giant") == 10
    assert sum(n > 1 for n in found.values()) <= 24


def test_all_linked_and_tight(spark):
    found = spread(spark, [(i, f"t{i // 7}") for i in range(7 * 24)], 24)
    assert set(found.values()) == {1}
    found = spread(spark, [(i, f"t{i // 5}") for i in range(5 * 24 * 2 - 3)], 24)  # 9 or 10 rows a shard, fives: few cuts
    assert sum(n > 1 for n in found.values()) <= 24


@pytest.mark.parametrize("n", [1, 5, 23, 24, 25])
def test_fewer_rows_than_shards(spark, n):
    spread(spark, [(i, "same") for i in range(n)], 24)


def test_shards_of_odd_rows(spark, odd, empty):
    out = sharding.sharded(odd).collect()
    check_shards(out, [r[:2] for r in ODD], 24)
    assert {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}
    assert sharding.sharded(empty).count() == 0
    copies = sharding.sharded(odd.filter("doc_id is null").unionByName(odd).unionByName(odd), 3).collect()
    check_shards(copies, [r[:2] for r in ODD] * 2 + [ODD[7][:2]], 3)


def test_shards_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    out = queries.op12_sharding(spark, SF).collect()
    check_shards(out, rows, 24)
    again = queries.op12_sharding(spark, SF).collect()
    assert sorted(out) == sorted(again)
    texts = dict(rows)
    groups = defaultdict(list)
    for r in out:
        groups[texts[r["doc_id"]]].append(r["shard"])
    assert all(len(set(s)) == 1 for s in groups.values() if len(s) <= len(rows) // 24)


# --- conversation repair


def brute_repair(turns):
    """Least (cost, audit) by trying all edits with at most two inserts between turns; turns: (initial, must_go, truncated)."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    states = {"": [(0, "")]}

    def inserted(all_):
        out = {s: list(v) for s, v in all_.items()}
        step = all_
        for _ in range(2):
            new = defaultdict(list)
            for s, v in step.items():
                new["a" if s == "u" else "u"] += [(c + 2, a + "I") for c, a in v]
            for s, v in new.items():
                out.setdefault(s, []).extend(v)
            step = new
        return out

    states = inserted(states)
    for first, must_go, cut in turns:
        new = defaultdict(list)
        for s, v in states.items():
            new[s] += [(c + 3, a + "D") for c, a in v]
            if not must_go:
                if first in follows[s] and first:
                    new[first] += [(c + cut, a + "K") for c, a in v]
                for to in "ua":
                    if to in follows[s]:
                        new[to] += [(c + 2 + cut, a + "R") for c, a in v]
        states = inserted(new)
    return min(states[""] + states["a"])


def replay(turns, audit):
    """Repaired ``role:text`` lines of (role, text) turns."""
    out, i, last = [], 0, ""
    for e in audit:
        role, text = ("", "") if e == "I" else turns[i]
        i += e != "I"
        if e == "D":
            continue
        if e != "K":
            role = "assistant" if last == "u" else "user"
        last = role[:1]
        out.append(f"{role}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in out)) and i == len(turns)
    return "\n".join(out)


def test_repairs_equal_all_edits_tried():
    rng = random.Random(11)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "system", "tool", " ", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(5))]
        fold = repair.Repair()
        texts = [(r, f"t{i}") for i, (r, _, _) in enumerate(turns)]
        for (role, text), (_, go, cut) in zip(texts, turns):
            fold.add(role, text, go, cut)
        cost, audit, digest = fold.finish()
        assert (cost, audit) == brute_repair([(r[:1], g, c) for r, g, c in turns])
        assert digest == hashlib.sha256(replay(texts, audit).encode()).hexdigest()


def test_a_long_conversation_is_a_stream(monkeypatch):
    rng = random.Random(5)
    turns = [(rng.choice(["user", "assistant", "system"]), f"t{i}", rng.random() < 0.1, rng.random() < 0.1) for i in range(6000)]
    fold, most = repair.Repair(), 0
    for t in turns:
        fold.add(*t)
        most = max(most, len(fold.waiting))
    assert most < 1000
    found = fold.finish()
    monkeypatch.setattr(repair, "SETTLE", 1 << 30)
    whole = repair.Repair()
    for t in turns:
        whole.add(*t)
    assert found == whole.finish()
    assert found[2] == hashlib.sha256(replay([t[:2] for t in turns], found[1]).encode()).hexdigest()


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, fault string, copy int"


def brute_report(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        by[conv] += []
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        by[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = set()
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, n, edits = set(), Counter(), []
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            n[fault] += 1
            edits.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(edits, edits[1:]))
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        fold = repair.Repair()
        for (_, role, text), (_, go, cut) in zip(turns, edits):
            fold.add(role, text, go, cut)
        cost, audit, _ = fold.finish()
        digest = hashlib.sha256(replay([t[1:] for t in turns], audit).encode()).hexdigest()
        out.add((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest))
    return out


def test_report_of_odd_conversations(spark):
    rng = random.Random(8)
    rows = [(c, rng.choice([None, 0, 1, 1, 2, 5, 9, 14]), rng.choice(["user", "assistant", "system", None, ""]), rng.choice(["Hi.", "hm", None, "", " \t\x0b", "Ünd?! \n", "no ", "x" * 5000])) for c in [None, -3, *range(40)] for _ in range(rng.randrange(1, 9))]
    given = spark.createDataFrame([(*r, "x", 7) for r in rows], CONVERSATIONS)
    got = repair.repaired(repair.damaged(given))
    assert [f.strip() for f in repair.REPORT.split(",")] == [f"{f.name} {f.dataType.simpleString()}" for f in got.schema]
    assert {tuple(r) for r in got.collect()} == brute_report(rows)


def test_conversations_that_damage_takes_away(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    given = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string")
    assert [tuple(r) for r in repair.repaired(repair.damaged(given)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repaired(repair.damaged(given.limit(0))).count() == 0


def test_one_huge_conversation(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"text {i % 700}.") for i in range(5000)]
    given = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert {tuple(r) for r in repair.repaired(repair.damaged(given)).collect()} == brute_report(rows)
