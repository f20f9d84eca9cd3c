import numpy as np

from loomwork.llm import decontamination
from tests.llm.test_text_operators import brute_leaks


def items(count):
    rng = np.random.default_rng(8)
    return [(i, " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(18))) for i in range(count)]


def found(rows, bench):
    group = decontamination.Items([i for i, _ in bench], [decontamination.normalised(t) for _, t in bench])
    return {d for d, t in rows if group.regions(decontamination.normalised(t))}


def test_alignment_before_the_text():
    bench = [(0, items(1)[0][1][:100].strip())]
    t = bench[0][1]
    rows = [(0, t[:50] + t[56:] + " more text"), (1, t[6:] + " and more"), (2, t[:20] + t[26:]), (3, "x " + t[5:])]
    assert found(rows, bench) == {0, 1, 2, 3} == {d for d, _, _ in brute_leaks(rows, bench)}


def test_edited_items_at_both_ends_against_brute_force():
    rng, bench = np.random.default_rng(6), items(4)
    rows = []
    for _, t in bench:
        for k in range(1, 14):
            for place in range(4):
                at = int(rng.integers(0, len(t) - k))
                cut = t[:at] + t[at + k :] if place % 2 else t[k:]
                rows.append((len(rows), cut + " and then more of it" if place < 2 else "before it " + cut))
    got = found(rows, bench)
    assert got == {d for d, _, _ in brute_leaks(rows, bench)}
    assert 0 < len(got) < len(rows)


def test_kept_ids_of_a_small_fixture_against_brute_force(spark):
    rng, bench = np.random.default_rng(7), items(3)
    docs = [(r["doc_id"], r["text"][:600]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 30").collect()]
    for n, (_, t) in enumerate(bench * 10):
        letters = list(t)
        for i in rng.choice(len(letters), 2 * (n // 3), replace=False):
            letters[i] = ("", "x", letters[i] + "y")[int(rng.integers(0, 3))]
        docs.append((1000 + n, "".join(letters) + docs[n % 20][1][:200] if n % 2 else docs[n % 20][1][:200] + " " + "".join(letters)))
    given = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r["doc_id"] for r in decontamination.keep_uncontaminated(given, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _, _ in brute_leaks(docs, bench)}
    assert 30 < len(kept) < len(docs)


def test_all_places_of_a_short_item():
    group = decontamination.Items([0], [b"ab cd"])
    assert group.regions(b"ab cd ab cd x ab cde ab cd") == [(0, 0, 5, 0), (0, 6, 11, 0), (0, 21, 26, 0)]
    assert decontamination.Items([0], [b"a"]).regions(b"a a ba a") == [(0, 0, 1, 0), (0, 2, 3, 0), (0, 7, 8, 0)]


def test_starts_of_edited_places_are_traced():
    t = decontamination.normalised(items(1)[0][1][:120])
    group = decontamination.Items([0], [t])
    for middle in (t[:50] + t[54:], t[:50] + b"xyzw" + t[50:], t[:30] + t[33:80] + b"qq" + t[80:]):
        text = b"some words before " + middle + b" and after it"
        ((_, start, end, edits),) = group.regions(text)
        assert text[start:end] == middle and 0 < edits <= decontamination.budget(len(t))[0]


def test_grams_that_text_and_item_repeat(monkeypatch):
    group = decontamination.Items([0], [b"a" * 60])
    want = group.regions(b"a" * 900)
    monkeypatch.setattr(decontamination, "HITS", 500)
    assert group.regions(b"a" * 900) == want and len(want) > 10


def test_passes_are_collected_one_by_one(spark, monkeypatch):
    bench = spark.createDataFrame(items(6), "item_id long, text string")
    docs = spark.createDataFrame([(i, "before " + t + " after") for i, t in items(6)] + [(9, "clean text")], "doc_id long, text string")
    once = sorted(tuple(r) for r in decontamination.leaks(docs, bench).collect())
    monkeypatch.setattr(decontamination, "PASS_BYTES", 200)
    assert len(list(decontamination.passes(bench))) > 2
    assert sorted(tuple(r) for r in decontamination.leaks(docs, bench).collect()) == once and len(once) == 6
    assert [r["doc_id"] for r in decontamination.keep_uncontaminated(docs, bench).collect()] == [9]
