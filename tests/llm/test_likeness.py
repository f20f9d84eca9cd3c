import numpy as np

from loomwork.llm import likeness, simhash
from tests.llm.test_text_operators import SF1, brute_components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_firsts(rows):
    """The least id of each component of the 4-bit links and of the pairs at 0.8 or more."""
    parent = {d: c for d, (_, c) in brute_components(rows).items()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d for d in ids if find(d) == d}


def kept(spark, rows):
    return {r["doc_id"] for r in simhash.first_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def edited(words, places, mark):
    out = list(words)
    for p in places:
        out[p] = f"{mark}{p}"
    return " ".join(out)


def family(seed, n, likenesses):
    """A text of n words, and texts with spread words replaced so that their likeness to it is about as asked."""
    rng = np.random.default_rng(seed)
    words = [f"s{seed}w{x}" for x in rng.integers(0, 50_000, n)]
    out = [" ".join(words)]
    for v, j in enumerate(likenesses):
        lost = round((n - 4) * (1 - j) / (1 + j) / 5)
        out.append(edited(words, 4 + 5 * rng.choice(n // 5 - 1, lost, replace=False), f"v{seed}x{v}x"))
    return out


def likeness_of(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_every_pair_at_the_threshold_is_found(spark):
    rows = [(10 * s + i, t) for s in range(60) for i, t in enumerate(family(s, 400, [0.81 + 0.001 * s]))]
    assert all(0.8 <= likeness_of(rows[i][1], rows[i + 1][1]) < 0.9 for i in range(0, 120, 2))
    assert kept(spark, rows) == set(range(0, 600, 10)) == brute_firsts(rows)


def test_texts_under_the_threshold_stay(spark):
    """Texts that share a template; those within 4 bits of each other are left out."""
    rows = [(10 * s + i, t) for s in range(60) for i, t in enumerate(family(100 + s, 400, [0.7 + 0.0015 * s]))]
    assert all(0.65 < likeness_of(rows[i][1], rows[i + 1][1]) < 0.8 for i in range(0, 120, 2))
    want = brute_firsts(rows)
    assert len(want) > 100 and kept(spark, rows) == want


def test_links_of_all_members_of_a_group_count(spark):
    rows = []
    for s in range(20):
        rng = np.random.default_rng(s)
        words = [f"s{s}w{x}" for x in rng.integers(0, 50_000, 400)]
        places = 4 + 5 * rng.permutation(78)
        a1, a2, b = (edited(words, places[:n], "x") for n in (0, 4, 11))
        assert likeness_of(a1, a2) > 0.9 and likeness_of(a2, b) > 0.8 > likeness_of(a1, b)
        rows += [(10 * s, a1), (10 * s + 1, a2), (10 * s + 2, b)]
    assert kept(spark, rows) == set(range(0, 200, 10)) == brute_firsts(rows)


def test_families_and_shared_passages_against_brute_force(spark):
    rng = np.random.default_rng(9)
    notice = " ".join(f"notice{i}" for i in range(40))
    rows = []
    for s in range(12):
        for t in family(200 + s, int(rng.integers(40, 300)) // 5 * 5, rng.uniform(0.6, 0.98, 8)):
            rows.append((len(rows), notice + " " + t if s % 2 else t))
    for n in range(4, 12):  # short texts
        rows += [(len(rows) + i, " ".join(f"k{j}" for j in range(n + i))) for i in range(2)]
    assert kept(spark, rows) == brute_firsts(rows)


def test_stage_on_a_fixture_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"] for r in simhash.first_of_each_group(docs).collect()} == brute_firsts(rows)


def test_prefixes_of_alike_sets_meet():
    rng = np.random.default_rng(4)
    none = (np.empty(0, np.uint64), np.empty(0, np.int64))
    for _ in range(2_000):
        shared, a, b = rng.integers(1, 60), rng.integers(0, 12), rng.integers(0, 12)
        x = np.unique(rng.integers(0, 1 << 63, shared + a + b, dtype=np.uint64))
        order = rng.permutation(len(x))
        one, two = np.sort(x[order[: shared + a]]), np.sort(x[np.r_[order[:shared], order[shared + a :]]])
        some = np.sort(x[order[: shared // 2]])
        if likeness.alike(shared, len(one), len(two)):
            for known in (none, (some, rng.integers(3, 9, len(some)))):
                assert set(likeness.prefix(one, *known)) & set(likeness.prefix(two, *known))
    assert [likeness.prefix_size(n) for n in (0, 1, 4, 5, 10)] == [0, 1, 1, 2, 3]


def test_columns_of_any_name_pass_through(spark):
    rows = [(1, "a b c d e f g", "p", 1, 2.0, "x", 5), (2, "a b c d e f g", "q", 1, 2.0, "x", 5), (3, None, "r", 1, 2.0, "x", 5), (None, "other words here", "s", 1, 2.0, None, 5), (4, "z", "t", 0, 0.0, "y", 6), (4, "y", "u", 0, 0.0, "y", 6), (4, None, "v", 0, 0.0, "y", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, i string, _n int, node double, id string, component long")
    found = simhash.first_of_each_group(docs)
    assert found.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["i"]) for r in found.collect()) == [(0, "s"), (1, "p"), (3, "r")]


def test_blocks_of_a_long_list_meet_once(spark):
    rng = np.random.default_rng(11)
    sets = [np.sort(rng.choice(400, 60, replace=False)) for _ in range(30)]
    for s in list(sets):
        sets += [np.unique(np.r_[s[:-k], rng.integers(1_000, 9_000, k)]) for k in (2, 5, 9)]
    rows = []
    for rep, s in enumerate(sets):
        rows += [(int(k), rep, len(s), at, rep) for at, k in enumerate(s[: likeness.prefix_size(len(s))])]
    lists = spark.createDataFrame(rows, "key long, rep long, n int, at int, c long")
    parts = [{tuple(r) for r in likeness.meeting(lists, most).collect()} for most in (4_096, 7)]
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if likeness.alike(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    assert parts[0] == parts[1] and alike <= parts[0] and len(alike) > 50
    best = {tuple(r) for r in likeness.meeting(lists, best=True).collect()}
    assert best <= parts[0] and {i for p in best for i in p} == {i for p in parts[0] for i in p}
    first = [{int(k): len(s) - at for at, k in enumerate(s[: likeness.prefix_size(len(s))])} for s in sets]  # what a set has left from there
    may = lambda i, j: any(9 * min(first[i][k], first[j][k]) >= 4 * (len(sets[i]) + len(sets[j])) for k in first[i].keys() & first[j].keys())
    assert parts[0] == {(i, j) for j in range(len(sets)) for i in range(j) if may(i, j)}


def test_sketches_never_rule_out_alike_sets():
    rng = np.random.default_rng(9)
    ruled_out = 0
    for _ in range(3000):
        n = int(rng.choice([1, 2, 5, 31, 33, 63, 65, 200, 900, 3000]))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        keep = rng.random(n) < rng.choice([0.2, 0.6, 0.85, 0.9, 0.95, 1.0])
        b = np.r_[a[keep], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 3)), dtype=np.uint64)]
        if not len(b):
            continue
        a, b = np.unique(a), np.unique(b)
        is_alike = likeness.alike(len(np.intersect1d(a, b)), len(a), len(b))
        possible = likeness.may_be_alike(likeness.sketch(a), likeness.sketch(b), len(a) + len(b))
        assert possible or not is_alike
        ruled_out += not possible
    assert ruled_out > 1000
    big = np.unique(rng.integers(0, 1 << 63, 150_000, dtype=np.uint64))
    assert len(likeness.sketch(big)) == likeness.SKETCH_BITS // 8 and likeness.may_be_alike(likeness.sketch(big), likeness.sketch(big[100:]), 2 * len(big) - 100)
