import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwork.llm import components, decontamination, fingerprints, labelled, packing, quality, simhash, toxicity
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"
SF1 = "/root/testdata/sf0.01"


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- fingerprints


def xx(*values, seed=42):
    """xxhash64 of longs or texts as Spark chains it."""
    for v in values:
        data = v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def int_hash(j, t):
    seed = 42
    for v in (j, t):
        seed = _xx_int(v, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def _xx_int(v, seed):
    return xxhash.xxh64_intdigest(int(v).to_bytes(4, "little", signed=True), seed)


def brute_fingerprint(text):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]
    if not words:
        return ""
    h = [xx(w) for w in words]
    k = fingerprints.WORDS
    shingles = [xx(*h[i : i + k]) for i in range(max(1, len(h) - k + 1))]
    bins = {}
    for s in shingles:
        b = (s >> (64 - fingerprints.BIN_BITS)) + fingerprints.BINS // 2
        bins[b] = min(s, bins.get(b, s))
    out = []
    for j in range(fingerprints.BINS):
        v = bins.get(j)
        if v is None:
            probes = (int_hash(j, t) % fingerprints.BINS for t in range(sum(fingerprints.PROBES)))
            v = next((bins[p] for p in probes if p in bins), bins[min(bins)])
        out.append(f"{v & ((1 << fingerprints.BITS) - 1):x}")
    return "".join(out)


def brute_report(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for at, (doc, text) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        out.append((doc, text, edited, following))
    return out


def test_fingerprints_against_brute_force(spark, odd, empty):
    import hashlib

    for df in (odd, documents(spark).filter("doc_id < 40")):
        rows = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
        got = sorted(tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")) if r["doc_id"] is not None else (-1, *list(r)[1:5]) for r in fingerprints.fingerprint_report(df).collect())
        want = sorted((-1 if d is None else d, len(t), hashlib.sha256(e.encode()).hexdigest(), brute_fingerprint(t), brute_fingerprint(e)) for d, t, e, _ in brute_report(rows))
        assert got == want
    assert fingerprints.fingerprint_report(empty).count() == 0


def test_next_row_over_many_ranges(spark):
    ids = [x * x - 500 for x in range(200)] + [10**12]
    df = spark.createDataFrame([(i, f"t{i}", 0) for i in ids], "doc_id long, text string, k int")
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(df, "doc_id", "text", ["text"], rows_per_range=3).collect()}
    assert got == {i: f"t{j}" for i, j in zip(ids, [*ids[1:], ids[0]])}


def test_likeness_follows_jaccard(spark):
    words = [f"w{i}" for i in range(600)]
    rows = [(i, " ".join(words[: 600 - 60 * i] + [f"x{i}-{j}" for j in range(60 * i)])) for i in range(10)]
    df = spark.createDataFrame(rows, "i int, text string").select("i", fingerprints.fingerprint(__import__("pyspark.sql.functions", fromlist=["x"]).col("text")).alias("f"))
    prints = {r["i"]: r["f"] for r in df.collect()}
    pairs = spark.createDataFrame([(i, prints[0], f) for i, f in prints.items()], "i int, a string, b string")
    from pyspark.sql import functions as F

    for r in pairs.select("i", fingerprints.likeness(F.col("a"), F.col("b")).alias("s")).collect():
        kept = 600 - 60 * r["i"] - 4
        assert abs(r["s"] - kept / (2 * 596 - kept)) < 0.12


# --- SimHash


def brute_components(rows):
    prints = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (f"{f:016x}", find(d)) for d, f in prints.items()}


def test_simhash_against_brute_force(spark, odd, empty):
    for df, rows in ((odd.filter("doc_id is not null"), [r[:2] for r in ODD if r[0] is not None]), (documents(spark), None)):
        rows = rows or [(r["doc_id"], r["text"]) for r in df.collect()]
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.fingerprint_components(df).collect()}
        assert got == brute_components(rows)
    assert simhash.fingerprint_components(odd).count() == len(ODD)
    assert simhash.fingerprint_components(empty).count() == 0


def test_every_close_pair_shares_a_key():
    rng = np.random.default_rng(3)
    for _ in range(2_000):
        a = rng.integers(0, 1 << 63)
        flips = rng.choice(64, 4, replace=False)
        b = int(a) ^ sum(1 << int(f) for f in flips)
        same = {p for p in range(8) if (int(a) >> 8 * p & 255) == (b >> 8 * p & 255)}
        assert any(set(t) <= same for t in simhash.CONTRACT.triples)
    assert len(simhash.CONTRACT.triples) == 20


def test_long_lists_go_to_the_second_level(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 6)
    prints = sorted({int(b) ^ sum(1 << int(f) for f in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(120)})
    rows = [(i, p if p < 1 << 63 else p - (1 << 64)) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc_id long, f0 long")
    parts = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    for most in (simhash.LIST_ROWS, 8):
        index = simhash._index(df.withColumnRenamed("doc_id", "rep"), simhash.CONTRACT)
        first = simhash.keep(simhash._matches(index, simhash.CONTRACT, last=False, most=most), "t")
        long_lists = first.filter("key is not null").withColumnRenamed("a", "rep")
        assert (long_lists.count() > 0) == (most == 8)
        edges = first.filter("key is null").select("a", "b")
        if most == 8:
            edges = edges.unionByName(simhash._matches(simhash._deeper(long_lists, simhash.CONTRACT), simhash.CONTRACT, last=True).select("a", "b"))
        parts.append(sorted(tuple(r) for r in components.components(edges).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert parts[0] == parts[1]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 7), (500, 500)]
    got = dict((r["node"], r["component"]) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(200, 260)} == {3} and got[7] == 3 and 500 not in got


def test_first_of_each_group(spark, odd):
    kept = simhash.first_of_each_group(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect())
    assert ids == sorted([(False, 0), (True, 1), (True, 4), (True, 5), (True, 7), (True, 9)])
    rng = np.random.default_rng(1)
    rows = []
    for g in range(40):
        words = [f"g{g}w{i}" for i in rng.integers(0, 5_000, 300)]
        rows.append((10 * g, " ".join(words)))
        for c in range(1, 4):
            other = list(words)
            for i in rng.choice(300, c, replace=False):
                other[i] = f"new{g}-{c}-{i}"
            rows.append((10 * g + c, " ".join(other)))
    got = sorted(r["doc_id"] for r in simhash.first_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert set(range(0, 400, 10)) <= set(got) and len(got) <= 42


# --- decontamination


def brute_leaks(rows, items):
    found = set()
    for doc, text in rows:
        data = decontamination.normalised(text)
        for item, passage in items:
            p = decontamination.normalised(passage)
            if not p:
                continue
            e = decontamination.budget(len(p))[0] if len(p) >= decontamination.Q else 0
            row = list(range(len(p) + 1))  # edits of the passage's starts against any part that ends here
            best = row[-1]
            for c in data:
                new = [0]
                for i, x in enumerate(p, 1):
                    new.append(min(row[i - 1] + (x != c), row[i] + 1, new[-1] + 1))
                row = new
                best = min(best, row[-1])
            if len(p) < decontamination.Q:
                best = 0 if b" " + p + b" " in b" " + data + b" " else 1
            if best <= e:
                found.add((doc, item, best))
    return found


def test_leaks_against_brute_force(spark, odd, empty):
    rng = np.random.default_rng(2)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(4).collect()]
    items += [(100, "short one"), (101, ""), (102, None), (103, "Twelve bytes"), (104, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa")]
    rows = [r[:2] for r in ODD if r[0] is not None and r[0] != 7]
    for n, (_, t) in enumerate(items[:4]):
        for k in (0, 3, 8, 30):
            letters = list(t)
            for i in rng.choice(len(letters), k, replace=False):
                letters[i] = ("", "x", letters[i] + "y")[int(rng.integers(0, 3))]
            rows.append((1000 + 100 * n + k, "before it " + "".join(letters).upper() + "\n\nafter"))
        rows.append((2000 + n, t[: len(t) // 2]))
    rows += [(3000, "a short  one, here"), (3001, "ashort one"), (3002, "b" + "a" * 60), (3003, "a" * 20 + " b " + "a" * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontamination.leaks(docs, bench).collect()}
    want = brute_leaks(rows, items)
    least = lambda s: {(d, i): min(e for a, b, e in s if (a, b) == (d, i)) for d, i, _ in s}
    assert least(got) == least(want)
    clean = {r["doc_id"] for r in decontamination.keep_uncontaminated(docs, bench).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _, _ in want}
    assert decontamination.keep_uncontaminated(odd, bench).count() == len(ODD)
    assert decontamination.leaks(empty, bench).count() == 0
    assert decontamination.leaks(odd, bench.limit(0)).count() == 0


# --- packing


def brute_padding(lengths, k):
    tops = sorted(set(lengths))
    best = {0: 0}
    cost = lambda a, b: sum(tops[b - 1] - x for x in lengths if tops[a] <= x <= tops[b - 1])
    for _ in range(k):
        best = {b: min(best[a] + cost(a, b) for a in best if a < b) for b in range(1, len(tops) + 1) if any(a < b for a in best)} | {0: 0}
    return best[len(tops)]


@pytest.mark.parametrize("seed", range(4))
def test_boundaries_are_optimal(seed):
    lengths = np.random.default_rng(seed).geometric(0.05, 60).tolist()
    cells, counts = np.unique(lengths, return_counts=True)
    tops = packing.boundaries(cells, counts, 4)
    padding = sum(min(t for t in tops if t >= x) - x for x in lengths)
    assert len(tops) == 4 and padding == brute_padding(lengths, 4)


def test_packing(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 50)
    for df in (documents(spark, SF1), odd, empty):
        rows = packing.packed(df, buckets=6, budget=2_000).collect()
        assert len(rows) == df.count()
        batches = {}
        for r in rows:
            assert r["padded_tokens"] >= r["n_tokens"]
            batches.setdefault(r["batch_id"], []).append(r)
        for b in batches.values():
            assert len({r["bucket"] for r in b}) == 1 and sorted(r["slot"] for r in b) == list(range(len(b)))
            assert len(b) == 1 or sum(r["padded_tokens"] for r in b) <= 2_000
        for bucket in {r["bucket"] for r in rows}:
            own = [b for b in batches.values() if b[0]["bucket"] == bucket]
            room = max(1, 2_000 // max(1, own[0][0]["padded_tokens"]))
            assert sum(len(b) < room for b in own) <= 1
    assert {r["doc_id"]: r["n_tokens"] for r in packing.packed(odd).collect() if r["doc_id"] in (1, 2, 3, 4, 7)} == {1: 0, 2: 0, 3: 0, 4: 1, 7: 24_000}


# --- classifiers


@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.95), (toxicity, "toxic", 0.92)])
def test_classifier_on_held_out_documents(spark, odd, empty, module, label, least):
    score = quality.quality_scores if module is quality else toxicity.toxicity_scores
    keep = quality.keep_good if module is quality else toxicity.keep_clean
    docs, labels = documents(spark, SF1), spark.read.parquet(f"{SF1}/labels.parquet")
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == (r["score"] >= module.THRESHOLD)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) >= least
    assert keep(docs, labels).count() == sum(r["predicted"] == (module is quality) for r in rows)
    assert keep(odd, labels).columns == odd.columns
    assert score(odd, labels).count() == len(ODD) and score(empty, labels).count() == 0
    assert score(docs, labels.limit(0)).count() == len(rows)


def test_sample_leaves_out_held_out_rows(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(0, 300, 2)] + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    ids = {r["i"] for r in labelled.sampled(docs, labels, "quality", 1_000).collect()}
    assert ids == {i for i in range(0, 300, 2) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert labelled.sampled(docs, labels, "quality", 10).count() == 10
    twice = docs.unionByName(docs.selectExpr("doc_id", "concat('s', text) AS text"))
    assert {r["text"] for r in labelled.sampled(twice, labels, "quality", 1_000).collect()} == {f"st{i}" for i in ids}
    rows, y = labelled.gathered(labelled.sampled(docs, labels, "quality", 1_000), quality.features)
    assert len(rows) == len(ids) and y.tolist() == [i % 2 for i in sorted(ids)]
    assert all((r == quality.features(f"t{i}")).all() for r, i in zip(rows, sorted(ids)))


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    y = rng.random(6_000) < 0.2
    hit = lambda p, q: np.where(y, rng.random(6_000) < p, rng.random(6_000) < q)
    v = np.stack([hit(0.8, 0.02), hit(0.7, 0.05), hit(0.6, 0.01), hit(0.9, 0.1), hit(0.8, 0.03), hit(0.7, 0.02)], axis=1)
    v = np.c_[v, np.where(rng.random(6_000) < 0.7, v[:, 3], hit(0.5, 0.1))]
    v = np.where(v, toxicity.TOXIC, toxicity.ABSTAIN)
    v = np.c_[v, np.where(hit(0.05, 0.6), toxicity.CLEAN, toxicity.ABSTAIN)]
    m = toxicity.LabelModel().fit(v, y.mean())
    assert (m.parent[6] == 3) != (m.parent[3] == 6)
    assert ((m.posterior(v) > 0.5) == y).mean() > 0.95
    assert abs(m.table[0, 1, 0, toxicity.TOXIC] - 0.8) < 0.1 and abs(m.table[7, 0, 0, toxicity.CLEAN] - 0.6) < 0.1


def test_no_vote_knows_the_documents_own_label():
    rng = np.random.default_rng(3)
    rows = [np.unique(np.r_[rng.integers(0, 500, 20) * 4, [4000] if i % 4 < 2 else []]).astype(np.int64) for i in range(400)]
    y = np.array([float(i % 4 < 2) for i in range(400)])
    names = np.unique(np.concatenate(rows))
    x = labelled.Sparse([np.searchsorted(names, r) for r in rows], len(names))
    v = toxicity.votes(x, names, y)
    for i in range(0, 400, 37):
        other = y.copy()
        other[i] = 1 - other[i]
        assert (toxicity.votes(x, names, other)[i] == v[i]).all()
    assert (v[y == 1, 2] == toxicity.TOXIC).all() and (v[y == 0, -1] == toxicity.CLEAN).mean() > 0.9


def test_shapes_are_whole():
    a, b = (" ".join(["ab1" * 9 + end] * 5) for end in ("x-", "x+"))
    assert set(quality.features(a)) != set(quality.features(b))
    assert len(quality.token_shapes(b"a1" * 5_000)[0]) == 10_000


def test_boundaries_of_long_lengths_are_exact(spark):
    lengths = [*range(1_000, 1_400, 7), *range(5_000, 5_300, 11), 90_001]
    df = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(lengths)], "doc_id long, text string")
    placed = packing.packed(df, buckets=4)
    rows = placed.collect()
    assert sum(r["padded_tokens"] - r["n_tokens"] for r in rows) == brute_padding(lengths, 4)
    told = packing.padding(placed).first()
    assert told["padding"] == brute_padding(lengths, 4) and told["padding_one_bucket"] == 90_001 * len(lengths) - sum(lengths)
    made = packing.batches(placed).collect()
    assert sorted(i for b in made for i in b["doc_ids"]) == list(range(len(lengths)))
    assert all(len(b["doc_ids"]) == 1 or b["padded_tokens"] <= packing.BUDGET for b in made) and sum(b["padding"] for b in made) == told["padding"]
    own = packing.packed(df.withColumn("k", F.col("doc_id") % 3), tokens=F.col("k")).collect()
    assert sorted(r["n_tokens"] for r in own) == sorted(i % 3 for i in range(len(lengths)))


def test_quality_of_texts_that_differ_in_words_only():
    rng = np.random.default_rng(2)
    names = [f"w{i}" for i in range(400)]
    words = [w.replace("w", "ab").translate(str.maketrans("0123456789", "cdefghijkl")) for w in names]
    text = lambda good: " ".join(rng.choice(words[: 300] if good else words[100:], 60))
    labels = np.arange(400) % 2
    model = quality.train([quality.features(text(y)) for y in labels], labels)
    score = model.scorer()
    fresh = np.arange(200) % 2
    assert np.mean([(score(text(y)) > 0) == bool(y) for y in fresh]) > 0.9
    assert {len(s) for s in quality.token_shapes(text(1).encode())} == {1}
