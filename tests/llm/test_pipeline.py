import numpy as np

import corpus_pipeline
from loomwork.llm import decontamination, quality, toxicity
from tests.llm.test_text_operators import SF1, brute_leaks


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    columns, given = docs.columns, None
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == len(set(names)) == 5
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, SF1)
        path = str(tmp_path / str(number))
        found.write.parquet(path)
        given, docs = docs, spark.read.parquet(path)
        before = {r["doc_id"]: r["text"] for r in given.select("doc_id", "text").collect()}
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= set(before) and docs.count() == len(after)
        if number < 4:
            assert docs.columns == columns
        if number == 0:
            model = quality.fitted(given, spark.read.parquet(f"{SF1}/labels.parquet")).scorer()
            assert after == {i for i, t in before.items() if model(t or "") >= 0}
        if number == 1:
            score = toxicity.Scorer(toxicity.fitted(given, spark.read.parquet(f"{SF1}/labels.parquet")))
            assert after == {i for i, t in before.items() if toxicity.sigmoid(np.array([score(t or "")]))[0] < toxicity.THRESHOLD}
        if number == 2:
            texts = [before[i] for i in after]
            assert len(texts) == len(set(texts))
        if number == 3:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF1}/benchmark.parquet").collect()]
            exact = {i for i, t in before.items() if any(decontamination.normalised(x) in decontamination.normalised(t) for _, x in items)}
            gone = set(before) - after
            assert exact <= gone
            rest = [(i, before[i]) for i in sorted(gone - exact)[:3]]
            assert {d for d, _, _ in brute_leaks(rest, items)} == {i for i, _ in rest}
        if number == 4:
            assert after == set(before)


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "n_tokens", "bucket", "padded_tokens", "batch_id", "slot"] and rows.count() > 100
