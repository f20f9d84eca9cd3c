"""Findings of the fourth round: the ten best matches are those of the SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomwork.functions.expr import rounded
from loomwork.operators import similarity
from loomwork.plans import catalog


def both(spark, path, name, rows):
    """Rows of a query and of its SQL, in order, on vectors (id, numbers)."""
    ids, vectors = [r[0] for r in rows], [None if r[1] is None else [float(x) for x in r[1]] for r in rows]
    table = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())})
    pq.write_table(table, path / "embeddings.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS FROM read_parquet('{path}/embeddings.parquet')")
        want = c.execute(catalog.oracle_sql()[name]).fetchall()
    return repr([tuple(r) for r in catalog.queries()[name](spark, str(path)).collect()]), repr(want)


def test_the_best_matches_are_ordered_by_the_weight_returned(spark, tmp_path):
    r = np.random.default_rng(1)
    v = r.normal(size=(40, 64))
    got, want = both(spark, tmp_path, "top_matches", [(i, v[i % 20] + (1e-3 * r.normal(size=64) if i >= 20 else 0)) for i in range(40)])
    assert got == want and want.startswith("[(0, 20, 1.0), (1, 21, 1.0)")


def test_matches_without_a_distance_are_those_of_the_sql(spark, tmp_path):
    v = np.random.default_rng(2).normal(size=(30, 64))
    odd = {4: np.zeros(64), 9: None, 15: np.where(np.arange(64) == 3, np.nan, v[15]), 21: np.full(64, 1e-20)}
    many = [(i, odd.get(i, v[i])) for i in range(30)] + [(5, v[0])]
    few = [(0, None), (1, np.zeros(64)), (2, v[0]), (3, v[1]), (4, None), (None, v[2])]
    for rows in (many, few, many[:2], many[:1]):
        got, want = both(spark, tmp_path, "top_matches", rows)
        assert got == want
    got, want = both(spark, tmp_path, "mutual_nn", many)
    assert sorted(eval(got)) == sorted(eval(want))


def test_an_id_of_many_rows_hides_no_neighbour():
    r = np.random.default_rng(3)
    y = np.concatenate([r.normal(size=(300, 8)), np.ones((700, 8))])
    di = np.concatenate([np.arange(300), np.full(700, 300)])
    q, d, _ = similarity.nearest(y[-1:], y, di[-1:], di, 2, "cosine")
    far = 1 - y[:300].sum(1) / np.sqrt(8 * (y[:300] ** 2).sum(1))
    assert d.tolist() == np.argsort(far)[:2].tolist()


@pytest.mark.parametrize("digits", [5, 9])
def test_halves_are_rounded_as_in_the_sql(spark, digits):
    with duckdb.connect() as c:
        rows = c.execute(f"SELECT x, round(x, {digits}) FROM (SELECT (i + 0.5) / 1e{digits} AS x FROM range(-500, 500) t(i) UNION ALL SELECT unnest([NULL, 'nan'::DOUBLE, -2e9, 0.0]))").fetchall()
    df = spark.createDataFrame(rows, "x double, r double").select("x", "r", rounded(F.col("x"), digits).alias("got"))
    assert df.filter("not (r <=> got)").count() == 0 and df.count() == 1004
    x = np.array([x for x, _ in rows[500:1000]])
    assert similarity._round9(x).tolist() == [r for _, r in rows[500:1000]] if digits == 9 else True
