"""Nearest neighbours in blocks, mutual matches, pose rankings and non-maximum suppression."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block at least, and at most; between them a table is cut into ``SIDE`` blocks.
BLOCK = 4096
MOST = 32_768
SIDE = 16
#: Base rows whose nearest one stands for all of them in the first look.
RUN = 64
#: Numbers of a strip of distances that a task holds at a time.
STRIP = 1 << 23


def _block_size(rows: int, block: int) -> int:
    """Blocks grow with their table up to ``MOST`` rows: every row is dealt to as many pairs of blocks as the other side has blocks."""
    return max(block, min(MOST, -(-rows // SIDE)))


def _round9(far: np.ndarray) -> np.ndarray:
    """To 9 digits, half away from zero, as SQL does; numpy's goes to the even one."""
    far = far * 1e9
    whole = np.floor(far)
    return (whole + (far - whole >= 0.5)) / 1e9


def nearest(x: np.ndarray, y: np.ndarray, qi: np.ndarray, di: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, id, distance) of the ``k`` nearest rows ``y``, whose ids ascend, of each row ``x``; distances are rounded to 9 digits.

    A row's ``k`` nearest lie in runs of ``y`` at least as near as the ``k``-th
    nearest run.  Runs are found with a margin over the error of single precision;
    what lies in them is measured in double precision, so the result is exact.
    """
    sound_x, sound_y = (np.isfinite(m).all(axis=1) for m in (x, y))
    x, qi, y, di = x[sound_x], qi[sound_x], y[sound_y], di[sound_y]
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(x) or not len(y):
        return none
    given_x, given_y = x, y
    if metric == "cosine":
        square_x, square_y = (np.where(s > 0, s, 1) for s in ((m**2).sum(1) for m in (x, y)))
        x, y = x / np.sqrt(square_x)[:, None], y / np.sqrt(square_y)[:, None]
    less = np.zeros(len(y)) if metric == "cosine" else (y**2).sum(1) / 2  # the nearest y has the greatest x.y - y.y / 2
    far_x, far_y = (float(np.sqrt((m**2).sum(1).max())) for m in (x, y))
    kind = np.float32 if max(far_x, far_y) < 1e15 else np.float64
    n, width = len(y), x.shape[1]
    runs = -(-n // RUN)
    wide = np.zeros((width + 1, runs * RUN), kind)
    wide[:width, :n], wide[width, :n], wide[width, n:] = y.T, -less, -np.inf
    margin = 2 * (width + 16) * 2.0**-24 * (far_x * far_y + float(less.max())) + 2e-9 * max(1.0, far_x + far_y)
    ends = [np.searchsorted(di, di, side) for side in ("left", "right")]
    spare = k + int(((ends[1] - 1) // RUN - ends[0] // RUN).max()) + 1  # so many runs may be led by rows of a row's own id
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, STRIP // (runs * RUN))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        score = (np.concatenate([part, np.ones((len(part), 1))], axis=1).astype(kind) @ wide).reshape(len(part), runs, RUN)
        top = score.max(axis=2)
        least = np.partition(top, runs - spare, axis=1)[:, runs - spare] if runs > spare else np.full(len(part), -np.finfo(kind).max, kind)
        least = least - kind(margin)
        row, run = np.nonzero(top >= least[:, None])
        for a in range(0, len(row), STRIP // (RUN * 64)):
            r, c = row[a : a + STRIP // (RUN * 64)], run[a : a + STRIP // (RUN * 64)]
            i, j = np.nonzero(score[r, c] >= least[r][:, None])
            r, c = at + r[i], c[i] * RUN + j
            keep = qi[r] != di[c]
            r, c = r[keep], c[keep]
            if metric == "cosine":
                far = 1 - np.clip(np.einsum("ij,ij->i", given_x[r], given_y[c]) / np.sqrt(square_x[r] * square_y[c]), -1, 1)
            else:
                far = np.sqrt(((x[r] - y[c]) ** 2).sum(1))
            far = _round9(far)
            order = np.lexsort((c, far, r))
            r, c, far = r[order], c[order], far[order]
            best = np.arange(len(r)) - np.searchsorted(r, r) < k  # a row whose candidates go on has more, which are merged later
            out.append((qi[r[best]], di[c[best]], far[best]))
    if not out:
        return none
    q, d, far = (np.concatenate(c) for c in zip(*out))
    return q, d, far


def _kind(vector: Column, metric: str) -> Column:
    """0 of a vector that has distances; 1 if it isn't finite or, by cosine, is zero: they are NaN; 2 if it is null: so are they."""
    least, most = F.array_min(vector), F.array_max(vector)  # NaN is the greatest
    sound = (least > float("-inf")) & (most < float("inf")) & ((least < 0) | (most > 0) | F.lit(metric != "cosine"))
    return F.when(vector.isNull(), 2).when(sound, 0).otherwise(1)


def _without_distance(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(q, id, distance) of pairs whose distance is NaN or null, as far as they may be among a row's ``k`` first: each kind's lowest ids."""
    lowest = None
    for kind in range(3):
        ids = b.filter(F.col("kind") == kind).groupBy("id").agg(F.least(F.count("*"), F.lit(k)).alias("n")).orderBy("id").limit(k + 1)
        ids = ids.select("id", F.lit(kind).alias("other"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        lowest = ids if lowest is None else lowest.unionByName(ids)
    worse = F.greatest("kind", "other")
    pairs = a.select(F.col("id").alias("q"), "kind").join(F.broadcast(lowest), (worse > 0) & (F.col("q") != F.col("id")))
    return pairs.select("q", "id", F.when(worse == 1, F.lit(float("nan"))).alias("distance"))


def neighbours(queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine", id_column: str = "id", vector: str = "v", block: int = BLOCK) -> DataFrame:
    """(q, id, distance, rank): the ``k`` nearest base rows of each query row, exact, lower ids first of equals.

    Both sides are dealt to hash blocks, each pair of blocks is matrix products
    that keep their own ``k`` best, and those are merged; memory is bounded by a
    block, and no pair of rows is a row of a join.  A row isn't its own neighbour.
    All pairs are compared, which is quadratic by nature.  Pairs without a distance
    come last as in SQL: those with a vector that isn't finite or, by cosine, is
    zero have NaN, and behind them those with a null vector have null.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(metric)
    a, b = (df.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).alias("v")).filter("id is not null").withColumn("kind", _kind(F.col("v"), metric)) for df in (queries, base))
    counts = [df.agg(F.count_if(F.col("kind") == 0), F.count_if(F.col("kind") > 0)).first() for df in (a, b)]
    odd = _without_distance(a, b, k) if any(n for _, n in counts) else None
    n_q, n_b = (max(1, -(-n // _block_size(n, block))) for n, _ in counts)
    a = a.filter("kind = 0").withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_q)))
    b = b.filter("kind = 0").withColumn("bb", F.pmod(F.xxhash64("id"), F.lit(n_b)))
    a = a.withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(n_b - 1)))).withColumn("side", F.lit(0))
    b = b.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).withColumn("side", F.lit(1))
    both = a.select("qb", "bb", "side", "id", "v").unionByName(b.select("qb", "bb", "side", "id", "v"))

    def rows_of(table: pa.Table, side: int) -> tuple[np.ndarray, np.ndarray]:
        mine = table.filter(pc.equal(table["side"], side)).combine_chunks()
        ids = mine["id"].to_numpy()
        if not len(ids):
            return ids, np.empty((0, 0))
        flat = pc.list_flatten(mine["v"]).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        return ids[order], flat[order]

    def best(table: pa.Table) -> pa.Table:
        (qi, x), (di, y) = (rows_of(table, side) for side in (0, 1))
        found = nearest(x, y, qi, di, k, metric) if len(qi) and len(di) else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table(dict(zip(("q", "id", "distance"), found)))

    tasks = max(1, min(n_q * n_b, 4096))
    found = both.repartition(tasks, "qb", "bb").groupBy("qb", "bb").applyInArrow(best, "q bigint, id bigint, distance double")
    found = found if odd is None else found.unionByName(odd)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("distance").asc_nulls_last(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def ratio_weights(pairs: DataFrame) -> DataFrame:
    """(q, id, weight) of the first neighbour: 1 minus its distance over the second's; rows with one neighbour have none."""
    w = Window.partitionBy("q").orderBy("rank")
    weighed = pairs.withColumn("_d2", F.lead("distance").over(w)).withColumn("_r2", F.lead("rank").over(w)).filter("rank = 1 and _r2 = 2")
    return weighed.select("q", "id", (1 - F.col("distance") / F.greatest("_d2", F.lit(1e-9))).alias("weight"))


def mutual(forth: DataFrame, back: DataFrame) -> DataFrame:
    """(q, id): first neighbours of each other; of one table's own neighbours both rows of a pair meet in a sum, and it is made once."""
    if forth is back:
        ends = F.struct(F.least("q", "id").alias("a"), F.greatest("q", "id").alias("b"))
        both = forth.filter("rank = 1").select("q", ends.alias("p")).groupBy("p").agg(F.collect_set("q").alias("q")).filter("size(q) = 2")  # two at most
        return both.select(F.explode("q").alias("q"), "p").select("q", F.when(F.col("q") == F.col("p.a"), F.col("p.b")).otherwise(F.col("p.a")).alias("id"))
    a = forth.filter("rank = 1").select("q", "id")
    b = back.filter("rank = 1").select(F.col("id").alias("q"), F.col("q").alias("id"))
    return a.join(b, ["q", "id"])


def top_matches(weighted: DataFrame, k: int) -> DataFrame:
    return weighted.orderBy(F.col("weight").desc(), "q", "id").limit(k)


def ranked_by_distance(items: DataFrame, group: str, id_column: str, vector: str, most: int | None = None) -> DataFrame:
    """(group, ref, id, distance, rank): for each reference its group's other members by distance.

    A group is a scene: its pairs are the result itself.
    """
    from loomwork.functions.geometry import squared_distance

    a = items.select(group, F.col(id_column).alias("ref"), F.col(vector).alias("_a"))
    b = items.select(group, F.col(id_column).alias("id"), F.col(vector).alias("_b"))
    pairs = a.join(b, group).filter("ref <> id").withColumn("distance", F.sqrt(squared_distance(F.col("_a"), F.col("_b"))))
    w = Window.partitionBy(group, "ref").orderBy(F.round("distance", 9), "id")
    out = pairs.withColumn("rank", F.row_number().over(w)).drop("_a", "_b")
    return out if most is None else out.filter(F.col("rank") <= most)


def suppressed(detections: DataFrame, limit: float = 1.0, confidence: float = 0.3, most: int = 16) -> DataFrame:
    """Detections (img, cls, box, score) over the confidence, best first, at most ``most`` a class, overlapping ones gone.

    Greedy: a box stays if its overlap with every box that stays is under ``limit``.
    """

    def area(b: np.ndarray) -> float:
        return max(b[2] - b[0] + 1, 0) * max(b[3] - b[1] + 1, 0)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["score"] > confidence].sort_values("score", ascending=False, kind="stable").head(most)
        kept: list[int] = []
        boxes = [np.asarray(b, float) for b in pdf["box"]]
        for i, b in enumerate(boxes):
            for j in kept:
                c = boxes[j]
                inner = area(np.array([max(b[0], c[0]), max(b[1], c[1]), min(b[2], c[2]), min(b[3], c[3])]))
                union = area(b) + area(c) - inner
                if union and inner / union >= limit:
                    break
            else:
                kept.append(i)
        return pdf.iloc[kept]

    return detections.select("img", "cls", "box", "score").groupBy("img", "cls").applyInPandas(keep, "img string, cls string, box array<double>, score double")


def similarity_alignment(points: DataFrame, group: str) -> DataFrame:
    """(group, scale, rotation, translation) that best maps ``a`` to ``b`` (arrays of 3), by singular values of their covariance.

    Sums are taken in Spark; only a 3x3 matrix of each group reaches Python.
    """
    cells = [F.sum(F.col("b")[i] * F.col("a")[j]).alias(f"c{i}{j}") for i in range(3) for j in range(3)]
    sums = [F.sum(F.col(s)[i]).alias(f"{s}{i}") for s in "ab" for i in range(3)]
    squares = F.sum(sum((F.col("a")[i] * F.col("a")[i] for i in range(3)), F.lit(0.0))).alias("aa")
    stats = points.groupBy(group).agg(F.count("*").alias("n"), *sums, *cells, squares)

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                n = r["n"]
                ma, mb = (np.array([r[f"{s}{i}"] for i in range(3)]) / n for s in "ab")
                cov = np.array([[r[f"c{i}{j}"] for j in range(3)] for i in range(3)]) / n - np.outer(mb, ma)
                var = r["aa"] / n - ma @ ma
                u, d, vt = np.linalg.svd(cov)
                s = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1])
                rot = u @ s @ vt
                scale = float((d * np.diag(s)).sum() / var) if var > 0 else 1.0
                rows.append((r[group], scale, rot.ravel().tolist(), (mb - scale * rot @ ma).tolist()))
            yield pd.DataFrame(rows, columns=[group, "scale", "rotation", "translation"])

    kind = points.schema[group].dataType.simpleString()
    return stats.mapInPandas(solve, f"`{group}` {kind}, scale double, rotation array<double>, translation array<double>")
