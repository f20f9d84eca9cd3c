"""Benchmark reports as aggregations; a group without rows has no row, and a division by nothing is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.expr import let
from loomwork.functions.parsers import evalai_answer, number_of, strip
from loomwork.operators.ordering import in_ranges


def _mean(x: Column) -> Column:
    return F.avg(x.cast("double"))


def histogram(df: DataFrame, value: Column, examples: str | None = None, most: int = 5) -> DataFrame:
    """(value, n, percent, total[, examples]): counts of each value, its share, and the first few examples."""
    aggs = [F.count("*").alias("n")]
    counts = df.groupBy(value.alias("value")).agg(*aggs)
    total = counts.agg(F.sum("n").alias("total"))
    out = counts.crossJoin(total).withColumn("percent", F.round(100.0 * F.col("n") / F.col("total"), 4))  # one row
    if examples is None:
        return out
    w = Window.partitionBy("value").orderBy(examples)
    some = df.select(value.alias("value"), examples).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    lists = some.groupBy("value").agg(F.array_sort(F.collect_list(examples)).alias("examples"))
    return out.join(lists, "value", "left")


def confusion(df: DataFrame, group: list[str], gold: Column, predicted: Column) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1, accuracy, yes_ratio of each group."""
    base = df.groupBy(*group).agg(
        F.count_if(gold & predicted).alias("tp"),
        F.count_if(~gold & predicted).alias("fp"),
        F.count_if(~gold & ~predicted).alias("tn"),
        F.count_if(gold & ~predicted).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    return base.select(
        *group, "tp", "fp", "tn", "fn",
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide(tp + tn, n).alias("accuracy"),
        F.try_divide(tp + fp, n).alias("yes_ratio"),
    )


def macro(df: DataFrame, value: str, name: str | None = None) -> DataFrame:
    return df.agg(F.avg(value).alias(name or f"macro_{value}"))


def paired(df: DataFrame, task: list[str], pair: list[str], correct: Column, size: int = 2) -> DataFrame:
    """acc over rows, acc_plus over pairs whose rows are all right, and 100 * (acc + acc_plus); incomplete pairs count in acc only."""
    pairs = df.groupBy(*task, *pair).agg(F.count("*").alias("n"), F.count_if(correct).alias("right"))
    out = pairs.groupBy(*task).agg(
        (F.sum("right") / F.sum("n")).alias("acc"),
        F.try_divide(F.count_if((F.col("n") == size) & (F.col("right") == size)), F.count_if(F.col("n") == size)).alias("acc_plus"),
        F.sum("n").alias("rows"),
    )
    return out.withColumn("score", 100 * (F.col("acc") + F.col("acc_plus")))


def paired_report(df: DataFrame, task: str, image: str, gold: Column, predicted: Column, types: dict[str, list[str]]) -> DataFrame:
    """(type, task, TP, FN, FP, TN, precision, recall, other_num, acc, acc_plus, score) of yes/no questions asked in pairs, two an image.

    Other answers than yes and no are wrong in ``acc`` and left out of the counts,
    precision and recall, which are 0 where nothing is divided.  ``acc_plus`` is
    the share of images whose questions are both right.  A type's score is the
    sum of its tasks' scores and has no task; tasks of no type are left out.
    """
    kinds = F.create_map(*[F.lit(x) for kind, names in types.items() for name in names for x in (name, kind)])
    named = df.select(F.col(task).alias("task"), F.col(image).alias("image"), F.lower(gold).alias("g"), F.lower(predicted).alias("p"))
    typed = named.withColumn("type", F.element_at(kinds, F.col("task"))).filter("type is not null")
    known = F.col("p").isin("yes", "no")
    count = lambda g, p: F.count_if((F.col("g") == g) & (F.col("p") == p))
    images = typed.groupBy("type", "task", "image").agg(
        F.count("*").alias("n"), F.count_if(F.col("g") == F.col("p")).alias("right"), F.count_if(~F.coalesce(known, F.lit(False))).alias("other"),
        count("yes", "yes").alias("tp"), count("yes", "no").alias("fn"), count("no", "yes").alias("fp"), count("no", "no").alias("tn"),
    )
    tasks = images.groupBy("type", "task").agg(
        *[F.sum(c).alias(n) for c, n in (("tp", "TP"), ("fn", "FN"), ("fp", "FP"), ("tn", "TN"), ("other", "other_num"))],
        (F.sum("right") / F.sum("n")).alias("acc"), (F.count_if(F.col("right") == 2) / F.count("*")).alias("acc_plus"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    scored = tasks.withColumns({"precision": share("TP", "FP"), "recall": share("TP", "FN"), "score": 100 * (F.col("acc") + F.col("acc_plus"))})
    totals = scored.groupBy("type").agg(F.sum("score").alias("score"))
    return scored.unionByName(totals, allowMissingColumns=True)


def domain_report(df: DataFrame, category: str, correct: Column, domains: dict[str, list[str]]) -> DataFrame:
    """(name, level, num, acc): categories, ``Overall-`` domains and ``Overall``, each the share of right rows to three places.

    A category that no domain names counts nowhere, one without rows has no row;
    a domain without any has 0 rows and accuracy 0.
    """
    kinds = F.create_map(*[F.lit(x) for domain, names in domains.items() for name in names for x in (name, domain)])
    known = df.select(F.col(category).alias("category"), correct.cast("int").alias("_c")).withColumn("domain", F.element_at(kinds, F.col("category"))).filter("domain is not null")
    sets = known.groupingSets([[F.col("domain"), F.col("category")], [F.col("domain")], []], "domain", "category")
    rolled = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("num"), F.avg("_c").alias("acc"))
    name = F.when(F.col("g") == 0, F.col("category")).when(F.col("g") == 1, F.concat(F.lit("Overall-"), "domain")).otherwise(F.lit("Overall"))
    level = F.when(F.col("g") == 0, "category").when(F.col("g") == 1, "domain").otherwise("all")
    found = rolled.select(name.alias("name"), level.alias("level"), "num", F.round(F.coalesce("acc", F.lit(0.0)), 3).alias("acc"))
    names = df.sparkSession.createDataFrame([(f"Overall-{d}",) for d in domains], "name string")
    empty = names.join(found, "name", "left_anti").select("name", F.lit("domain").alias("level"), F.lit(0).cast("bigint").alias("num"), F.lit(0.0).alias("acc"))
    return found.unionByName(empty)


def best_first(report: DataFrame, group: str, value: str, ties: list[str]) -> DataFrame:
    """Adds ``place`` in each group of a report, from 1: the greatest value first."""
    return report.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last(value), *ties)))


def any_and_tag_means(df: DataFrame, prompt: str, tag: str, correct: Column) -> DataFrame:
    """One row: share of right rows, of prompts with any right row, and the unweighted mean of the tags' shares."""
    by = df.groupBy(prompt, tag).agg(F.count("*").alias("n"), F.count_if(correct).alias("right"))
    rows = by.agg((F.sum("right") / F.sum("n")).alias("image_accuracy"))
    prompts = by.groupBy(prompt).agg(F.max((F.col("right") > 0).cast("int")).alias("ok")).agg(F.avg("ok").alias("prompt_accuracy"))
    tags = by.groupBy(tag).agg((F.sum("right") / F.sum("n")).alias("acc")).agg(F.avg("acc").alias("overall"))
    return rows.crossJoin(prompts).crossJoin(tags)  # one row each


def hierarchy(df: DataFrame, outer: str, inner: str, correct: Column, eps: float = 0.0, scale: float = 1.0) -> DataFrame:
    """(outer, inner, level, right, n, acc) for each inner group, each outer group and all; weighted by rows."""
    rolled = df.withColumn("_c", correct.cast("int")).rollup(outer, inner).agg(
        F.grouping_id().alias("g"), F.sum("_c").alias("right"), F.count("*").alias("n")
    )
    level = F.when(F.col("g") == 0, "inner").when(F.col("g") == 1, "outer").otherwise("all")
    return rolled.select(outer, inner, level.alias("level"), "right", "n", (scale * F.col("right") / (F.col("n") + F.lit(eps))).alias("acc"))


def by_attributes(df: DataFrame, keys: list[str], correct: Column, lists: tuple[str, ...] = ()) -> DataFrame:
    """(key, value, right, n, acc): accuracy by each value of each key; list columns count in each of their values."""
    rows = df.withColumn("_c", correct.cast("int"))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])

    def of_list(name: str) -> Column:
        values = F.coalesce(F.col(name), F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("key"), v.alias("value")))

    if lists:
        pairs = F.concat(pairs, *map(of_list, lists))
    one = rows.select("_c", F.explode(pairs).alias("p")).filter("p.value is not null")
    out = one.groupBy("p.key", "p.value").agg(F.sum("_c").alias("right"), F.count("*").alias("n"))
    return out.withColumn("acc", F.col("right") / F.col("n"))


def gain_over(report: DataFrame, baseline: DataFrame, keys: list[str], value: str) -> DataFrame:
    b = baseline.select(*keys, F.col(value).alias("_b"))
    return report.join(b, keys, "left").withColumn("gain", F.round(F.col(value) - F.col("_b"), 2)).drop("_b")


def soft_vqa(matches: Column, answers: int = 10) -> Column:
    """The leave-one-out soft score of a prediction that ``matches`` of the answers."""
    m = matches.cast("double")
    return (m * F.least(F.lit(1.0), (m - 1) / 3) + (answers - m) * F.least(F.lit(1.0), m / 3)) / answers


def anls(prediction: Column, answers: Column, threshold: float = 0.5) -> Column:
    """The best of 1 - edit distance / longer length over the answers, 0 under the threshold; null between empty texts."""

    def one(p: Column, a: Column) -> Column:
        return let(F.lower(strip(a)), lambda g: 1 - F.try_divide(F.levenshtein(p, g), F.greatest(F.char_length(p), F.char_length(g))))

    best = let(F.lower(strip(prediction)), lambda p: F.array_max(F.transform(answers, lambda a: one(p, a))))
    return let(best, lambda b: F.when(b < threshold, F.lit(0.0)).otherwise(b))


def relaxed_match(prediction: Column, target: Column, slack: float = 0.05) -> Column:
    """Numbers (also with a % sign) within the slack of the target; texts, and targets of zero, alike but for case."""

    def number(x: Column) -> Column:
        pct = number_of(F.rtrim(x, F.lit("%"))) / 100
        return F.when(x.endswith("%"), pct).otherwise(number_of(x))

    p, t = number(prediction), number(target)
    same = F.lower(prediction) == F.lower(target)
    return F.when(p.isNotNull() & t.isNotNull() & (t != 0), F.abs(p - t) / F.abs(t) <= slack).otherwise(same)


def exact_match(prediction: Column, answers: Column) -> Column:
    p = F.lower(strip(prediction))
    return F.exists(answers, lambda a: F.lower(strip(a)) == p)


#: Scores of one prediction against its answers, by name.
EVALUATORS = {
    "exact": lambda p, a: exact_match(p, a).cast("double"),
    "anls": lambda p, a: F.coalesce(anls(p, a), F.lit(0.0)),
    "relaxed": lambda p, a: F.exists(a, lambda x: F.coalesce(relaxed_match(p, x), F.lit(False))).cast("double"),
    "vqa": lambda p, a: vqa_accuracy(p, a),
}


def vqa_accuracy(prediction: Column, answers: Column) -> Column:
    """The mean over all answers but one of how many of them, three at most, a normalised prediction matches as a share of three."""
    n = F.size(answers)
    others = lambda m: F.least(F.lit(1.0), m / 3)
    matches = let(evalai_answer(prediction), lambda said: F.size(F.filter(F.transform(answers, evalai_answer), lambda x: x == said)))
    mean = let(matches, lambda m: F.try_divide(m * others(m - 1) + (n - m) * others(m), n))
    return F.coalesce(mean, F.lit(0.0))


def evaluated(df: DataFrame, how: str, prediction: str, answers: str, group: list[str] | None = None) -> DataFrame:
    """(group, n, score): the mean score of an evaluator; rows without a prediction score 0, an empty group has no row."""
    score = F.coalesce(EVALUATORS[how](F.col(prediction), F.col(answers)), F.lit(0.0))
    return df.groupBy(*(group or [])).agg(F.count("*").alias("n"), F.avg(score).alias("score"))


def geometric(a: Column, b: Column) -> Column:
    return F.sqrt(a * b)


def viescore(semantics: Column, quality: Column) -> Column:
    """The root of the least semantic score times the least quality score."""
    return F.sqrt(F.array_min(semantics) * F.array_min(quality))


def group_and_macro(df: DataFrame, group: str, a: Column, b: Column, kept: Column) -> DataFrame:
    """Means of two scores and of their geometric mean by group, over all rows and over the kept ones; plus the groups' mean."""
    x = df.select(F.col(group).cast("string").alias("grp"), a.cast("double").alias("a"), b.cast("double").alias("b"), kept.alias("kept"))
    o = F.sqrt(F.col("a") * F.col("b"))
    means = [F.avg(c).alias(n) for c, n in (("a", "sc"), ("b", "pq"))] + [F.avg(o).alias("o")]
    means += [F.avg(F.when(F.col("kept"), c)).alias(n) for c, n in ((F.col("a"), "sc_kept"), (F.col("b"), "pq_kept"), (o, "o_kept"))]
    by = x.groupBy("grp").agg(*means)
    names = ("sc", "pq", "o", "sc_kept", "pq_kept", "o_kept")
    return by.unionByName(by.agg(*[F.avg(n).alias(n) for n in names]).select(F.lit("all").alias("grp"), *names))


def normalised_levels(df: DataFrame, meta: str, kind: str, item: str, metrics: list[str]) -> DataFrame:
    """Means of (score - 1) * 25 at every level: (meta, kind, item, metric, level, mean, n); nulls are left out.

    Levels: item and metric, kind and metric, kind, meta, all; the last three are
    over all single values.
    """
    long = df.unpivot([meta, kind, item], metrics, "metric", "score").filter("score is not null").withColumn("x", (F.col("score") - 1) * 25.0)
    sets = [[kind, item, "metric"], [kind, "metric"], [kind], [meta], []]
    columns = [meta, kind, item, "metric"]
    out = long.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.grouping_id().alias("g"), F.avg("x").alias("mean"), F.count("*").alias("n"))
    bits = {sum(1 << (3 - columns.index(c)) for c in columns if c not in s): "+".join(s) or "all" for s in sets}
    level = F.create_map(*[x for k, v in bits.items() for x in (F.lit(k), F.lit(v))])
    return out.select(*columns, F.element_at(level, F.col("g").cast("int")).alias("level"), "mean", "n")


def wise_score(consistency: Column, realism: Column, aesthetic: Column) -> Column:
    return 0.7 * consistency + 0.2 * realism + 0.1 * aesthetic


def guarded_means(df: DataFrame, source: str, bucket: Column, score: Column, failed: Column, least: int) -> DataFrame:
    """(source, bucket, mean, n): half the buckets' mean score, of sources without a failed row and with at least so many rows."""
    x = df.select(F.col(source).alias("source"), bucket.alias("bucket"), score.alias("score"), failed.alias("failed"))
    whole = x.groupBy("source").agg(F.max(F.col("failed").cast("int")).alias("bad"), F.count("*").alias("rows"))
    valid = whole.filter((F.col("bad") == 0) & (F.col("rows") >= least)).select("source")
    return x.join(valid, "source").groupBy("source", "bucket").agg((F.sum("score") / (2 * F.count("*"))).alias("mean"), F.count("*").alias("n"))


def rise_score(category: Column, consistency: Column, reasoning: Column, quality: Column, free: Column) -> Column:
    """Weights by category; a reasoning of 1 halves the score, but not below 1."""
    visual = F.when(free, 0.2 * quality + 0.8 * reasoning).otherwise(0.3 * consistency + 0.5 * reasoning + 0.2 * quality)
    score = F.when(category == "logical_reasoning", 0.3 * consistency + 0.7 * reasoning).otherwise(visual)
    return F.when(reasoning == 1, F.greatest(F.lit(1.0), score * 0.5)).otherwise(score)


def rise_complete(category: Column, consistency: Column, reasoning: Column, quality: Column) -> Column:
    """1 where all scores that count are 5, else 0; scores that are missing count as not 5."""
    two = (consistency == 5) & (reasoning == 5)
    return F.coalesce(F.when(category == "logical_reasoning", two).otherwise(two & (quality == 5)).cast("int"), F.lit(0))


def rise_of_list(scores: Column) -> Column:
    """(consistency, reasoning, quality) of three scores, or of two on a 0 to 1 scale brought to 1 to 5."""
    two = lambda i: 4 * F.least(F.get(scores, F.lit(i)), F.lit(1)) + 1
    pick = lambda i: F.when(F.size(scores) == 3, F.get(scores, F.lit(i))).when(F.size(scores) == 2, two(i))
    return F.struct(pick(0).alias("consistency"), pick(1).alias("reasoning"), F.when(F.size(scores) == 3, F.get(scores, F.lit(2))).alias("quality"))


def scored_levels(df: DataFrame, category: str, subtask: str) -> DataFrame:
    """(level, name, score, percent, accuracy): means over all, by category and by subtask of ``score`` and ``complete``."""
    out = df.groupingSets([[], [F.col(category)], [F.col(subtask)]], category, subtask).agg(
        F.grouping_id().alias("g"), F.avg("score").alias("score"), F.avg("complete").alias("accuracy")
    )
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "category").otherwise("subtask")
    return out.select(level.alias("level"), F.coalesce(category, subtask, F.lit("all")).alias("name"), "score", (25 * (F.col("score") - 1)).alias("percent"), "accuracy")


def typed_means(df: DataFrame, kind: str, value: str) -> DataFrame:
    """(kind, mean, n) by type and over all keys; keys without a type count in the overall mean only."""
    out = df.groupingSets([[F.col(kind)], []], kind).agg(F.grouping_id().alias("g"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.filter((F.col("g") == 1) | F.col(kind).isNotNull()).select(F.when(F.col("g") == 1, "overall").otherwise(F.col(kind)).alias("kind"), "mean", "n")


def under_thresholds(df: DataFrame, group: list[str], error: str, thresholds: list[float]) -> DataFrame:
    """(group, mean, share under each threshold), strictly under."""
    named = [F.avg((F.col(error) < t).cast("double")).alias(f"under_{t:g}".replace(".", "_")) for t in thresholds]
    return df.groupBy(*group).agg(F.avg(error).alias("mean"), *named)


def error_auc(df: DataFrame, group: str, error: str, threshold: float) -> DataFrame:
    """(group, auc): the area under the recall curve up to a threshold, as its share.

    Recall goes from 0 at error 0 to 1 in equal steps over the sorted errors.
    Rows are ranked by their counts, so equal errors are one step of the curve, in
    ranges of errors, so no task holds a group.  A null error is over any threshold.
    """
    counts = in_ranges(df.groupBy(group, F.coalesce(F.col(error).cast("double"), F.lit(float("inf"))).alias("e")).agg(F.count("*").alias("c")), "e", "range")
    ranges = counts.groupBy(group, "range").agg(F.sum("c").alias("c"), F.max("e").alias("e"))
    earlier = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.select(
        group, "range", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"), F.coalesce(F.max("e").over(earlier), F.lit(0.0)).alias("e0"), F.sum("c").over(Window.partitionBy(group)).alias("n")
    )
    w = Window.partitionBy(group, "range").orderBy("e")
    upto = F.col("c0") + F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    curve = counts.join(sums, [group, "range"]).withColumn("upto", upto).withColumn("before", F.coalesce(F.lag("e").over(w), F.col("e0")))
    n = F.col("n")
    curve = curve.withColumn("r1", F.col("upto") / n).withColumn("r0", (F.col("upto") - F.col("c")) / n).withColumn("step", 1 / n)
    # from the last error to this one recall rises by one step; the equal ones after it take no width
    inside = F.when(F.col("e") < threshold, (F.col("e") - F.col("before")) * (F.col("r0") + F.col("r0") + F.col("step")) / 2).otherwise(F.lit(0.0))
    parts = curve.groupBy(group).agg(
        F.sum(inside).alias("area"),
        F.max(F.when(F.col("e") < threshold, F.col("e"))).alias("last"),
        F.max(F.when(F.col("e") < threshold, F.col("r1"))).alias("top"),
    )
    tail = (F.lit(threshold) - F.coalesce("last", F.lit(0.0))) * F.coalesce("top", F.lit(0.0))
    return parts.select(group, ((F.col("area") + tail) / threshold).alias("auc"))


def binned_mean(df: DataFrame, x: Column, y: Column, edges: list[float]) -> DataFrame:
    """(bin, lo, hi, mean, n) of y by x in [lo, hi)."""
    index = sum(((x >= e).cast("int") for e in edges), F.lit(0)) - 1
    placed = df.select(index.alias("bin"), y.alias("y")).filter((F.col("bin") >= 0) & (F.col("bin") < len(edges) - 1))
    at = lambda i: F.get(F.array(*[F.lit(float(e)) for e in edges]), i)
    return placed.groupBy("bin").agg(F.avg("y").alias("mean"), F.count("*").alias("n")).select("bin", at(F.col("bin")).alias("lo"), at(F.col("bin") + 1).alias("hi"), "mean", "n")


def bounds(df: DataFrame, group: str, axes: dict[str, Column], valid: Column) -> DataFrame:
    """Least and greatest of each axis over valid rows, 0 without any."""
    aggs = []
    for name, c in axes.items():
        aggs += [F.coalesce(F.min(F.when(valid, c)), F.lit(0.0)).alias(f"{name}_min"), F.coalesce(F.max(F.when(valid, c)), F.lit(0.0)).alias(f"{name}_max")]
    return df.groupBy(group).agg(*aggs)


def latest(log: DataFrame, keys: list[str], value: str, arrival: str) -> DataFrame:
    """The value that arrived last for each key."""
    return log.groupBy(*keys).agg(F.max_by(value, arrival).alias(value))


def complete_latest(log: DataFrame, key: str, metric: str, value: str, arrival: str, wanted: list[str]) -> DataFrame:
    """Keys with a last value for every wanted metric, one column a metric."""
    last = latest(log, [key, metric], value, arrival)
    wide = last.groupBy(key).agg(*[F.max(F.when(F.col(metric) == m, F.col(value))).alias(m) for m in wanted])
    return wide.dropna(subset=wanted)


def telemetry(steps: DataFrame, every: int, flops_per_token: float, flops_per_pair: float, peak: float) -> DataFrame:
    """Tumbling windows of steps: tokens, squared lengths, seconds, tokens a second and the share of peak."""
    w = F.floor(F.col("step") / every)
    out = steps.groupBy(w.alias("window")).agg(F.sum("tokens").alias("tokens"), F.sum("squares").alias("squares"), F.sum("seconds").alias("seconds"))
    work = F.col("tokens") * flops_per_token + F.col("squares") * flops_per_pair
    return out.withColumn("tokens_per_second", F.try_divide("tokens", "seconds")).withColumn("mfu", F.try_divide(work, F.col("seconds") * peak))


def corpus_bleu(df: DataFrame, key: str, prediction: str, references: str, order: int = 4) -> DataFrame:
    """One row (bleu): clipped n-gram precision and brevity penalty of a corpus; words stand between blanks.

    N-grams are rows that are counted by (key, n, gram) and joined with the
    greatest count that any reference has, so long texts cost no more than their
    length.
    """

    def words(t: Column) -> Column:
        return F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        def of_size(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
            found = F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(w, i, F.lit(n)), "\u0001").alias("gram")))
            return F.when(F.size(w) >= n, found).otherwise(F.slice(found, 1, 0))

        return F.concat(*[of_size(n) for n in range(1, order + 1)])

    rows = df.select(F.col(key).alias("key"), words(F.col(prediction)).alias("p"), F.transform(F.col(references), words).alias("refs"))
    sizes = F.transform("refs", lambda r: F.struct(F.abs(F.size(r) - F.size("p")).alias("off"), F.size(r).alias("n")))
    lengths = rows.agg(F.sum(F.size("p")).alias("p_len"), F.sum(F.array_min(sizes)["n"]).alias("r_len"))
    mine = rows.select("key", F.explode(grams(F.col("p"))).alias("g")).groupBy("key", "g.n", "g.gram").agg(F.count("*").alias("c"))
    ref = rows.select("key", F.posexplode("refs").alias("ref", "w")).select("key", "ref", F.explode(grams(F.col("w"))).alias("g"))
    top = ref.groupBy("key", "ref", "g.n", "g.gram").agg(F.count("*").alias("c")).groupBy("key", "n", "gram").agg(F.max("c").alias("most"))
    clipped = mine.join(top, ["key", "n", "gram"], "left").select("n", "c", F.least("c", F.coalesce("most", F.lit(0))).alias("m"))
    logs = clipped.groupBy("n").agg(F.log(F.sum("m") / F.sum("c")).alias("log"), F.sum("m").alias("m"))
    means = logs.agg(F.when((F.count("*") == order) & (F.min("m") > 0), F.avg("log")).alias("log"))
    brevity = F.least(F.lit(0.0), 1 - F.try_divide(F.col("r_len").cast("double"), F.col("p_len")))
    return means.crossJoin(lengths).select(F.coalesce(F.exp(F.col("log") + brevity), F.lit(0.0)).alias("bleu"))  # one row each
