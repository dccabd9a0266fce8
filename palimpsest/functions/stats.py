"""Rank statistics, thresholds and intervals over grouped rows, as windows and aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.relational import total_order


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def midranks(df: DataFrame, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Average rank of ``value`` per group, ties sharing it.

    Ranks come from counts by distinct value, so a value that a third of all rows have is one row of the window.
    """
    keys = list(by)
    counts = df.where(_c(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ranked = total_order(counts, keys, [F.col(value).asc()], "__n", "__upto")
    ranks = ranked.select(*keys, F.col(value), (F.col("__upto") - (F.col("__n") - 1) / 2.0).alias(name))
    return df.join(ranks, [*keys, value], "left")


def auroc(df: DataFrame, score: str, positive: str, by: Sequence[str] = ()) -> DataFrame:
    """P(a positive scores lower than a negative), ties a half; null without both classes. Low means positive."""
    keys = list(by)
    ranked = midranks(df.where(_c(score).isNotNull() & _c(positive).isNotNull()), score, "__rank", keys)
    agg = ranked.groupBy(*keys).agg(F.count_if(_c(positive)).alias("n_pos"), F.count_if(~_c(positive)).alias("n_neg"), F.sum(F.when(_c(positive), F.col("__rank"))).alias("__r"))
    above = F.col("__r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), 1 - above / (F.col("n_pos") * F.col("n_neg")))
    return agg.select(*keys, "n_pos", "n_neg", auc.alias("auroc"))


def _guarded(df: DataFrame, x: str, y: str, keys: list[str], least: int, name: str) -> DataFrame:
    agg = df.where(_c(x).isNotNull() & _c(y).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("__r"), F.stddev_pop(x).alias("__sx"), F.stddev_pop(y).alias("__sy"))
    return agg.select(*keys, "n", F.when((F.col("n") >= least) & (F.col("__sx") > 0) & (F.col("__sy") > 0), F.col("__r") / (F.col("__sx") * F.col("__sy"))).alias(name))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), least: int = 3) -> DataFrame:
    """Correlation of midranks; null with fewer than ``least`` pairs or no variance."""
    keys = list(by)
    pairs = df.where(_c(x).isNotNull() & _c(y).isNotNull())
    return _guarded(midranks(midranks(pairs, x, "__rx", keys), y, "__ry", keys), "__rx", "__ry", keys, least, "spearman")


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = (), least: int = 3) -> DataFrame:
    return _guarded(df, x, y, list(by), least, "pearson")


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct<low, high> of a proportion's Wilson interval; null for n = 0."""
    k, n = _c(k).cast("double"), _c(n).cast("double")
    p = k / n
    d = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.struct(F.greatest(mid - half, F.lit(0.0)).alias("low"), F.least(mid + half, F.lit(1.0)).alias("high")))


def order_statistic(df: DataFrame, value: str, position: Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The value at a 0-based position of each group's rising order; ``position`` is an expression over ``n``.

    Positions are found in cumulative counts by distinct value, not by sorting a group's rows in one task.
    """
    keys = list(by)
    counts = df.where(_c(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    upto = total_order(counts, keys, [F.col(value).asc()], "__n", "__upto")
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("n"))
    placed = upto.crossJoin(F.broadcast(total)) if not keys else upto.join(total, keys)
    hit = placed.where((F.col("__upto") > position) & (F.col("__upto") - F.col("__n") <= position))
    return hit.select(*keys, "n", F.col(value).alias(name))


def nearest_rank(p: float) -> Column:
    """0-based position of the ``p``-th percentile by nearest rank, rounded half to even."""
    return F.least(F.bround(F.lit(p / 100.0) * (F.col("n") - 1)), F.col("n") - 1)


def specificity_position(target: float) -> Column:
    return F.greatest(F.lit(0), F.least(F.bround(F.lit(1 - target) * F.col("n")), F.col("n") - 1))


def threshold_sweep(df: DataFrame, score: str, positive: str, taus: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Per threshold (a score below it is flagged): tp, fp, fn, tn, precision, recall, f1, specificity.

    Null where a denominator is 0; f1 is null where precision or recall is 0. One pass over the rows, a column set per
    threshold, unpivoted after the aggregation.
    """
    keys = list(by)
    pos, s = _c(positive), _c(score)
    counts = [F.struct(F.lit(float(t)).alias("tau"), F.count_if(pos & (s < t)).alias("tp"), F.count_if(~pos & (s < t)).alias("fp"), F.count_if(pos & (s >= t)).alias("fn"), F.count_if(~pos & (s >= t)).alias("tn")) for t in taus]
    wide = df.where(s.isNotNull() & pos.isNotNull()).groupBy(*keys).agg(*[c.alias(f"__{i}") for i, c in enumerate(counts)])
    rows = wide.select(*keys, F.inline(F.array(*[F.col(f"__{i}") for i in range(len(counts))])))
    ratio = lambda a, b: F.when(b > 0, a / b)
    rows = rows.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "specificity": ratio(F.col("tn"), F.col("tn") + F.col("fp"))})
    return rows.withColumn("f1", F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def best_threshold(sweep: DataFrame, least_specificity: float) -> DataFrame:
    """The highest threshold that keeps the specificity."""
    return sweep.where(F.col("specificity") >= least_specificity).agg(F.max("tau").alias("tau"))


def bootstrap_ci(df: DataFrame, value: str, reps: int = 4000, seed: int = 20260917, max_rows: int = 100_000) -> DataFrame:
    """Mean and the 2.5 % and 97.5 % points of ``reps`` resampled means.

    Draws are Poisson(1) weights from a hash of (row, replicate), which approach resampling with replacement and need
    no row numbers: each row carries its weights to one aggregation of ``reps`` sums. Meant for document-level
    differences; the work is rows x reps.
    """
    weighted = df.where(_c(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.xxhash64(*df.columns).alias("k"))
    each = weighted.select("v", "k", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    u = F.pmod(F.xxhash64("k", "rep", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    steps, p, acc = [], 0.36787944117144233, 0.36787944117144233
    for i in range(1, 8):
        steps.append(acc)
        p /= i
        acc += p
    w = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
    means = each.groupBy("rep").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("m"))
    sorted_ = F.array_sort(F.collect_list("m"))  # reps values
    out = means.agg(sorted_.alias("s"))
    mean = weighted.agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
    return mean.crossJoin(F.broadcast(out)).select("n", "mean", F.element_at("s", int(0.025 * reps) + 1).alias("low"), F.element_at("s", int(0.975 * reps) + 1).alias("high"))


def decompose(a_vocabulary: Column, a_words: Column, b_vocabulary: Column, b_words: Column, coefficients: tuple[float, float]) -> Column:
    """Shares of an index change that its two terms have; contributions add up to the change."""
    dv = coefficients[0] * (_c(b_vocabulary) - _c(a_vocabulary))
    dw = coefficients[1] * (_c(b_words) - _c(a_words))
    size = F.abs(dv) + F.abs(dw)
    share = lambda x: F.when(size > 0, 100 * F.abs(x) / size)
    return F.struct(dv.alias("by_vocabulary"), dw.alias("by_words"), (dv + dw).alias("total"), share(dv).alias("share_vocabulary"), share(dw).alias("share_words"))
