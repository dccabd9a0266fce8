"""Queries of rank statistics, thresholds, intervals and reports over labelled documents and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import stats as ST
from palimpsest.functions import text as T
from palimpsest.operators.mining import term_integrity
from palimpsest.plans.inputs import LABELLED, labelled, table
from palimpsest.plans.registry import query

TAUS = [200.0, 500.0, 1000.0, 2000.0, 4000.0]


@query(
    f"""with {LABELLED}, r as (select *, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0 as rk from lab),
a as (select count(*) filter (where quality = 0) as n_pos, count(*) filter (where quality = 1) as n_neg, sum(rk) filter (where quality = 0) as s from r)
select n_pos, n_neg, 1 - (s - n_pos * (n_pos + 1) / 2.0)::double / (n_pos * n_neg) as auroc from a"""
)
def auroc_feature_vs_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether low-quality documents are shorter"""
    return ST.auroc(labelled(spark, sf_dir).withColumn("bad", F.col("quality") == 0), "n_chars", "bad")


@query(
    f"""with {LABELLED}, r as (select *, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0 as rk from lab),
a as (select lang, count(*) filter (where quality = 0) as n_pos, count(*) filter (where quality = 1) as n_neg, sum(rk) filter (where quality = 0) as s from r group by lang)
select lang, n_pos, n_neg, case when n_pos > 0 and n_neg > 0 then 1 - (s - n_pos * (n_pos + 1) / 2.0)::double / (n_pos * n_neg) end as auroc from a"""
)
def auroc_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22 by group"""
    return ST.auroc(labelled(spark, sf_dir).withColumn("bad", F.col("quality") == 0), "n_chars", "bad", ["lang"])


@query("select doc_id, n_chars, (rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0)::double as midrank from documents")
def midranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6"""
    return ST.midranks(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "midrank").select("doc_id", "n_chars", "midrank")


_WORDS = r"w as (select doc_id, lang, n_chars::double as x, len(list_filter(string_split_regex(text, '\s+'), lambda y: y <> ''))::double as y from documents)"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("x"), F.size(T.words("text")).cast("double").alias("y"))


@query(
    f"""with {_WORDS}, r as (select lang, rank() over (partition by lang order by x) + (count(*) over (partition by lang, x) - 1) / 2.0 as a, rank() over (partition by lang order by y) + (count(*) over (partition by lang, y) - 1) / 2.0 as b from w)
select lang, count(*) as n, case when count(*) >= 5 and stddev_pop(a) > 0 and stddev_pop(b) > 0 then corr(a::double, b::double) end as spearman from r group by lang"""
)
def spearman_midrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23"""
    return ST.spearman(_features(spark, sf_dir), "x", "y", ["lang"], 5)


@query(f"with {_WORDS} select lang, count(*) as n, case when count(*) >= 3 and stddev_pop(x) > 0 and stddev_pop(y) > 0 then corr(x, y) end as pearson from w group by lang")
def pearson_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24"""
    return ST.pearson(_features(spark, sf_dir), "x", "y", ["lang"])


@query(
    f"""with {LABELLED}, r as (select lang, n_chars, row_number() over (partition by lang order by n_chars) - 1 as i, count(*) over (partition by lang) as n from lab where quality = 1)
select lang, n, n_chars as tau from r where i = greatest(0, least(round_even(0.05 * n, 0), n - 1))"""
)
def tau_at_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length below which 5 % of good documents lie"""
    return ST.order_statistic(labelled(spark, sf_dir).where("quality = 1"), "n_chars", F.greatest(F.lit(0), F.least(F.bround(F.lit(0.05) * F.col("n")), F.col("n") - 1)), "tau", ["lang"])


_SWEEP = f"""{LABELLED}, t as (select unnest({TAUS}) as tau),
c as (select tau, count(*) filter (where quality = 0 and n_chars < tau) as tp, count(*) filter (where quality = 1 and n_chars < tau) as fp, count(*) filter (where quality = 0 and n_chars >= tau) as fn, count(*) filter (where quality = 1 and n_chars >= tau) as tn from lab, t group by tau),
p as (select *, case when tp + fp > 0 then tp / (tp + fp) end as precision, case when tp + fn > 0 then tp / (tp + fn) end as recall, case when tn + fp > 0 then tn / (tn + fp) end as specificity from c)"""


@query(f"with {_SWEEP} select tau::double as tau, tp, fp, fn, tn, precision, recall, specificity, case when precision > 0 and recall > 0 then 2 * precision * recall / (precision + recall) end as f1 from p")
def threshold_sweep_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15 A16 Q17"""
    return ST.threshold_sweep(labelled(spark, sf_dir).withColumn("bad", F.col("quality") == 0), "n_chars", "bad", TAUS)


@query(f"with {_SWEEP} select max(tau)::double as tau from p where specificity >= 0.5")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest threshold that keeps a specificity"""
    return ST.best_threshold(threshold_sweep_prf(spark, sf_dir), 0.5)


@query(
    f"""with {LABELLED}, g as (select lang, count(*) as n, sum(toxic)::double as k, 1.96::double as z from lab group by lang), c as (select *, k / n as p, 1 + z * z / n as d from g),
m as (select *, (p + z * z / (2 * n)) / d as mid, z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / d as half from c)
select lang, n, k::bigint as k, greatest(mid - half, 0)::double as low, least(mid + half, 1)::double as high from m"""
)
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25 A3"""
    g = labelled(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").cast("long").alias("k"))
    return g.withColumn("w", ST.wilson("k", "n")).select("lang", "n", "k", "w.low", "w.high")


_BUCKET = "case when n_chars < 200 then 0 when n_chars < 1000 then 1 when n_chars < 4000 then 2 else 3 end"


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.when(n < 200, 0).when(n < 1000, 1).when(n < 4000, 2).otherwise(3).alias("bucket"))


@query(
    f"""with r as (select {_BUCKET} as bucket, n_chars, row_number() over (partition by {_BUCKET} order by n_chars) - 1 as i, count(*) over (partition by {_BUCKET}) as n from documents)
select bucket, n, max(n_chars) filter (where i = least(round_even(0.25 * (n - 1), 0), n - 1)) as p25, max(n_chars) filter (where i = least(round_even(0.5 * (n - 1), 0), n - 1)) as p50, max(n_chars) filter (where i = least(round_even(0.75 * (n - 1), 0), n - 1)) as p75 from r group by bucket, n"""
)
def nearest_rank_percentiles_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 A12"""
    rows = _bucketed(spark, sf_dir)
    out = None
    for p in (25, 50, 75):
        one = ST.order_statistic(rows, "n_chars", ST.nearest_rank(p), f"p{p}", ["bucket"])
        out = one if out is None else out.join(one.drop("n"), "bucket")
    return out


@query(
    f"""with r as (select {_BUCKET} as bucket, n_chars, row_number() over (partition by {_BUCKET} order by n_chars) - 1 as i, count(*) over (partition by {_BUCKET}) as n from documents),
q as (select bucket, max(n_chars) filter (where i = least(round_even(0.25 * (n - 1), 0), n - 1)) as a, max(n_chars) filter (where i = least(round_even(0.75 * (n - 1), 0), n - 1)) as b from r group by bucket)
select bucket, count(*) filter (where n_chars > b + 1.5 * (b - a)) as above, count(*) filter (where n_chars < a - 1.5 * (b - a)) as below from r join q using (bucket) group by bucket"""
)
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13 Q8"""
    rows = _bucketed(spark, sf_dir)
    q = ST.order_statistic(rows, "n_chars", ST.nearest_rank(25), "a", ["bucket"]).drop("n").join(ST.order_statistic(rows, "n_chars", ST.nearest_rank(75), "b", ["bucket"]).drop("n"), "bucket")
    fence = 1.5 * (F.col("b") - F.col("a"))
    return rows.join(q, "bucket").groupBy("bucket").agg(F.count_if(F.col("n_chars") > F.col("b") + fence).alias("above"), F.count_if(F.col("n_chars") < F.col("a") - fence).alias("below"))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean order value by customer segment's region, resampled (a hash, no portable random stream)"""
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("value"))
    return ST.bootstrap_ci(per, "value", reps=1000)


@query("select user_id % 4 as grp, max(avg_v) as highest, min(avg_v) as lowest, avg(avg_v) as mean, count(avg_v) as n, sum(coalesce(avg_v, 0)) as total from (select user_id, avg(value) as avg_v from events group by user_id) group by user_id % 4")
def null_aware_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 A2 A29"""
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("v"))
    return u.groupBy((F.col("user_id") % 4).alias("grp")).agg(F.max("v").alias("highest"), F.min("v").alias("lowest"), F.avg("v").alias("mean"), F.count("v").alias("n"), F.sum(F.coalesce("v", F.lit(0.0))).alias("total"))


@query("with c as (select user_id, event_type, count(*) as n from events group by 1, 2), m as (select user_id, max(n) as most from c group by user_id) select c.user_id, min(event_type) as event_type, most as n from c join m on c.user_id = m.user_id and c.n = m.most group by c.user_id, most")
def most_common_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties go to the first by name"""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.max(F.struct("n", (-F.ascii("event_type")).alias("o"), "event_type")).alias("x")).select("user_id", "x.event_type", "x.n")


@query(f"with {LABELLED} select source, avg(n_chars) filter (where quality = 1) as good, avg(n_chars) filter (where quality = 0) as bad from lab group by source")
def route_metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 Q21"""
    rows = labelled(spark, sf_dir).withColumn("kind", F.when(F.col("quality") == 1, "good").otherwise("bad"))
    return rows.groupBy("source").pivot("kind", ["good", "bad"]).agg(F.avg("n_chars"))


@query(
    """with r as (select o_custkey as k, o_orderpriority as p, avg(o_totalprice) as x from orders group by 1, 2), a as (select k, x from r where p = '1-URGENT'), b as (select k, x from r where p = '5-LOW')
select a.k as custkey, b.x - a.x as delta, case when b.x > a.x then 'b' when b.x < a.x then 'a' else 'tie' end as better from a join b using (k)"""
)
def paired_route_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 A21 Q3"""
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.avg("o_totalprice"))
    r = r.where("`1-URGENT` is not null and `5-LOW` is not null").withColumn("delta", F.col("5-LOW") - F.col("1-URGENT"))
    return r.select("custkey", "delta", F.when(F.col("delta") > 0, "b").when(F.col("delta") < 0, "a").otherwise("tie").alias("better"))


@query(
    """with r as (select o_custkey as k, avg(o_totalprice) filter (where o_orderpriority = '1-URGENT') as a, avg(o_totalprice) filter (where o_orderpriority = '5-LOW') as b from orders group by 1)
select count(*) as n, avg((a < b)::int)::double as win_rate from r where a is not null and b is not null"""
)
def paired_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21"""
    return paired_route_delta(spark, sf_dir).agg(F.count("*").alias("n"), F.avg((F.col("delta") > 0).cast("double")).alias("win_rate"))


@query(
    f"""with {LABELLED}, m as (select source, avg(n_chars) as a, avg(quality) as b from lab group by source)
select source, row_number() over (order by a desc, source)::int as rank_a, row_number() over (order by b desc, source)::int as rank_b from m"""
)
def rank_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O8 (one row per source)"""
    m = labelled(spark, sf_dir).groupBy("source").agg(F.avg("n_chars").alias("a"), F.avg("quality").alias("b"))
    rank = lambda c: F.row_number().over(Window.orderBy(F.col(c).desc(), "source"))
    return m.select("source", rank("a").alias("rank_a"), rank("b").alias("rank_b"))


@query(
    """with d as (select source, avg(n_chars) as mean_len, count(*) as n from documents group by source) select count(*) as n, case when count(*) >= 3 and stddev_pop(n) > 0 and stddev_pop(mean_len) > 0 then corr(n::double, mean_len::double) end as confound from d"""
)
def chunk_confound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A33"""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.avg("n_chars").alias("m"), F.count("*").cast("double").alias("c"))
    return ST.pearson(d, "c", "m").withColumnRenamed("pearson", "confound")


@query("select lang, avg(n_chars) filter (where n_chars >= 2000) - avg(n_chars) filter (where n_chars < 2000) as gap, case when count(*) filter (where n_chars >= 2000) > count(*) filter (where n_chars < 2000) then 'mostly long' else 'mostly short' end as verdict from documents group by lang")
def size_split_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A31 A34"""
    n = F.col("n_chars")
    gap = F.avg(F.when(n >= 2000, n)) - F.avg(F.when(n < 2000, n))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(gap.alias("gap"), F.when(F.count_if(n >= 2000) > F.count_if(n < 2000), "mostly long").otherwise("mostly short").alias("verdict"))


@query(
    """with a as (select lang, avg(n_chars)::double as x, count(*)::double as y from documents group by lang), b as (select max(x) as x0, max(y) as y0 from a)
select lang, -0.261::double * (x0 - x) as by_vocabulary, -1.045::double * (y0 - y) as by_words, -0.261::double * (x0 - x) + -1.045::double * (y0 - y) as total,
  case when abs(0.261 * (x0 - x)) + abs(1.045 * (y0 - y)) > 0 then 100 * abs(0.261::double * (x0 - x)) / (abs(0.261::double * (x0 - x)) + abs(1.045::double * (y0 - y))) end as share_vocabulary from a, b"""
)
def index_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A28 Q20"""
    a = table(spark, sf_dir, "documents").groupBy("lang").agg(F.avg("n_chars").alias("x"), F.count("*").cast("double").alias("y"))
    both = a.crossJoin(F.broadcast(a.agg(F.max("x").alias("x0"), F.max("y").alias("y0"))))
    rows = both.withColumn("d", ST.decompose("x", "y", "x0", "y0", (T.INDEX_VOCABULARY, T.INDEX_WORDS)))
    return rows.select("lang", "d.by_vocabulary", "d.by_words", "d.total", "d.share_vocabulary")


@query("with t as (select lang, count(*) as total, count(*) filter (where n_chars > 1000) as kept, count(*) filter (where n_chars between 500 and 1000) as eq, count(*) filter (where n_chars < 100) as und from documents group by lang) select lang, 100.0::double * kept / total as conservative, 100.0::double * (kept + eq) / total as adjudicated, 100.0::double * (kept + eq + und) / total as upper from t")
def term_integrity_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A27 Q11"""
    n = F.col("n_chars")
    t = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("total"), F.count_if(n > 1000).alias("kept"), F.count_if(n.between(500, 1000)).alias("eq"), F.count_if(n < 100).alias("und"))
    return t.withColumn("i", term_integrity(F.col("kept"), F.col("eq"), F.col("und"), F.col("total"))).select("lang", "i.conservative", "i.adjudicated", "i.upper")


@query(r"select source, count(distinct lower(w)) as types, count(*) as tokens, count(*) filter (where length(w) > 6) as long_tokens from (select source, unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from documents) group by source")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A30 A4"""
    t = table(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    return t.groupBy("source").agg(F.count_distinct(F.lower("w")).alias("types"), F.count("*").alias("tokens"), F.count_if(F.length("w") > 6).alias("long_tokens"))


@query("with c as (select l_suppkey, l_returnflag, count(*) as n from lineitem group by 1, 2) select l_returnflag, count(*) as groups, max(n) as most, min(n) as least, avg(n) as mean from c group by l_returnflag")
def segment_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 A29"""
    c = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return c.groupBy("l_returnflag").agg(F.count("*").alias("groups"), F.max("n").alias("most"), F.min("n").alias("least"), F.avg("n").alias("mean"))
