"""The thin queries over the operators, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, line_dedup, mixing, packing, secret_scan, simhash, topk_search, toxicity, url_filter, warc
from palimpsest.storage import fresh_path

URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), carry=["doc_id", "source"]).select("doc_id", "source", "size", "source_size", "target", "taken")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(secret_scan.scan_secrets(_table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.withColumn("held_out", toxicity.fold(F.col("doc_id")) == 0), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.remove_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return clean.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("clean_chars"), F.md5("text").alias("clean_md5"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    path = fresh_path(spark, "warc")
    warc.write_warc(pages, path)
    records = warc.read_warc(spark, path)
    kind = pages.schema["page_id"].dataType
    return records.select(F.col("id").cast(kind).alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers").cast(kind).alias("refers_to"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_secret_scan, op3_toxicity, op4_line_dedup, op5_pack, op6_simhash, op7_warc, op8_topk_search, op9_exact_dedup, op10_url_filter)
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')), 1, 12))::bigint as h
  from documents),
s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as r,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w
  from d group by source),
l as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(2.0::double * source_size) over (order by 2.0::double * source_size / w, r rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by 2.0::double * source_size / w, r rows between current row and unbounded following) as level from s),
m as (select max(level) as level from l),
t as (
  select l.source, source_size, least(2.0::double * source_size, m.level * w) as target from l, m),
b as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from t),
g as (select source, h, sum(size)::bigint as mass from d group by source, h),
c as (select source, h, mass, sum(mass) over (partition by source order by h) as upto from g),
p as (
  select c.source, c.h, (case when upto <= target - whole * source_size then 1
     when upto - mass <= target - whole * source_size and mass > 0 and 2 * (target - whole * source_size - (upto - mass)) >= mass then 1 else 0 end) as more
  from c join b on c.source is not distinct from b.source)
select d.doc_id, d.source, d.size::bigint as size, b.source_size, b.target, (d.size * (b.whole + p.more))::bigint as taken
from d join b on d.source is not distinct from b.source join p on d.source is not distinct from p.source and d.h = p.h
""",
    "op2_secret_scan": secret_scan.SQL,
    "op4_line_dedup": r"""
with d as (select row_number() over () as rid, doc_id, source, text from documents),
l as (select rid, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from d where text is not null),
k as (select rid, source, line, pos, regexp_replace(line, '^[\x20\t\r]+|[\x20\t\r]+\z', '', 'g') as bare from l),
bad as (select bare from k where source is not null and bare <> '' group by bare having count(distinct source) >= 4),
r as (select rid, count(*) as n_lines, count(*) filter (where bare in (from bad)) as n_removed,
  coalesce(string_agg(line, chr(10) order by pos) filter (where bare not in (from bad)), '') as clean from k group by rid)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, length(clean)::bigint as clean_chars, md5(clean) as clean_md5
from d left join r using (rid)
""",
    "op7_warc": """
with p as (select page_id, coalesce(html, '') as body from pages),
g as (select body, max(page_id) as largest from p group by body),
h as (select page_id, strlen(body)::bigint as n, sha1(body) as hexed, case when page_id <> largest or page_id is null and largest is not null then largest end as refers from p join g using (body))
select page_id, n as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hexed, 5 * (i // 4)::int + 1, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), '') as payload_digest,
  case when refers is null then 'response' else 'revisit' end as record_type, refers as refers_to
from h
""",
    "op8_topk_search": """
with v as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.rid, q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e)::bigint as score from v q join v on q.rid <> v.rid where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by rid order by score desc, vec_id) as n from s)
select query_id, n::int as rank, vec_id, score from r where n <= 5
""",
    "op9_exact_dedup": """
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as t from documents),
g as (select t, min(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size::bigint as group_size, row_number() over (partition by d.t order by doc_id nulls last) = 1 as kept, sha256(d.t) as text_sha256 from d join g using (t)
""",
    "op10_url_filter": """
with p as (select page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
l as (select page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from p),
r as (select * from (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) as r(rule_host, rule_path, verdict)),
m as (select page_id, host, path, (select arg_max(struct_pack(rule := rule_host || rule_path, verdict := r.verdict), length(rule_host || rule_path) * 1000 + length(rule_host)) from r
  where (l.host = rule_host or ends_with(l.host, '.' || rule_host)) and starts_with(l.path, rule_path)) as x from l)
select page_id, host, path, x.rule as rule, coalesce(x.verdict, 'allow') as verdict from m
""",
}
