"""Queries over relational shapes: islands, sections, as-of joins, samples, mining, caches and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import spans as SP
from palimpsest.functions import text as T
from palimpsest.functions.profiles import LATIN
from palimpsest.operators import mining as MI
from palimpsest.operators import models as MO
from palimpsest.operators import relational as R
from palimpsest.plans import document_schema as DS
from palimpsest.plans.inputs import SENTS, doc_sentences, table
from palimpsest.plans.registry import query
from palimpsest.sources.files import review_sheet, union_latest
from palimpsest.streaming import incremental as I

_KIND = "case when length(trim(x)) = 0 then 'blank' when length(x) > 200 then 'long' else 'short' end"


@query(
    f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents),
k as (select doc_id, line, {_KIND} as kind from l), k2 as (select * from k where kind <> 'blank'),
c as (select *, case when lag(kind) over w is distinct from kind then 1 else 0 end as ch from k2 window w as (partition by doc_id order by line)),
b as (select doc_id, kind, sum(ch) over (partition by doc_id order by line) as block from c)
select doc_id, block::bigint as block, kind, count(*) as lines from b group by doc_id, block, kind"""
)
def line_class_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 D9"""
    x = F.col("x")
    kind = F.when(F.length(F.trim(x)) == 0, "blank").when(F.length(x) > 200, "long").otherwise("short")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "x")).select("doc_id", "line", kind.alias("kind")).where("kind <> 'blank'")
    return R.islands(lines, ["doc_id"], "line", "kind").groupBy("doc_id", "block", "kind").agg(F.count("*").alias("lines"))


@query(
    r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as line from documents),
n as (select *, length(x) % 7 = 0 as head from l), s as (select *, sum(head::int) over (partition by doc_id order by line) as sec from n),
t as (select doc_id, sec, max(trim(x)) filter (where head) as title, coalesce(string_agg(trim(x), ' ' order by line) filter (where not head and trim(x) <> ''), '') as body from s where sec > 0 group by doc_id, sec),
k as (select *, row_number() over (partition by doc_id order by sec) - 1 as sec_idx from t where trim(body) <> '')
select doc_id, sec_idx::int as sec_idx, md5(title) as title, md5(body) as body from k"""
)
def section_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose length divides by 7 stand for headings"""
    marked = F.transform(F.split("text", "\n", -1), lambda x: F.when(F.length(x) % 7 == 0, F.concat(F.lit("\u0001H"), x)).otherwise(x))
    sections = R.forward_fill_sections(marked, "(?s)^(\u0001H)(.*)$")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sections).alias("sec_idx", "s"))
    return rows.select("doc_id", "sec_idx", F.md5("s.title").alias("title"), F.md5("s.body").alias("body"))


@query(
    """with p as (select user_id, event_id, ts from events where event_type = 'click'), b as (select user_id, ts from events where event_type = 'error')
select p.user_id, p.event_id, (select min(b.ts) from b where b.user_id = p.user_id and b.ts >= p.ts) as boundary from p"""
)
def asof_forward_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first error at or after each click of a user"""
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'click'").select("user_id", "event_id", "ts")
    right = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("boundary"))
    return R.asof_forward(left, right, ["user_id"], "ts", "boundary").select("user_id", "event_id", "boundary")


@query(
    """with e as (select user_id, event_id, floor(epoch(ts))::bigint as s, event_type from events)
select a.user_id, a.event_id as l_event_id, b.event_id as r_event_id from e a join e b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'purchase' and abs(a.s - b.s) <= 600"""
)
def interval_join_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and purchases of a user within ten minutes"""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), "event_type")
    of = lambda k: e.where(F.col("event_type") == k).drop("event_type")
    return R.interval_join(of("click"), of("purchase"), ["user_id"], "s", "s", 600).select("user_id", "l_event_id", "r_event_id")


@query(
    """with t as (select lang, source, doc_id, row_number() over (partition by lang, source order by doc_id) as turn from documents),
r as (select lang, source, doc_id, row_number() over (partition by lang order by turn, source) as n from t where turn <= 40) select lang, source, doc_id from r where n <= 40"""
)
def balanced_round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 documents of each language, sources in turn"""
    return R.balanced_sample(table(spark, sf_dir, "documents").select("lang", "source", "doc_id"), ["lang"], "source", 40, order=[F.col("doc_id")])


@query()
def stratified_blind_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O5 O6 S14 (seeded by a hash that DuckDB lacks)"""
    sheet, key = review_sheet(table(spark, sf_dir, "documents"), F.col("n_chars") > 5000, 40, 7, ["lang", "n_chars"], ["doc_id"])
    return sheet.join(key, "no").select("no", "doc_id", "group", "lang", "n_chars")


@query("with g as (select doc_id, r.route from documents cross join (values ('a'), ('b'), ('c')) r(route)), done as (select doc_id, case when doc_id % 3 = 0 then 'a' else 'b' end as route from documents) select doc_id, route from g where not exists (select 1 from done d where d.doc_id = g.doc_id and d.route = g.route)")
def work_grid_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J24 T2"""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    grid = docs.select("doc_id", F.explode(F.array(*map(F.lit, "abc"))).alias("route"))
    return R.anti_todo(grid, docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b").alias("route")), ["doc_id", "route"])


@query(
    """with w as (select doc_id, left(sha256(concat('v2', chr(0), text, chr(0))), 12) as h from documents),
c as (select doc_id, case when doc_id % 4 = 0 then 'old' else h end as h, case when doc_id % 5 = 0 then 'failed' else 'ok' end as status from w)
select w.doc_id, w.h as input_hash from w where not exists (select 1 from c where c.doc_id = w.doc_id and c.h = w.h and c.status <> 'failed')"""
)
def stage_cache_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose cached stage result is missing, failed or of another input"""
    wanted = I.with_stage_hash(table(spark, sf_dir, "documents").select("doc_id", "text"), "simplify", "v2", "text").drop("text")
    cache = wanted.withColumn("input_hash", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("input_hash"))).withColumn("status", F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("ok"))
    return I.stale(wanted, cache, ["doc_id"]).select("doc_id", "input_hash")


#: What is wrong with the document made for a doc_id, by doc_id % 13.
_FAULTS = {
    0: ["missing: source"], 1: ["schema_version differs: 0.9"], 2: ["unknown status: created"], 3: ["translations lacks vi"], 4: ["mt_validation lacks en"],
    5: ["glossary.n_insertions and the length of insertions differ"], 6: ["glossary.n_skipped and the length of skipped differ"], 7: ["integrity.n_blanks and the length of blanks differ"],
    8: ["source.meta.status is wrong: bad"], 9: ["simplified.meta lacks stage"], 10: ["missing: pipeline", "missing: display"], 11: ["translations.ja.meta lacks input_hash"],
}
_FAULTS_SQL = "case doc_id % 13 " + " ".join("when {} then [{}]".format(k, ", ".join(f"'{x}'" for x in v)) for k, v in _FAULTS.items()) + " else [] end"


def _made_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of the schema per row of documents, good but for what _FAULTS says."""
    is_ = lambda k: F.col("id") % 13 == k
    meta = lambda status="ok", stage="s", hashed="h": F.struct(*[x.cast("string").alias(k) for k, x in (("stage", F.lit(stage) if isinstance(stage, str) else stage), ("stage_version", F.lit("1")), ("input_hash", F.lit(hashed) if isinstance(hashed, str) else hashed), ("status", F.lit(status) if isinstance(status, str) else status), ("computed_at", F.lit("t")))])
    kind = {f.name: f.dataType for f in DS.DOCUMENT.fields}

    def block(name: str, **own: Column) -> Column:
        return F.struct(*[own.get(g.name, F.lit(None)).cast(g.dataType).alias(g.name) for g in kind[name].fields])

    def by_lang(name: str, without: str, when: Column, own: dict[str, Column]) -> Column:
        value = lambda x: F.struct(*[(own.get(x, meta()) if g.name == "meta" else F.lit(None)).cast(g.dataType).alias(g.name) for g in kind[name].valueType.fields])
        entry = lambda x: F.struct(F.lit(x).alias("key"), value(x).alias("value"))
        every, fewer = (F.map_from_entries(F.array(*[entry(x) for x in DS.LANGS if x not in out])) for out in ((), (without,)))
        return F.when(when, fewer).otherwise(every)

    none, zero = F.array(), F.lit(0)
    extra = lambda k: F.when(is_(k), 1).otherwise(0)
    made = {
        "schema_version": F.when(is_(1), "0.9").otherwise(DS.SCHEMA_VERSION),
        "doc_id": F.lit("x"),
        "status": F.when(is_(2), "created").otherwise("partial"),
        "pipeline": F.when(~is_(10), F.struct(*[F.lit(None).cast(g.dataType).alias(g.name) for g in kind["pipeline"].fields])),
        "source": F.when(~is_(0), block("source", text=F.col("text"), meta=meta(F.when(is_(8), "bad").otherwise("ok")))),
        "integrity": block("integrity", blanks=none, n_blanks=extra(7), meta=meta()),
        "simplified": block("simplified", meta=meta(stage=F.when(~is_(9), "s"))),
        "glossary": block("glossary", insertions=none, skipped=none, n_insertions=extra(5), n_skipped=extra(6), meta=meta()),
        "ko_validation": block("ko_validation", n_halluc=zero, meta=meta()),
        "simplicity": block("simplicity"),
        "translations": by_lang("translations", "vi", is_(3), {"ja": meta(hashed=F.when(~is_(11), "h"))}),
        "mt_validation": by_lang("mt_validation", "en", is_(4), {}),
        "display": F.when(~is_(10), block("display", korean_simple=F.when(F.length("text") > 500, F.col("text")))),
    }
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").select("id", *[made[f.name].alias(f.name) for f in DS.DOCUMENT.fields])


@query(f"select doc_id, {_FAULTS_SQL} as errors from documents")
def schema_validate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each check fires for some documents"""
    return _made_documents(spark, sf_dir).select(F.col("id").alias("doc_id"), DS.validation_errors().alias("errors"))


@query(
    f"""with d as (select doc_id, coalesce(length(text), 0) as n, {_FAULTS_SQL} as plain from documents)
select doc_id, list_sort(case when doc_id % 13 in (0, 10) then plain else list_concat(list_concat(plain, case doc_id % 13 when 3 then ['simplicity.meta is empty', 'translations.vi.meta is empty'] when 4 then ['simplicity.meta is empty', 'mt_validation.en.meta is empty'] else ['simplicity.meta is empty'] end),
  list_concat(case when n = 0 then ['source.text is empty'] else [] end, case when n <= 500 then ['display.korean_simple is empty'] else [] end)) end) as errors from d"""
)
def schema_validate_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not filled in yet counts as well"""
    return _made_documents(spark, sf_dir).select(F.col("id").alias("doc_id"), F.array_sort(DS.validation_errors(strict=True)).alias("errors"))


@query("with s as (select doc_id, unnest(['extract', 'simplify']) as stage from documents), t as (select doc_id, stage, case when doc_id % 10 = 0 and stage = 'extract' then 'failed' when doc_id % 3 = 0 and stage = 'simplify' then 'pending' else 'ok' end as status from s) select doc_id, case when bool_or(status = 'failed') then 'failed' when count(*) filter (where status = 'ok') = 2 then 'complete' else 'partial' end as status from t group by doc_id")
def document_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A35"""
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit("extract"), F.lit("simplify"))).alias("stage"))
    status = F.when((F.col("doc_id") % 10 == 0) & (F.col("stage") == "extract"), "failed").when((F.col("doc_id") % 3 == 0) & (F.col("stage") == "simplify"), "pending").otherwise("ok")
    return DS.rollup_status(s.withColumn("status", status), "doc_id", ["extract", "simplify"])


@query("select coalesce(l_returnflag, 'total') as l_returnflag, coalesce(l_linestatus, 'total') as l_linestatus, count(*) as n, sum(l_quantity) as quantity from lineitem group by rollup (l_returnflag, l_linestatus)")
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with total rows"""
    r = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    return r.select(F.coalesce("l_returnflag", F.lit("total")).alias("l_returnflag"), F.coalesce("l_linestatus", F.lit("total")).alias("l_linestatus"), "n", "quantity")


@query("select doc_id, lang, quality, n_chars, quality as x from (select doc_id, lang, n_chars, case when l.quality is null then d.doc_id % 2 else l.quality end as quality from documents d left join labels l using (doc_id))")
def union_latest_overwrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two tables by key, the later one wins where it has a row"""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    first = d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    merged = union_latest([first, table(spark, sf_dir, "labels").join(d.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("quality").cast("int"))], "doc_id")
    return d.join(merged, "doc_id").select("doc_id", "lang", "quality", "n_chars", F.col("quality").alias("x"))


@query("select doc_id, case lower(trim(v)) when 'yes' then true when 'no' then false end as equivalent, coalesce(case lower(trim(v)) when 'yes' then true when 'no' then false end, false) as counted from (select doc_id, case doc_id % 3 when 0 then ' Yes' when 1 then 'NO' else ' ' end as v from labels)")
def tri_state_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13"""
    v = F.when(F.col("doc_id") % 3 == 0, " Yes").when(F.col("doc_id") % 3 == 1, "NO").otherwise(" ")
    state = F.when(F.lower(F.trim(v)).isin("yes", "y", "true", "1"), True).when(F.lower(F.trim(v)).isin("no", "n", "false", "0"), False)
    return table(spark, sf_dir, "labels").select("doc_id", state.alias("equivalent"), F.coalesce(state, F.lit(False)).alias("counted"))


@query("with a as (select c_nationkey as k, count(*) as a from customer where c_nationkey < 15 group by 1), b as (select s_nationkey as k, count(*) as b from supplier where s_nationkey > 5 group by 1) select k, coalesce(a, 0) as a, coalesce(b, 0) as b, case when a is not null and b is not null then 'both' when a is not null then 'a' else 'b' end as side from a full join b using (k)")
def full_outer_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16"""
    a = table(spark, sf_dir, "customer").where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("a"))
    b = table(spark, sf_dir, "supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("b"))
    side = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("a").isNotNull(), "a").otherwise("b")
    return a.join(b, "k", "full").select("k", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"), side.alias("side"))


def _words(t: str) -> Column:
    """Words of 4 to 10 letters."""
    return F.regexp_extract_all(t, F.lit("[A-Za-zÀ-ÖØ-öø-ÿ]{4,10}"), F.lit(0))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, word): words of 4 to 10 letters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(_words("text")).alias("pos", "word"))


_TOK = "tok as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos from (select doc_id, regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]{4,10}') as w from documents))"


@query(f"with {_TOK}, c as (select doc_id, word, count(*) as n, min(pos) as f from tok where word not in ('with', 'that', 'this', 'from') group by doc_id, word), r as (select doc_id, word, n, row_number() over (partition by doc_id order by length(word) desc, n desc, f) as rank from c) select doc_id, word, n, rank::int as rank from r where rank <= 20")
def top_terms_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2 O4 P11"""
    tokens = _tokens(spark, sf_dir).where(~F.col("word").isin(*sorted(LATIN.stop_words)))
    return MI.top_terms(tokens, "doc_id", "word", "pos", 20).select("doc_id", "word", "n", "rank")


@query(f"with {_TOK} select word, count(distinct doc_id) as docs, count(*) as occurrences from tok group by word having count(distinct doc_id) >= 5")
def doc_frequency_min_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5"""
    return MI.document_frequency(_tokens(spark, sf_dir), "doc_id", "word", 5)


_TERMS = ("the", "and", "for", "with")


@query(
    r"""with t as (select doc_id, term, regexp_extract_all(' ' || text, '[^A-Za-zÀ-ÖØ-öø-ÿ]' || term || '(?:ing|es|ed|s)?') as hits from documents cross join (values ('with'), ('for'), ('and'), ('the')) v(term)),
u as (select doc_id, term, text from documents cross join (values ('with'), ('for'), ('and'), ('the')) v(term)),
g as (select doc_id, term, regexp_replace(text, '([A-Za-zÀ-ÖØ-öø-ÿ])' || term, '\1#', 'g') as masked from u)
select doc_id, term, (len(regexp_extract_all(masked, term || '(?:s|es|ed|ing)')) + len(regexp_extract_all(masked || ' ', term || '[^A-Za-zÀ-ÖØ-öø-ÿ]')))::bigint as n from g
where len(regexp_extract_all(masked, term || '(?:s|es|ed|ing)')) + len(regexp_extract_all(masked || ' ', term || '[^A-Za-zÀ-ÖØ-öø-ÿ]')) > 0"""
)
def term_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 W7"""
    of = lambda xs: F.array(*[F.struct(F.lit(k).alias("term"), F.size(F.filter(xs, lambda x: x["kind"] == k)).cast("long").alias("n")) for k in _TERMS])
    counts = T.let(SP.term_occurrences("text", _TERMS, runs=True), of)
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(counts)).where("n > 0")


@query()
def first_occurrence_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First occurrences outside brackets"""
    rows = table(spark, sf_dir, "documents").select("doc_id", SP.bracket_marks("text").alias("marks"), F.explode(SP.term_occurrences("text", _TERMS)).alias("x"))
    outside = rows.where(SP.depth_at(F.col("marks"), F.col("x.s")) == 0)
    return outside.groupBy("doc_id", F.col("x.kind").alias("term")).agg(F.min("x.s").alias("first"))


@query(
    """with p as (select doc_id, text, length(regexp_replace(text, '[^()]', '', 'g')) as n from documents)
select doc_id, n::int as brackets from p"""
)
def bracket_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9 input"""
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.regexp_replace("text", "[^()]", "")).alias("brackets"))


_GRAMS = "g as (select distinct conv_id || ':' || turn as pair, lower(unnest(regexp_extract_all(text, '[A-Za-z]{5,8}'))) as cand from conversations where role = 'assistant'), t as (select distinct conv_id || ':' || turn as pair, lower(unnest(regexp_extract_all(text, '[A-Za-z]{3,4}'))) as term from conversations where role = 'assistant')"


def _mined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("pair", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    of = lambda n, name: rows.select("pair", F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z]{{{n}}}"), F.lit(0))).alias("w")).select("pair", F.lower("w").alias(name)).distinct()
    return of("3,4", "term"), of("5,8", "cand")


@query(
    f"""with {_GRAMS}, n as (select count(distinct pair) as n from (select pair from g union select pair from t)), bg as (select cand, count(*) as bg from g group by cand), per as (select term, count(*) as nt from t group by term),
j as (select term, cand, count(*) as support from t join g using (pair) group by term, cand having count(*) >= 3),
s as (select term, cand, support, (support / nt) / (bg / n) as ratio from j join bg using (cand) join per using (term), n),
r as (select *, row_number() over (partition by term order by ratio desc, support desc, cand desc) as k from s where ratio >= 2)
select term, cand, support, ratio, case when support >= 2 then 'B' else 'C' end as grade from r where k = 1"""
)
def cooccurrence_ratio_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19 Q15"""
    terms, grams = _mined(spark, sf_dir)
    pairs = terms.select("pair").union(grams.select("pair"))
    return MI.background_ratio(pairs, terms, "pair", "term", "cand", grams, 3, 2.0)


@query()
def substring_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20 J17 (an ordered fold against what is kept)"""
    terms, grams = _mined(spark, sf_dir)
    return MI.cooccurrence_candidates(terms, grams, "pair", "term", "cand", 3, 0.2)


@query(
    f"""with {_TOK}, t as (select distinct doc_id, word from tok where length(word) >= 6), p as (select distinct doc_id, lower(word) as other from tok),
h as (select t.doc_id, word, other, row_number() over (partition by t.doc_id, word order by length(other) desc, other) as k from t join p on t.doc_id = p.doc_id and (contains(other, word) or contains(word, other)) and other <> word and length(other) >= 3)
select doc_id, word, other as variant from h where k = 1"""
)
def longest_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18, within each document"""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(_words("text")).alias("words"))
    rows = docs.select("doc_id", F.filter("words", lambda w: F.length(w) >= 6).alias("terms"), F.array_distinct(F.transform("words", F.lower)).alias("pool"))
    return MI.longest_variant(rows, "doc_id", "terms", "pool")


@query("with u as (select n_name as term, 'nation' as s from nation union all select r_name, 'region' from region union all select distinct c_mktsegment, 'customer' from customer) select term, list_sort(list(distinct s)) as sources from u group by term")
def pool_with_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 A18"""
    parts = [("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment")]
    return MI.union_with_sources([(t, table(spark, sf_dir, t).select(F.col(c).alias("term"))) for t, c in parts], "term")


@query(f"with {SENTS}, c as (select lang, text, count(*) as n from sents group by lang, text) select lang, count(*) filter (where n > 1) as repeated, coalesce(sum(n - 1), 0)::bigint as surplus from c group by lang")
def multiset_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U6"""
    c = doc_sentences(spark, sf_dir).groupBy("lang", "text").agg(F.count("*").alias("n"))
    return c.groupBy("lang").agg(F.count_if(F.col("n") > 1).alias("repeated"), F.sum(F.col("n") - 1).alias("surplus"))


@query("select doc_id, row_number() over (partition by source order by length(doc_id::varchar), doc_id)::int as n from documents qualify n <= 5")
def per_group_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O4 O1"""
    w = Window.partitionBy("source").orderBy(F.length(F.col("doc_id").cast("string")), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.row_number().over(w).alias("n")).where("n <= 5")


@query()
def spatial_nearest_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes derived from embeddings, ten to a page, paired greedily"""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("page"), F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 2 == 0, "foreign").otherwise("native").alias("kind"), (F.abs(F.col("embedding")[0]) * 400).cast("double").alias("x0"), (F.col("vec_id") % 10 * 60).cast("double").alias("y0"))
    return R.spatial_nearest_greedy(e.withColumns({"x1": F.col("x0") + 100, "y1": F.col("y0") + 30}), "page")


@query(
    """with w as (select vec_id // 20 as page, (vec_id % 20)::double as x, (vec_id % 7)::double as y, 'w' || vec_id as word from embeddings), l as (select page, (round_even(y / 3.0, 0))::double as line, x, word from w)
select page, line, string_agg(word, ' ' order by x, word) as text from l group by page, line"""
)
def lines_from_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12"""
    e = table(spark, sf_dir, "embeddings")
    return R.lines_from_words(e.select(F.floor(F.col("vec_id") / 20).alias("page"), (F.col("vec_id") % 20).cast("double").alias("x"), (F.col("vec_id") % 7).cast("double").alias("y"), F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word")), "page")


@query("select vec_id // 20 as page, vec_id, row_number() over (partition by vec_id // 20 order by round_even((vec_id % 7) / 2.0, 0), vec_id % 20)::int as position from embeddings")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13"""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("page"), "vec_id", ((F.col("vec_id") % 7) / 2.0).alias("y0"), (F.col("vec_id") % 20).alias("x0"))
    return R.reading_order(e, "page").select("page", "vec_id", "position")


@query("with v as (select 'text' as c, text as v from documents union all select 'source', source || ' name' from documents) select c as column, count(*) as n, avg(len(regexp_extract_all(v, '[A-Za-z]'))::double / length(v)) as letter_ratio, avg(length(v)) as mean_length from v where length(v) >= 8 group by c having count(*) >= 5")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17 over all values"""
    docs = table(spark, sf_dir, "documents")
    return R.column_profile(docs.select("text", F.concat("source", F.lit(" name")).alias("source")), ["text", "source"], "[A-Za-z]", sample=None)


@query()
def rule_based_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate terms by rule, with how many documents have them"""
    return MO.rule_terms(table(spark, sf_dir, "documents"), "doc_id", "text", LATIN).groupBy("term").agg(F.count("*").alias("docs")).where("docs >= 5")


@query("select l_orderkey, array_to_string(list(l_linenumber || ':' || l_quantity::int order by l_linenumber, l_quantity), ',') as lines from lineitem group by l_orderkey")
def ordered_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a document joined in order"""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("x"))
    return rows.select("l_orderkey", F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["l_linenumber"].cast("string"), r["q"].cast("string"))), ",").alias("lines"))


@query("select c.c_custkey, n.n_name, o.o_orderkey from customer c join nation n on c.c_nationkey = n.n_nationkey left join orders o on o.o_custkey = c.c_custkey and o.o_orderstatus = 'F' where n.n_regionkey = 1")
def left_join_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15 J19"""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").where("n_regionkey = 1")
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(o, "c_custkey", "left").select("c_custkey", "n_name", "o_orderkey")
