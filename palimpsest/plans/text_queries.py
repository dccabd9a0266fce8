"""Queries over sentences, documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.profiles import LATIN
from palimpsest.operators import relational as R
from palimpsest.operators import similarity as S
from palimpsest.plans.inputs import SENTS, doc_sentences, sql_sents, sql_words, table
from palimpsest.plans.registry import query
from palimpsest.sources.files import html_text

LONG_WORDS = 25


@query(rf"with {SENTS} select lang, count(*) as n_sentences, sum(length(text))::bigint as n_chars, sum(len({sql_words('text')}))::bigint as n_words, count(*) filter (where len({sql_words('text')}) > 25) as n_long from sents group by lang")
def sentence_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 F21 A1 A3"""
    n = F.size(T.words("text"))
    return doc_sentences(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_sentences"), F.sum(F.length("text")).alias("n_chars"), F.sum(n).alias("n_words"), F.count_if(n > LONG_WORDS).alias("n_long"))


@query(f"with {SENTS} select doc_id, sent_id, text from sents")
def sentence_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 D3"""
    return doc_sentences(spark, sf_dir).select("doc_id", "sent_id", "text")


@query(
    f"""with d as (select doc_id, {sql_sents('text')} as s from documents),
c as (select doc_id, case when len(s) = 0 then ['(empty)'] else list_concat(list_concat(s, list_transform(range(1, greatest(len(s), 1)), lambda i: s[i] || ' ' || s[i + 1])),
  list_transform(range(1, greatest(len(s) - 1, 1)), lambda i: s[i] || ' ' || s[i + 1] || ' ' || s[i + 2])) end as chunks from d),
e as (select doc_id, unnest(chunks) as chunk, generate_subscripts(chunks, 1) as pos from c),
f as (select doc_id, chunk, min(pos) as pos from e group by doc_id, chunk)
select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::int as chunk_id, chunk from f"""
)
def chunk_window_1_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 U5 D4"""
    return R.sentences(table(spark, sf_dir, "documents"), R.sliding_chunks(T.split_sentences("text")), ["doc_id"], "chunk", "chunk_id")


@query(rf"select doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g')))::int as squeezed, strlen(text)::int as bytes from documents")
def squeeze_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 (white space part)"""
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.squeeze("text")).alias("squeezed"), F.octet_length("text").alias("bytes"))


@query(r"select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[ \t\x{a0}\x{3000}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+\z', '', 'g')) as digest from documents")
def normalise_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 (NFC form)"""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalise("text", "NFC")).alias("digest"))


@query()
def normalise_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 (NFKC form, which DuckDB lacks)"""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalise("text")).alias("digest"))


@query(r"select doc_id, len(regexp_extract_all(text, '[가-힣]'))::int as ko, len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]'))::int as han, len(regexp_extract_all(text, '[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{1ea0}-\x{1ef9}]'))::int as lat from documents")
def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11 F10"""
    return table(spark, sf_dir, "documents").select("doc_id", T.script_counts("text").alias("n")).select("doc_id", "n.ko", "n.han", "n.lat")


@query(
    r"""with c as (select page_id, len(regexp_extract_all(url, '[가-힣]')) as ko, len(regexp_extract_all(url, '[\x{4e00}-\x{9fff}]')) as han, len(regexp_extract_all(url, '[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{1ea0}-\x{1ef9}]')) as lat from pages)
select page_id, case when ko + han + lat < 3 then 'other' when ko / (ko + han + lat) >= 0.3 then 'ko' when lat / (ko + han + lat) >= 0.5 then 'en' else 'other' end as script from c"""
)
def script_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11 P2"""
    return table(spark, sf_dir, "pages").select("page_id", T.detect_script("url", "en").alias("script"))


@query(f"with {SENTS} select doc_id, sent_id, length(text)::int as n from sents where length(text) between 20 and 300")
def length_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1"""
    return doc_sentences(spark, sf_dir).where(F.length("text").between(20, 300)).select("doc_id", "sent_id", F.length("text").alias("n"))


_LABELS = "[" + ", ".join(f"'{x}'" for x in LATIN.scaffold_labels) + "]"


@query(
    rf"""with {SENTS} select doc_id, sent_id,
 (length(text) < 25 or len(regexp_extract_all(text, ':')) >= 2 or (len(list_filter({_LABELS}, lambda l: contains(text, l))) >= 2 and not regexp_matches(text, '[.!?]\s*$'))
  or regexp_matches(text, '[_\-]{{3,}}') or len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]')) / greatest(length(text), 1) < 0.5) as scaffold,
 (length(trim(text)) >= 30 and regexp_matches(trim(text), '[.!?]\s*$')) as predicate from sents"""
)
def scaffold_and_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 P4"""
    return doc_sentences(spark, sf_dir).select("doc_id", "sent_id", S.is_scaffold("text").alias("scaffold"), S.is_predicate("text").alias("predicate"))


@query(r"select conv_id, turn, regexp_matches(text, '(?:^Sure)|(?:^Here is)|(?:hope this helps)|(?:let me know)') as meta, regexp_matches(text, '^\s*#{1,6}\s') as header from conversations")
def meta_and_header_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 P6"""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.is_meta("text").alias("meta"), F.col("text").rlike(r"^\s*#{1,6}\s").alias("header"))


@query("select doc_id, len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]'))::int as letters, len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]')) >= 25 as converts, case when len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]')) < 25 then len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]')) || ' letters < 25' else '' end as reason from documents")
def short_text_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8 F10"""
    n = T.letters("text")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("letters"), (n >= 25).alias("converts"), F.when(n < 25, F.concat(n.cast("string"), F.lit(" letters < 25"))).otherwise("").alias("reason"))


@query(r"select doc_id, len(regexp_extract_all(text, '[(\[]\s*[)\]]'))::int as empty_bracket, len(regexp_extract_all(text, '_{2,}|\.{4,}'))::int as rule, len(regexp_extract_all(text, ':\s*\z'))::int as empty_field from documents")
def blank_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 F9"""
    found = T.find_blanks("text")
    n = lambda k: F.coalesce(F.size(F.try_element_at(found, F.lit(k))), F.lit(0))
    size = lambda k: F.when(F.map_contains_key(found, F.lit(k)), n(k)).otherwise(0)
    return table(spark, sf_dir, "documents").select("doc_id", *[size(k).alias(k) for k in ("empty_bracket", "rule", "empty_field")])


@query(r"select doc_id, md5(regexp_replace(regexp_replace(text, '[(\[]\s*[)\]]', '[blank]', 'g'), '_{2,}|\.{4,}', '[blank]', 'g')) as digest, (len(regexp_extract_all(text, '[(\[]\s*[)\]]')) + len(regexp_extract_all(regexp_replace(text, '[(\[]\s*[)\]]', '[blank]', 'g'), '_{2,}|\.{4,}')))::int as n from documents")
def blank_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8"""
    marked = T.mark_blanks("text", token="[blank]")
    return table(spark, sf_dir, "documents").select("doc_id", marked.alias("m")).select("doc_id", F.md5("m.text").alias("digest"), "m.n")


@query(
    rf"""with {SENTS}, d as (select doc_id, count(*) as n, greatest(sum(len({sql_words('text')})), 1) as w, count(*) filter (where len({sql_words('text')}) > 25) as lng, string_agg(text, ' ' order by sent_id) as j from sents group by doc_id)
select documents.doc_id, coalesce(w / n, 0)::double as sent_len, coalesce(lng / n, 0)::double as long_ratio,
  coalesce(100.0::double * len(regexp_extract_all(j, '[()\[\]{{}}（）〔〕:：·／/※▶►▲■□○●◦-]')) / greatest(length(j), 1), 0)::double as paren,
  coalesce(100.0::double * ({' + '.join(f"len(regexp_extract_all(j, '{t}'))" for t in LATIN.terms)}) / w, 0)::double as term
from documents left join d using (doc_id)"""
)
def readability_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20"""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.readability("text").alias("f"))
    return rows.select("doc_id", "f.sent_len", "f.long_ratio", "f.paren", "f.term")


@query()
def readability_features_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20, all nine (word boundaries differ between regular expression engines, so no SQL)"""
    return table(spark, sf_dir, "documents").select("doc_id", T.readability("text").alias("f")).select("doc_id", "f.*")


@query(
    rf"""with {SENTS}, d as (select doc_id, count(*) as n, greatest(sum(len({sql_words('text')})), 1) as w, sum(length(text)) as c, count(*) filter (where len({sql_words('text')}) > 25) as lng from sents group by doc_id)
select documents.doc_id, n::int as n_sentences, (c / n)::double as chars_per_sent, (w / n)::double as words_per_sent, (100.0::double * lng / n)::double as long_sent_ratio from documents left join d using (doc_id)"""
)
def simplicity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F21"""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.simplicity("text").alias("f"))
    return rows.select("doc_id", "f.n_sentences", "f.chars_per_sent", "f.words_per_sent", "f.long_sent_ratio")


_VOCAB = "v as (select w, (1 + (count(*) % 6))::int as grade from (select distinct doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]{2,6}'))) as w from documents) group by w having count(*) >= 5)"


@query(
    f"""with {_VOCAB},
t as (select distinct lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as word from documents),
p as (select word, unnest(list_transform(range(1, length(word) + 1), lambda i: left(word, i::int))) as w from t),
h as (select word, arg_max(grade, length(w)) as grade from p join v using (w) where length(w) >= 2 or w = word group by word)
select word, grade from t left join h using (word)"""
)
def vocab_longest_prefix_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents against a vocabulary of frequent short ones"""
    docs = table(spark, sf_dir, "documents")
    short = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,6}"), F.lit(0))).alias("w")).select("doc_id", F.lower("w").alias("w")).distinct()
    vocab = short.groupBy("w").agg(F.count("*").alias("n")).where("n >= 5").select("w", (1 + F.col("n") % 6).cast("int").alias("grade"))
    tokens = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("x")).select(F.lower("x").alias("word")).distinct()
    return R.longest_prefix(tokens, vocab, "word", "w", "grade")


@query(
    f"""with {SENTS}, d as (select doc_id, sum(len({sql_words('text')}))::double / count(*) as wps from sents group by doc_id),
m as (select doc_id, 100.0::double * len(list_filter({sql_words('text')}, lambda w: length(w) > 8)) / greatest(len({sql_words('text')}), 1) as mid from documents),
i as (select doc_id, 61.994::double + -0.261::double * mid + -1.045::double * wps as idx from d join m using (doc_id))
select doc_id, idx as index_value, case when idx >= 45 then '쉬움' when idx >= 35 then '보통' else '어려움' end as level from i"""
)
def readability_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of more than 8 characters stand for the graded vocabulary's upper levels"""
    sents = F.col("s")
    wps = F.aggregate(F.transform(sents, lambda s: F.size(T.words(s))), F.lit(0), lambda a, x: a + x).cast("double") / F.size(sents)
    mid = 100.0 * F.size(F.filter(T.words("text"), lambda w: F.length(w) > 8)) / F.greatest(F.size(T.words("text")), F.lit(1))
    rows = table(spark, sf_dir, "documents").withColumn("s", T.split_sentences("text")).where(F.size(sents) > 0).select("doc_id", T.index_value(mid, wps).alias("index_value"))
    return rows.withColumn("level", T.index_level("index_value"))


@query(
    r"""with p as (select page_id, regexp_replace(html, '(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)\s*>|<!--.*?-->', ' ', 'g') as t from pages),
q as (select page_id, regexp_replace(regexp_replace(t, '(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|title|section|article|nav|footer|header)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') as t from p),
r as (select page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as t from q),
s as (select page_id, trim(regexp_replace(regexp_replace(t, '[ \t\r\f]+', ' ', 'g'), '[ ]*\n[\n ]*', chr(10), 'g')) as t from r)
select page_id, length(t)::int as chars, md5(t) as digest from s"""
)
def html_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 stand-in"""
    return table(spark, sf_dir, "pages").select("page_id", html_text("html").alias("t")).select("page_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


@query(r"select regexp_extract(url, '://([^/:?#]+)', 1) as host, count(*) as pages, sum(length(html))::bigint as chars, avg(length(html))::double as chars_per_page from pages group by 1")
def page_profile_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 A29"""
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "://([^/:?#]+)", 1).alias("host")).agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"), F.avg(F.length("html")).alias("chars_per_page"))


@query("select conv_id, turn, list_transform(range(0, 4), lambda i: case when i = 3 then substr(text, (i * greatest(length(text) // 4, 1))::int + 1) else substr(text, (i * greatest(length(text) // 4, 1))::int + 1, greatest(length(text) // 4, 1)::int) end) as slices from conversations")
def equal_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F36"""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.equal_slices("text", 4).alias("slices"))


@query(r"select doc_id, left(sha256(concat('v1', chr(0), text, chr(0), coalesce(lang, ''), chr(0))), 12) as input_hash, regexp_replace(source || '/' || lang || ' ' || doc_id, '[^A-Za-z0-9._-]+', '_', 'g') as slug from documents")
def stage_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F38 T4 hash functions"""
    return table(spark, sf_dir, "documents").select("doc_id", T.input_hash(F.lit("v1"), F.col("text"), F.col("lang")).alias("input_hash"), T.slug(F.concat_ws("", "source", F.lit("/"), "lang", F.lit(" "), F.col("doc_id").cast("string"))).alias("slug"))


@query(
    r"""with w as (select distinct lower(unnest(regexp_extract_all(text, '[A-Za-z]{3,}'))) as w from documents)
select w as word, case when regexp_matches(w, '(ectomy|ology|itis)$') then w when length(w) > 5 and ends_with(w, 'ies') then left(w, length(w) - 3) || 'y'
  when length(w) > 4 and ends_with(w, 'es') then left(w, length(w) - 2) when length(w) > 4 and ends_with(w, 's') and not ends_with(w, 'ss') then left(w, length(w) - 1) else w end as stem,
  case when length(w) > 4 and ends_with(w, 'ing') then left(w, length(w) - 3) when length(w) > 3 and (ends_with(w, 'es') or ends_with(w, 'ed')) then left(w, length(w) - 2) when length(w) > 2 and ends_with(w, 's') then left(w, length(w) - 1) else w end as bare
from w"""
)
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12 F14"""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct()
    return words.select("word", T.stem_english("word").alias("stem"), T.strip_particle("word", LATIN.particles).alias("bare"))


@query(r"select doc_id, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')))::int as n_words, md5(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')) as alnum from documents")
def word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F40"""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.word_set("text")).alias("n_words"), F.md5(T.alnum("text")).alias("alnum"))


@query(
    r"""with g as (select doc_id, regexp_extract_all(text, '([A-Za-z]{2,12})\s*[（(]\s*([^)）]{2,40})\s*[)）]', 1) as t, list_transform(regexp_extract_all(text, '([A-Za-z]{2,12})\s*[（(]\s*([^)）]{2,40})\s*[)）]', 2), lambda x: trim(x)) as g from documents),
e as (select doc_id, unnest(t) as term, unnest(g) as gloss from g) select doc_id, term, gloss from e"""
)
def parenthetical_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16"""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.parenthetical_glosses("text", "[A-Za-z]{2,12}")).alias("g"))
    return rows.select("doc_id", "g.term", "g.gloss")


@query(
    """select item_id, list_sort(list_filter(list_distinct(list_transform(string_split(text, ' '), lambda w: regexp_replace(w, '[0-9\\-]', '', 'g'))), lambda w: w <> '')) as variants from benchmark"""
)
def headword_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F33"""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_sort(T.lemma_variants(F.regexp_replace("text", " ", "/"))).alias("variants"))


@query("select doc_id, len(regexp_extract_all(text, 'license'))::int as legal, (len(regexp_extract_all(text, 'http')) + len(regexp_extract_all(text, 'www')))::int as web, case when len(regexp_extract_all(text, 'license')) > 0 and not contains(source, 'license') then ['legal'] else [] end as foreign_domains from documents")
def domain_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of a text that its source's name doesn't have"""
    domains = {"legal": ["license"], "web": ["http", "www"]}
    found, own = T.keyword_counts("text", domains), T.keyword_counts("source", domains)
    hit = lambda m: F.map_keys(F.map_filter(m, lambda k, v: (v > 0) & (k == "legal")))
    return table(spark, sf_dir, "documents").select("doc_id", found["legal"].alias("legal"), found["web"].alias("web"), F.array_except(hit(found), hit(own)).alias("foreign_domains"))


@query("select conv_id, turn, (regexp_matches(text, 'the') and regexp_matches(text, '[.!?]')) as all_match, (regexp_matches(text, 'the') or regexp_matches(text, '[.!?]')) as any_match from conversations")
def fact_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17"""
    pats = F.array(F.lit("the"), F.lit("[.!?]"))
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.forall(pats, lambda p: F.regexp_like(text, p)).alias("all_match"), F.exists(pats, lambda p: F.regexp_like(text, p)).alias("any_match"))


@query("""select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from (select event_id, regexp_extract('note ' || props || ' end', '(?s)(\\{.*\\})', 1) as props from events) where json_valid(props)""")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F35"""
    rows = table(spark, sf_dir, "events").select("event_id", T.salvage_json(F.concat(F.lit("note "), "props", F.lit(" end")), "k int").alias("j"))
    return rows.where("j is not null").select("event_id", "j.k")
