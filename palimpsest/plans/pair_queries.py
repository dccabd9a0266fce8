"""Queries over pairs of a text and its rewriting: user turns stand for sources, the replies for outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import perturb as P
from palimpsest.functions import spans as SP
from palimpsest.functions import text as T
from palimpsest.functions.profiles import KO, LATIN
from palimpsest.operators import models as M
from palimpsest.operators import relational as R
from palimpsest.operators import similarity as S
from palimpsest.operators.mining import term_coverage
from palimpsest.plans.inputs import PAIRS, doc_sentences, sents_of, sql_jaccard, sql_ngrams, sql_sents, sql_squeeze, sql_units, sql_words, table, turn_pairs
from palimpsest.plans.registry import query
from palimpsest.storage import stage

_KS, _OO = (f"list_transform({sql_sents(x)}, lambda y: {sql_squeeze('y')})" for x in ("src", "out"))
_KW, _OW = sql_words("src"), sql_words("out")


@query(
    f"""with {PAIRS}, p as (select *, {_KS} as ks, {_OO} as oo, {_KW} as kw, {_OW} as ow, {sql_squeeze('src')} as a, {sql_squeeze('out')} as b from pairs)
select conv_id, turn, (length(b) / greatest(length(a), 1))::double as compression, 100.0::double * len(list_filter(oo, lambda s: list_contains(ks, s))) / greatest(len(oo), 1) as exact_copies,
  (len(oo) / greatest(len(ks), 1))::double as split_ratio, 100.0::double * len(list_filter(ow, lambda w: not list_contains(kw, w))) / greatest(len(ow), 1) as added_pct,
  100.0::double * len(list_filter(kw, lambda w: not list_contains(ow, w))) / greatest(len(kw), 1) as deleted_pct from p"""
)
def turn_pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19 J1 J13"""
    m = T.edit_metrics(F.col("src"), F.col("out"))
    keep = ("compression", "exact_copies", "split_ratio", "added_pct", "deleted_pct")
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", *[m[k].alias(k) for k in keep])


@query()
def turn_pair_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18 over every pair (DuckDB's levenshtein counts bytes, so no SQL)"""
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", T.levenshtein_similarity("src", "out").alias("levenshtein_sim"))


@query(f"with {PAIRS}, g as (select conv_id, turn, {sql_ngrams('src', 3)} as a, {sql_ngrams('out', 3)} as b from pairs) select conv_id, turn, {sql_jaccard('a', 'b')} as jaccard3, len(a)::int as n_src from g")
def char_trigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 U4"""
    grams = turn_pairs(spark, sf_dir).select("conv_id", "turn", T.char_ngrams("src", 3).alias("a"), T.char_ngrams("out", 3).alias("b"))
    return grams.select("conv_id", "turn", T.jaccard("a", "b").alias("jaccard3"), F.size("a").alias("n_src"))


#: Prose without digits gets the turn's number in a sentence, so that number queries have something to find.
_NUM = "numbered as (select conv_id, turn, src || ' Take ' || (turn + 2) || ' mg for ' || (conv_id % 9) || ' days.' as src, out || ' Take ' || (turn + 2) || 'mg for ' || (conv_id % 7) || ' days.' as out from pairs)"


def numbered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lambda text, gap, n: F.concat(F.col(text), F.lit(" Take "), (F.col("turn") + 2).cast("string"), F.lit(f"{gap}mg for "), (F.col("conv_id") % n).cast("string"), F.lit(" days."))
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", told("src", " ", 9).alias("src"), told("out", "", 7).alias("out"))


@query(f"with {PAIRS}, {_NUM} select conv_id, turn, {sql_units('src')} as units from numbered")
def numeric_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5"""
    return numbered_pairs(spark, sf_dir).select("conv_id", "turn", T.number_units("src").alias("units"))


@query(f"with {PAIRS}, {_NUM}, u as (select conv_id, turn, list_distinct({sql_units('src')}) as n, regexp_replace(out, '\\s+', '', 'g') as flat from numbered) select conv_id, turn, case when len(n) > 0 then 100.0::double * len(list_filter(n, lambda x: contains(flat, x))) / len(n) end as num_keep from u")
def numeric_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6"""
    return numbered_pairs(spark, sf_dir).select("conv_id", "turn", T.numeric_keep("src", "out").alias("num_keep"))


@query(f"with {PAIRS}, {_NUM} select conv_id, turn, list_sort(list_filter(list_distinct({sql_units('out')}), lambda x: not list_contains({sql_units('src')}, x))) as invented from numbered")
def numeric_hallucination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 J14 U3"""
    return numbered_pairs(spark, sf_dir).select("conv_id", "turn", T.numeric_hallucination("src", "out").alias("invented"))


@query(
    f"""with {PAIRS}, {_NUM},
u as (select conv_id, turn, {sql_units('src')} as s, {sql_units('out')} as o from numbered)
select conv_id, turn, len(s)::int as numbers, len(list_filter(s, lambda x: list_contains(o, x)))::int as kept, len(list_filter(s, lambda x: not list_contains(o, x)))::int as lost,
  len(list_filter(list_distinct(o), lambda x: not list_contains(s, x)))::int as invented from u"""
)
def numeric_verifier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q16 (kept, lost, invented; changed ones are in numeric_verifier_changed)"""
    u = numbered_pairs(spark, sf_dir).select("conv_id", "turn", T.number_units("src").alias("s"), T.number_units("out").alias("o"))
    return u.select("conv_id", "turn", F.size("s").alias("numbers"), F.size(F.filter("s", lambda x: F.array_contains("o", x))).alias("kept"), F.size(F.filter("s", lambda x: ~F.array_contains("o", x))).alias("lost"), F.size(F.array_except("o", "s")).alias("invented"))


@query()
def numeric_verifier_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source number that the output lacks, with the output number that took its place

    Each word of 3 letters or more within 35 characters of the number is sought at all its places in the output; the first
    by word and place with an output number within 60 characters counts. Where that number is in the source or there is none,
    the number is lost: changed_to is null.
    """
    rows = numbered_pairs(spark, sf_dir)
    spans = lambda c: SP.pattern_spans(F.col(c), LATIN.number_unit)
    src = rows.withColumns({"s_toks": T.number_units("src"), "o_toks": T.number_units("out")})
    src = src.select("conv_id", "turn", "src", "out", "s_toks", "o_toks", F.explode(spans("src")).alias("n"))
    src = src.withColumns({"tok": T.without_spaces(F.col("n.raw")), "pos": F.col("n.s")}).where(~F.array_contains("o_toks", F.col("tok")))
    start = F.greatest(F.col("pos") - 35, F.lit(0))
    near = F.substring(F.col("src"), start + 1, F.col("pos") + 35 - start)
    words = src.select("conv_id", "turn", "out", "s_toks", "tok", "pos", F.posexplode(F.regexp_extract_all(near, F.lit(r"\p{L}{3,}"), F.lit(0))).alias("nth", "kw"))
    gaps = F.transform(F.split("out", F.concat(F.lit(r"\Q"), F.col("kw"), F.lit(r"\E")), -1), F.length)
    parts = words.withColumn("gaps", gaps).where(F.size("gaps") > 1)
    parts = parts.select("conv_id", "turn", "s_toks", "tok", "pos", "nth", F.length("kw").alias("k"), F.posexplode(F.slice("gaps", F.lit(1), F.size("gaps") - 1)).alias("m", "gap"))
    w = Window.partitionBy("conv_id", "turn", "pos", "nth").orderBy("m")
    hits = parts.select("conv_id", "turn", "s_toks", "tok", "pos", "nth", (F.sum("gap").over(w) + F.col("m") * F.col("k")).alias("at"))
    out = rows.select("conv_id", "turn", F.explode(spans("out")).alias("n")).select("conv_id", "turn", T.without_spaces(F.col("n.raw")).alias("other"), F.col("n.s").cast("long").alias("opos"))
    met = R.interval_join(hits, out, ["conv_id", "turn"], "at", "opos", 60)
    first = F.min_by("r_other", F.struct("l_nth", "l_at", "r_opos")).alias("changed_to")
    best = met.groupBy("conv_id", "turn", "l_tok", "l_pos").agg(first, F.first("l_s_toks").alias("s_toks"))
    best = best.where(~F.array_contains("s_toks", F.col("changed_to"))).select("conv_id", "turn", F.col("l_tok").alias("tok"), F.col("l_pos").alias("pos"), "changed_to")
    every = src.select("conv_id", "turn", "tok", "pos").join(best, ["conv_id", "turn", "tok", "pos"], "left")
    return every.select("conv_id", "turn", F.col("tok").alias("number"), F.col("pos").alias("position"), "changed_to")


_LEX = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'))"


def _lex(p: str, h: str) -> str:
    a, b = _LEX.format(p), _LEX.format(h)
    return f"(case when len({b}) > 0 then len(list_intersect({b}, {a}))::double / len({b}) else 0 end)"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Hypotheses: sentences of replies; chunks: sentences of the user turns; doc is conv_id:turn."""
    pairs = turn_pairs(spark, sf_dir).withColumn("doc", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    hyps = R.sentences(pairs, T.split_sentences("out"), ["doc"], "hyp", "hyp_id")
    chunks = R.sentences(pairs, T.split_sentences("src"), ["doc"], "chunk", "chunk_id")
    return hyps, chunks


_SIDES = f"""{PAIRS}, keyed as (select conv_id || ':' || turn as doc, src, out from pairs),
{sents_of('keyed', 'out', 'doc', 'hyps', 'doc')}, {sents_of('keyed', 'src', 'doc', 'chunks', 'doc')},
hg as (select doc, sent_id as hyp_id, text as hyp, {sql_ngrams('text', 2)} as g from hyps), cg as (select doc, sent_id as chunk_id, text as chunk, {sql_ngrams('text', 2)} as g from chunks),
sim as (select h.doc, hyp_id, chunk_id, hyp, chunk, {sql_jaccard('h.g', 'c.g')} as score from hg h join cg c on h.doc = c.doc),
top as (select *, (row_number() over (partition by doc, hyp_id order by score desc, chunk_id))::int as rank from sim)"""


@query(f"with {_SIDES} select doc, hyp_id, chunk_id, score, rank from top where rank <= 5")
def topk_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3"""
    hyps, chunks = _sides(spark, sf_dir)
    return S.topk_similarity_join(hyps, chunks, k=5)


@query(f"with {_SIDES}, e as (select doc, hyp_id, max({_lex('chunk', 'hyp')}) as best from top where rank <= 5 group by doc, hyp_id), b as (select h.doc, h.hyp_id, coalesce(best, 0) as best from hg h left join e using (doc, hyp_id)) select doc, count(*) as n, 100.0::double * avg((best >= 0.5)::int) as rate, 100.0::double * avg(best) as mean_best from b group by doc")
def grounding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 X2 A6 with the lexical scorer, top 5"""
    hyps, chunks = _sides(spark, sf_dir)
    return S.support_rate(S.best_per_hypothesis(hyps, S.scored_evidence(hyps, chunks, k=5)))


@query(f"with {_SIDES}, e as (select doc, chunk_id, max({_lex('hyp', 'chunk')}) as best from sim group by doc, chunk_id), b as (select c.doc, c.chunk_id, coalesce(best, 0) as best from cg c left join e using (doc, chunk_id)) select doc, count(*) as n, 100.0::double * avg((best >= 0.5)::int) as rate, 100.0::double * avg(best) as mean_best from b group by doc")
def coverage_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 with roles swapped, J4: every pair of a document"""
    hyps, chunks = _sides(spark, sf_dir)
    swapped = {"hyp_id": "chunk_id", "chunk_id": "hyp_id", "hyp": "chunk", "chunk": "hyp"}
    evidence = S.scored_evidence(chunks, hyps, k=0, **swapped)
    return S.support_rate(S.best_per_hypothesis(chunks, evidence, hyp_id="chunk_id"))


@query(f"with {_SIDES}, e as (select doc, hyp_id, max({_lex('chunk', 'hyp')}) as best from sim group by doc, hyp_id), b as (select h.doc, h.hyp_id, coalesce(best, 0) as best from hg h left join e using (doc, hyp_id)) select 100.0::double * avg(best) as summac from b")
def summac_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3 J4"""
    hyps, chunks = _sides(spark, sf_dir)
    best = S.best_per_hypothesis(hyps, S.scored_evidence(hyps, chunks, k=0))
    return best.agg((100.0 * F.avg("best")).alias("summac"))


@query(
    f"""with {_SIDES}, m as (select *, {_lex('chunk', 'hyp')} as s, length(chunk) < 60 as scaffold, abs(chunk_id - hyp_id) <= 1 as local from top)
select doc, hyp_id, max(s) as "GLOBAL", coalesce(max(s) filter (where not scaffold), max(s)) as "FILTERED", coalesce(max(s) filter (where rank <= 2), max(s)) as "TOPK", coalesce(max(s) filter (where local), max(s)) as "LOCAL" from m group by doc, hyp_id"""
)
def agg_modes_global_filtered_topk_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 P4"""
    hyps, chunks = _sides(spark, sf_dir)
    ranked = S.topk_similarity_join(hyps, chunks, k=1_000_000).select("doc", "hyp_id", "chunk_id", "rank")
    rows = ranked.join(hyps, ["doc", "hyp_id"]).join(chunks, ["doc", "chunk_id"])
    scored = rows.select("doc", "hyp_id", "rank", S.lexical_scorer(F.col("chunk"), F.col("hyp")).alias("score"), (F.length("chunk") < 60).alias("scaffold"), (F.abs(F.col("chunk_id") - F.col("hyp_id")) <= 1).alias("local"))
    return S.aggregate_modes(scored, ["doc", "hyp_id"], k=2)


@query(
    f"""with {PAIRS}, {_NUM}, u as (select conv_id, turn, list_distinct({sql_units('src')}) as n, len(list_filter(list_distinct({sql_units('out')}), lambda x: not list_contains({sql_units('src')}, x))) as h, regexp_replace(out, '\\s+', '', 'g') as flat, {_lex('src', 'out')} * 100 as ground from numbered),
m as (select conv_id, turn, case when len(n) > 0 then 100.0::double * len(list_filter(n, lambda x: contains(flat, x))) / len(n) end as keep, h, ground from u),
r as (select conv_id, turn, list_filter([case when keep < 90 then 'num_keep' end, case when h > 0 then 'n_halluc' end, case when ground < 70 then 'ground' end], lambda x: x is not null) as reasons from m)
select conv_id, turn, len(reasons) = 0 as ok, reasons from r"""
)
def gate_pass_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9"""
    g = S.gate(T.numeric_keep("src", "out"), F.size(T.numeric_hallucination("src", "out")), 100.0 * S.lexical_scorer(F.col("src"), F.col("out")))
    return numbered_pairs(spark, sf_dir).select("conv_id", "turn", g.alias("g")).select("conv_id", "turn", "g.ok", "g.reasons")


@query(f"with {PAIRS} select conv_id, turn, left(sha256(src), 12) as src_hash, left(sha256(src), 12) = left(sha256({sql_squeeze('src')}), 12) as same from pairs")
def input_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two routes were given the same source"""
    h = lambda c: F.left(F.sha2(c, 256), F.lit(12))
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", h(F.col("src")).alias("src_hash"), (h(F.col("src")) == h(T.squeeze("src"))).alias("same"))


@query(
    f"""with {PAIRS}, s as (select conv_id, turn, {sql_sents('src')} as a, {sql_sents('out')} as b from pairs), n as (select *, least(len(a), len(b)) as m from s),
z as (select conv_id, turn, unnest(range(0, m))::int as pos, a, b from n) select conv_id, turn, pos, a[pos + 1] as src, b[pos + 1] as out from z"""
)
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J21"""
    s = turn_pairs(spark, sf_dir).select("conv_id", "turn", T.split_sentences("src").alias("a"), T.split_sentences("out").alias("b"))
    z = s.withColumn("n", F.least(F.size("a"), F.size("b")))
    z = z.select("conv_id", "turn", F.posexplode(F.arrays_zip(F.slice("a", F.lit(1), F.col("n")).alias("src"), F.slice("b", F.lit(1), F.col("n")).alias("out"))).alias("pos", "x"))
    return z.select("conv_id", "turn", "pos", "x.src", "x.out")


@query(
    f"""with {PAIRS} select conv_id, turn, (contains(src, 'the')::int + contains(src, 'der')::int)::int as present,
  ((contains(src, 'the') and (contains(lower(out), 'and') or contains(lower(out), 'the')))::int + (contains(src, 'der') and contains(lower(out), 'die'))::int)::int as kept from pairs"""
)
def bilingual_term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 J7 J8"""
    c = term_coverage(F.col("src"), F.col("out"), {"the": ["and", "the"], "der": ["die"]})
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", c.alias("c")).select("conv_id", "turn", "c.present", "c.kept")


@query(
    f"""with {PAIRS}, m as (select conv_id, turn, {_lex('src', 'out')} as e, 1 - {_lex('out', 'src')} as c from pairs)
select conv_id, turn, case when c >= 0.5 and c > e then 'contradicted' when e >= 0.5 then 'supported' else 'unsupported' end as support from m"""
)
def support_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A32"""
    e, c = S.lexical_scorer(F.col("src"), F.col("out")), 1 - S.lexical_scorer(F.col("out"), F.col("src"))
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", S.support_class(e, c).alias("support"))


@query(
    f"""with {PAIRS}, c as (select conv_id, turn, out, trim(substr(out, 1, 60)) as cited, src from pairs),
o as (select *, len(list_intersect({_LEX.format('src')}, {_LEX.format('cited')}))::double / greatest(len({_LEX.format('src')}), 1) as v from c)
select conv_id, turn, case when not contains(out, cited) or cited = '' then 'absent' when v >= 0.15 then 'supported' else 'unrelated' end as verdict from o"""
)
def cited_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations checked by containment and word overlap"""
    cited = F.trim(F.substring("out", 1, 60))
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", M.judge(F.col("src"), F.col("out"), cited).alias("verdict"))


@query()
def ungrounded_parentheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17"""
    rows = turn_pairs(spark, sf_dir).withColumn("out", F.concat("out", F.lit(" (nowhere said) ("), F.substring("src", 1, 12), F.lit(")")))
    return rows.select("conv_id", "turn", T.ungrounded_parentheses("out", "src").alias("ungrounded"))


@query()
def mask_audit_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document masked, audited and restored"""
    masked = table(spark, sf_dir, "documents").select("doc_id", "text", SP.mask("text").alias("m"))
    a = SP.audit(F.col("m.text"), F.col("m.map"))
    return masked.select("doc_id", F.size(F.map_keys("m.map")).alias("placeholders"), a["ok"].alias("ok"), (SP.restore(F.col("m.text"), F.col("m.map")) == F.col("text")).alias("round_trip"))


@query(f"with {PAIRS}, {_NUM} select conv_id, turn, len(regexp_extract_all(src, '\\d+'))::int as n from numbered")
def protected_span_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """placeholders made in numbered turns"""
    pat = [x for x in LATIN.protected if x[1] == r"\d+"]
    return numbered_pairs(spark, sf_dir).select("conv_id", "turn", F.size(SP.non_overlapping(SP.pattern_spans(F.col("src"), pat[0][1], "N"))).alias("n"))


@query()
def glossary_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline, footnote and sentence rendering with their checks"""
    glossary = {"the": "the definite one", "der": "the male one"}
    rows = turn_pairs(spark, sf_dir).select("conv_id", "turn", "out", SP.glossary_plan("out", glossary).alias("g"))
    plan = F.col("g.plan")
    inline = SP.render_inline("out", plan, glossary)
    sentence = SP.render_sentences("out", plan, {k: f"Here {k} is {v}." for k, v in glossary.items()}, r"[.!?]\s+|\n+")
    return rows.select("conv_id", "turn", F.size(plan).alias("insertions"), F.size("g.skipped").alias("skipped"), SP.check_rendering("out", inline, plan, glossary).alias("errors"), F.length(SP.render_footnotes("out", plan, glossary)).alias("footnote_chars"), F.length(sentence).alias("sentence_chars"))


def _perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sents = doc_sentences(spark, sf_dir, ("doc_id",)).where("length(text) between 40 and 200")
    told = sents.withColumn("text", F.concat("text", F.lit(" Take 3 days is low.")))
    made = P.perturbations("text", LATIN, [["the", "and", "for"]])
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("changed")) for k, v in made.items()])
    return told.select("doc_id", "sent_id", "text", F.inline(F.array_append(kinds, F.struct(F.lit("ORIGINAL").alias("kind"), F.col("text").alias("changed"))))).where("changed is not null and (changed <> text or kind = 'ORIGINAL')")


@query()
def perturbation_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection rate and mean score of each kind of corruption, by the lexical scorer"""
    scored = _perturbed(spark, sf_dir).select("kind", S.lexical_scorer(F.col("text"), F.col("changed")).alias("score"))
    return scored.groupBy("kind").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), (100.0 * F.avg((F.col("score") < 0.95).cast("double"))).alias("detected"))


@query()
def omission_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of a sentence by its document without it, without a clause of it and without a term

    A word of the sentence is in such a premise if another sentence of the document has it or what is left of the sentence has.
    """
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("rid"), T.split_sentences("text", LATIN).alias("sents"))
    every = docs.select("rid", F.size("sents").alias("of"), F.posexplode("sents").alias("sent_id", "text"))
    every = stage(every.withColumn("words", T.word_set("text")), "omission-sentences")
    word = every.select("rid", "sent_id", F.explode(F.array_distinct("words")).alias("w"))
    often = word.groupBy("rid", "w").agg(F.count("*").alias("n")).where("n > 1").select("rid", "w")
    told = word.join(often, ["rid", "w"]).groupBy("rid", "sent_id").agg(F.collect_list("w").alias("told"))
    s = every.where("length(text) between 30 and 300").join(told, ["rid", "sent_id"], "left")
    s = s.withColumn("told", F.coalesce("told", F.array().cast("array<string>")))
    left = {"FULL": F.when(F.col("of") >= 4, F.lit("")), "CLAUSE": P.omit_clause("text"), "TERM": P.omit_term("text", LATIN.terms)}
    none = F.array().cast("array<string>")
    premises = [F.struct(F.lit(k).alias("kind"), v.alias("rest"), F.col("told").alias("told")) for k, v in left.items()]
    premises.append(F.struct(F.lit("OFF_TOPIC").alias("kind"), F.lit(LATIN.off_topic[0]).alias("rest"), none.alias("told")))
    rows = s.select("words", F.inline(F.array(*premises))).where("rest is not null")
    found = F.size(F.array_intersect("words", F.concat("told", T.word_set("rest"))))
    score = F.when(F.size("words") > 0, found / F.size("words")).otherwise(0.0)
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.avg(score).alias("mean"))


@query(
    rf"""with {PAIRS}, {_NUM}, c as (select conv_id, turn, out, case when length(out) >= 40 and length(regexp_replace(left(out, floor(length(out) * 0.55)::int), '\s+\z', '')) >= 15 then regexp_replace(left(out, floor(length(out) * 0.55)::int), '\s+\z', '') end as cut from numbered)
select conv_id, turn, md5(cut) as cut from c"""
)
def translation_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F32 truncation"""
    return numbered_pairs(spark, sf_dir).select("conv_id", "turn", F.md5(P.truncate("out")).alias("cut"))


@query(
    f"""with {PAIRS}, {_NUM}, n as (select *, '(^|[^\\d.])(\\d{{1,4}})(\\s*)(%|days|weeks|months|years|hours|min|mg|ml|cm|kg)' as p from numbered)
select conv_id, turn, regexp_replace(src, p, '\\1' || (3 * regexp_extract(src, p, 2)::int + 1) || '\\3\\4') as changed from n"""
)
def number_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number of every turn becomes three times itself and one"""
    return numbered_pairs(spark, sf_dir).select("conv_id", "turn", P.change_number("src").alias("changed"))


@query()
def korean_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F27 F29 F34 with the Korean profile, over its own term list"""
    terms = spark.createDataFrame([(t,) for t in KO.terms], "term string")
    variant = F.concat(F.col("term"), F.lit("증"))
    return terms.select("term", T.has_final_consonant("term").alias("closed"), T.definition_sentence(F.col("term"), F.lit("설명하는 말")).alias("sentence"), T.classify_variant(F.col("term"), variant)["kind"].alias("kind"), T.repair_particle(F.col("term"), F.lit("는 것")).alias("repaired"))


@query(f"with {PAIRS}, r as (select conv_id, turn, case when turn % 2 = 0 then 'a' else 'b' end as route, length(out)::double as x from pairs), w as (select conv_id, max(x) filter (where route = 'a') as a, max(x) filter (where route = 'b') as b from r group by conv_id) select conv_id, a, b, b - a as delta from w where a is not null and b is not null")
def paired_route_delta_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 A10"""
    r = turn_pairs(spark, sf_dir).select("conv_id", F.when(F.col("turn") % 2 == 0, "a").otherwise("b").alias("route"), F.length("out").cast("double").alias("x"))
    w = r.groupBy("conv_id").pivot("route", ["a", "b"]).agg(F.max("x"))
    return w.where("a is not null and b is not null").withColumn("delta", F.col("b") - F.col("a"))


@query(
    """with l as (select *, lead(role) over w as nr, lead(text) over w as nt, lag(role) over w as pr, lag(text) over w as pt from conversations window w as (partition by conv_id order by turn))
select conv_id, turn, text, coalesce(case when nr = 'assistant' then nt end, case when pr = 'assistant' then pt end) as other from l where role = 'user' and (nr = 'assistant' or pr = 'assistant')"""
)
def adjacent_block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12 W10"""
    return R.adjacent_pairs(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", "user", "assistant", "text").select("conv_id", "turn", "text", "other")


@query(f"with {PAIRS}, s as (select conv_id, turn, unnest({_OO}) as t from pairs), k as (select conv_id, turn, unnest({_KS}) as t from pairs) select conv_id, turn, t as sentence from s where exists (select 1 from k where k.conv_id = s.conv_id and k.turn = s.turn and k.t = s.t)")
def exact_copy_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13 J23"""
    pairs = turn_pairs(spark, sf_dir)
    of = lambda c: pairs.select("conv_id", "turn", F.explode(F.transform(T.split_sentences(c), T.squeeze)).alias("sentence"))
    return of("out").join(of("src"), ["conv_id", "turn", "sentence"], "left_semi")


@query()
def cleaned_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """replies with chatter and markdown around them, cleaned"""
    dressed = F.concat(F.lit("Sure, here it is:\n\n---\n"), F.col("text"), F.lit("\n\nLet me know if anything is missing."))
    c = T.clean_output(dressed, (r"^Sure",), (r"^Let me know",))
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.col("text"), c.alias("c"))
    return rows.select("conv_id", "turn", "c.removed", (T.without_spaces("c.text") == T.without_spaces("text")).alias("restored"))


@query(f"with {PAIRS} select conv_id, turn, length(out)::int as n from pairs order by length(conv_id::varchar), conv_id, turn limit 100")
def natural_order_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1 O3 S13"""
    return turn_pairs(spark, sf_dir).orderBy(F.length(F.col("conv_id").cast("string")), "conv_id", "turn").limit(100).select("conv_id", "turn", F.length("out").alias("n"))


@query(
    f"""with {PAIRS}, s as (select conv_id, turn, len({sql_sents('src')}) as ns, len({sql_sents('out')}) as no from pairs)
select conv_id, turn, (case when ns > 0 then no / ns end)::double as split_ratio from s"""
)
def sentence_split_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F21 against a source"""
    n = F.size(T.split_sentences("src"))
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.when(n > 0, F.size(T.split_sentences("out")) / n).alias("split_ratio"))


@query()
def multiple_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6 interface: options scored by word overlap with the question"""
    rows = turn_pairs(spark, sf_dir).select("conv_id", "turn", F.col("src").alias("q"), T.equal_slices("out", 4).alias("options"))
    scores = F.transform("options", lambda o: S.lexical_scorer(F.col("q"), o))
    return rows.select("conv_id", "turn", M.pick_option(scores, ["A", "B", "C", "D"]).alias("answer"), F.length(M.multiple_choice_prompt(F.col("q"), F.col("options"))).alias("prompt_chars"))


@query()
def window_of_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """55 characters to either side of a word"""
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", SP.context(F.col("out"), F.lit("en"), 55).alias("context"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("n"))
