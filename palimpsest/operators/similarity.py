"""Top-k similarity joins and scoring: evidence by shared character n-grams, entailment through a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.profiles import LATIN, LangProfile
from palimpsest.functions.text import char_ngrams, word_set

#: (premise, hypothesis) -> entailment score from 0 to 1; a pandas UDF around a model fits as well.
Scorer = Callable[[Column, Column], Column]


def lexical_scorer(premise: Column, hypothesis: Column) -> Column:
    """Share of the hypothesis's words that the premise has: a deterministic stand-in for a model."""
    h = word_set(hypothesis)
    return F.when(F.size(h) > 0, F.size(F.array_intersect(h, word_set(premise))) / F.size(h)).otherwise(0.0)


def topk_similarity_join(hyps: DataFrame, chunks: DataFrame, *, doc: str = "doc", hyp_id: str = "hyp_id", chunk_id: str = "chunk_id", hyp: str = "hyp", chunk: str = "chunk", n: int = 2, k: int = 5, ties: str = "lowest") -> DataFrame:
    """The ``k`` chunks of the same document most like each hypothesis: doc, hyp_id, chunk_id, score, rank.

    Grams are hashed, each text's set once; an equi-join on (document, gram) counts shared ones, so only texts that
    share a gram meet. Chunks without any fill up the ranks by position, from at most ``k`` candidates per document.
    ``ties``: the lowest or the highest chunk id first.
    """
    grams = lambda df, id_, text: df.select(doc, id_, F.transform(char_ngrams(text, n), lambda g: F.xxhash64(g)).alias("g")).withColumn("size", F.size("g"))
    h, c = grams(hyps, hyp_id, hyp), grams(chunks, chunk_id, chunk)
    hg = h.select(doc, hyp_id, F.col("size").alias("hn"), F.explode("g").alias("gram"))
    cg = c.select(doc, chunk_id, F.col("size").alias("cn"), F.explode("g").alias("gram"))
    shared = hg.join(cg, [doc, "gram"]).groupBy(doc, hyp_id, chunk_id).agg(F.count("*").alias("i"), F.first("hn").alias("hn"), F.first("cn").alias("cn"))
    scored = shared.select(doc, hyp_id, chunk_id, (F.col("i") / (F.col("hn") + F.col("cn") - F.col("i"))).alias("score"))
    by = F.col(chunk_id).asc() if ties == "lowest" else F.col(chunk_id).desc()
    first = chunks.withColumn("__n", F.row_number().over(Window.partitionBy(doc).orderBy(by))).where(F.col("__n") <= k)
    filler = hyps.select(doc, hyp_id).join(first.select(doc, chunk_id), doc).select(doc, hyp_id, chunk_id, F.lit(0.0).alias("score"))
    filled = scored.unionByName(filler.join(scored.select(doc, hyp_id, chunk_id), [doc, hyp_id, chunk_id], "left_anti"))
    rank = F.row_number().over(Window.partitionBy(doc, hyp_id).orderBy(F.col("score").desc(), by))
    # fillers may crowd out a scored chunk of equal score only at 0, and scored chunks are above 0
    return filled.withColumn("rank", rank).where(F.col("rank") <= k)


def scored_evidence(hyps: DataFrame, chunks: DataFrame, scorer: Scorer = lexical_scorer, *, doc: str = "doc", hyp_id: str = "hyp_id", chunk_id: str = "chunk_id", hyp: str = "hyp", chunk: str = "chunk", k: int = 5, n: int = 2) -> DataFrame:
    """doc, hyp_id, chunk_id, entail: the scorer on the top ``k`` chunks only; ``k`` <= 0 scores all chunks of the document."""
    if k > 0:
        pairs = topk_similarity_join(hyps, chunks, doc=doc, hyp_id=hyp_id, chunk_id=chunk_id, hyp=hyp, chunk=chunk, n=n, k=k).select(doc, hyp_id, chunk_id)
    else:
        pairs = hyps.select(doc, hyp_id).join(chunks.select(doc, chunk_id), doc)
    texts = pairs.join(hyps.select(doc, hyp_id, F.col(hyp).alias("__h")), [doc, hyp_id]).join(chunks.select(doc, chunk_id, F.col(chunk).alias("__p")), [doc, chunk_id])
    return texts.select(doc, hyp_id, chunk_id, scorer(F.col("__p"), F.col("__h")).alias("entail"))


def best_per_hypothesis(hyps: DataFrame, evidence: DataFrame, doc: str = "doc", hyp_id: str = "hyp_id") -> DataFrame:
    best = evidence.groupBy(doc, hyp_id).agg(F.max("entail").alias("best"))
    return hyps.select(doc, hyp_id).join(best, [doc, hyp_id], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))


def support_rate(best: DataFrame, tau: float = 0.5, doc: str = "doc") -> DataFrame:
    """Per cent of hypotheses supported at ``tau``, and the mean best score times 100 (the SummaC shape)."""
    return best.groupBy(doc).agg(F.count("*").alias("n"), (100.0 * F.avg((F.col("best") >= tau).cast("double"))).alias("rate"), (100.0 * F.avg("best")).alias("mean_best"))


def is_scaffold(t: Column | str, p: LangProfile = LATIN, least: int = 25) -> Column:
    """A form's skeleton: short, two colons, labels without a sentence end, a rule, or few letters."""
    t = F.col(t) if isinstance(t, str) else t
    labels = sum((F.contains(t, F.lit(x)).cast("int") for x in p.scaffold_labels), F.lit(0))
    ratio = F.regexp_count(t, F.lit(p.letter)) / F.greatest(F.length(t), F.lit(1))
    return (F.length(t) < least) | (F.regexp_count(t, F.lit(":")) >= 2) | ((labels >= 2) & ~t.rlike(p.scaffold_final)) | t.rlike(r"[_\-]{3,}") | (ratio < p.min_letter_ratio)


def is_predicate(t: Column | str, p: LangProfile = LATIN) -> Column:
    """A sentence rather than a form item."""
    t = F.trim(F.col(t) if isinstance(t, str) else t)
    return (F.length(t) >= p.min_predicate) & t.rlike(p.predicate) & ~(t.rlike(p.form_item) & ~t.rlike(p.predicate))


def is_meta(t: Column | str, p: LangProfile = LATIN) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    return t.rlike("|".join(f"(?:{x})" for x in p.meta))


def aggregate_modes(scores: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """GLOBAL, FILTERED, TOPK and LOCAL maxima in one pass over (keys, score, scaffold, rank, local).

    Where a filter leaves nothing, the mode falls back to all chunks.
    """
    best = F.max("score")
    of = lambda cond: F.coalesce(F.max(F.when(cond, F.col("score"))), best)
    return scores.groupBy(*keys).agg(best.alias("GLOBAL"), of(~F.col("scaffold")).alias("FILTERED"), of(F.col("rank") <= k).alias("TOPK"), of(F.col("local")).alias("LOCAL"))


def gate(keep: Column, hallucinated: Column, ground: Column, least_keep: float = 90.0, most: int = 0, least_ground: float = 70.0) -> Column:
    """struct<ok, reasons>; a metric that is null passes."""
    reasons = F.array_compact(F.array(F.when(keep < least_keep, "num_keep"), F.when(hallucinated > most, "n_halluc"), F.when(ground < least_ground, "ground")))
    return F.struct((F.size(reasons) == 0).alias("ok"), reasons.alias("reasons"))


def support_class(entail: Column, contradict: Column, tau: float = 0.5) -> Column:
    """contradicted before supported before unsupported, mutually exclusive."""
    return F.when((contradict >= tau) & (contradict > entail), "contradicted").when(entail >= tau, "supported").otherwise("unsupported")
