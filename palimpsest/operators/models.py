"""Where a model plugs in: scalar interfaces with deterministic stand-ins, loaded once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.profiles import KO, LangProfile
from palimpsest.functions.text import strip_particle, word_set

#: Made once per Python worker; maps a batch of texts to a batch of results.
Loader = Callable[[], Callable[[pd.Series], pd.Series]]
PairLoader = Callable[[], Callable[[pd.Series, pd.Series], pd.Series]]


def text_model(load: Loader, returns: str = "string"):
    """A column function over texts (generation, translation, lemmas); the loader runs once per worker."""

    @F.pandas_udf(returns)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in parts:
            yield model(s)

    return run


def pair_model(load: PairLoader, returns: str = "double"):
    """A column function over (premise, hypothesis) or (source, output) pairs: entailment, translation quality."""

    @F.pandas_udf(returns)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in parts:
            yield model(a, b)

    return run


def judge(claim: Column, source: Column, cited: Column, least: float = 0.15) -> Column:
    """'supported' if the cited text stands in the source and shares enough words with the claim, 'unrelated' if it only stands there, else 'absent'."""
    c, s = word_set(claim), word_set(cited)
    overlap = F.size(F.array_intersect(c, s)) / F.greatest(F.size(c), F.lit(1))
    return F.when(~F.contains(source, cited) | (F.trim(cited) == ""), "absent").when(overlap >= least, "supported").otherwise("unrelated")


def verdict_score(verdict: Column) -> Column:
    return F.when(verdict == "present", 1.0).when(verdict == "partial", 0.5).when(verdict == "absent", 0.0)


def pick_option(scores: Column, options: Sequence[str]) -> Column:
    """The option with the highest score, the first of equals."""
    return F.element_at(F.array(*map(F.lit, options)), F.array_position(scores, F.array_max(scores)).cast("int"))


def multiple_choice_prompt(question: Column, options: Column, letters: str = "ABCDE") -> Column:
    listed = F.transform(options, lambda o, i: F.concat(F.substring(F.lit(letters), i + 1, F.lit(1)), F.lit(". "), o))
    return F.concat(question, F.lit("\n"), F.array_join(listed, "\n"), F.lit("\nAnswer:"))


def rule_terms(docs: DataFrame, doc: str, text: str, p: LangProfile = KO, low: int = 2, high: int = 10) -> DataFrame:
    """(doc, term): letter runs without their particle, ``low`` to ``high`` long and no stop word."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"{p.letter}{{2,12}}"), F.lit(0))
    terms = docs.select(doc, F.explode(runs).alias("__w")).select(doc, strip_particle(F.col("__w"), p.particles).alias("term"))
    return terms.where(F.length("term").between(low, high) & ~F.col("term").isin(*sorted(p.stop_words))).distinct()
