"""Tables as queries read them, and the SQL fragments that say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.profiles import LATIN
from palimpsest.functions.text import split_sentences
from palimpsest.operators.relational import sentences


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_sentences(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"), split_sentences("text", LATIN), list(keep))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, src, out): each user turn with the assistant turn right behind it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("out", F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w)))
    return rows.where("role = 'user' and out is not null").select("conv_id", "turn", F.col("text").alias("src"), "out")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, quality, toxic)"""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


def sents_of(source: str, text: str = "text", keys: str = "doc_id, lang", name: str = "sents", order: str = "doc_id") -> str:
    """SQL common table: the sentences of a column, numbered from 0."""
    return rf"""{name} as (
  select {keys}, (row_number() over (partition by {order} order by pos) - 1)::int as sent_id, s as text from (
    select {keys}, pos, trim(regexp_replace(x, '[ \t\r\f]+', ' ', 'g')) as s from (
      select {keys}, unnest(parts) as x, generate_subscripts(parts, 1) as pos from (
        select {keys}, string_split_regex(regexp_replace({text}, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+') as parts from {source})))
  where length(s) >= 10 and not regexp_matches(s, '^\s*(\d+|[A-Za-z])\s*[.)]\s*$'))"""


SENTS = sents_of("documents")
PAIRS = """pairs as (
  select conv_id, turn, text as src, nxt as out from (
    select *, lead(role) over w as next_role, lead(text) over w as nxt from conversations window w as (partition by conv_id order by turn))
  where role = 'user' and next_role = 'assistant')"""
LABELLED = "lab as (select doc_id, lang, source, n_chars, quality, toxic from documents join labels using (doc_id))"


def sql_sents(t: str) -> str:
    """SQL list of a text's sentences."""
    split = rf"list_transform(string_split_regex(regexp_replace({t}, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(regexp_replace(x, '[ \t\r\f]+', ' ', 'g')))"
    return rf"list_filter({split}, lambda x: length(x) >= 10 and not regexp_matches(x, '^\s*(\d+|[A-Za-z])\s*[.)]\s*$'))"


def sql_words(t: str) -> str:
    return rf"list_filter(string_split_regex({t}, '\s+'), lambda w: w <> '')"


def sql_squeeze(t: str) -> str:
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def sql_ngrams(t: str, n: int) -> str:
    bare = rf"regexp_replace({t}, '\s+', '', 'g')"
    return f"(case when length({bare}) = 0 then [] else list_distinct(list_transform(range(1, greatest(length({bare}) - {n} + 1, 1) + 1), lambda i: substr({bare}, i::int, {n}))) end)"


def sql_jaccard(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b}))::double / greatest(len({a}) + len({b}) - len(list_intersect({a}, {b})), 1))"


UNIT = r"(\d{1,4})\s*(%|days|weeks|months|years|hours|min|mg|ml|cm|kg)"


def sql_units(t: str) -> str:
    """Number units; the look-behind is stood in for by a captured character before."""
    return rf"list_transform(regexp_extract_all({t}, '(?:^|[^\d.])({UNIT})', 1), lambda x: regexp_replace(x, '\s+', '', 'g'))"
