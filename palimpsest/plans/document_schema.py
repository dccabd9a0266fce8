"""The nested record of a processed document, its validation and the roll-up of stage states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "1.0"
LANGS = ("en", "zh", "ja", "vi")
# States of documents and stages, and the parts that a document must have.
DOC_STATUS = ("pending", "running", "complete", "partial", "failed")
STAGE_STATUS = ("ok", "skipped", "cached", "failed")
BLOCKS = ("source", "integrity", "simplified", "glossary", "ko_validation", "simplicity")
REQUIRED = ("schema_version", "doc_id", "status", "pipeline", *BLOCKS, "translations", "mt_validation", "display")

META = T.StructType([T.StructField(n, T.StringType()) for n in ("stage", "stage_version", "input_hash", "status", "computed_at")])


def _block(**fields: T.DataType) -> T.StructType:
    return T.StructType([*(T.StructField(n, t) for n, t in fields.items()), T.StructField("meta", META)])


_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()
_LIST = T.ArrayType(_S)
_SECTION = T.StructType([T.StructField("title", _S), T.StructField("body", _S), T.StructField("hangul_len", _I)])
_INSERTION = T.StructType([T.StructField("term", _S), T.StructField("explanation", _S), T.StructField("position", _I)])

DOCUMENT = T.StructType(
    [
        *(T.StructField(n, _S) for n in ("schema_version", "doc_id", "status")),
        T.StructField("pipeline", T.StructType([T.StructField("langs", _LIST), T.StructField("stage_versions", T.MapType(_S, _S)), T.StructField("completed_stages", _LIST), T.StructField("failed_stages", _LIST)])),
        T.StructField("source", _block(text=_S, sections=T.ArrayType(_SECTION))),
        T.StructField("integrity", _block(blanks=T.ArrayType(_S), n_blanks=_I)),
        T.StructField("simplified", _block(text=_S, model=_S)),
        T.StructField("glossary", _block(text=_S, insertions=T.ArrayType(_INSERTION), n_insertions=_I, skipped=T.ArrayType(_INSERTION), n_skipped=_I)),
        T.StructField("ko_validation", _block(ground=_D, cover=_D, num_keep=_D, n_halluc=_I, gate_pass=T.BooleanType())),
        T.StructField("simplicity", _block(metrics=T.MapType(_S, _D))),
        T.StructField("translations", T.MapType(_S, _block(text=_S, model=_S))),
        T.StructField("mt_validation", T.MapType(_S, _block(fwd=_D, rev=_D, num_keep=_D, term_acc=_D))),
        T.StructField("display", T.StructType([T.StructField("korean_source", _S), T.StructField("korean_simple", _S), T.StructField("warnings", T.ArrayType(T.MapType(_S, _S))), T.StructField("glossary_tooltips", T.ArrayType(T.MapType(_S, _S)))])),
    ]
)


def _meta_errors(name: str, meta: Column, strict: bool) -> list[Column]:
    missing = [F.when(meta.isNotNull() & meta[f].isNull(), F.lit(f"{name}.meta lacks {f}")) for f in ("stage", "stage_version", "input_hash", "status")]
    wrong = F.when(meta.isNotNull() & ~F.coalesce(meta["status"].isin(*STAGE_STATUS), F.lit(False)), F.concat(F.lit(f"{name}.meta.status is wrong: "), F.coalesce(meta["status"], F.lit("null"))))
    return [*missing, wrong, *([F.when(meta.isNull(), F.lit(f"{name}.meta is empty"))] if strict else [])]


def validation_errors(strict: bool = False) -> Column:
    """What is wrong with a document of schema DOCUMENT, as an array; a missing top-level part is reported alone."""
    top = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing: {c}")) for c in REQUIRED]))
    found = [
        F.when(F.col("schema_version") != SCHEMA_VERSION, F.concat(F.lit("schema_version differs: "), F.col("schema_version"))),
        F.when(~F.col("status").isin(*DOC_STATUS), F.concat(F.lit("unknown status: "), F.col("status"))),
    ]
    for part in ("translations", "mt_validation"):
        found += [F.when(~F.map_contains_key(part, F.lit(x)), F.lit(f"{part} lacks {x}")) for x in LANGS]
    for b in BLOCKS:
        found += _meta_errors(b, F.col(f"{b}.meta"), strict)
    for part in ("translations", "mt_validation"):
        for x in LANGS:
            found += _meta_errors(f"{part}.{x}", F.try_element_at(F.col(part), F.lit(x))["meta"], strict)
    for block, array, count in (("glossary", "insertions", "n_insertions"), ("glossary", "skipped", "n_skipped"), ("integrity", "blanks", "n_blanks")):
        found.append(F.when(~F.col(f"{block}.{count}").eqNullSafe(F.size(F.coalesce(F.col(f"{block}.{array}"), F.array().cast(DOCUMENT[block].dataType[array].dataType)))), F.lit(f"{block}.{count} and the length of {array} differ")))
    if strict:
        found.append(F.when(F.coalesce(F.col("source.text"), F.lit("")) == "", F.lit("source.text is empty")))
        found.append(F.when(F.coalesce(F.col("display.korean_simple"), F.lit("")) == "", F.lit("display.korean_simple is empty")))
    rest = F.array_compact(F.array(*found))
    return F.when(F.size(top) > 0, top).otherwise(rest)


def rollup_status(stages: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """Per document: failed if a stage failed, complete if every required stage is good, else partial."""
    good = F.collect_set(F.when(F.col("status").isin("ok", "skipped", "cached"), F.col("stage")))
    agg = stages.groupBy(key).agg(F.bool_or(F.col("status") == "failed").alias("__failed"), good.alias("__good"))
    full = F.size(F.array_except(F.array(*map(F.lit, required)), F.col("__good"))) == 0
    return agg.select(key, F.when(F.col("__failed"), "failed").when(full, "complete").otherwise("partial").alias("status"))
