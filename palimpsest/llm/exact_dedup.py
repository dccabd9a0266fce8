"""Exact deduplication: group by a 128-bit content hash, keep the smallest id, compare bytes inside the groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.joins import attach, masked, unmasked
from palimpsest.storage import stage

#: Hashes of repeated contents are broadcast up to this many (about 60 bytes each).
BROADCAST_ROWS = 500_000
#: More of them are broadcast in so many ranges of the hash at most, one scan each; beyond that texts are shuffled once.
RANGES = 4


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def content_hash(norm: Column, bits: int) -> Column:
    return F.unhex(F.substring(F.md5(norm), 1, bits // 4))


def _classes(slim: DataFrame, key: list[str]) -> DataFrame:
    """Classes of several rows: their rows, smallest id and the row that stays (any one of the rows that repeat the smallest id)."""
    stats = slim.groupBy(*key).agg(F.count("*").alias("n_rows"), F.min("id").alias("keep_id"), F.coalesce(F.min_by("rid", "id"), F.min("rid")).alias("keep_rid"))
    return stage(stats.where("n_rows > 1"), "exact-classes")


def _members(texts: DataFrame, classes: DataFrame, key: list[str], n: int) -> DataFrame:
    """Texts whose class has several rows; only they move, up to RANGES * BROADCAST_ROWS classes."""
    ranges = max(-(-n // max(BROADCAST_ROWS, 1)), 1)
    if BROADCAST_ROWS and ranges <= RANGES:
        part = lambda df, i: df.where(F.pmod(F.xxhash64("h"), F.lit(ranges)) == i)
        return reduce(DataFrame.unionByName, [part(texts, i).join(F.broadcast(part(classes.select(*key), i)), key, "left_semi") for i in range(ranges)])
    return attach(texts, classes.select(*key, "n_rows"), key, how="left_semi", broadcast_rows=0)


def _collisions(texts: DataFrame, classes: DataFrame, key: list[str]) -> int:
    """Classes of several rows that hold texts of different bytes."""
    n = classes.count()
    if not n:
        return 0
    members = _members(texts.select(*key, "norm"), classes, key, n)
    return members.distinct().groupBy(*key).count().where("count > 1").count()


def content_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 128) -> tuple[DataFrame, DataFrame, list[str]]:
    """Staged rows (id, rid, h, text_sha256), staged classes of several rows, and the columns that identify a class.

    Rows meet by ``h``, the first ``hash_bits`` bits of the MD5 of the normalised text. Each group of several rows
    is then compared by bytes: texts of one group are brought to one copy of each by map-side aggregation, so a hot
    group does not travel. Should a group hold different bytes, classes are formed by (h, SHA-256) and compared anew.
    """
    norm = normalised(F.col(f"`{text_col}`"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), norm.alias("norm")).withColumns({"h": content_hash(F.col("norm"), hash_bits), "text_sha256": F.sha2(F.col("norm"), 256)})
    slim = stage(texts.select("id", F.monotonically_increasing_id().alias("rid"), "h", "text_sha256"), "exact-rows")
    for key in (["h"], ["h", "text_sha256"]):
        classes = _classes(slim, key)
        if not _collisions(texts, classes, key):
            return slim, classes, key
    raise ValueError("texts of different bytes share both hashes")


def exact_groups(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space becomes one space; null counts as empty.
    Of equal texts the row with the smallest id stays; among rows that repeat that id exactly one stays. A null id
    never wins against an id; a class of null ids only has keep_id null and one row that stays. Empty in, empty out; other
    columns don't matter. Only classes of several rows meet the rows again.
    """
    slim, classes, key = content_groups(docs, **options)
    met = attach(slim, classes.withColumn("group_size", F.col("n_rows")), key, broadcast_rows=BROADCAST_ROWS)
    alone = F.col("group_size").isNull()
    return met.select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 128) -> DataFrame:
    """``docs`` (all its columns, whatever their names) without rows whose normalised text another row with a smaller id has.

    Same rules as ``exact_groups``. Of rows that repeat the smallest id and the normalised text the one stays whose columns
    hash least, so that reruns agree; they are aggregated where they lie.
    """
    _, classes, key = content_groups(docs, id_col=id_col, text_col=text_col, hash_bits=hash_bits)
    rows, names = masked(docs)
    norm = normalised(F.col(names[text_col]))
    rows = rows.withColumns({"h": content_hash(norm, hash_bits)} | ({"text_sha256": F.sha2(norm, 256)} if len(key) > 1 else {}))
    met = attach(rows, classes.select(*key, "keep_id", "n_rows", F.lit(True).alias("repeated")), key, broadcast_rows=BROADCAST_ROWS)
    single = met.where("repeated is null")
    keepers = met.where(F.col("repeated") & F.col(names[id_col]).eqNullSafe(F.col("keep_id")))
    first = keepers.groupBy(*key).agg(F.min_by(F.struct(*names.values()), F.xxhash64(*names.values())).alias("r")).select("r.*")
    return unmasked(single, docs).unionByName(unmasked(first, docs))
