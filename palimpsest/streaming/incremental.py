"""Resumable work: only what is missing or out of date is computed; a stream of inputs goes the same way."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.functions.text import input_hash
from palimpsest.operators.relational import anti_todo

GOOD = ("ok", "skipped", "cached")


def with_stage_hash(df: DataFrame, stage: str, version: str, *parts: str) -> DataFrame:
    """``df`` with stage, stage_version and the hash of its inputs, to which an earlier stage's text belongs."""
    return df.withColumns({"stage": F.lit(stage), "stage_version": F.lit(version), "input_hash": input_hash(F.lit(version), *[F.col(p) for p in parts])})


def cache_valid(status: Column, version: Column, cached_version: Column, digest: Column, cached_digest: Column) -> Column:
    return F.coalesce(status.isin(*GOOD) & (version == cached_version) & (digest == cached_digest), F.lit(False))


def stale(wanted: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``wanted`` without a good cached result of the same stage, version and input hash."""
    return anti_todo(wanted, cache.where(F.col("status").isin(*GOOD)), [*keys, "stage", "stage_version", "input_hash"])


def hits(wanted: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = [*keys, "stage", "stage_version", "input_hash"]
    return cache.where(F.col("status").isin(*GOOD)).join(wanted.select(*on).distinct(), on, "left_semi")


def refresh(wanted: DataFrame, cache: DataFrame, keys: Sequence[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cached rows where valid, computed ones for the rest; ``compute`` adds the result columns of ``cache``."""
    return hits(wanted, cache, keys).unionByName(compute(stale(wanted, cache, keys)), allowMissingColumns=True)


def process_stream(source: DataFrame, target: str, checkpoint: str, keys: Sequence[str], compute: Callable[[DataFrame], DataFrame], *, available_now: bool = True) -> StreamingQuery:
    """Append results of new inputs to the parquet table ``target``; inputs whose keys it has are passed over.

    Each micro-batch writes its own partition by overwrite, so a batch that is tried again writes the same rows once.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        todo = df.dropDuplicates(list(keys))
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path) and fs.listStatus(path):
            done = spark.read.option("basePath", target).parquet(target).where(F.col("batch") != batch_id)
            todo = anti_todo(todo, done, keys)
        compute(todo).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
