"""Tables written to the folder that all executors share, to cut lineage so that jobs survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_ROOT = "/tmp/checkpoints"
_WRITTEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a folder of its own below ``/tmp/checkpoints``
    (removed when Python ends) and any other session one below its warehouse, which a cluster shares.
    """
    own = getattr(spark, "_palimpsest_dir", None)
    if own:
        return own
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if spark.sparkContext.master.startswith("local"):
            path = f"{LOCAL_ROOT}/palimpsest-{uuid.uuid4().hex}"
            atexit.register(shutil.rmtree, path, ignore_errors=True)
        else:
            path = f"{spark.conf.get('spark.sql.warehouse.dir')}/palimpsest-staging"
    spark._palimpsest_dir = path.rstrip("/")
    return spark._palimpsest_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete what this process has written to the shared folder, once the results that read it are saved; how many tables."""
    n = len(_WRITTEN)
    for path in list(_WRITTEN):
        delete(spark, path)
    return n


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._palimpsest_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``stage`` wrote; only for tables that no later plan reads."""
    path = getattr(df, "_palimpsest_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    _WRITTEN.discard(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
