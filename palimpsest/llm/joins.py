"""Joins of rows with facts about their classes that survive classes of any size, and columns that clash with no input's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Facts about classes are broadcast up to this many rows (about 100 bytes each).
BROADCAST_ROWS = 500_000
#: A class of more rows than this is hot. There are at most rows / HOT_ROWS hot classes.
HOT_ROWS = 100_000


#: Rows and bytes of an Arrow batch at most: both sides of a Python task hold some of them with whole texts.
BATCH_ROWS, BATCH_BYTES = 1024, 1 << 23


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to BATCH_ROWS and BATCH_BYTES where they are higher or unset."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        own = spark.conf.get(key, None)
        number = int(own) if own and own.lstrip("-").isdigit() else 0
        if spark.conf.isModifiable(key) and not 0 < number <= most:
            spark.conf.set(key, str(most))


def masked(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns in_0, in_1, ... and the new name of each; names made inside an operator start otherwise."""
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def unmasked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their own names, and no others."""
    return rows.select(*[f"in_{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def attach(rows: DataFrame, classes: DataFrame, keys: list[str], *, how: str = "left", size: str = "n_rows", broadcast_rows: int | None = None, count: int | None = None) -> DataFrame:
    """Join ``rows`` with ``classes`` (one row per ``keys``, staged, ``size`` the rows of the class), without ``size``.

    Up to ``broadcast_rows`` classes are broadcast. Beyond that the hot ones, of which rows / HOT_ROWS bounds the number, are
    broadcast and only rows of other classes are shuffled, so that no task gets all rows of a hot class. ``count``: the number
    of classes, where it is known.
    """
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    if (classes.limit(limit + 1).count() if count is None else count) <= limit:
        return rows.join(F.broadcast(classes.drop(size)), keys, how)
    hot, cold = classes.where(F.col(size) > HOT_ROWS).drop(size), classes.where(F.col(size) <= HOT_ROWS).drop(size)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return rows.join(F.broadcast(hot), keys, "left_semi" if how == "left_semi" else "inner").unionByName(rest)
