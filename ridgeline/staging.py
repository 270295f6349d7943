"""Cutting lineage, global numbering and fixpoint loops.

Tables that a job reuses are written as parquet below the folder the cluster names in
``spark.checkpoint.dir``.  Unlike blocks kept on executors they survive the loss of an
executor, and their sizes are known to the optimizer afterwards.
"""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

_fallback: str | None = None


def staging_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where the session names none, a temporary folder serves on one machine; a cluster must name
    a folder that driver and executors share.
    """
    global _fallback
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    if _fallback is None:
        _fallback = tempfile.mkdtemp(prefix="ridgeline-")
        spark.sparkContext.setCheckpointDir(_fallback)
    return _fallback


def new_path(spark: SparkSession, label: str) -> str:
    return os.path.join(staging_root(spark), f"{label}-{uuid.uuid4().hex}")


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and return a scan of it."""
    return stage_at(df, new_path(df.sparkSession, label))


def stage_at(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """``df`` for a join that is to shuffle both sides.

    What grows with the input must not be sent whole through the driver.  Staged ids and labels take so few bytes
    in their files that Spark would broadcast millions of rows of them.
    """
    return df.hint("merge")


#: Rows of a task where the work of a row is far more than its bytes in a file tell.
ROWS = 50_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, which has ``rows`` rows, in tasks of about ``ROWS`` however few bytes they take."""
    return df.repartition(max(1, math.ceil(rows / ROWS)), *keys)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def mark(spark: SparkSession, path: str) -> None:
    """Leave an empty file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True).close()


def number_rows(df: DataFrame, order: list[Column], name: str, *, start: int = 0, label: str = "numbered") -> DataFrame:
    """Dense global row number along ``order`` without a single-task window.

    One range-partitioned sort is staged with (partition, position) ids; the numbers of
    rows per partition, at most one row per sort task, give the offsets.
    """
    part = F.shiftright("_mono", 33)
    placed = df.orderBy(*order) if order else df
    sorted_rows = stage(placed.withColumn("_mono", F.monotonically_increasing_id()), label)
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(running), F.lit(0)).alias("_offset"))
    position = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        sorted_rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per sort task
        .withColumn(name, (position + F.col("_offset") + start).cast("bigint"))
        .drop("_mono", "_part", "_offset")
    )


def fixpoint(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], *, label: str = "round") -> DataFrame:
    """Repeat ``step`` until no row of its staged result has ``changed`` set.

    ``step`` gets the last state and the round number and returns the next state with a
    boolean column ``changed``; every round is staged, so lineage never grows, and a round is
    deleted once its successor is written.  A step must make progress whenever it reports a change
    (lower a label, extend a path), which bounds the rounds by the data.
    """
    spark, round_no, before = state.sparkSession, 0, None
    while True:
        path = new_path(spark, label)
        state = stage_at(step(state, round_no), path)
        if before is not None:
            discard(spark, before)
        before, round_no = path, round_no + 1
        if state.where("changed").isEmpty():
            return state
