"""Folders of ``.npy`` arrays as a Spark data source.

Rows of an array have a fixed width, so a partition is a range of rows and every task reads
only its own bytes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def _shape(path: str) -> tuple[int, int, np.dtype]:
    array = np.load(path, mmap_mode="r")  # reads the header only
    if array.ndim not in (1, 2):
        raise ValueError(f"{path}: one or two dimensions expected")
    return array.shape[0], (array.shape[1] if array.ndim == 2 else 1), array.dtype


class RowRange(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class NpyReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, rows_per_task: int):
        self.path, self.schema, self.rows_per_task = path, schema, rows_per_task

    def partitions(self) -> list[RowRange]:
        rows, _, _ = _shape(self.path)
        return [RowRange(s, min(s + self.rows_per_task, rows)) for s in range(0, rows, self.rows_per_task)] or [RowRange(0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        array = np.load(self.path, mmap_mode="r")
        whole = isinstance(self.schema.fields[1].dataType, LongType)
        for start in range(partition.start, partition.stop, 65536):
            part = np.asarray(array[start : min(start + 65536, partition.stop)])
            part = part.reshape(len(part), -1)
            ids = pa.array(np.arange(start, start + len(part), dtype=np.int64))
            columns = [pa.array(part[:, i].astype(np.int64 if whole else np.float64)) for i in range(part.shape[1])]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=self.schema.names)


class NpyDataSource(DataSource):
    """``format('npy')``: ``id`` and one column ``c0, c1, ...`` per array column."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> StructType:
        _, width, dtype = _shape(self.options["path"])
        kind = LongType() if np.issubdtype(dtype, np.integer) or dtype == bool else DoubleType()
        return StructType([StructField("id", LongType()), *(StructField(f"c{i}", kind) for i in range(width))])

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options["path"], schema, int(self.options.get("rowspertask", 1_000_000)))


def read_npy_dir(spark: SparkSession, path: str, *, keys: list[str] | None = None, rows_per_task: int = 1_000_000) -> dict[str, DataFrame]:
    """One DataFrame per array file; named arrays that do not exist are skipped."""
    if not os.path.isdir(path):
        raise FileNotFoundError(path)
    spark.dataSource.register(NpyDataSource)
    present = sorted(f[:-4] for f in os.listdir(path) if f.endswith(".npy"))
    wanted = present if keys is None else [k for k in keys if k in present]
    return {k: spark.read.format("npy").option("rowspertask", rows_per_task).load(f"{path}/{k}.npy") for k in wanted}


def assemble(arrays: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``surface`` and ``mat`` tables from the arrays, joined on the row number."""
    def named(key: str, names: list[str]) -> DataFrame:
        return arrays[key].toDF("s_id", *names)

    surface = named("coords", ["px", "py", "pz"])
    if "normals" in arrays:
        surface = surface.join(named("normals", ["nx", "ny", "nz"]), "s_id", "left")
    sides = []
    for side in ("in", "out"):
        ball = named(f"ma_coords_{side}", ["cx", "cy", "cz"]).join(named(f"ma_qidx_{side}", ["q_id"]), "s_id")
        sides.append(ball.select("s_id", F.lit(side).alias("side"), "cx", "cy", "cz", F.col("q_id").cast("bigint").alias("q_id")))
    return surface, sides[0].unionByName(sides[1])
