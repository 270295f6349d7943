"""Typed parquet tables that hand one stage over to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def write_tables(tables: dict[str, DataFrame], folder: str, *, only: list[str] | None = None, partition_by: dict[str, str] | None = None) -> None:
    """Write the named tables (all if none are named), replacing earlier ones."""
    for name, df in tables.items():
        if only is not None and name not in only:
            continue
        writer = df.write.mode("overwrite")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.parquet(f"{folder}/{name}")
