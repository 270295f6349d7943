"""Tables, word patterns and task plumbing shared by the text operators.

Every operator selects the columns it needs before it adds its own, so extra columns of the
input never clash.  A null text counts as empty and a null ``doc_id`` is kept as null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, and words, as the contracts define them (Java and RE2 syntax).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a bit table at most: 32 MB for the driver and for a task.
BITS = 1 << 28


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text falls on ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def utf8(text: Column) -> Column:
    """The bytes of a text, empty for null; tasks get bytes and so need no decoding."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def words(text: Column) -> Column:
    """Array of the words of a text, natively; empty for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def per_document(rows: DataFrame, columns: str, make: Callable[[], Callable[[bytes], tuple]]) -> DataFrame:
    """``doc_id`` and the columns that ``make()`` computes from each whole text.

    ``rows`` has ``doc_id`` and ``text`` as bytes.  ``make`` is called once in a task, so that
    models and dictionaries are loaded once; batches are streamed, one in memory at a time.
    """
    schema = f"doc_id bigint, {columns}"
    names = [c.split()[0] for c in columns.split(", ")]
    types = [_ARROW[c.split()[1]] for c in columns.split(", ")]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            found = [work(text.as_py()) for text in batch.column("text")]
            parts = zip(*found) if found else ([] for _ in names)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(list(p), t) for p, t in zip(parts, types))], ["doc_id", *names]
            )

    return rows.mapInArrow(task, schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the text as bytes."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8(F.col("text")).alias("text"))


class BitTable:
    """Bit table of keys: two bits of a 64-bit hash; a key that was put in is always found."""

    def __init__(self, keys: DataFrame) -> None:
        """``keys`` has a column ``h``; at most ``BITS`` bits come to the driver and the tasks."""
        wanted = 16 * max(64, keys.count())
        self.mask = min(1 << (wanted - 1).bit_length(), BITS) - 1
        spots = F.array(F.col("h").bitwiseAND(self.mask), F.shiftrightunsigned("h", 32).bitwiseAND(self.mask))
        bits = keys.select(F.explode(spots).alias("spot")).groupBy(F.shiftright("spot", 6).alias("at"))
        found = bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits")).toArrow()
        self.cells = np.zeros(self.mask + 1 >> 6, np.uint64)
        self.cells[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        def at(spot: np.ndarray) -> np.ndarray:
            return (self.cells[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1)

        mask = np.uint64(self.mask)
        return (at(hashes & mask) & at((hashes >> np.uint64(32)) & mask)).astype(bool)
