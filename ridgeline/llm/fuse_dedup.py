"""Exact deduplication against immutable snapshots with static binary-fuse filters.

Documents arrive in batches.  A batch is digested (SHA-256 of the text, A-Z lower-cased) and its own
duplicates are grouped by digest.  Every earlier batch is a snapshot that never changes: its digests
lie in buckets by their leading bytes, and each bucket has a static filter, a 3-wise binary-fuse
array of 16-bit fingerprints (about 18 bits a digest, 1 false positive in 65,536, no false negative).  The batch's digests
are screened bucket by bucket; only positives are joined with the exact bucket of the snapshot.
Wherever two rows share a digest their texts are compared byte by byte; unequal texts with one digest
stop the job with an error.

Filters are built and used in the tasks of their buckets; the number of buckets follows the number of
digests, so the filter of a bucket stays small, and nothing is broadcast.  Copies collapse in partial
aggregates before any shuffle, so a group with a third of all rows is no burden to one task.

Null counts as empty text; empty texts are equal to each other.  Rows equal in id and text are
rows of one group of which one stays.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import BitTable, utf8
from ridgeline.staging import stage

PER_BUCKET = 100_000


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser over keys and seed (murmur3 constants)."""
    h = keys.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


@dataclass
class FuseFilter:
    """Static filter over 64-bit keys: three slots in neighbouring segments xor to the fingerprint."""

    seed: int
    segment: int  # slots in a segment, a power of two
    segments: int  # starting segments
    slots: np.ndarray

    @staticmethod
    def _places(hashes: np.ndarray, segment: int, segments: int) -> np.ndarray:
        start = ((hashes >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64) * segment
        own = [(hashes >> np.uint64(shift)).astype(np.int64) & (segment - 1) for shift in (0, 11, 22)]
        return np.stack([start + own[i] + i * segment for i in range(3)])

    @staticmethod
    def _prints(hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Peels the 3-uniform hypergraph in rounds; a seed that does not peel is replaced by the next."""
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << min(18, max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        spread = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))
        seed = 0
        while True:
            seed += 1
            segments = max(1, int(np.ceil(n * (spread + 0.01 * seed) / segment)) - 2)
            hashes = _mix(keys, seed)
            places = cls._places(hashes, segment, segments)
            size = (segments + 2) * segment
            count = np.bincount(places.ravel(), minlength=size)
            owner = np.zeros(size, np.int64)
            for p in places:
                np.bitwise_xor.at(owner, p, np.arange(n))
            alive, order = np.ones(n, bool), []
            while True:
                free = np.flatnonzero(count == 1)
                if not len(free):
                    break
                peeled, first = np.unique(owner[free], return_index=True)
                at = free[first]
                order.append((peeled, at))
                alive[peeled] = False
                for p in places[:, peeled]:
                    np.subtract.at(count, p, 1)
                    np.bitwise_xor.at(owner, p, peeled)
            if not alive.any():
                break
        slots, prints = np.zeros(size, np.uint16), cls._prints(hashes)
        for peeled, at in reversed(order):  # a round's own slots are read by no other key of the round
            three = places[:, peeled]
            slots[at] = 0
            slots[at] = prints[peeled] ^ slots[three[0]] ^ slots[three[1]] ^ slots[three[2]]
        return cls(seed, segment, segments, slots)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        hashes = _mix(keys, self.seed)
        three = self._places(hashes, self.segment, self.segments)
        return self.slots[three[0]] ^ self.slots[three[1]] ^ self.slots[three[2]] == self._prints(hashes)


def digested(docs: DataFrame, carry: Column) -> DataFrame:
    """``row`` as ``carry`` gives it, and ``digest``, the SHA-256 of the normalised bytes of the text."""
    rows = docs.select(carry.alias("row"), utf8(F.col("text")).alias("_bytes"))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([hashlib.sha256(t.as_py().lower()).digest() for t in batch.column("_bytes")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), found], ["row", "digest"])

    return rows.mapInArrow(task, rows.select("row", F.lit(b"").alias("digest")).schema)


def _number(start: int) -> Column:
    """Eight bytes of the digest as an integer, for buckets (0) and filters (8)."""
    half = [F.conv(F.hex(F.substring("digest", start + i + 1, 4)), 16, 10).cast("bigint") for i in (0, 4)]
    return F.shiftleft(half[0], 32).bitwiseOR(half[1])


def build_filters(entries: DataFrame) -> DataFrame:
    """``bucket`` and its filter, from the distinct digests of a snapshot (``bucket``, ``key``)."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(group["key"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"bucket": [group["bucket"].iloc[0]], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "slots": [f.slots.tobytes()]})

    return entries.select("bucket", "key").groupBy("bucket").applyInPandas(build, "bucket bigint, seed bigint, segment bigint, segments bigint, slots binary")


def screen(entries: DataFrame, filters: DataFrame) -> DataFrame:
    """The ``bucket`` and ``digest`` of the entries that a snapshot's filters let through."""

    def test(group: pd.DataFrame, filter_: pd.DataFrame) -> pd.DataFrame:
        if filter_.empty or group.empty:
            return group[["bucket", "digest"]].iloc[:0]
        one = filter_.iloc[0]
        f = FuseFilter(int(one.seed), int(one.segment), int(one.segments), np.frombuffer(one.slots, np.uint16))
        return group.loc[f.contains(group["key"].to_numpy(np.int64).view(np.uint64)), ["bucket", "digest"]]

    return entries.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(test, "bucket bigint, digest binary")


def duplicate_groups(docs: DataFrame, *, batches: int = 3) -> DataFrame:
    """``doc_id, digest, copies, keep_id, group_size``: rows equal in id and text as one with their number.

    Rows are dealt to ``batches`` arrivals by their id; each is screened against all earlier ones.
    """
    ids = digested(docs, F.struct(F.col("doc_id").cast("bigint").alias("doc_id"))).select("row.doc_id", "digest")
    units = stage(ids.groupBy("doc_id", "digest").agg(F.count("*").alias("copies")), "dedup-rows")
    arrival = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % batches
    buckets = max(1, -(-units.count() // PER_BUCKET))
    entries = units.groupBy(arrival.alias("batch"), "digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("n"))
    entries = entries.withColumns({"bucket": F.pmod(_number(0), F.lit(buckets)), "key": _number(8)})
    entries = stage(entries, "dedup-entries")

    matched, filters = None, []
    for b in range(1, batches):
        new = entries.where(F.col("batch") == b)
        filters.append(stage(build_filters(entries.where(F.col("batch") == b - 1)), "dedup-filters"))  # batch b - 1 is closed now
        for earlier in range(b):
            snapshot = entries.where(F.col("batch") == earlier)
            positive = screen(new.select("bucket", "key", "digest"), filters[earlier])
            exact = positive.join(snapshot.select("bucket", "digest"), ["bucket", "digest"], "left_semi").select("digest")
            matched = exact if matched is None else matched.unionByName(exact)
    none = entries.select("digest").limit(0)
    matched = stage((none if matched is None else matched).distinct(), "dedup-matched")

    across = entries.join(matched, "digest", "left_semi").groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    alone = entries.join(matched, "digest", "left_anti").select("digest", "keep_id", "n")
    groups = stage(alone.unionByName(across).withColumnRenamed("n", "group_size"), "dedup-groups")
    check_bytes(docs, groups.where("group_size > 1").select("digest"))
    return units.join(groups, "digest").select("doc_id", "digest", "copies", "keep_id", "group_size")


def check_bytes(docs: DataFrame, digests: DataFrame) -> None:
    """Compares the bytes of all texts under each of the ``digests``: the first and the last in order must be equal.

    Only rows that a bit table of the digests lets through leave their task, and copies collapse to two
    texts for each task before the shuffle.
    """
    known = BitTable(digests.select(_number(8).alias("h")))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [t.as_py().lower() for t in batch.column("_bytes")]
            found = [hashlib.sha256(t).digest() for t in low]
            keys = np.frombuffer(b"".join(d[8:16] for d in found), ">u8").astype(np.uint64)
            passed = pa.array(known.holds(keys), pa.bool_())
            whole = pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(low, pa.binary())], ["digest", "bytes"])
            yield whole.filter(passed)

    texts = docs.select(utf8(F.col("text")).alias("_bytes")).mapInArrow(task, "digest binary, bytes binary")
    ends = texts.groupBy("digest").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
    if not ends.where("low <> high").isEmpty():
        raise ValueError("unequal texts share a SHA-256 digest")


def deduplicate(docs: DataFrame, *, batches: int = 3) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row; one row of a group is kept."""
    found = duplicate_groups(docs, batches=batches)
    rows = found.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, *, batches: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    found = duplicate_groups(docs, batches=batches)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "copies")
    rows = digested(docs, F.struct(*docs.columns))
    same = (F.col("digest") == F.col("_digest")) & F.col("row.doc_id").eqNullSafe(F.col("_id"))
    single = rows.join(stays.where("copies = 1"), same, "left_semi").select("row")
    # only rows equal in id and text need another look, to keep one of them
    repeated = rows.join(stays.where("copies > 1"), same).groupBy("_digest", "_id").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return single.unionByName(repeated).select("row.*")


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
 doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AND row_number() OVER (PARTITION BY t, doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents) d
WINDOW g AS (PARTITION BY t)
"""
