"""Near copies by exact Jaccard similarity of word shingles, from BK-tree links and rare shingles.

* Shingles: the distinct runs of ``size`` words, A-Z lower-cased; a shorter text is one shingle.  They are
  64-bit hashes here, and a text is the sorted array of its hashes.
* The SimHash operator's BK-trees give the first candidates: texts whose fingerprints differ in few bits.
* A prefix filter gives all others.  Shingles have one global order, rare ones first.  Two texts of n and m shingles
  at similarity s share at least s / (1 + s) * (n + m); so they share one among the first ``n - ceil(s n) + 1`` of each,
  and at their first common one, at places i and j, ``min(n - i, m - j)`` is at least that.  Texts are filed under these
  shingles with place and length.  The order comes from a sample of texts (of at most ``SAMPLE``, or one in
  ``THIN`` where that is more); any order finds all pairs, a good one finds few others: a common line comes last and is no key.
* Under a key a representative is compared with all members; members whose class differs go on, with four
  times as many representatives in the next round.  A key is done when one class is left or when all that could be
  the shorter text of a pair have been representatives.  Only classes at links matter, so pairs go
  untested only where links connect them already.
* Every link is verified on the whole arrays, which are made for the texts of a round's pairs only.  Each round is deleted when
  the next is written.

Null and blank texts are one text.  Equal texts are one node; repeated rows and ids do not matter.  Very long texts
are arrays of eight bytes a word.  An empty table gives no class.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.bk_simhash import keep_smallest, link_shards, simhash, text_digest
from ridgeline.llm.common import BitTable, utf8
from ridgeline.operators.components import components
from ridgeline.staging import discard, new_path, stage, stage_at

#: Texts in the sample that orders shingles, at most, unless one in THIN is more; shingles of the order that tasks get.
SAMPLE, THIN, ORDERED = 16_384, 16, 1 << 21
#: Nodes whose digests (32 bytes each) are broadcast to find their texts; more are joined by a shuffle.
FEW = 200_000
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """Hashes of words, forgotten now and then so that they stay few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 5)
        return found


def shingle_hashes(text: bytes, size: int, words: _Words) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    found = text.lower().split()  # bytes split on exactly the six ASCII blanks
    if len(found) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 7)], np.uint64)
    each = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    total = each[: len(each) - size + 1].copy()
    for k in range(1, size):
        total = total * _FACTOR + each[k : len(each) - size + 1 + k]
    total = (total ^ (total >> np.uint64(32))) * _MIX
    return np.unique(total ^ (total >> np.uint64(29)))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _order(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles that several sampled texts have, sorted, and their classes of frequency."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            found = [shingle_hashes(t.as_py(), size, words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], ["key"])

    thin = min(THIN, max(1, -(-docs.count() // SAMPLE)))
    texts = docs.select(utf8(F.col("text")).alias("text")).where(F.crc32("text") % thin == 0)
    counts = stage(texts.mapInArrow(task, "key bigint").groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-order")
    least, held = 2, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("keys")).orderBy(F.desc("n")).collect():  # one row for each count
        held += r["keys"]
        if held > ORDERED:
            least = r["n"] + 1
            break
    found = counts.where(F.col("n") >= least).orderBy("key").toArrow()
    keys = found.column("key").to_numpy().view(np.uint64)
    ranks = np.minimum(255, 4 * np.log2(found.column("n").to_numpy().astype(float))).astype(np.uint8)
    by_hash = np.argsort(keys)
    return keys[by_hash], ranks[by_hash]


def _marked(docs: DataFrame, size: int, percent: int, seed: int) -> DataFrame:
    """``node, doc_id, digest, n, fp, keys``: a number for each row, number of shingles, fingerprint, and the first shingles in order."""
    common, ranks = _order(docs, size)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sizes, prints, keys = [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                found = shingle_hashes(text, size, words)
                if len(common):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    rank = np.where(common[at] == found, ranks[at], 0)
                    ordered = found[np.argsort(rank, kind="stable")]
                else:
                    ordered = found
                sizes.append(len(found))
                prints.append(simhash(text, size, seed))
                keys.append(ordered[: len(found) - -(-percent * len(found) // 100) + 1].view(np.int64))
            columns = [*(batch.column(c) for c in ("node", "doc_id", "digest")), pa.array(sizes, pa.int64())]
            columns += [pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "doc_id", "digest", "n", "fp", "keys"])

    rows = docs.select(
        F.monotonically_increasing_id().alias("node"), F.col("doc_id").cast("bigint").alias("doc_id"), text_digest().alias("digest"), utf8(F.col("text")).alias("text")
    )
    return rows.mapInArrow(task, "node bigint, doc_id bigint, digest binary, n bigint, fp bigint, keys array<bigint>")


def _filed(marked: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """``key, node, n, i, short`` of the shingles that several texts are filed under.

    Most are filed under by one text only.  The keys alone are counted; a bit table of those that come twice keeps the
    others in their tasks.  ``short`` marks places where the shorter text of a pair can have its first common shingle.
    """
    twice = stage(marked.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key"), "near-twice")
    known = BitTable(twice.select(F.col("key").alias("h")))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.diff(batch.column("keys").offsets.to_numpy())
            keys = batch.column("keys").flatten().to_numpy()
            place = np.arange(len(keys)) - np.repeat(np.cumsum(held) - held, held)
            at = np.flatnonzero(known.holds(keys.view(np.uint64)))
            row = pa.array(np.repeat(np.arange(len(batch)), held)[at])
            columns = [pa.array(keys[at]), batch.column("node").take(row), batch.column("n").take(row), pa.array(place[at])]
            yield pa.RecordBatch.from_arrays(columns, ["key", "node", "n", "i"])

    rows = marked.select("keys", "node", "n").mapInArrow(task, "key bigint, node bigint, n bigint, i bigint")
    rows = rows.join(twice, "key", "left_semi").join(first.select("node"), "node", "left_semi")
    return rows.withColumn("short", (100 + percent) * (F.col("n") - F.col("i")) >= 2 * percent * F.col("n"))


def _arrays(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``node, hashes``: the shingle arrays of some texts, given as ``node, digest, copies``."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            found = [shingle_hashes(t.as_py(), size, words).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "hashes"])

    texts = docs.select(text_digest().alias("digest"), utf8(F.col("text")).alias("text"))
    wanted = texts.join(F.broadcast(nodes) if nodes.count() <= FEW else nodes, "digest")
    once = wanted.where("copies = 1").select("node", "text")  # only texts that several rows have are brought together
    several = wanted.where("copies > 1").groupBy("node").agg(F.min("text").alias("text"))
    return once.unionByName(several).mapInArrow(task, "node bigint, hashes binary")


def _verified(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose texts are alike.

    The array of ``a`` goes once to where its pairs are compared, and the arrays of ``b`` one by one; arrays that no pair
    needs do not travel where the pairs are few enough to be broadcast.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for a, b, hashes in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("hashes")):
                found = np.frombuffer(hashes.as_py(), np.uint64)
                if b is None:  # comes first among the rows of its text
                    last, held = a, found
                    keep.append(False)
                else:
                    keep.append(a == last and alike(held, found, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    few = pairs.count() <= FEW  # 16 bytes each
    firsts, seconds = pairs.select(F.col("a").alias("node")).distinct(), pairs.select("a", "b", F.col("b").alias("node"))
    own = arrays.join(F.broadcast(firsts) if few else firsts, "node", "left_semi").select(F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"), "hashes")
    others = arrays.join(F.broadcast(seconds) if few else seconds, "node").select("a", "b", "hashes")
    rows = own.unionByName(others).repartition("a").sortWithinPartitions("a", F.asc_nulls_first("b"))
    return rows.mapInArrow(task, "a bigint, b bigint")


def _tree_pairs(marked: DataFrame, radius: int) -> DataFrame:
    """``a, b``: texts with one fingerprint and their first one, and the first ones of linked fingerprints."""
    first = stage(marked.groupBy("fp").agg(F.min("node").alias("a"), F.max("node").alias("z")), "near-prints")
    same = marked.join(first.where("a <> z"), "fp").select("a", F.col("node").alias("b")).where("a <> b")
    linked = link_shards(first.select("fp"), radius=radius)
    ends = linked.join(first.select(F.col("fp").alias("a"), F.col("a").alias("_a")), "a").join(first.select(F.col("fp").alias("b"), F.col("a").alias("_b")), "b")
    return same.unionByName(ends.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))).distinct()


def classes(docs: DataFrame, *, size: int = 5, percent: int = 80, radius: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, digest, class`` for every row: texts that links of at least ``percent`` similarity connect."""
    spark = docs.sparkSession
    marked = stage(_marked(docs, size, percent, seed), "near-marks")
    first = stage(marked.groupBy("digest").agg(F.min("node").alias("node"), F.count("*").alias("copies")), "near-first")  # equal texts are one node
    path = new_path(spark, "near-state")
    state = stage_at(_filed(marked, first, percent).withColumn("class", F.col("node")), path)
    trees = stage(_tree_pairs(marked.join(first, ["digest", "node"], "left_semi").select("fp", "node"), radius), "near-trees")
    found_at = new_path(spark, "near-classes")
    nodes = state.select("node").unionByName(trees.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    found = stage_at(nodes.withColumn("class", F.col("node")), found_at)
    arrays: list[DataFrame] = []
    seen: list[DataFrame] = []

    turn, most = 0, 1
    while True:
        if turn == 0:
            pairs, used = trees, None
        else:
            open_ = state.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.max("short").alias("any"))
            open_ = open_.where("any and lo <> hi").select("key")
            before, path = path, new_path(spark, "near-state")
            state = stage_at(state.join(open_, "key", "left_semi"), path)
            discard(spark, before)
            if state.isEmpty():
                break
            could = state.where("short")
            if most == 1:
                ranked = could.groupBy("key").agg(F.min(F.struct("node", "n", "i", "class")).alias("first")).select("key", "first.*")
            else:
                order = Window.partitionBy("key").orderBy("node")
                ranked = could.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most)
            used_at = new_path(spark, "near-used")
            used = stage_at(ranked.select("key", F.col("node").alias("_p"), F.col("n").alias("_m"), F.col("i").alias("_j"), F.col("class").alias("_c")), used_at)
            near = F.least(F.col("n") - F.col("i"), F.col("_m") - F.col("_j")) * (100 + percent) >= percent * (F.col("n") + F.col("_m"))
            pairs = state.join(used, "key").where((F.col("class") != F.col("_c")) & near)
            pairs = pairs.select(F.least("node", "_p").alias("a"), F.greatest("node", "_p").alias("b")).distinct()
            most *= 4
        pairs_at, links_at = new_path(spark, "near-pairs"), new_path(spark, "near-links")
        pairs = stage_at(pairs, pairs_at)
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        for nodes in seen:
            asked = asked.join(nodes, "node", "left_anti")
        asked = stage(asked, "near-asked")
        if not asked.isEmpty():
            seen.append(asked)
            arrays.append(stage(_arrays(docs, first.join(asked, "node", "left_semi"), size), "near-arrays"))
        links = stage_at(_verified(pairs, functools.reduce(DataFrame.unionByName, arrays), percent) if arrays else pairs, links_at)
        discard(spark, pairs_at)
        new = None
        if not links.isEmpty():
            ends = links.join(found.select(F.col("node").alias("a"), F.col("class").alias("ca")), "a").join(found.select(F.col("node").alias("b"), F.col("class").alias("cb")), "b")
            new = stage(components(ends.select("ca", "cb"), key="class", ends=("ca", "cb")), "near-merged")
            renamed = F.coalesce("component", "class").alias("class")
            before, found_at = found_at, new_path(spark, "near-classes")
            found = stage_at(found.join(new, "class", "left").select("node", renamed), found_at)
            discard(spark, before)
        if new is not None or used is not None:
            next_ = state
            if used is not None:
                done = (F.col("key") == F.col("_k")) & (F.col("node") == F.col("_p"))
                next_ = next_.join(used.select(F.col("key").alias("_k"), "_p"), done, "left_anti")
            if new is not None:
                next_ = next_.join(new, "class", "left").select("key", "node", "n", "i", "short", renamed)
            before, path = path, new_path(spark, "near-state")
            state = stage_at(next_.select("key", "node", "n", "i", "short", "class"), path)
            discard(spark, before)
        discard(spark, links_at)
        if used is not None:
            discard(spark, used_at)
        turn += 1
    named = first.drop("copies").join(found, "node", "left").select("digest", F.coalesce("class", "node").alias("class"))
    return marked.select("doc_id", "digest").join(named, "digest")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of every class, all columns as they are; see ``bk_simhash.keep_smallest``."""
    return keep_smallest(docs, classes(docs, **options))
