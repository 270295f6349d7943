"""Near duplicates by SimHash fingerprints and BK-trees over shards of the fingerprint space.

* Fingerprint: majority bits of the XXH64 hashes of word shingles, repeats included.
* Shards: the bits are cut into ``radius + 1`` blocks.  Two fingerprints that differ in at most
  ``radius`` bits agree in a whole block, so it is enough to search among the fingerprints with
  the same value of a block.  A shard of more than ``limit`` fingerprints is cut again in the
  same way over the bits not used yet, which keeps every link.
* In a shard a BK-tree is grown: children hang on their Hamming distance to the parent, and a
  search follows only edges within the radius of its own distance.  A shard yields a spanning
  set of links (one per union), never all pairs, so its output is linear in its size.
* Components of the links come from star contraction over staged tables.

Only distinct fingerprints are searched, so exact copies cost nothing.  Null and blank texts have
the fingerprint zero and are linked like any other; a text shorter than a shingle counts as one
shingle; repeated rows fall into one component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import per_document, texts, utf8
from ridgeline.operators.components import components
from ridgeline.staging import stage

WIDTH = 64


def simhash(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Fingerprint of a UTF-8 text after lower-casing A-Z."""
    found = text.lower().split()  # bytes split on exactly the six ASCII blanks
    if not found:
        return 0
    joined = b" ".join(found)
    length = np.fromiter(map(len, found), np.int64, len(found))
    stop = np.cumsum(length + 1) - 1
    if len(found) < shingle:
        starts, stops = [0], [len(joined)]
    else:
        starts, stops = (stop - length)[: len(found) - shingle + 1].tolist(), stop[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts))
    ones = np.zeros(WIDTH, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed 64-bit integer."""

    def make():
        return lambda text: (int(np.uint64(simhash(text, shingle, seed)).astype(np.int64)),)

    return per_document(texts(docs), "fp bigint", make)


class BKTree:
    """Fingerprints as unsigned integers; a child's key is its distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Positions of all fingerprints within the radius."""
        found, open_ = [], [0] if self.values else []
        values, children = self.values, self.children
        while open_:
            node = open_.pop()
            distance = (values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            if kids := children[node]:
                low, high = distance - radius, distance + radius
                open_ += [kid for edge, kid in kids.items() if low <= edge <= high]
        return found

    def add(self, value: int) -> None:
        new, node = len(self.values), 0
        self.values.append(value)
        self.children.append({})
        if new:
            while True:
                kids = self.children[node]
                below = kids.setdefault((self.values[node] ^ value).bit_count(), new)
                if below == new:
                    return
                node = below


def spanning_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links within the radius that connect what all such links connect; values are distinct."""
    tree, root = BKTree(), list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values):
        for j in tree.near(value, radius):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                yield value, values[j]
        tree.add(value)


def cut(used: int, radius: int) -> list[int]:
    """The bits outside ``used`` in ``radius + 1`` blocks, each joined with ``used``."""
    free = [b for b in range(WIDTH) if not used >> b & 1]
    parts = radius + 1
    blocks = [free[len(free) * i // parts : len(free) * (i + 1) // parts] for i in range(parts)]
    return [used | sum(1 << b for b in block) for block in blocks]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def link_shards(distinct: DataFrame, *, radius: int = 4, limit: int = 4096, depth: int = 4) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``), enough to connect each class.

    ``limit`` only decides where a shard is cut further, at most ``depth`` times; it drops nothing.
    """
    spark = distinct.sparkSession

    def search(most: float):
        def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, held, size = None, [], 0

            def close() -> list[tuple[bool, int, int, int]]:
                if 1 < len(held):
                    return [(True, 0, _signed(a), _signed(b)) for a, b in spanning_links([v & (1 << 64) - 1 for v in held], radius)]
                return []

            out: list[tuple[bool, int, int, int]] = []
            for batch in batches:
                for used, bits, fp in zip(*(batch.column(c).to_pylist() for c in ("used", "bits", "fp"))):
                    if (used, bits) != shard:
                        out += close()
                        shard, held, size = (used, bits), [], 0
                    size += 1
                    if size <= most:
                        held.append(fp)
                    else:  # too large for one tree: hand its rows on to be cut again
                        out += [(False, used, v, v) for v in [*held, fp]]
                        held = []
                if len(out) > 10_000:
                    yield _links(out)
                    out = []
            yield _links(out + close())

        return task

    todo, found, masks = distinct.select(F.lit(0).cast("bigint").alias("used"), "fp"), None, [0]
    for level in range(depth):
        cuts = [(_signed(m), [_signed(n) for n in cut(m, radius)]) for m in masks]
        plan = spark.createDataFrame(cuts, "used bigint, next array<bigint>")  # (radius + 1)^level rows
        rows = todo.join(F.broadcast(plan), "used").select(F.explode("next").alias("used"), "fp")
        rows = rows.select("used", F.col("fp").bitwiseAND(F.col("used")).alias("bits"), "fp")
        last = level == depth - 1
        out = rows.repartition("used", "bits").sortWithinPartitions("used", "bits", "fp").mapInArrow(
            search(float("inf") if last else limit), "link boolean, used bigint, a bigint, b bigint"
        )
        out = stage(out, "simhash-links")
        links = out.where("link").select("a", "b")
        found = links if found is None else found.unionByName(links)
        todo = out.where("not link").select("used", F.col("a").alias("fp"))
        masks = [m for used in masks for m in cut(used, radius)]
        if last or todo.isEmpty():
            break
    return found


def _links(rows: list[tuple[bool, int, int, int]]) -> pa.RecordBatch:
    parts = list(zip(*rows)) or [[], [], [], []]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(p, k) for p, k in zip(parts, kinds)], ["link", "used", "a", "b"])


def fingerprint_classes(fps: DataFrame, *, radius: int = 4, limit: int = 4096) -> DataFrame:
    """``fp, class`` for the distinct fingerprints of ``fps``: those that links of at most ``radius`` bits connect."""
    distinct = fps.select("fp").distinct()
    linked = components(link_shards(distinct, radius=radius, limit=limit), ends=("a", "b"), key="fp")
    return distinct.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("class"))


def near_duplicates(docs: DataFrame, *, shingle: int = 4, radius: int = 4, seed: int = 42, limit: int = 4096) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that links of at most ``radius`` bits reach.
    """
    marked = stage(fingerprints(docs, shingle=shingle, seed=seed), "simhash")
    lowest = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    classes = stage(lowest.join(fingerprint_classes(marked, radius=radius, limit=limit), "fp"), "simhash-classes")
    ids = classes.groupBy("class").agg(F.min("low").alias("component_id"))
    members = classes.join(ids, "class").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(members, "fp").select("doc_id", hexed, "component_id")


def text_digest() -> Column:
    """Tells rows with one id, or with none, apart by their texts."""
    return F.unhex(F.sha2(utf8(F.col("text")), 256))


def keep_smallest(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of each class the row of ``docs`` with the smallest id (null last) and then digest, all columns as they are.

    ``classes`` has ``doc_id, digest, class`` for every row.  Of rows equal in id and text the one
    that sorts first by its other columns stays.
    """
    rows = classes.groupBy("class", "doc_id", "digest").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("n").alias("_rows")))
    chosen = stage(rows.groupBy("class").agg(first.alias("first")).select("first._id", "first._digest", "first._rows"), "near-kept")
    marked = docs.select(F.struct(*docs.columns).alias("row"), text_digest().alias("digest"))
    same = (F.col("digest") == F.col("_digest")) & F.col("row.doc_id").eqNullSafe(F.col("_id"))
    single = marked.join(chosen.where("_rows = 1"), same, "left_semi").select("row")
    # only rows equal in id and text need another look, to keep one of them
    repeated = marked.join(chosen.where("_rows > 1"), same).groupBy("_digest", "_id").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return single.unionByName(repeated).select("row.*")


def keep_one(docs: DataFrame, *, shingle: int = 4, radius: int = 4, seed: int = 42, limit: int = 4096) -> DataFrame:
    """One row of every class of ``near_duplicates``, all columns as they are; see ``keep_smallest``.

    Rows are told apart by id and text, so unlike texts with one id, or without ids, stay in their own classes.
    """
    marked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8(F.col("text")).alias("text"), text_digest().alias("digest"))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(simhash(t.as_py(), shingle, seed)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(fps, pa.int64())], ["doc_id", "digest", "fp"])

    marked = stage(marked.mapInArrow(task, "doc_id bigint, digest binary, fp bigint"), "simhash")
    return keep_smallest(docs, marked.join(fingerprint_classes(marked, radius=radius, limit=limit), "fp"))
