"""Sharding by a hierarchical weighted hash tree: regions, racks, shards.

A key descends from the root: at each level every child draws an exponential variate from a hash
of the key and the child's name, divided by the child's weight, and the smallest draw wins.  A
child is chosen in proportion to its weight, the sum of the weights below it.  When a weight
changes, only the draws of the nodes on its path change, so keys move only into or out of these
subtrees; a new shard in a region of its own takes keys from all others and moves no key between
them, as its region's weight is the only one that changes.

The tree is a small fixed table (nodes, not data).  The placement of a row depends on its id and the
tree alone.  Null ids are placed like the empty text.  Slots number the rows of a shard from 0 in
order of id, size, checksum; rows equal in all three are interchangeable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.staging import number_rows


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: str
    rack: str
    weight: float = 1.0


def tree(shards: int, *, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """Shards filled into racks, racks into regions, in order."""
    return [Leaf(s, f"region{s // (per_rack * racks)}", f"rack{s // per_rack}") for s in range(shards)]


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own."""
    new = max(leaf.shard for leaf in leaves) + 1
    return [*leaves, Leaf(new, f"region-of-{new}", f"rack-of-{new}", weight)]


def _draw(key: Column, node: str, weight: float) -> Column:
    """Exponential variate of rate ``weight``: 52 bits of an MD5 digest as a uniform number."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{node}")).cast("binary")), 1, 13), 16, 10).cast("bigint")
    return -F.ln((bits.cast("double") + 0.5) / F.lit(float(1 << 52))) / F.lit(weight)


def _choose(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """What belongs to the child with the smallest draw; on a tie the first child."""
    if len(children) == 1:
        return children[0][2]
    draws = F.array(*[F.struct(_draw(key, node, weight).alias("draw"), F.lit(i).alias("i")) for i, (node, weight, _) in enumerate(children)])
    best = F.array_min(draws)["i"]
    chosen = F.when(best == 0, children[0][2])
    for i, (_, _, value) in enumerate(children[1:], 1):
        chosen = chosen.when(best == i, value)
    return chosen


def place(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key (text); only the branch that is chosen is evaluated further."""
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in leaves:
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    top = []
    for region, racks in regions.items():
        middle = []
        for rack, own in racks.items():
            bottom = [(f"{region}/{rack}/{leaf.shard}", leaf.weight, F.lit(leaf.shard)) for leaf in own]
            middle.append((f"{region}/{rack}", sum(leaf.weight for leaf in own), _choose(key, bottom)))
        top.append((region, sum(leaf.weight for own in racks.values() for leaf in own), _choose(key, middle)))
    return _choose(key, top).cast("int")


def shard(docs: DataFrame, leaves: list[Leaf]) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard`` of every row.

    Slots come from one sort over all rows and the number of rows of each shard, so no shard is
    ever gathered in one task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        place(key, leaves).alias("shard"),
        place(key, grown(leaves)).alias("grown_shard"),
    )
    numbered = number_rows(rows, [F.col(c) for c in ("shard", "doc_id", "size", "text_crc32")], "_n", label="shards")
    first = numbered.groupBy("shard").agg(F.min("_n").alias("_first"))  # one row per shard of the tree
    placed = numbered.join(F.broadcast(first), "shard").withColumn("slot", F.col("_n") - F.col("_first"))
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")


def oracle(shards: int = 8, per_rack: int = 2, racks: int = 2) -> str:
    """The placement in SQL for ``tree(shards)`` and one shard more; checksums byte by byte."""

    def draw(node: str, weight: int) -> str:
        bits = f"('0x' || md5(key || '|{node}')[1:13])::BIGINT"
        return f"-ln(({bits} + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / {weight}::DOUBLE"

    def choose(children: list[tuple[str, int, str]]) -> str:
        if len(children) == 1:
            return children[0][2]
        draws = "[" + ", ".join(draw(node, weight) for node, weight, _ in children) + "]"
        return f"(CASE list_position({draws}, list_min({draws})) " + " ".join(f"WHEN {i} THEN {value}" for i, (_, _, value) in enumerate(children, 1)) + " END)"

    regions: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in tree(shards, per_rack=per_rack, racks=racks):
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    top = []
    for region, own in regions.items():
        middle = [(f"{region}/{rack}", len(leaves), choose([(f"{region}/{rack}/{leaf.shard}", 1, str(leaf.shard)) for leaf in leaves])) for rack, leaves in own.items()]
        top.append((region, sum(map(len, own.values())), choose(middle)))
    return f"""
WITH steps AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i) r),
t AS (SELECT list(c ORDER BY i) AS step FROM steps),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, (len(h) / 2 + 1)::BIGINT AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295, [('0x' || h[2 * i + 1:2 * i + 2])::BIGINT FOR i IN range(len(h) // 2)]), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]))) AS text_crc32,
  {choose(top)}::INT AS shard, {choose([*top, (f"region-of-{shards}", 1, str(shards))])}::INT AS grown_shard FROM d, t)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM p
"""
