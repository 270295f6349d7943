"""Exact nearest items by regions of about equal size.

Items (points or triangles) are dealt to regions by a tree of halving planes, so regions follow the
density however uneven it is.  A query is first answered inside its own region.  Its ``need``-th distance
there is a bound; the few queries that have another region within it are asked there, too, and the lists are
merged.  Each step is one shuffle by region.  A region with very many queries is copied to several tasks.

The planes come from a sample of at most ``16 * MOST`` items; they only balance the work.  Boxes of regions are the tight
boxes of all their items, distances are compared as they are, and equal ones go to the lower id, so results are exact.

Inside a task a region is a tree of halves over arrays: groups of close queries descend together,
and a group compares its points with the items that can matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.staging import stage

#: Items of a region, regions at most, queries answered by one copy of a region, items of a leaf.
SIZE, MOST, ASKED, LEAF = 4096, 1 << 17, 1 << 16, 32
#: Copies of regions that a task answers one after the other, and tasks for which fewer are taken: starting a task costs
#: as much as many a region.
EACH, TASKS = 16, 48
SLACK = 1 + 1e-9  # for bounds that are rounded differently from distances


@dataclass(frozen=True)
class Kind:
    """What items are: ``width`` numbers each, their boxes, and squared distances of all points to all items."""

    width: int
    boxes: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    distance2: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _point_distance2(q: np.ndarray, items: np.ndarray) -> np.ndarray:
    gap = [q[:, None, a] - items[None, :, a] for a in range(3)]
    return gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]


POINTS = Kind(3, lambda items: (items, items), _point_distance2)


def _near2(lo: np.ndarray, hi: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared smallest distance between a box (or point) and many boxes, summed as distances of points are."""
    gap = np.maximum(0.0, np.maximum(lows - hi, lo - highs))
    return gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2]


def _far2(lo: np.ndarray, hi: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    gap = np.maximum(highs - lo, hi - lows)
    return gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2]


def _enough(far2: np.ndarray, held: np.ndarray, need: int) -> float:
    """A squared distance within which boxes hold ``need`` items; infinite if all hold fewer."""
    order = np.argsort(far2)
    total = np.cumsum(held[order])
    at = int(np.searchsorted(total, need))
    return float(far2[order[at]]) * SLACK if at < len(order) else math.inf


class Halves:
    """Items in the order of a balanced tree; node ``i`` of a level has the children ``2 i`` and ``2 i + 1``."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, held: np.ndarray | None = None, leaf: int = LEAF) -> None:
        centre = (lo + hi) / 2
        self.order, bounds, self.levels = np.arange(len(lo)), [0, len(lo)], []
        held = np.ones(len(lo), np.int64) if held is None else held
        all_bounds = [bounds]
        while max(b - a for a, b in zip(bounds, bounds[1:])) > leaf:
            finer = [0]
            for a, b in zip(bounds, bounds[1:]):
                part = self.order[a:b]
                at = centre[part]
                middle = (b - a) // 2
                self.order[a:b] = part[np.argpartition(at[:, np.argmax(np.ptp(at, axis=0))], middle)]
                finer += [a + middle, b]
            bounds = finer
            all_bounds.append(bounds)
        lo, hi, held = lo[self.order], hi[self.order], held[self.order]
        for bounds in all_bounds:
            starts = bounds[:-1]
            self.levels.append((np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts), np.add.reduceat(held, starts)))
        self.bounds = np.array(all_bounds[-1])

    def leaves(self, lo: np.ndarray, hi: np.ndarray, need: int, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Leaves that can hold one of the ``need`` nearest of a box, their near and far distances, and the bound."""
        nodes = np.zeros(1, np.int64)
        for level, (lows, highs, held) in enumerate(self.levels):
            if level:
                nodes = np.concatenate([2 * nodes, 2 * nodes + 1])
            near, far = _near2(lo, hi, lows[nodes], highs[nodes]), _far2(lo, hi, lows[nodes], highs[nodes])
            if need:
                limit = min(limit, _enough(far, held[nodes], need))
            kept = near <= limit
            nodes, near, far = nodes[kept], near[kept], far[kept]
        return nodes, near, far, limit

    def members(self, leaves: np.ndarray) -> np.ndarray:
        """Positions of the items in some leaves."""
        return np.concatenate([self.order[a:b] for a, b in zip(self.bounds[leaves].tolist(), self.bounds[leaves + 1].tolist())])


class Region:
    """The items of one region and the search among them."""

    def __init__(self, kind: Kind, ids: np.ndarray, items: np.ndarray) -> None:
        self.kind, self.ids, self.items = kind, ids, items
        self.lo, self.hi = kind.boxes(items)
        self.tree = Halves(self.lo, self.hi) if len(ids) else None

    def nearest(self, q: np.ndarray, need: int, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, squared distance and position of the best items of a group of close points, at most ``need`` each."""
        if self.tree is None:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        lo, hi = q.min(axis=0), q.max(axis=0)
        leaves, near, far, limit = self.tree.leaves(lo, hi, need, float(limits.max()))
        if not len(leaves):
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        by_far = np.argsort(far)
        first = self.tree.members(leaves[by_far[: 1 + 2 * need // LEAF]])
        if len(first) >= need:  # distances within the closest leaves sharpen the bound
            tried = self.kind.distance2(q, self.items[first])
            limits = np.minimum(limits, np.partition(tried, need - 1, axis=1)[:, need - 1])
            limit = min(limit, float(limits.max()))
            leaves = leaves[near <= limit]
        at = self.tree.members(leaves)
        at = at[_near2(lo, hi, self.lo[at], self.hi[at]) <= limit]
        d2 = self.kind.distance2(q, self.items[at])
        who, what = np.nonzero(d2 <= limits[:, None])
        d2 = d2[who, what]
        order = np.lexsort((self.ids[at[what]], d2, who))
        who, d2, at = who[order], d2[order], at[what[order]]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        best = place < need
        return who[best], d2[best], at[best]


class Planes:
    """Halving planes of a sample; ``find`` tells the region of each point."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.axis, self.value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        parts = [sample]
        for level in range(depth):
            finer = []
            for i, part in enumerate(parts):
                node = (1 << level) - 1 + i
                if len(part):
                    axis = int(np.argmax(np.ptp(part, axis=0)))
                    self.axis[node], self.value[node] = axis, np.median(part[:, axis])
                right = part[:, self.axis[node]] > self.value[node]
                finer += [part[~right], part[right]]
            parts = finer

    def find(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.value[node])
        return node - (1 << self.depth) + 1


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _dealt(rows: DataFrame, planes: Planes, kind: Kind) -> DataFrame:
    """``id, xs`` with the region of the middle of each item's box."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = kind.boxes(_matrix(batch.column("xs"), kind.width))
            region = planes.find((lo + hi) / 2)
            yield pa.RecordBatch.from_arrays([pa.array(region), batch.column("id"), batch.column("xs")], ["region", "id", "xs"])

    return rows.select("id", "xs").mapInArrow(task, "region bigint, id bigint, xs array<double>")


def _boxes(items: DataFrame, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the regions that hold items, their tight boxes and sizes; at most ``MOST`` rows."""
    names = [f"{end}{a}" for end in ("lo", "hi") for a in "xyz"]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = kind.boxes(_matrix(batch.column("xs"), kind.width))
            region, group = np.unique(batch.column("region").to_numpy(), return_inverse=True)
            found = [np.full((len(region), 3), np.inf), np.full((len(region), 3), -np.inf)]
            np.minimum.at(found[0], group, lo)
            np.maximum.at(found[1], group, hi)
            columns = [pa.array(region), pa.array(np.bincount(group, minlength=len(region)))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(f[:, a]) for f in found for a in range(3)], ["region", "n", *names])

    rows = items.select("region", "xs").mapInArrow(task, "region bigint, n bigint, " + ", ".join(f"{c} double" for c in names))
    ends = [F.min(c).alias(c) for c in names[:3]] + [F.max(c).alias(c) for c in names[3:]]
    found = rows.groupBy("region").agg(F.sum("n").alias("n"), *ends).toArrow()
    box = [np.stack([found.column(c).to_numpy() for c in names[i : i + 3]], axis=1) for i in (0, 3)]
    return found.column("region").to_numpy(), box[0].reshape(-1, 3), box[1].reshape(-1, 3), found.column("n").to_numpy()


_FOUND = "id bigint, xs array<double>, found array<struct<d2:double,id:bigint>>, limit double, others array<bigint>"


def _tasks(copies: int) -> int:
    """Tasks for so many copies of regions."""
    return max(1, min(copies, TASKS), math.ceil(copies / EACH))


def _asked(queries: DataFrame, items: DataFrame, kind: Kind, need: int, map_: tuple | None = None) -> DataFrame:
    """Answers of each query (``region, id, xs, limit``) from the region it names.

    With ``map_``, the regions' numbers, boxes and sizes, ``others`` tells which regions may hold closer items.
    """
    if map_:
        numbers, lows, highs, held = map_
        near_regions = Halves(lows, highs, held, leaf=8) if len(numbers) else None

    def others(q: np.ndarray, region: int, limits: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Bounds that are certain, and for each query the regions within its bound."""
        for i in np.flatnonzero(np.isinf(limits)):
            limits[i] = _enough(_far2(q[i], q[i], lows, highs), held, need)
        lo, hi = q.min(axis=0), q.max(axis=0)
        leaves = near_regions.leaves(lo, hi, 0, float(limits.max()))[0]
        at = near_regions.members(leaves) if len(leaves) else leaves
        at = at[numbers[at] != region]
        if not len(at):
            return limits, [[] for _ in q]
        gap = np.maximum(0.0, np.maximum(lows[at] - q[:, None], q[:, None] - highs[at]))
        within = gap[..., 0] * gap[..., 0] + gap[..., 1] * gap[..., 1] + gap[..., 2] * gap[..., 2] <= limits[:, None]
        who, what = np.nonzero(within)
        return limits, [x.tolist() for x in np.split(numbers[at[what]], np.cumsum(np.bincount(who, minlength=len(q)))[:-1])]

    def answer(region: int, part: Region, ids: np.ndarray, q: np.ndarray, limits: np.ndarray) -> pa.RecordBatch:
        groups = Halves(q, q)
        who, d2, at, certain, further = [], [], [], np.empty(len(q)), [None] * len(q)
        for a, b in zip(groups.bounds.tolist(), groups.bounds[1:].tolist()):
            own = groups.order[a:b]
            w, d, x = part.nearest(q[own], need, limits[own])
            who.append(own[w])
            d2.append(d)
            at.append(x)
            if map_:
                bound = limits[own].copy()
                full = np.bincount(w, minlength=len(own)) >= need
                last = np.full(len(own), math.inf)
                last[w] = d  # rows of a query are in order, so its largest stays
                bound[full] = np.minimum(bound, last)[full]
                certain[own], lists = others(q[own], region, bound)
                for i, regions in zip(own.tolist(), lists):
                    further[i] = regions
            else:
                certain[own] = limits[own]
        who, d2, at = np.concatenate(who), np.concatenate(d2), np.concatenate(at)
        order = np.argsort(who, kind="stable")
        counts = np.bincount(who, minlength=len(q))
        rows = pa.StructArray.from_arrays([pa.array(d2[order]), pa.array(part.ids[at[order]], pa.int64())], ["d2", "id"])
        found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), rows)
        places = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(q) + 1, 3), pa.int32()), pa.array(q.ravel()))
        columns = [pa.array(ids), places, found, pa.array(certain), pa.array(further, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["id", "xs", "found", "limit", "others"])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, held_, asked = None, None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if asked:
                yield answer(key[0], part, *(np.concatenate(c) for c in zip(*asked)))
            asked.clear()

        for batch in batches:
            region, salt, query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("region", "salt", "query"))
            starts = [0, *(np.flatnonzero((np.diff(region) != 0) | (np.diff(salt) != 0) | (np.diff(query) != 0)) + 1).tolist(), len(batch)]
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                rows, of = batch.slice(a, b - a), (int(region[a]), int(salt[a]))
                if of != key:
                    yield from done()
                    key, part, held_ = of, None, []
                ids = rows.column("id").to_numpy()
                if not query[a]:
                    held_.append((ids, _matrix(rows.column("xs"), kind.width)))
                    continue
                if part is None:
                    part = Region(kind, *(np.concatenate(c) for c in zip(*held_))) if held_ else Region(kind, np.empty(0, np.int64), np.empty((0, kind.width)))
                asked.append((ids, _matrix(rows.column("xs"), 3), rows.column("limit").to_numpy(zero_copy_only=False)))
                if sum(len(x[0]) for x in asked) >= ASKED:
                    yield from done()
        yield from done()

    load = queries.groupBy("region").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("salts"))
    load = stage(load, "region-load")  # a row for each region
    parts = _tasks(load.agg(F.sum("salts")).first()[0] or 0)
    spread = F.broadcast(load)
    rows = queries.join(spread, "region").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    rows = rows.select("region", "salt", F.lit(True).alias("query"), "id", "xs", "limit")
    copies = items.join(spread, "region").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    copies = copies.select("region", "salt", F.lit(False).alias("query"), "id", "xs", F.lit(0.0).alias("limit"))
    keys = ["region", "salt"]
    # explicit: the work of a task is far more than its bytes tell
    return rows.unionByName(copies).repartition(parts, *keys).sortWithinPartitions(*keys, "query").mapInArrow(task, _FOUND)


def nearest(queries: DataFrame, items: DataFrame, need: int, kind: Kind = POINTS) -> DataFrame:
    """``id, xs, found`` of each query: its ``need`` best items as (d2, id), closest first, then lowest id.

    ``queries`` has ``id, xs`` with three numbers, ``items`` has ``id, xs`` with as many as ``kind`` says.
    """
    count = items.count()
    depth = max(0, math.ceil(math.log2(max(1, min(MOST * SIZE, count)) / SIZE)))
    sample = np.empty((0, 3))
    if depth:
        rows = items.select("xs").sample(min(1.0, 16 * (1 << depth) / count), seed=11).toArrow().column("xs").combine_chunks()
        lo, hi = kind.boxes(_matrix(rows, kind.width))
        sample = (lo + hi) / 2
    planes = Planes(sample, depth)
    held = stage(_dealt(items, planes, kind), "region-items")
    map_ = _boxes(held, kind)
    own = _dealt(queries, planes, POINTS).withColumn("limit", F.lit(math.inf))
    first = stage(_asked(stage(own, "region-queries"), held, kind, need, map_), "region-first")
    alone = first.where("size(others) = 0").select("id", "xs", "found")
    more = first.where("size(others) > 0").select(F.explode("others").alias("region"), "id", "xs", "limit")
    if depth == 0:
        return alone
    rest = _asked(stage(more, "region-more"), held, kind, need).select("id", "xs", "found")
    both = first.where("size(others) > 0").select("id", "xs", "found").unionByName(rest).groupBy("id").agg(
        F.first("xs").alias("xs"), F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, need).alias("found")
    )
    return alone.unionByName(both)
