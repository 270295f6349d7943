"""Region growing of balls into sheets over a neighbour graph.

Growing one region after the other from ranked seeds gives every ball the first seed that
reaches it along accepted edges.  That is a property of the whole graph, not of the order
of visits, so it is computed for all regions together.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ridgeline.functions.vec import Vec, acos_clamped
from ridgeline.operators.components import components, lowest_reaching
from ridgeline.operators.nearest import knn
from ridgeline.staging import discard, large, new_path, number_rows, stage, stage_at

Predicate = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def _cos(degrees: float) -> float:
    return math.cos(math.radians(degrees))


def _vec(side: Callable[[str], Column], prefix: str) -> Vec:
    return Vec(*(side(f"{prefix}{a}") for a in "xyz"))


def similar_bisector(degrees: float = 10.0) -> Predicate:
    return lambda u, v: _vec(u, "b").dot(_vec(v, "b")) > _cos(degrees)


def similar_theta(degrees: float = 10.0) -> Predicate:
    return lambda u, v: F.abs(u("theta") - v("theta")) < math.radians(degrees)


def all_of(*predicates: Predicate) -> Predicate:
    def both(u, v):
        out = predicates[0](u, v)
        for p in predicates[1:]:
            out = out & p(u, v)
        return out
    return both


def ball_overlap(threshold: float = 10.0) -> Predicate:
    def test(u, v):
        gap = (_vec(u, "c") - _vec(v, "c")).norm()
        return F.when(gap > 0, (u("r") + v("r")) / gap > threshold).otherwise(F.lit(True))
    return test


def similar_spokecross(degrees: float = 5.0) -> Predicate:
    return lambda u, v: _vec(u, "k").unit().dot(_vec(v, "k").unit()) > _cos(degrees)


def similar_normal(degrees: float = 5.0) -> Predicate:
    return lambda u, v: F.abs(_vec(u, "n").dot(_vec(v, "n"))) > _cos(degrees)


def similar_bisector_spread(degrees: float = 5.0) -> Predicate:
    """Needs ``bisec_diff`` and ``seg`` on the balls."""
    return lambda u, v: (F.abs(u("bisec_diff") - v("bisec_diff")) < math.radians(degrees)) & (u("seg") == v("seg"))


def same_spoke_count_side(threshold: int = 10) -> Predicate:
    """Needs ``spoke_cnt``: both below or both above the threshold."""
    def test(u, v):
        a, b = u("spoke_cnt"), v("spoke_cnt")
        return ((a < threshold) & (b < threshold)) | ((a > threshold) & (b > threshold))
    return test


METHODS: dict[str, Callable[[float, float], Predicate]] = {
    "bisec": lambda bisec, theta: all_of(similar_bisector(bisec), similar_theta(theta)),
    "theta": lambda bisec, theta: similar_theta(theta),
    "bisecthetacnt": lambda bisec, theta: all_of(similar_bisector(bisec), similar_theta(theta), same_spoke_count_side()),
    "spokecross": lambda bisec, theta: similar_spokecross(),
    "normal": lambda bisec, theta: similar_normal(),
    "balloverlap": lambda bisec, theta: ball_overlap(),
}


def attach_ends(atoms: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """Edges with the listed ball columns of both ends as ``u_*`` and ``v_*``."""
    for end in ("u", "v"):
        side = atoms.select(F.col("ma_id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns))
        edges = edges.join(large(side), end)
    return edges


def candidate_edges(atoms: DataFrame, edges: DataFrame, predicate: Predicate, *, k: int = 10) -> DataFrame:
    """Accepted directed neighbour edges ``u, v``; ``k`` counts the ball itself."""
    columns = [c for c in atoms.columns if c not in ("ma_id", "s_id", "side", "q_id")]
    near = attach_ends(atoms, edges.where(F.col("rank") < k).select("u", "v"), columns)
    return near.where(predicate(lambda c: F.col(f"u_{c}"), lambda c: F.col(f"v_{c}"))).select("u", "v")


def rank_seeds(atoms: DataFrame, order: str = "ma_id") -> DataFrame:
    """``id, rank``; ``order`` is 'ma_id' or 'radius' (largest first)."""
    if order == "ma_id":
        return atoms.select(F.col("ma_id").alias("id"), F.col("ma_id").alias("rank"))
    if order == "radius":
        seeds = atoms.select(F.col("ma_id").alias("id"), "r")
        return number_rows(seeds, [F.col("r").desc(), F.col("id")], "rank", label="seeds").select("id", "rank")
    raise ValueError(f"unknown seed order {order!r}")


def flood(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``ma_id, seg``: every ball gets the seed rank of the first region to reach it."""
    return lowest_reaching(edges, seeds).select(F.col("id").alias("ma_id"), F.col("rank").alias("seg"))


def unmark_small(labels: DataFrame, mincount: int) -> DataFrame:
    """Set the label of segments with fewer than ``mincount`` balls to 0."""
    sizes = labels.where("seg <> 0").groupBy("seg").agg(F.count("*").alias("_n")).where(F.col("_n") >= mincount)
    kept = labels.where("seg <> 0").join(large(sizes), "seg", "left")
    kept = kept.select("ma_id", F.when(F.col("_n").isNotNull(), F.col("seg")).otherwise(F.lit(0)).cast("bigint").alias("seg"))
    return kept.unionByName(unlabelled(labels))


def unlabelled(labels: DataFrame) -> DataFrame:
    """Balls without a segment; they may be most of a cloud and stay out of joins by label."""
    return labels.where("seg = 0 OR seg IS NULL").select("ma_id", F.lit(0).cast("bigint").alias("seg"))


def relabel(labels: DataFrame) -> DataFrame:
    """Dense labels from 1 in the order of the old ones; 0 stays."""
    olds = labels.where("seg <> 0").select("seg").distinct()
    dense = number_rows(olds, [F.col("seg")], "dense", start=1, label="relabel")
    found = labels.where("seg <> 0").join(large(dense), "seg").select("ma_id", F.col("dense").cast("bigint").alias("seg"))
    return found.unionByName(unlabelled(labels))


def segment(
    atoms: DataFrame, *, edges: DataFrame | None = None, method: str | Predicate = "bisec", k: int = 10,
    bisec_deg: float = 10.0, theta_deg: float = 10.0, mincount: int = 10, seed_order: str = "ma_id",
    second_pass_deg: float | None = 175.0,
) -> DataFrame:
    """``ma_id, seg`` for all balls (0 unsegmented): method pass, then a pass over flat leftovers.

    The second pass starts from unsegmented balls with a separation angle above
    ``second_pass_deg`` and only unsegmented balls join.
    """
    if edges is None:
        edges = stage(knn(atoms, k - 1), "edges")
    predicate = METHODS[method](bisec_deg, theta_deg) if isinstance(method, str) else method
    seeds = rank_seeds(atoms, seed_order)
    labels = flood(candidate_edges(atoms, edges, predicate, k=k), seeds.withColumn("rank", F.col("rank") + 1))
    labels = stage(unmark_small(labels, mincount), "pass1")
    if second_pass_deg is None:
        return relabel(labels)
    loose = stage(atoms.join(large(labels.where("seg = 0").select("ma_id")), "ma_id", "left_semi"), "loose")
    accepted = candidate_edges(loose, edges, similar_theta(theta_deg), k=k)
    ranks = loose.select(F.col("ma_id").alias("id"), "theta").join(large(seeds), "id").select(
        "id", F.when(F.col("theta") > math.radians(second_pass_deg), F.col("rank") + 1).alias("rank")
    )
    # labels of the two passes must not meet: the second pass gets negative ones
    second = flood(accepted, ranks).withColumn("seg", -F.col("seg"))
    both = labels.join(large(second.withColumnRenamed("seg", "late")), "ma_id", "left").select(
        "ma_id", F.coalesce("late", "seg").alias("seg")
    )
    small_free = unmark_small(both, mincount)
    # first-pass segments come first
    ordered = small_free.select("ma_id", F.when(F.col("seg") < 0, (1 << 62) - F.col("seg")).otherwise(F.col("seg")).alias("seg"))
    return relabel(stage(ordered, "pass2"))


def members(labels: DataFrame, *, chunk: int = 100_000) -> DataFrame:
    """``seg, part, members``: sorted balls of each segment, in lists of at most ``chunk``.

    Most segments fit in part 0.  A huge one is cut along one range-partitioned sort, so no
    task ever holds more than a chunk of it; its parts in order are the whole list.
    """
    placed = stage(number_rows(labels.select("seg", "ma_id"), [F.col("seg"), F.col("ma_id")], "_pos", label="members"), "members")
    starts = placed.groupBy("seg").agg(F.min("_pos").alias("_from"))
    parts = placed.join(starts, "seg").withColumn("part", F.floor((F.col("_pos") - F.col("_from")) / chunk))
    return parts.groupBy("seg", "part").agg(F.sort_array(F.collect_list("ma_id")).alias("members"))


def segment_balloverlap(atoms: DataFrame, *, edges: DataFrame | None = None, k: int = 10, thres: float = 2.0, mincount: int = 2) -> DataFrame:
    return segment(atoms, edges=edges, method=ball_overlap(thres), k=k, mincount=mincount, second_pass_deg=None)


def segment_running_mean(
    atoms: DataFrame, *, edges: DataFrame | None = None, k: int = 10, deg: float = 2.0, theta_deg: float | None = None,
    mincount: int = 10,
) -> DataFrame:
    """Growth against the mean bisector of each region, in synchronous rounds.

    Regions start at the free balls that come first among their accepted free neighbours in the order of a hash of
    the id, so starts are spread evenly however ids run.  In a round every free ball next to a region
    whose mean is within ``deg`` joins it, the one with the lowest label if there are several.  When no ball
    joins, regions start anew on what is free until nothing is.  Regions that meet along accepted neighbours and whose
    means are within ``deg`` become one then, so a flat stretch is one region wherever it was started.
    """
    if edges is None:
        edges = stage(knn(atoms, k - 1), "edges")
    accept = similar_bisector(deg) if theta_deg is None else all_of(similar_bisector(deg), similar_theta(theta_deg))
    near = attach_ends(atoms, edges.where(F.col("rank") < k).select("u", "v"), ["bx", "by", "bz", "theta"])
    near = stage(near, "near")
    similar = near.where(accept(lambda c: F.col(f"u_{c}"), lambda c: F.col(f"v_{c}"))).select("u", "v")
    similar = similar.unionByName(similar.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    flat = near.where(F.abs(F.col("u_theta") - F.col("v_theta")) < math.radians(theta_deg)) if theta_deg is not None else near
    flat = stage(flat.select("u", "v"), "flat")
    balls = stage(atoms.select("ma_id", "bx", "by", "bz"), "balls")
    similar = stage(similar, "similar")
    grown = _merge_by_means(balls, similar, stage(_grow_by_means(balls, flat, similar, _cos(deg)), "regions"), _cos(deg))
    return relabel(stage(unmark_small(grown, mincount), "grown"))


class _Increments:
    """A table that grows by staged increments, which are merged every few additions."""

    def __init__(self, empty: DataFrame, merge: Callable[[DataFrame], DataFrame], label: str, most: int = 8) -> None:
        self.spark, self.merge, self.label, self.most = empty.sparkSession, merge, label, most
        self.parts, self.paths = [empty], []

    def add(self, rows: DataFrame) -> None:
        self.parts.append(rows)
        if len(self.parts) > self.most:
            path = new_path(self.spark, self.label)
            whole = stage_at(self.now(), path)
            self.close()
            self.parts, self.paths = [whole], [path]

    def now(self) -> DataFrame:
        rows = self.parts[0]
        for part in self.parts[1:]:
            rows = rows.unionByName(part)
        return self.merge(rows)

    def close(self) -> None:
        for path in self.paths:
            discard(self.spark, path)


def _grow_by_means(balls: DataFrame, flat: DataFrame, similar: DataFrame, least: float) -> DataFrame:
    """``ma_id, seg`` of all balls.

    Only what changed is written: the balls that joined, the sums they add to their regions, and the open pairs of a
    free ball and a region next to it.
    """
    spark = balls.sparkSession
    labels = _Increments(balls.select("ma_id", F.col("ma_id").alias("seg")).limit(0), lambda rows: rows, "joined")
    free_at, links_at, seeded = None, None, 0
    free, links = balls, similar
    while True:
        before, free_at = free_at, new_path(spark, "free")
        free = stage_at(free.join(labels.now().select("ma_id"), "ma_id", "left_anti") if seeded else free, free_at)
        if before:
            discard(spark, before)
        if free.isEmpty():
            break
        u, v = (free.select(F.col("ma_id").alias(end)) for end in "uv")
        before, links_at = links_at, new_path(spark, "links")
        links = stage_at(links.join(u, "u", "left_semi").join(v, "v", "left_semi"), links_at)
        if before:
            discard(spark, before)
        order = [F.struct(F.md5(F.col(end).cast("string")), F.col(end)) for end in "vu"]
        beaten = links.where(order[0] < order[1]).select(F.col("u").alias("ma_id")).distinct()
        fresh = free.join(beaten, "ma_id", "left_anti").withColumn("seg", F.col("ma_id") + 1)
        fresh = stage(fresh, "joined")
        seeded += 1
        sums = _Increments(fresh.select("seg", "bx", "by", "bz").limit(0), _region_sums, "sums")
        open_, open_at = None, None
        while True:  # regions of earlier starts are next to nothing that fits, so only new ones grow
            labels.add(fresh.select("ma_id", "seg"))
            sums.add(fresh.select("seg", "bx", "by", "bz"))
            reached = flat.join(fresh.select(F.col("ma_id").alias("u"), "seg"), "u").select(F.col("v").alias("ma_id"), "seg")
            pairs = free.join(reached.distinct(), "ma_id")
            if open_ is not None:
                pairs = open_.unionByName(pairs).distinct()
            before, open_at = open_at, new_path(spark, "open")
            open_ = stage_at(pairs.join(labels.now().select("ma_id"), "ma_id", "left_anti"), open_at)
            if before:
                discard(spark, before)
            means = sums.now().select("seg", *(F.col(f"b{a}").alias(f"m{a}") for a in "xyz"))
            fits = open_.join(means, "seg").where(Vec.of("m").unit().dot(Vec.of("b")) > least)
            fresh = stage(fits.groupBy("ma_id", "bx", "by", "bz").agg(F.min("seg").alias("seg")).select(free.columns + ["seg"]), "joined")
            if fresh.isEmpty():
                break
        sums.close()
        discard(spark, open_at)
    return labels.now()


def _merge_by_means(balls: DataFrame, similar: DataFrame, grown: DataFrame, least: float) -> DataFrame:
    """``ma_id, seg`` after joining regions that links of close means connect; the lowest label stays."""
    ends = [grown.select(F.col("ma_id").alias(end), F.col("seg").alias(name)) for end, name in (("u", "a"), ("v", "b"))]
    meet = similar.join(ends[0], "u").join(ends[1], "v").where("a < b").select("a", "b").distinct()
    sums = stage(_region_sums(grown.join(balls, "ma_id")), "sums")
    for end in "ab":
        meet = meet.join(sums.select(F.col("seg").alias(end), *(F.col(f"b{x}").alias(f"{end}m{x}") for x in "xyz")), end)
    close = meet.where(Vec.of("am").unit().dot(Vec.of("bm").unit()) > least).select("a", "b")
    joined = components(close, key="seg")
    return grown.join(joined, "seg", "left").select("ma_id", F.coalesce("component", "seg").alias("seg"))


def _region_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("seg").agg(*(F.sum(f"b{a}").alias(f"b{a}") for a in "xyz"))


def unsegmented_report(atoms: DataFrame, labels: DataFrame, edges: DataFrame, *, k: int = 10) -> DataFrame:
    """For each unsegmented ball the smallest angle between its bisector and a direction to a neighbour."""
    loose = atoms.join(labels.where("seg = 0").select("ma_id"), "ma_id", "left_semi")
    own = loose.select(F.col("ma_id").alias("u"), *(F.col(f"{v}{a}").alias(f"u{v}{a}") for v in ("c", "b") for a in "xyz"))
    other = atoms.select(F.col("ma_id").alias("v"), *(F.col(f"c{a}").alias(f"vc{a}") for a in "xyz"))
    near = edges.where(F.col("rank") < k).select("u", "v").join(own, "u").join(other, "v")
    heading = (Vec.of("vc") - Vec.of("uc")).unit()
    angle = acos_clamped(Vec.of("ub").dot(heading))
    return near.withColumn("angle", angle).groupBy(F.col("u").alias("ma_id")).agg(
        F.count("*").alias("neighbours"), F.min("angle").alias("min_angle")
    )
