"""Pruning, clustering, merging and classification of the sheet graph."""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.vec import Vec, angle
from ridgeline.operators.atoms import to_surface
from ridgeline.operators.components import components
from ridgeline.operators.growth import unlabelled
from ridgeline.staging import number_rows, stage

# Class numbers and their names.
CLASS_NAMES = {0: "never classified", 1: "other", 2: "exterior", 3: "interior", 4: "building"}


def _touching(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("a", "b")).alias("seg"))


def _within(sheets: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose both sheets are listed."""
    ids = sheets.select("seg")
    return links.join(ids.withColumnRenamed("seg", "a"), "a", "left_semi").join(ids.withColumnRenamed("seg", "b"), "b", "left_semi").select(links.columns)


def drop_high_degree(sheets: DataFrame, links: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Drop sheets whose degree is above the n-th highest degree."""
    degrees = sheets.select("seg").join(_touching(links).groupBy("seg").agg(F.count("*").alias("d")), "seg", "left")
    degrees = degrees.select("seg", F.coalesce("d", F.lit(0)).alias("d"))
    cut = degrees.orderBy(F.col("d").desc()).limit(n).agg(F.min("d").alias("cut"))
    high = degrees.crossJoin(F.broadcast(cut)).where("d > cut").select("seg")  # cut is one row
    kept = sheets.join(high, "seg", "left_anti")
    return kept, _within(kept, links)


def drop_radius_theta(sheets: DataFrame, links: DataFrame, *, min_r: float = 9.0, max_theta: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Drop sheets with both a ball above ``min_r`` and a separation angle below ``max_theta``."""
    kept = sheets.where(~((F.col("r_max") > min_r) & (F.col("theta_min") < max_theta)))
    return kept, _within(kept, links)


def prune(sheets: DataFrame, links: DataFrame, *, min_count: int = 20, drop_flip: bool = True) -> tuple[DataFrame, DataFrame]:
    """Keep links above ``min_count`` (and not flip relations) and the sheets they touch."""
    strong = links.where(F.col("adj_count") > min_count)
    if drop_flip:
        strong = strong.where(~F.col("is_fliprel"))
    return sheets.join(_touching(strong), "seg", "left_semi"), strong


def get_clusters(
    sheets: DataFrame, links: DataFrame, *, min_count: int = 20, remove_highest_degree: int = 0, remove_rtheta: bool = False,
    min_r: float = 9.0, max_theta: float = 1.0, drop_flip: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """``seg, s_no, cluster, sheets`` and the links kept.

    ``s_no`` numbers the remaining sheets from 1; clusters are numbered from 1, most sheets first.
    """
    if remove_highest_degree:
        sheets, links = drop_high_degree(sheets, links, remove_highest_degree)
    if remove_rtheta:
        sheets, links = drop_radius_theta(sheets, links, min_r=min_r, max_theta=max_theta)
    sheets, links = prune(sheets, links, min_count=min_count, drop_flip=drop_flip)
    links = stage(links, "strong")
    found = stage(components(links, sheets.select("seg"), key="seg"), "found")
    sizes = found.groupBy("component").agg(F.count("*").alias("sheets"))
    ranked = number_rows(sizes, [F.col("sheets").desc(), F.col("component")], "cluster", start=1, label="clusters")
    numbered = number_rows(found.select("seg"), [F.col("seg")], "s_no", start=1, label="sheets")
    return found.join(ranked, "component").join(numbered, "seg").select("seg", "s_no", "cluster", "sheets"), links


def push_labels(labels: DataFrame, mapping: DataFrame, new: str = "s_no") -> DataFrame:
    """Ball labels after renumbering; balls of dropped sheets get 0."""
    moved = labels.where("seg <> 0").join(mapping.select("seg", new), "seg", "left")
    return moved.select("ma_id", F.coalesce(new, F.lit(0)).cast("bigint").alias("seg")).unionByName(unlabelled(labels))


def contract_similar(sheets: DataFrame, links: DataFrame, *, deg: float = 10.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge linked sheets whose mean bisectors differ by at most ``deg``.

    Returns merged sheets (plain means of the sheet means), summed links and ``seg, merged``.
    """
    means = sheets.select("seg", *(f"b{a}_mean" for a in "xyz"))
    near = links
    for end in ("a", "b"):
        near = near.join(means.select(F.col("seg").alias(end), *(F.col(f"b{x}_mean").alias(f"{end}{x}") for x in "xyz")), end)
    similar = near.where(angle(Vec.of("a"), Vec.of("b")) <= math.radians(deg)).select("a", "b")
    mapping = stage(components(similar, sheets.select("seg"), key="seg").withColumnRenamed("component", "merged"), "merged")
    averaged = [c for c in sheets.columns if c.endswith("_mean")]
    merged = sheets.join(mapping, "seg").groupBy(F.col("merged").alias("seg")).agg(
        F.count("*").alias("parts"), F.sum("n").alias("n"), *(F.avg(c).alias(c) for c in averaged)
    )
    moved = links
    for end in ("a", "b"):
        moved = moved.join(mapping.select(F.col("seg").alias(end), F.col("merged").alias(f"m{end}")), end)
    moved = moved.where("ma <> mb").groupBy(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).agg(
        F.sum("adj_count").alias("adj_count"), F.sum(F.col("is_fliprel").cast("bigint")).alias("flips")
    )
    return merged, moved, mapping


def grow_by_flip(cluster: DataFrame, atoms: DataFrame, labels: DataFrame, *, min_flip: int = 10) -> DataFrame:
    """``a, b, flip_count``: sheets on the other side of a cluster's surface points.

    Counts per sheet of ``cluster`` the interior label of each primary and secondary point of
    its balls, or the exterior one where the interior label is the sheet itself.
    """
    sided = atoms.select("ma_id", "s_id", "side").join(labels, "ma_id").groupBy("s_id").agg(
        F.max(F.when(F.col("side") == "in", F.col("seg"))).alias("si"), F.max(F.when(F.col("side") == "out", F.col("seg"))).alias("so")
    )
    own = labels.where("seg <> 0").join(cluster.select("seg"), "seg", "left_semi")
    spokes = to_surface(atoms.select("ma_id", "s_id", "q_id").join(own.select("ma_id"), "ma_id", "left_semi"), distinct=False)
    # how often a sheet uses a point, before looking at the point's labels
    uses = spokes.join(own, "ma_id").groupBy("seg", "s_id").agg(F.count("*").alias("uses"))
    other = F.when(F.col("si") == F.col("seg"), F.col("so")).otherwise(F.col("si"))
    counted = uses.join(sided, "s_id").withColumn("b", other).where("b <> 0").groupBy(F.col("seg").alias("a"), "b").agg(F.sum("uses").alias("flip_count"))
    return counted.where(F.col("flip_count") > min_flip)


def classify(clusters: DataFrame, links: DataFrame, sheets: DataFrame, atoms: DataFrame, labels: DataFrame) -> DataFrame:
    """``cluster, class, name`` with the figures behind it.

    Compares the means of the lowest and highest tenth of the vertical bisector components.
    The tenths come from one range-partitioned sort of all balls, so no cluster is sorted in a
    single task.
    """
    home = clusters.select("seg", "cluster")
    steep = atoms.where(F.col("theta") < math.pi * 0.9).select("ma_id", "bz").where("bz IS NOT NULL")
    rows = steep.join(labels.where("seg <> 0"), "ma_id").join(home, "seg").select("cluster", "bz", "ma_id")
    ordered = number_rows(rows, [F.col("cluster"), F.col("bz"), F.col("ma_id")], "_pos", label="steep")
    ordered = stage(ordered, "steep")
    spans = ordered.groupBy("cluster").agg(F.min("_pos").alias("_from"), F.count("*").alias("l"))
    placed = ordered.join(spans, "cluster").withColumn("_i", F.col("_pos") - F.col("_from")).withColumn("_tenth", F.floor(F.col("l") / 10))
    tenths = placed.groupBy("cluster").agg(
        F.first("l").alias("balls"),
        F.avg(F.when(F.col("_i") < F.col("_tenth"), F.col("bz"))).alias("bottom"),
        F.avg(F.when(F.col("_i") >= F.col("l") - F.col("_tenth"), F.col("bz"))).alias("top"),
    )
    theta = sheets.join(home, "seg").groupBy("cluster").agg(F.avg("theta_mean").alias("theta_mean"))
    linked = links.join(home.withColumnRenamed("seg", "a"), "a").groupBy("cluster").agg(F.count("*").alias("links"))
    ids = home.select("cluster").distinct()
    facts = ids.join(tenths, "cluster", "left").join(theta, "cluster", "left").join(linked, "cluster", "left")
    ratio = F.try_divide(F.abs("top"), F.abs("bottom"))
    closed = (ratio > 1.05) | (F.col("bottom") > 0) | ((F.col("bottom") == 0) & (F.col("top") != 0))
    kind = (
        F.when(F.coalesce("links", F.lit(0)) == 0, 0)
        .when(F.coalesce(closed, F.lit(False)), F.when(F.col("theta_mean") > math.pi / 4, 4).otherwise(3))
        .when(F.coalesce(ratio > 0.95, F.lit(False)), 1)
        .otherwise(2)
    )
    name = F.element_at(F.create_map(*(F.lit(x) for pair in CLASS_NAMES.items() for x in pair)), F.col("class"))
    out = facts.withColumns({"class": kind.cast("int"), "links": F.coalesce("links", F.lit(0)), "balls": F.coalesce("balls", F.lit(0))})
    return out.select("cluster", "class", name.alias("name"), "links", "balls", "bottom", "top", "theta_mean")


def match_flat_top(links: DataFrame) -> DataFrame:
    """All ways to map the flat-roof pattern (edges 01 12 23 30 02, not induced) onto the graph."""
    both = links.select(F.col("a").alias("s"), F.col("b").alias("t")).unionByName(links.select(F.col("b").alias("s"), F.col("a").alias("t"))).distinct()

    # every triangle is found at its corner of lowest degree, so a hub makes no wedges
    degree = both.groupBy("s").agg(F.count("*").alias("d"))
    ranked = both.join(degree, "s").join(degree.toDF("t", "dt"), "t")
    rising = stage(ranked.where("d < dt OR (d = dt AND s < t)").select("s", "t"), "rising")
    wedges = rising.select("s", F.col("t").alias("x")).join(rising.select("s", F.col("t").alias("y")), "s").where("x < y")
    found = wedges.join(both.toDF("x", "y"), ["x", "y"], "left_semi")
    ways = F.array(*(F.struct(F.col(a).alias("v0"), F.col(b).alias("v1"), F.col(c).alias("v2")) for a, b, c in permutations("sxy")))
    triangle = stage(found.select(F.explode(ways).alias("w")).select("w.*"), "triangles")
    # two triangles on one diagonal
    other = triangle.select("v0", F.col("v1").alias("v3"), "v2")
    return triangle.join(other, ["v0", "v2"]).where("v1 <> v3").select("v0", "v1", "v2", "v3")
