"""Relations between sheets and the sheet graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flip_relations(atoms: DataFrame, labels: DataFrame) -> DataFrame:
    """``a, b, cnt``: surface points whose two balls lie in segments a and b, both not 0."""
    sided = atoms.select("ma_id", "s_id", "side").join(labels.where("seg <> 0"), "ma_id")
    both = sided.groupBy("s_id").agg(
        F.max(F.when(F.col("side") == "in", F.col("seg"))).alias("i"), F.max(F.when(F.col("side") == "out", F.col("seg"))).alias("o")
    ).where("i IS NOT NULL AND o IS NOT NULL")
    return both.groupBy(F.least("i", "o").alias("a"), F.greatest("i", "o").alias("b")).agg(F.count("*").alias("cnt"))


def adjacency_relations(labels: DataFrame, edges: DataFrame, *, k: int = 25) -> DataFrame:
    """``a, b, cnt``: directed neighbour edges between different segments, both not 0.

    Restrict ``labels`` and ``edges`` to interior balls for the interior-only variant.
    """
    seg = labels.where("seg <> 0")
    near = edges.where(F.col("rank") < k).select("u", "v")
    near = near.join(seg.select(F.col("ma_id").alias("u"), F.col("seg").alias("su")), "u")
    near = near.join(seg.select(F.col("ma_id").alias("v"), F.col("seg").alias("sv")), "v").where("su <> sv")
    return near.groupBy(F.least("su", "sv").alias("a"), F.greatest("su", "sv").alias("b")).agg(F.count("*").alias("cnt"))


def find_relations(atoms: DataFrame, labels: DataFrame, edges: DataFrame, *, k: int = 25, only_interior: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Adjacency and flip tables; with ``only_interior`` flips are undefined (None).

    ``edges`` must then be the neighbour edges among interior balls.
    """
    if only_interior:
        inner = labels.join(atoms.where("side = 'in'").select("ma_id"), "ma_id", "left_semi")
        return adjacency_relations(inner, edges, k=k), None
    return adjacency_relations(labels, edges, k=k), flip_relations(atoms, labels)


def sheet_means(atoms: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per segment: size, plain means of centre, bisector and angle, radius and angle range."""
    rows = atoms.join(labels.where("seg <> 0"), "ma_id")
    means = [F.avg(f"{p}{a}").alias(f"{p}{a}_mean") for p in ("c", "b") for a in "xyz"]
    return rows.groupBy("seg").agg(
        F.count("*").alias("n"), *means, F.avg("theta").alias("theta_mean"), F.avg("r").alias("r_mean"),
        F.max("r").alias("r_max"), F.min("r").alias("r_min"), F.min("theta").alias("theta_min"),
    )


def sheet_graph(atoms: DataFrame, labels: DataFrame, edges: DataFrame, *, k: int = 25) -> tuple[DataFrame, DataFrame]:
    """Sheets and their edges ``a, b, adj_count, is_fliprel``."""
    adjacent, flips = find_relations(atoms, labels, edges, k=k)
    marked = flips.select("a", "b", F.lit(True).alias("_flip"))
    links = adjacent.join(marked, ["a", "b"], "left").select(
        "a", "b", F.col("cnt").alias("adj_count"), F.col("_flip").isNotNull().alias("is_fliprel")
    )
    return sheet_means(atoms, labels), links


def filter_regions(atoms: DataFrame, labels: DataFrame, *, max_r: float, min_theta: float) -> DataFrame:
    """Labels of the segments whose largest radius is below and mean angle above the limits."""
    kept = atoms.join(labels.where("seg <> 0"), "ma_id").groupBy("seg").agg(F.max("r").alias("r"), F.avg("theta").alias("t"))
    kept = kept.where((F.col("r") < max_r) & (F.col("t") > min_theta))
    return labels.join(kept.select("seg"), "seg", "left_semi").select("ma_id", "seg")
