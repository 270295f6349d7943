"""Local feature size and feature-size based thinning of the surface."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.atoms import bbox
from ridgeline.operators.nearest import knn


def local_feature_size(
    surface: DataFrame, atoms: DataFrame, *, k: int = 10, only_interior: bool = False, labels: DataFrame | None = None,
    sqrt_compat: bool = False, near: DataFrame | None = None,
) -> DataFrame:
    """``s_id, lfs``: median distance from a surface point to its k nearest balls.

    With ``labels`` unsegmented balls are left out.  ``sqrt_compat`` takes one more square root.
    """
    if near is None:
        balls = atoms.where("side = 'in'") if only_interior else atoms
        if labels is not None:
            balls = balls.join(labels.where("seg <> 0").select("ma_id"), "ma_id", "left_semi")
        near = knn(surface, k, key="s_id", prefix="p", points=balls)
    distance = F.sqrt("d2")
    value = F.median(F.sqrt(distance) if sqrt_compat else distance)
    if sqrt_compat:
        value = F.sqrt(F.median(distance))
    return near.where(F.col("rank") <= k).groupBy(F.col("u").alias("s_id")).agg(value.alias("lfs"))


def hashed_uniform(key: Column) -> Column:
    """A repeatable number in [0, 1) from an integer id."""
    low = F.pmod(key, F.lit(2147483648))  # the rest does not change the result and would overflow
    return F.pmod(low * F.lit(1103515245) + F.lit(12345), F.lit(2147483648)) / F.lit(2147483648.0)


def decimate(
    surface_lfs: DataFrame, *, cell: float = 0.5, eps: float = 0.4, dims: int = 2, edge_preserve: bool = False,
    uniform: Callable[[Column], Column] = hashed_uniform,
) -> DataFrame:
    """Points with ``keep``: per grid cell a share of cell**2 / (eps * mean lfs)**dims / n stays.

    With ``edge_preserve`` cells spanning more than 0.5 in height use a tenth of their mean lfs,
    and ``lfs_edge`` carries a tenth of every lfs.
    """
    if dims not in (2, 3):
        raise ValueError("dims must be 2 or 3")
    axes = "xyz"[:dims]
    low = bbox(surface_lfs, "p").select(*(f"lo{a}" for a in "xyz"))
    placed = surface_lfs.crossJoin(F.broadcast(low))  # exactly one row
    cells = [F.floor((F.col(f"p{a}") - F.col(f"lo{a}")) / cell).alias(f"c{a}") for a in axes]
    placed = placed.select(*surface_lfs.columns, *cells)
    keys = [f"c{a}" for a in axes]
    # one pre-aggregated row per cell instead of a window over the points of a cell
    stats = placed.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg("lfs").alias("_lfs"), (F.max("pz") - F.min("pz")).alias("_rise"))
    mean = F.when(F.col("_rise") > 0.5, F.col("_lfs") / 10).otherwise(F.col("_lfs")) if edge_preserve else F.col("_lfs")
    share = stats.withColumn("_share", F.try_divide(F.lit(cell * cell), F.pow(mean * eps, F.lit(float(dims)))) / F.col("_n")).select(*keys, "_share")
    kept = placed.join(share, keys).withColumn("keep", F.coalesce(uniform(F.col("s_id")) <= F.col("_share"), F.lit(True)))
    if edge_preserve:
        kept = kept.withColumn("lfs_edge", F.col("lfs") / 10)
    return kept.drop("_share")
