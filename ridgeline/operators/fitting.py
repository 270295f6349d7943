"""Grouped least-squares planes and lines, and sampled plane search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ridgeline.functions.shapes import Plane, point_plane_distance
from ridgeline.functions.symmetric3 import with_axis
from ridgeline.functions.vec import Vec
from ridgeline.staging import ROWS, large, spread, stage

PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def moments(df: DataFrame, by: list[str], prefix: str = "p") -> DataFrame:
    """Per group: size, centroid ``m*`` and centred second moments ``sxx ... szz``.

    All are mergeable aggregates, so a group of any size is reduced before the shuffle.
    """
    centre = [F.avg(f"{prefix}{a}").alias(f"m{a}") for a in "xyz"]
    second = [(F.covar_pop(f"{prefix}{a}", f"{prefix}{b}") * F.count("*")).alias(f"s{a}{b}") for a, b in PAIRS]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *centre, *second)


def fit_plane(df: DataFrame, by: list[str], prefix: str = "p") -> DataFrame:
    """Per group the least-squares plane ``rx, ry, rz, nx, ny, nz``; NULL normal below 3 points
    and for points on one line."""
    fitted = with_axis(moments(df, by, prefix), "s", "e", largest=False)
    # on a line the two smaller eigenvalues vanish together
    spread = F.col("sxx") + F.col("syy") + F.col("szz")
    minor = F.col("sxx") * F.col("syy") - F.col("sxy") ** 2 + F.col("sxx") * F.col("szz") - F.col("sxz") ** 2 + F.col("syy") * F.col("szz") - F.col("syz") ** 2
    sound = (F.col("n") >= 3) & (minor > spread * spread * 1e-24)
    return fitted.select(
        *by, "n", *(F.col(f"m{a}").alias(f"r{a}") for a in "xyz"), *(F.when(sound, F.col(f"e{a}")).alias(f"n{a}") for a in "xyz"),
    )


def fit_line(df: DataFrame, by: list[str], prefix: str = "p") -> DataFrame:
    """Per group the least-squares line ``rx, ry, rz, tx, ty, tz``; NULL direction below 2 points."""
    fitted = with_axis(moments(df, by, prefix), "s", "e", largest=True)
    return fitted.select(
        *by, "n", *(F.col(f"m{a}").alias(f"r{a}") for a in "xyz"), *(F.when(F.col("n") >= 2, F.col(f"e{a}")).alias(f"t{a}") for a in "xyz"),
    )


def _picks(left: DataFrame, by: str, key: str, round_no: int, trials: int, seed: int) -> DataFrame:
    """Per group and trial the three points with the lowest keyed hash: ``by, trial, place`` and the point.

    One pass keeps the points whose hash is below a bound for some trial; a trial expects ``wanted`` of them,
    whatever the size of the group.  Only these few are ranked.  In small groups they can be several rows for each point, so tasks
    are dealt bounded numbers of points (a large group to several).  Groups where a trial got fewer than three are passed again
    with a higher bound.
    """
    sizes = stage(left.groupBy(by).agg(F.count("*").alias("_size")).where("_size >= 3"), "sizes")
    count = left.count()
    found, wanted, done = None, 32, None
    while True:
        lot = f"md5(concat_ws(' ', '{seed}', '{round_no}', cast(t AS string), cast({key} AS string)))"
        lots = F.expr(f"transform(sequence(0, {trials - 1}), t -> struct(t AS trial, {lot} AS lot))")
        # the first 15 hexadecimal digits are a number below 2^60
        low = f"filter(_lots, e -> cast(conv(substring(e.lot, 1, 15), 16, 10) AS double) < {wanted * 2.0**60!r}D / _size)"
        rows = left.join(large(sizes), by).withColumn("_salt", F.when(F.col("_size") > ROWS, F.pmod(F.xxhash64(key), F.ceil(F.col("_size") / ROWS))).otherwise(0))
        rows = spread(rows, count, by, "_salt").withColumn("_lots", lots).withColumn("_lot", F.explode(F.expr(low)))
        rows = rows.select(*left.columns, "_lot.trial", "_lot.lot")
        order = Window.partitionBy(by, "trial").orderBy("lot", key)
        three = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 3).drop("lot")
        three = stage(three, "picks")
        whole = three.groupBy(by).agg(F.count("*").alias("_picked")).where(F.col("_picked") == 3 * trials).select(by)
        part = three.join(large(whole), by, "left_semi")
        found = part if found is None else found.unionByName(part)
        sizes = stage(sizes.join(large(whole), by, "left_anti"), "sizes")
        if sizes.isEmpty():
            return found
        wanted *= 32


def ransac_planes(
    df: DataFrame, by: str, *, key: str = "s_id", prefix: str = "p", threshold: float = 0.05, n_planes: int = 2, iterations: int = 10, seed: int = 0
) -> DataFrame:
    """Per group up to ``n_planes`` planes, each the best of ``iterations`` random triples (the earliest among equals).

    Triples are the three points with the lowest keyed hash (``k1, k2, k3``), so a run can be repeated.  A
    group with fewer than 3 points left yields no further plane.
    """
    left = stage(df.select(by, key, *(f"{prefix}{a}" for a in "xyz")), "points")
    found: list[DataFrame] = []
    for round_no in range(1, n_planes + 1):
        spots = [F.max(F.when(F.col("place") == i, F.col(f"{prefix}{a}"))).alias(f"a{i}{a}") for i in (1, 2, 3) for a in "xyz"]
        names = [F.max(F.when(F.col("place") == i, F.col(key))).alias(f"k{i}") for i in (1, 2, 3)]
        triples = _picks(left, by, key, round_no, iterations, seed).groupBy(by, "trial").agg(*spots, *names)
        plane = Plane.through(Vec.of("a1"), Vec.of("a2"), Vec.of("a3"))
        proposals = stage(triples.select(by, "trial", "k1", "k2", "k3", *plane.cols("")).where("nx IS NOT NULL"), "proposals")
        scored = left.join(large(proposals), by).where(point_plane_distance(Vec.of(prefix), Plane.of("")) < threshold)
        counts = scored.groupBy(by, "trial").agg(F.count("*").alias("inliers"))
        best = counts.groupBy(by).agg(F.max_by("trial", F.struct("inliers", -F.col("trial"))).alias("trial"), F.max("inliers").alias("inliers"))
        chosen = stage(best.join(large(proposals), [by, "trial"]).drop("trial"), "chosen")
        found.append(chosen.withColumn("round", F.lit(round_no)))
        if round_no < n_planes:
            taken = left.join(large(chosen), by).where(point_plane_distance(Vec.of(prefix), Plane.of("")) < threshold).select(key, by)
            left = stage(left.join(large(taken), [by, key], "left_anti").join(large(chosen.select(by)), by, "left_semi"), "left")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select(by, "round", "inliers", "k1", "k2", "k3", "rx", "ry", "rz", "nx", "ny", "nz")
