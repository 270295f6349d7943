"""Medial balls ("atoms") with their derived geometry, two per surface point.

``surface`` has ``s_id, px, py, pz`` (and optionally ``nx, ny, nz``); ``mat`` has one row per
ball: ``s_id, side ('in'/'out'), cx, cy, cz, q_id`` with ``q_id`` the secondary point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.vec import Vec, acos_clamped, put
from ridgeline.staging import large


def stack_sides(wide: DataFrame) -> DataFrame:
    """One row per point with ``ci*, co*, qin, qout`` -> one row per ball, without a shuffle."""
    balls = F.array(
        *(
            F.struct(
                F.lit(side).alias("side"),
                *(F.col(f"c{side[0]}{axis}").alias(f"c{axis}") for axis in "xyz"),
                F.col(f"q{side}").alias("q_id"),
            )
            for side in ("in", "out")
        )
    )
    return wide.select("s_id", F.explode(balls).alias("ball")).select("s_id", "ball.*")


def bbox(df: DataFrame, prefix: str) -> DataFrame:
    """One row ``lo*, hi*``."""
    aggs = []
    for axis in "xyz":
        aggs += [F.min(f"{prefix}{axis}").alias(f"lo{axis}"), F.max(f"{prefix}{axis}").alias(f"hi{axis}")]
    return df.agg(*aggs)


def mean_offset(surface: DataFrame) -> DataFrame:
    return surface.agg(*(F.avg(f"p{axis}").alias(f"mean{axis}") for axis in "xyz"))


def subtract(df: DataFrame, prefix: str, offset: DataFrame, name: str) -> DataFrame:
    """Shift a vector column by a one-row table."""
    moved = df.crossJoin(F.broadcast(offset))  # exactly one row
    return put(moved, prefix, Vec.of(prefix) - Vec.of(name)).drop(*offset.columns)


def center_on_mean(surface: DataFrame, mat: DataFrame) -> tuple[DataFrame, DataFrame]:
    offset = mean_offset(surface)
    return subtract(surface, "p", offset, "mean"), subtract(mat, "c", offset, "mean")


def center_on_bbox(df: DataFrame, prefix: str = "p") -> tuple[DataFrame, DataFrame]:
    """Subtract the middle of the bounding box; also returns the one-row offset ``off*``."""
    box = bbox(df, prefix)
    offset = box.select(*(F.expr(f"lo{a} + (hi{a} - lo{a}) / 2").alias(f"off{a}") for a in "xyz"))
    return subtract(df, prefix, offset, "off"), offset


def derive_atoms(surface: DataFrame, mat: DataFrame, *, center: bool = True) -> DataFrame:
    """All per-ball measures from two key joins.

    Adds ``ma_id``, the feature points ``p*`` and ``q*``, radius ``r``, spokes ``f1*, f2*``,
    unit bisector ``b*``, separation angle ``theta``, spoke cross product ``k*`` and the unit
    vector ``n*`` orthogonal to it and the bisector.  Undefined directions are NULL.
    """
    if center:
        surface, mat = center_on_mean(surface, mat)
    points = surface.select("s_id", "px", "py", "pz")
    second = points.select(F.col("s_id").alias("q_id"), *(F.col(f"p{a}").alias(f"q{a}") for a in "xyz"))
    size = points.agg((F.max("s_id") + 1).alias("_m"))
    balls = mat.join(large(points), "s_id").join(large(second), "q_id").crossJoin(F.broadcast(size))
    p, q, c = Vec.of("p"), Vec.of("q"), Vec.of("c")
    balls = put(put(balls, "f1", p - c), "f2", q - c).withColumn(
        "ma_id", F.col("s_id") + F.when(F.col("side") == "out", F.col("_m")).otherwise(F.lit(0))
    )
    f1, f2 = Vec.of("f1"), Vec.of("f2")
    balls = balls.withColumns({
        "r": f1.norm(),
        "theta": acos_clamped(f1.unit().dot(f2.unit())),
    })
    balls = put(put(balls, "b", (f1.unit() + f2.unit()).unit()), "k", f1.cross(f2))
    balls = put(balls, "n", Vec.of("k").cross(Vec.of("b")).unit())
    vectors = [f"{v}{a}" for v in ("c", "p", "q", "f1", "f2", "b", "k", "n") for a in "xyz"]
    return balls.select("ma_id", "s_id", "side", "q_id", "r", "theta", *vectors)


def spoke_count(atoms: DataFrame, surface: DataFrame) -> DataFrame:
    """How often each surface point is a secondary point, over both sides."""
    used = atoms.groupBy(F.col("q_id").alias("s_id")).agg(F.count("*").alias("n"))
    return surface.select("s_id").join(used, "s_id", "left").select("s_id", F.coalesce("n", F.lit(0)).alias("spoke_cnt"))


def bisector_spread(atoms: DataFrame, edges: DataFrame, *, depth: int = 4) -> DataFrame:
    """Largest angle between a ball's bisector and those of its ``depth`` nearest balls."""
    own = atoms.select(F.col("ma_id").alias("u"), *(F.col(f"b{a}").alias(f"u{a}") for a in "xyz"))
    other = atoms.select(F.col("ma_id").alias("v"), *(F.col(f"b{a}").alias(f"v{a}") for a in "xyz"))
    near = edges.where(F.col("rank") <= depth).join(own, "u").join(other, "v")
    return near.groupBy(F.col("u").alias("ma_id")).agg(
        F.max(acos_clamped(Vec.of("u").dot(Vec.of("v")))).alias("bisec_diff")
    )


# --- masks and id spaces -----------------------------------------------------

def to_atoms(surface_ids: DataFrame, atoms: DataFrame) -> DataFrame:
    """Ids of both balls of each listed surface point."""
    return atoms.join(surface_ids.select("s_id"), "s_id", "left_semi").select("ma_id")


def to_surface(atoms: DataFrame, *, distinct: bool = True) -> DataFrame:
    """Primary and secondary points of the given atoms.

    ``distinct=False`` keeps one row per spoke with its number ``spoke`` (1 primary, 2 secondary).
    """
    spokes = F.array(
        F.struct(F.lit(1).alias("spoke"), F.col("s_id").alias("s_id")),
        F.struct(F.lit(2).alias("spoke"), F.col("q_id").alias("s_id")),
    )
    rows = atoms.select("ma_id", F.explode(spokes).alias("e")).select("ma_id", "e.spoke", "e.s_id")
    return rows.select("s_id").distinct() if distinct else rows


def apply_masks(table: DataFrame, *masks: tuple[DataFrame, str] | None, atoms: DataFrame) -> DataFrame:
    """Keep the rows of a surface (``s_id``) or atom (``ma_id``) table passing every mask.

    A mask is ``(ids, 's')`` or ``(ids, 'ma')``; ``None`` is ignored.  A surface mask keeps
    both balls of a point, an atom mask keeps the primary and secondary points.
    """
    in_atom_space = "ma_id" in table.columns
    key = "ma_id" if in_atom_space else "s_id"
    for mask in masks:
        if mask is None:
            continue
        ids, space = mask
        if space not in ("s", "ma"):
            raise ValueError(f"unknown mask space {space!r}")
        if in_atom_space and space == "s":
            ids = to_atoms(ids, atoms)
        elif not in_atom_space and space == "ma":
            ids = to_surface(atoms.join(ids.select("ma_id"), "ma_id", "left_semi"))
        table = table.join(ids.select(key), key, "left_semi")
    return table


def masked(points: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    """Rows whose boolean ``flag`` in ``mask`` is true."""
    return points.join(mask.where("flag").select(key), key, "left_semi")


def filter_class(df: DataFrame, cls: int, column: str = "classification") -> DataFrame:
    return df.where(F.col(column) == cls)


def quantise(df: DataFrame, offset: DataFrame, *, prefix: str = "p", scale: float = 100.0) -> DataFrame:
    """Integer coordinates; shifted value and offset are each truncated toward zero."""
    rows = df.crossJoin(F.broadcast(offset))  # exactly one row
    return rows.withColumns({
        f"{prefix}{a}_q": (F.col(f"{prefix}{a}") * scale).cast("bigint") + (F.col(f"off{a}") * scale).cast("bigint")
        for a in "xyz"
    }).drop(*offset.columns)
