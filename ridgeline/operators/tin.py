"""Operators on triangle meshes ``vertex(v_id, x, y, z)`` and ``face(f_id, v0, v1, v2)``."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.shapes import circumcentre_xy, double_area_xy, inside_xy, z_on_triangle
from ridgeline.functions.vec import Vec
from ridgeline.operators.nearest import places
from ridgeline.operators.regions import Kind, nearest
from ridgeline.staging import large, stage

CORNERS = "abc"


def corners(face: DataFrame, vertex: DataFrame) -> DataFrame:
    """Faces with the coordinates ``a*, b*, c*`` of their vertices."""
    out = face.select("f_id", "v0", "v1", "v2")
    for i, name in enumerate(CORNERS):
        out = out.join(large(vertex.select(F.col("v_id").alias(f"v{i}"), *(F.col(x).alias(f"{name}{x}") for x in "xyz"))), f"v{i}")
    return out


def _abc() -> tuple[Vec, Vec, Vec]:
    return Vec.of("a"), Vec.of("b"), Vec.of("c")


def edges(face: DataFrame) -> DataFrame:
    """``a, b, f1, f2``: undirected edges with their faces; ``f2`` is NULL on the hull."""
    sides = F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    rows = face.select("f_id", F.explode(sides).alias("e")).select("f_id", "e.a", "e.b")
    return rows.groupBy("a", "b").agg(F.min("f_id").alias("f1"), F.when(F.count("*") > 1, F.max("f_id")).alias("f2"))


def big_faces(face: DataFrame, vertex: DataFrame, *, max_sq_edge: float | None = None, max_double_area: float | None = None) -> DataFrame:
    """``f_id`` of faces with a squared edge, or a signed doubled plan area, above the limit."""
    a, b, c = _abc()
    rows = corners(face, vertex)
    test: Column = F.lit(False)
    if max_sq_edge is not None:
        test = test | (F.greatest((a - b).abs2(), (b - c).abs2(), (c - a).abs2()) > max_sq_edge)
    if max_double_area is not None:
        test = test | (double_area_xy(a, b, c) > max_double_area)
    return rows.where(test).select("f_id")


def contours(face: DataFrame, vertex: DataFrame, isos: list[float], *, skip: DataFrame | None = None, tolerance: float = 1e-7) -> DataFrame:
    """``iso, x1, y1, x2, y2``: segments where the mesh crosses the given heights.

    A segment joins the two points of a face at the height: vertices on it and crossings of
    edges.  A flat face has three such points and a touching one a single point; both give
    none.  An edge on the height is given once.  With ``skip`` (faces to leave out) the height
    is exact and an edge shared by two faces is given by both.
    """
    if skip is not None:
        face, tolerance = face.join(skip, "f_id", "left_anti"), 0.0
    rows = corners(face, vertex)
    low, high = F.least("az", "bz", "cz"), F.greatest("az", "bz", "cz")
    asked = F.filter(F.array(*(F.lit(float(i)) for i in isos)), lambda i: (i >= low - tolerance) & (i <= high + tolerance))
    rows = rows.withColumn("iso", F.explode(asked))
    side = {n: F.when(F.col(f"{n}z") < F.col("iso") - tolerance, -1).when(F.col(f"{n}z") > F.col("iso") + tolerance, 1).otherwise(0) for n in CORNERS}
    rows = rows.withColumns({f"s{n}": s for n, s in side.items()})

    def at_vertex(n: str) -> Column:
        return F.when(F.col(f"s{n}") == 0, F.struct(F.col(f"{n}x").alias("x"), F.col(f"{n}y").alias("y")))

    def crossing(m: str, n: str) -> Column:
        share = (F.col("iso") - F.col(f"{m}z")) / (F.col(f"{n}z") - F.col(f"{m}z"))
        point = F.struct(*(((1 - share) * F.col(f"{m}{x}") + share * F.col(f"{n}{x}")).alias(x) for x in "xy"))
        return F.when(F.col(f"s{m}") * F.col(f"s{n}") == -1, point)

    found = F.array(*(at_vertex(n) for n in CORNERS), crossing("a", "b"), crossing("b", "c"), crossing("c", "a"))
    cut = rows.withColumn("at", F.array_sort(F.array_compact(found))).where(F.size("at") == 2)
    on_edge = (F.col("sa") == 0).cast("int") + (F.col("sb") == 0).cast("int") + (F.col("sc") == 0).cast("int") == 2
    segment = ["iso", F.col("at")[0]["x"].alias("x1"), F.col("at")[0]["y"].alias("y1"), F.col("at")[1]["x"].alias("x2"), F.col("at")[1]["y"].alias("y2")]
    if skip is not None:
        return cut.select(*segment)
    return cut.where(~on_edge).select(*segment).unionByName(cut.where(on_edge).select(*segment).distinct())


def laplace_z(vertex: DataFrame, face: DataFrame) -> DataFrame:
    """``v_id, z_hat``: heights of interior vertices from their neighbours, weighted by the
    length of the dual edge over that of the edge, in the plan."""
    a, b, c = _abc()
    cx, cy = circumcentre_xy(a, b, c)
    sides = F.array(*(F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    rows = corners(face, vertex).select("f_id", cx.alias("ox"), cy.alias("oy"), F.explode(sides).alias("e"))
    both = rows.groupBy("e.p", "e.q").agg(
        F.count("*").alias("faces"), F.min(F.struct("f_id", "ox", "oy")).alias("m"), F.max(F.struct("f_id", "ox", "oy")).alias("n")
    )
    for end in "pq":
        both = both.join(vertex.select(F.col("v_id").alias(end), *(F.col(x).alias(f"{end}{x}") for x in "xyz")), end)

    def plan(ax, ay, bx, by) -> Column:
        return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))

    dual = plan(F.col("m.ox"), F.col("m.oy"), F.col("n.ox"), F.col("n.oy"))
    weight = F.when(F.col("faces") == 2, F.try_divide(dual, plan(F.col("px"), F.col("py"), F.col("qx"), F.col("qy"))))
    ends = F.array(F.struct(F.col("p").alias("v_id"), F.col("qz").alias("z")), F.struct(F.col("q").alias("v_id"), F.col("pz").alias("z")))
    around = both.select("faces", weight.alias("w"), F.explode(ends).alias("e"))
    summed = around.groupBy("e.v_id").agg(F.min("faces").alias("faces"), F.sum(F.col("w") * F.col("e.z")).alias("wz"), F.sum("w").alias("w"))
    return summed.where("faces >= 2").select("v_id", F.try_divide("wz", "w").alias("z_hat")).where("z_hat IS NOT NULL")


def vertex_error(vertex: DataFrame, face: DataFrame) -> DataFrame:
    return vertex.join(laplace_z(vertex, face), "v_id").select("v_id", (F.col("z") - F.col("z_hat")).alias("error"))


def smooth(vertex: DataFrame, face: DataFrame, *, up_only: bool = True) -> DataFrame:
    """One simultaneous step z := z_hat (only upward if ``up_only``); hull vertices stay."""
    moved = vertex.join(laplace_z(vertex, face), "v_id", "left")
    lifted = F.greatest("z", "z_hat") if up_only else F.coalesce("z_hat", "z")  # greatest skips NULL
    return moved.withColumn("z", lifted).drop("z_hat")


#: Cells that a face's longer extent may span at most.
CELLS = 256


def _filed(rows: DataFrame) -> DataFrame:
    """Faces under the cells they touch: ``power, cell_x, cell_y``; cells have the size ``2 ^ power``.

    The size follows the height over the longest side, so cells are as small as the face is thin (down to a
    part in ``CELLS`` of its extent).  In each column of cells the sides are clipped to the column, which gives the range of
    rows; it is widened by more than rounding can amount to.
    """
    ends = [("a", "b"), ("b", "c"), ("c", "a")]

    def extent(axis: str) -> Column:
        return F.greatest(*(f"{n}{axis}" for n in CORNERS)) - F.least(*(f"{n}{axis}" for n in CORNERS))

    def length(p: str, q: str) -> Column:
        dx, dy = F.col(f"{q}x") - F.col(f"{p}x"), F.col(f"{q}y") - F.col(f"{p}y")
        return F.sqrt(dx * dx + dy * dy)

    span = F.greatest(extent("x"), extent("y"))
    height = F.abs(double_area_xy(*_abc())) / F.greatest(*(length(p, q) for p, q in ends))
    power = F.ceil(F.log2(F.greatest(height, span / CELLS))).cast("int")
    filed = rows.withColumn("power", power).withColumn("_s", F.pow(F.lit(2.0), F.col("power").cast("double")))
    low, high = F.least(*(f"{n}x" for n in CORNERS)), F.greatest(*(f"{n}x" for n in CORNERS))
    filed = filed.withColumn("cell_x", F.explode(F.sequence(F.floor(low / F.col("_s")), F.floor(high / F.col("_s")))))
    x0, x1 = F.col("cell_x") * F.col("_s"), (F.col("cell_x") + 1) * F.col("_s")
    lows, highs = [], []
    for p, q in ends:
        px, py, qx, qy = (F.col(c) for c in (f"{p}x", f"{p}y", f"{q}x", f"{q}y"))
        left, right = F.least(px, qx), F.greatest(px, qx)

        def height_at(x: Column, px=px, py=py, qx=qx, qy=qy, left=left, right=right) -> Column:
            return py + (qy - py) * F.try_divide(F.least(F.greatest(x, left), right) - px, qx - px)

        touches = (right >= x0) & (left <= x1)
        upright = px == qx
        lows.append(F.when(touches, F.when(upright, F.least(py, qy)).otherwise(F.least(height_at(x0), height_at(x1)))))
        highs.append(F.when(touches, F.when(upright, F.greatest(py, qy)).otherwise(F.greatest(height_at(x0), height_at(x1)))))
    margin = 1e-12 * (extent("y") + F.greatest(*(F.abs(f"{n}y") for n in CORNERS)))
    first, last = (F.floor((end + side * margin) / F.col("_s")) for end, side in ((F.least(*lows), -1.0), (F.greatest(*highs), 1.0)))
    return filed.withColumn("cell_y", F.explode(F.sequence(first, last))).drop("_s")


def _met(points: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Points ``key, at_x, at_y`` with the faces that share a cell with them."""
    filed = stage(_filed(rows), "filed")
    sizes = filed.select("power").distinct().agg(F.collect_list("power").alias("powers"))  # exponents only: a short list
    asked = points.select(F.col(key), F.col("x").alias("at_x"), F.col("y").alias("at_y")).crossJoin(F.broadcast(sizes))
    asked = asked.withColumn("power", F.explode("powers")).withColumn("_s", F.pow(F.lit(2.0), F.col("power").cast("double")))
    cells = [F.floor(F.col(f"at_{axis}") / F.col("_s")).alias(f"cell_{axis}") for axis in "xy"]
    return asked.select(key, "at_x", "at_y", "power", *cells).join(large(filed), ["power", "cell_x", "cell_y"])


def locate_on_mesh(points: DataFrame, face: DataFrame, vertex: DataFrame, *, key: str = "id") -> DataFrame:
    """``key, f_id, z_hat``: face below each point (lowest id on shared borders) and its height.

    A face is filed under the cells of about its own width that it touches; a point looks up its cell once
    for each size in use, so neither large nor small nor thin faces meet many points needlessly.
    Faces without an area in plan have no height to give and are left out.
    """
    rows = stage(corners(face, vertex).where(double_area_xy(*_abc()) != 0), "corners")
    a, b, c = _abc()
    hits = _met(points, rows, key).where(inside_xy(a, b, c, F.col("at_x"), F.col("at_y")))
    z = z_on_triangle(a, b, c, F.col("at_x"), F.col("at_y"))
    best = hits.groupBy(key).agg(F.min(F.struct(F.col("f_id"), z.alias("z_hat"))).alias("m"))
    return points.select(key).join(large(best), key, "left").select(key, "m.f_id", "m.z_hat")


def vertical_error(points: DataFrame, face: DataFrame, vertex: DataFrame, *, key: str = "id") -> DataFrame:
    """``key, error``: z minus the mesh height; NULL outside the mesh."""
    found = locate_on_mesh(points, face, vertex, key=key)
    return points.join(large(found), key).select(key, (F.col("z") - F.col("z_hat")).alias("error"))


def metric_safety(points: DataFrame, face: DataFrame, vertex: DataFrame, *, key: str = "id") -> DataFrame:
    """Points with ``unsafe`` where they lie more than 1e-5 above the mesh."""
    return vertical_error(points, face, vertex, key=key).select(key, "error", F.coalesce(F.col("error") > 1e-5, F.lit(False)).alias("unsafe"))


def diff_table(points: DataFrame, face: DataFrame, vertex: DataFrame, *, key: str = "id") -> DataFrame:
    """``key, x, y, z, d`` to 2 decimals; differences below 1e-5 are 0."""
    found = points.join(large(vertical_error(points, face, vertex, key=key)), key)
    d = F.when(F.abs("error") < 1e-5, F.lit(0.0)).otherwise(F.col("error"))
    return found.select(key, *(F.round(c, 2).alias(c) for c in "xyz"), F.round(d, 2).alias("d"))


def densify(vertex: DataFrame, face: DataFrame, *, only: DataFrame | None = None) -> DataFrame:
    """``f_id, x, y, z``: a new point at each face's plan circumcentre, height from the old mesh."""
    a, b, c = _abc()
    chosen = face if only is None else face.join(only, "f_id", "left_semi")
    cx, cy = circumcentre_xy(a, b, c)
    new = stage(corners(chosen, vertex).select("f_id", cx.alias("x"), cy.alias("y")).where("x IS NOT NULL"), "centres")
    heights = locate_on_mesh(new.withColumnRenamed("f_id", "id"), face, vertex).select(F.col("id").alias("f_id"), F.col("z_hat").alias("z"))
    return new.join(large(heights), "f_id").select("f_id", "x", "y", "z")


def simplify_candidates(vertex: DataFrame, face: DataFrame, *, threshold: float, up_only: bool = True) -> DataFrame:
    """``v_id, error``: small-error vertices that are the least among their neighbours.

    With ``up_only`` only vertices below the surface of their neighbours (error < -1e-5) count.
    Ties go to the lower id, so no two neighbours are given.
    """
    errors = vertex_error(vertex, face)
    small = F.abs("error") < threshold
    if up_only:
        small = small & (F.col("error") < -1e-5)
    small_ones = stage(errors.where(small), "small")
    links = edges(face).select("a", "b")
    both = links.select(F.col("a").alias("v_id"), F.col("b").alias("o")).unionByName(links.select(F.col("b").alias("v_id"), F.col("a").alias("o")))
    other = small_ones.select(F.col("v_id").alias("o"), F.abs("error").alias("oe"))
    lesser = (F.col("oe") < F.abs("error")) | ((F.col("oe") == F.abs("error")) & (F.col("o") < F.col("v_id")))
    beaten = small_ones.join(both, "v_id").join(other, "o").where(lesser).select("v_id").distinct()
    return small_ones.join(beaten, "v_id", "left_anti")


# --- nearest location on a mesh ------------------------------------------------------

def _triangle_boxes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    corners_ = t.reshape(-1, 3, 3)
    return corners_.min(axis=1), corners_.max(axis=1)


def _nearest_locations(q: np.ndarray, t: np.ndarray, best: bool = False) -> np.ndarray:
    """Squared distances of all points ``q`` to all triangles ``t`` (nine numbers each).

    The location is the foot of the perpendicular where it falls inside, else the best point of a side.
    With ``best`` points and triangles go in pairs and the locations themselves are returned.
    """
    points = [q[:, a] if best else q[:, None, a] for a in range(3)]
    corner = [[t[:, 3 * i + a] for a in range(3)] for i in range(3)]
    side = [[corner[(i + 1) % 3][a] - corner[i][a] for a in range(3)] for i in range(3)]

    def cross(u, v):
        return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]

    def dot(u, v):
        return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]

    normal = cross(side[0], side[1])
    area = dot(normal, normal)
    away = [[points[a] - corner[i][a] for a in range(3)] for i in range(3)]
    inside = (area > 0) & (dot(away[0], cross(normal, side[0])) >= 0)
    for i in (1, 2):
        inside = inside & (dot(away[i], cross(normal, side[i])) >= 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        height = dot(away[0], normal) / area
    spots = [[points[a] - normal[a] * height for a in range(3)]]
    for i in range(3):
        length = dot(side[i], side[i])
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(length > 0, np.clip(dot(away[i], side[i]) / length, 0.0, 1.0), 0.0)
        spots.append([corner[i][a] + side[i][a] * share for a in range(3)])
    gaps = []
    for spot in spots:
        gap = [points[a] - spot[a] for a in range(3)]
        gaps.append(dot(gap, gap))
    gaps[0] = np.where(inside, gaps[0], np.inf)
    if not best:
        return np.minimum(np.minimum(gaps[0], gaps[1]), np.minimum(gaps[2], gaps[3]))
    which = np.argmin(np.stack(gaps), axis=0)
    every = np.stack([np.stack(spot, axis=1) for spot in spots])
    return every[which, np.arange(len(q))]


TRIANGLES = Kind(9, _triangle_boxes, _nearest_locations)


def nearest_on_mesh(points: DataFrame, face: DataFrame, vertex: DataFrame, *, key: str = "id", prefix: str = "") -> DataFrame:
    """``key, f_id, fx, fy, fz, d2``: exact closest mesh location of every point.

    Locations are compared by distance alone; the location itself is worked out once for each point, for the winner.
    """
    numbers = F.array(*(F.col(f"{n}{x}").cast("double") for n in CORNERS for x in "xyz"))
    items = stage(corners(face, vertex).select(F.col("f_id").alias("id"), numbers.alias("xs")), "triangles")
    asked = stage(places(points, key, prefix, 1).select("id", "xs"), "places")
    found = nearest(asked, items, 1, TRIANGLES).where("size(found) > 0")
    found = found.select("xs", F.col("found")[0]["d2"].alias("d2"), F.col("found")[0]["id"].alias("id"))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c, n in (("xs", 3), ("t", 9))]
            spot = _nearest_locations(*at, best=True)
            columns = [pa.array(at[0][:, a]) for a in range(3)] + [batch.column("f_id")] + [pa.array(spot[:, a]) for a in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("d2")], ["qx", "qy", "qz", "f_id", "fx", "fy", "fz", "d2"])

    won = found.join(large(items.select("id", F.col("xs").alias("t"))), "id").select("xs", F.col("id").alias("f_id"), "t", "d2")
    feet = won.mapInArrow(task, "qx double, qy double, qz double, f_id bigint, fx double, fy double, fz double, d2 double")
    rows = points.selectExpr(key, *(f"cast({prefix}{x} AS double) + 0D AS q{x}" for x in "xyz"))
    return rows.join(large(feet), ["qx", "qy", "qz"]).select(key, "f_id", "fx", "fy", "fz", "d2")


def rms_to_mesh(points: DataFrame, face: DataFrame, vertex: DataFrame, *, key: str = "id") -> DataFrame:
    """One row ``n, rms``."""
    return nearest_on_mesh(points, face, vertex, key=key).agg(F.count("*").alias("n"), F.sqrt(F.avg("d2")).alias("rms"))


def metric_l2(vertex: DataFrame, other_face: DataFrame, other_vertex: DataFrame) -> DataFrame:
    """``v_id, d2``: squared distance of every vertex to another mesh."""
    return nearest_on_mesh(vertex, other_face, other_vertex, key="v_id").select("v_id", "d2")


def simplification_error(points: DataFrame, face: DataFrame, vertex: DataFrame, mask: DataFrame | None = None, *, key: str = "id") -> DataFrame:
    """RMS distance of the original points to the mesh built on the kept ones.

    With ``mask`` (``v_id, flag``) the faces whose three vertices are kept form the mesh.
    """
    if mask is not None:
        vertex = vertex.join(mask.where("flag").select("v_id"), "v_id", "left_semi")
        for i in range(3):
            face = face.join(vertex.select(F.col("v_id").alias(f"v{i}")), f"v{i}", "left_semi")
    return rms_to_mesh(points, face, vertex, key=key)
