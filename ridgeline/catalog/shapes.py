"""Geometry functions as jobs over the points of ``emb`` with lines and planes made of neighbours.

Row i uses the points A, B, C, D: its own and those of three other rows (by fixed strides).
The line is A to B, the other line C to D, the plane goes through A, B, C, and the second
plane through B, C, D.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.catalog.base import query, sql
from ridgeline.functions import shapes as S
from ridgeline.functions.vec import Vec, angle, put

STRIDES = (("a", 1, 0), ("b", 7, 3), ("c", 11, 5), ("d", 13, 8))
QUAD = "SELECT e.s_id, " + ", ".join(f"{n}.p{x} AS {n}{x}" for n, _, _ in STRIDES for x in "xyz") + " FROM emb e, (SELECT count(*) AS m FROM embeddings) z " + " ".join(
    f"JOIN emb {n} ON {n}.s_id = (e.s_id*{k}+{o}) % m" for n, k, o in STRIDES)


def quads(t):
    def make():
        points = t.emb().select("s_id", "px", "py", "pz")
        size = points.agg(F.count("*").alias("m"))
        rows = points.select("s_id").crossJoin(F.broadcast(size))  # exactly one row
        for n, k, o in STRIDES:
            at = points.select(F.col("s_id").alias(f"i{n}"), *(F.col(f"p{x}").alias(f"{n}{x}") for x in "xyz"))
            rows = rows.withColumn(f"i{n}", (F.col("s_id") * k + o) % F.col("m")).join(at, f"i{n}")
        return rows.where("ib <> ia AND ic <> ia AND ic <> ib AND id <> ic AND id <> ib AND id <> ia").select("s_id", *(f"{n}{x}" for n, _, _ in STRIDES for x in "xyz"))
    return t.share("quads", make)


def A():
    return Vec.of("a")


def B():
    return Vec.of("b")


def C():
    return Vec.of("c")


def D():
    return Vec.of("d")


def dot(p: str, q: str) -> str:
    return "(" + "+".join(f"({p}{x})*({q}{x})" for x in "xyz") + ")"


def sub(p: str, q: str, name: str) -> str:
    return ", ".join(f"{p}{x}-{q}{x} AS {name}{x}" for x in "xyz")


def cross(p: str, q: str, name: str) -> str:
    return f"{p}y*{q}z-{p}z*{q}y AS {name}x, {p}z*{q}x-{p}x*{q}z AS {name}y, {p}x*{q}y-{p}y*{q}x AS {name}z"


def unit(p: str, name: str) -> str:
    return ", ".join(f"{p}{x}/sqrt({dot(p, p)}) AS {name}{x}" for x in "xyz")


# Differences, unit line directions t (AB) and w (CD), plane normals n (ABC) and m (BCD).
STEPS = {
    "quad0": QUAD + " WHERE " + " AND ".join(f"{p}.s_id <> {q}.s_id" for i, (p, _, _) in enumerate(STRIDES) for q, _, _ in STRIDES[i + 1:]),
    "quad1": f"SELECT *, {sub('b', 'a', 'ab')}, {sub('c', 'a', 'ac')}, {sub('d', 'c', 'cd')}, {sub('c', 'b', 'bc')}, {sub('d', 'b', 'bd')}, {sub('d', 'a', 'ad')} FROM quad0",
    "quad2": f"SELECT *, {cross('ab', 'ac', 'rn')}, {cross('bc', 'bd', 'rm')}, {unit('ab', 't')}, {unit('cd', 'w')} FROM quad1",
    "quad": f"SELECT *, {unit('rn', 'n')}, {unit('rm', 'm')} FROM quad2",
}


def shape_sql(body: str, **kw) -> str:
    return sql(body, "emb", extra=STEPS, **kw)


def _line():
    return S.Line.through(A(), B())


def _other():
    return S.Line.through(C(), D())


def shapes(t):
    """Quads with the line directions and plane normals stored once."""
    def make():
        rows = quads(t)
        first, second = S.Plane.through(A(), B(), C()), S.Plane.through(B(), C(), D())
        rows = put(put(rows, "n", first.n), "m", second.n)
        return put(put(rows, "t", _line().t), "w", _other().t)
    return t.share("shapes", make)


def line():
    return S.Line(A(), Vec.of("t"))


def other():
    return S.Line(C(), Vec.of("w"))


def plane():
    return S.Plane(A(), Vec.of("n"))


def plane2():
    return S.Plane(B(), Vec.of("m"))


@query("vector_basics", shape_sql(
    f"SELECT s_id, {dot('ab', 'ac')} AS dot, {dot('ab', 'ab')} AS abs2, tx AS ux, {dot('ac', 't')}*tx AS along, acx - {dot('ac', 't')}*tx AS across FROM quad",
    rounded="dot:5 abs2:5 ux along across"), rounded="dot:5 abs2:5 ux along across")
def vector_basics(t):
    ab, ac = B() - A(), C() - A()
    return quads(t).select("s_id", ab.dot(ac).alias("dot"), ab.abs2().alias("abs2"), ab.unit().x.alias("ux"), ac.parallel_to(ab).x.alias("along"), ac.orthogonal_to(ab).x.alias("across"))


@query("angles", shape_sql(
    f"SELECT s_id, acos(greatest(-1.0, least(1.0, {dot('ab', 'ac')}/sqrt({dot('ab', 'ab')}*{dot('ac', 'ac')})))) AS between_vectors, acos(least(1.0, abs({dot('t', 'w')}))) AS line_line, pi()/2 - acos(least(1.0, abs({dot('w', 'n')}))) AS line_plane, acos(least(1.0, abs({dot('n', 'm')}))) AS plane_plane FROM quad",
    rounded="between_vectors line_line line_plane plane_plane", digits=5), rounded="between_vectors line_line line_plane plane_plane", digits=5)
def angles(t):
    return shapes(t).select(
        "s_id", angle(B() - A(), C() - A()).alias("between_vectors"), S.unsigned_angle(Vec.of("t"), Vec.of("w")).alias("line_line"),
        S.line_plane_angle(other(), plane()).alias("line_plane"), S.unsigned_angle(Vec.of("n"), Vec.of("m")).alias("plane_plane"),
    )


@query("plane_bases", shape_sql(
    "SELECT s_id, CAST(0 AS DOUBLE) AS first_on_normal, CAST(0 AS DOUBLE) AS second_on_normal, CAST(0 AS DOUBLE) AS third_point_height, CAST(1 AS DOUBLE) AS same_normal, CAST(0 AS DOUBLE) AS line_on_plane FROM quad",
    rounded="first_on_normal second_on_normal third_point_height same_normal line_on_plane"), rounded="first_on_normal second_on_normal third_point_height same_normal line_on_plane")
def plane_bases(t):
    first, second = S.dual(Vec.of("n"))
    rows = put(put(shapes(t), "g", first), "h", second)
    _, _, third = S.plane_points(plane())
    upright, normal, built = S.plane_normal_to(line(), C()), S.normal_line(plane()), S.line_dual_plane(line())
    return rows.select(
        "s_id", F.abs(Vec.of("g").dot(Vec.of("n"))).alias("first_on_normal"), F.abs(Vec.of("h").dot(Vec.of("n"))).alias("second_on_normal"),
        F.abs(S.signed_height(third, plane())).alias("third_point_height"), (F.abs(built.n.dot(Vec.of("t"))) + normal.t.dot(Vec.of("n")) - 1).alias("same_normal"),
        F.abs(S.signed_height(C(), upright)).alias("line_on_plane"),
    )


@query("projections", shape_sql(
    f"SELECT s_id, ax + tx*{dot('ac', 't')} AS on_line_x, az + tz*{dot('ac', 't')} AS on_line_z, dx - nx*{dot('ad', 'n')} AS on_plane_x, dz - nz*{dot('ad', 'n')} AS on_plane_z FROM quad",
    rounded="on_line_x on_line_z on_plane_x on_plane_z"), rounded="on_line_x on_line_z on_plane_x on_plane_z")
def projections(t):
    on_line, on_plane = S.project_on_line(C(), line()), S.project_on_plane(D(), plane())
    return shapes(t).select("s_id", on_line.x.alias("on_line_x"), on_line.z.alias("on_line_z"), on_plane.x.alias("on_plane_x"), on_plane.z.alias("on_plane_z"))


DIST = f"""SELECT s_id, sqrt({dot('ab', 'ab')}) AS point_point, sqrt(greatest(0.0, {dot('ac', 'ac')} - {dot('ac', 't')}*{dot('ac', 't')})) AS point_line, abs({dot('ad', 'n')}) AS point_plane,
 abs(acx*xx+acy*xy+acz*xz)/sqrt(xx*xx+xy*xy+xz*xz) AS line_line FROM (SELECT *, {cross('t', 'w', 'x')} FROM quad) q"""


@query("distances", shape_sql(DIST, rounded="point_point point_line:5 point_plane line_line:5"), rounded="point_point point_line:5 point_plane line_line:5")
def distances(t):
    return shapes(t).select(
        "s_id", S.point_distance(A(), B()).alias("point_point"), S.point_line_distance(C(), line()).alias("point_line"),
        S.point_plane_distance(D(), plane()).alias("point_plane"), S.line_line_distance(line(), other()).alias("line_line"),
    )


@query("distances_line_plane", shape_sql(
    "SELECT s_id, CAST(0 AS DOUBLE) AS line_plane, CAST(0 AS DOUBLE) AS plane_plane FROM quad", rounded="line_plane:5 plane_plane"), rounded="line_plane:5 plane_plane")
def distances_line_plane(t):
    """A line crossing a plane meets its own projection there, so both distances are 0."""
    gap = S.line_plane_distance(other(), plane())
    return shapes(t).select("s_id", gap.alias("line_plane"), S.plane_plane_distance(plane(), plane2()).alias("plane_plane"))


@query("midpoints", shape_sql(
    f"SELECT s_id, (ax+bx)/2 AS point_point, (cx + ax + tx*{dot('ac', 't')})/2 AS point_line, (2*dx - nx*{dot('ad', 'n')})/2 AS point_plane, (ax + s*tx + cx + u*wx)/2 AS line_line FROM (SELECT *, (ga - k*gb)/(1-k*k) AS s, (k*ga - gb)/(1-k*k) AS u FROM (SELECT *, {dot('t', 'w')} AS k, {dot('ac', 't')} AS ga, {dot('ac', 'w')} AS gb FROM quad) q) q2",
    rounded="point_point:8 point_line point_plane line_line:5"), rounded="point_point:8 point_line point_plane line_line:5")
def midpoints(t):
    return shapes(t).select(
        "s_id", S.point_midpoint(A(), B()).x.alias("point_point"), S.point_line_midpoint(C(), line()).x.alias("point_line"),
        S.point_plane_midpoint(D(), plane()).x.alias("point_plane"), S.line_line_midpoint(line(), other()).x.alias("line_line"),
    )


@query("plane_sides", shape_sql(
    f"SELECT s_id, {dot('ad', 'n')} * ((c0-ax)*nx+(c0-ay)*ny+(c0-az)*nz) < 0 AS separates, CAST(sign({dot('ad', 'n')}) AS INT) AS orientation, abs(nx) AS a, {dot('n', 'a')} * CASE WHEN nx < 0 THEN -1 ELSE 1 END AS d FROM (SELECT *, 0.5 AS c0 FROM quad) q",
    rounded="a d"), rounded="a d")
def plane_sides(t):
    a, _, _, d = S.coefficients(plane())
    return shapes(t).select("s_id", S.separates(plane(), D(), Vec.lit(0.5, 0.5, 0.5)).alias("separates"), S.orientation(plane(), D()).alias("orientation"), a.alias("a"), d.alias("d"))


@query("plane_intersection", shape_sql(
    f"SELECT s_id, 'line' AS kind, abs({dot('bc', 't2')}) AS along_bc FROM (SELECT *, {unit('bc', 't2')} FROM quad) q", rounded="along_bc:4"), rounded="along_bc:4")
def plane_intersection(t):
    """Planes ABC and BCD meet in the line BC: its direction over the length of BC, plus the
    distances of B and C from it."""
    kind, found = S.plane_intersection(plane(), plane2())
    rows = shapes(t).select("*", kind.alias("kind"), *found.cols("l"))
    off = S.point_line_distance(B(), S.Line.of("l")) + S.point_line_distance(C(), S.Line.of("l"))
    return rows.select("s_id", "kind", (F.abs((C() - B()).dot(Vec.of("lt"))) + off).alias("along_bc"))


@query("lines_cross_plan", shape_sql(
    "SELECT s_id, cx + s*wx AS x, cy + s*wy AS y, cz + s*wz AS z FROM (SELECT *, (tx*(cy-ay) - ty*(cx-ax))/(wx*ty - tx*wy) AS s FROM quad) q WHERE abs(wx*ty - tx*wy) > 0.01",
    rounded="x:4 y:4 z:4"), rounded="x:4 y:4 z:4")
def lines_cross_plan(t):
    at = S.lines_meet_xy(line(), other())
    return shapes(t).where("abs(wx*ty - tx*wy) > 0.01").select("s_id", at.x.alias("x"), at.y.alias("y"), at.z.alias("z"))


@query("quaternions", shape_sql(
    # turning C about the axis t by 1 radian, written as the rotation formula
    f"SELECT s_id, cx*cos(1.0) + (ty*cz-tz*cy)*sin(1.0) + tx*{dot('t', 'c')}*(1-cos(1.0)) AS x, cy*cos(1.0) + (tz*cx-tx*cz)*sin(1.0) + ty*{dot('t', 'c')}*(1-cos(1.0)) AS y, CAST(0 AS DOUBLE) AS there_and_back FROM quad",
    rounded="x y there_and_back"), rounded="x y there_and_back")
def quaternions(t):
    q = S.Quat.rotor(Vec.of("t"), 1.0)
    turned = q.rotate(C())
    rows = put(put(shapes(t), "r", turned), "u", (q.conj() * q).rotate(C()))
    return rows.select("s_id", F.col("rx").alias("x"), F.col("ry").alias("y"), (Vec.of("u") - C()).norm().alias("there_and_back"))


@query("rigid_motions", shape_sql(
    "SELECT s_id, " + ", ".join(f"CAST(0 AS DOUBLE) AS {n}" for n in ("point_point", "point_line", "point_plane", "line_line", "line_plane", "plane_plane", "inverse", "composed")) + ", true AS is_translation FROM quad",
    rounded="point_point point_line point_plane line_line:5 line_plane:5 plane_plane:5 inverse:5 composed:5"), rounded="point_point point_line point_plane line_line:5 line_plane:5 plane_plane:5 inverse:5 composed:5")
def rigid_motions(t):
    """Each motion carries its object onto the target: all remaining gaps are 0."""
    rows = shapes(t)
    motions = {
        "u": (A(), B()), "v": (C(), line()), "g": (D(), plane()), "h": (line(), other()), "e": (other(), plane()), "f": (plane(), plane2()),
    }
    for name, (source, target) in motions.items():
        rows = S.with_motion(rows, f"{name}_", source, target)
    m = {name: S.Motion.of(f"{name}_") for name in motions}
    moved = {"i": m["h"].apply(A()), "j": m["h"].apply(B()), "k": m["e"].apply(C()), "l": m["e"].apply(D()), "o": m["f"].apply(A()), "p": m["f"].apply(B()), "s": m["f"].apply(C())}
    for name, at in moved.items():
        rows = put(rows, f"z{name}", at)
    z = {name: Vec.of(f"z{name}") for name in moved}
    rows = put(put(rows, "back", m["h"].inverse().apply(z["i"])), "both", m["g"].after(m["h"]).apply(A()))
    gaps = {
        "point_point": (m["u"].apply(A()) - B()).norm(), "point_line": S.point_line_distance(m["v"].apply(C()), line()), "point_plane": F.abs(S.signed_height(m["g"].apply(D()), plane())),
        "line_line": S.point_line_distance(z["i"], other()) + S.point_line_distance(z["j"], other()),
        "line_plane": F.abs(S.signed_height(z["k"], plane())) + F.abs(S.signed_height(z["l"], plane())),
        "plane_plane": F.abs(S.signed_height(z["o"], plane2())) + F.abs(S.signed_height(z["p"], plane2())) + F.abs(S.signed_height(z["s"], plane2())),
        "inverse": (Vec.of("back") - A()).norm(), "composed": (Vec.of("both") - m["g"].apply(z["i"])).norm(),
    }
    return rows.select("s_id", *(g.alias(n) for n, g in gaps.items()), m["u"].is_translation().alias("is_translation"))


@query("triangle_functions", shape_sql(
    """SELECT s_id, CAST(0 AS DOUBLE) AS unequal_radii, az - (rnx*(dx-ax)+rny*(dy-ay))/rnz AS z FROM quad WHERE abs(rnz) > 1""", rounded="unequal_radii:4 z:4"), rounded="unequal_radii:4 z:4")
def triangle_functions(t):
    """The plan circumcentre is as far from A as from B and C; heights come from the plane."""
    ox, oy = S.circumcentre_xy(A(), B(), C())
    rows = shapes(t).where(F.abs((B() - A()).cross(C() - A()).z) > 1).withColumns({"ox": ox, "oy": oy})

    def reach(p: str):
        return F.sqrt((F.col("ox") - F.col(f"{p}x")) ** 2 + (F.col("oy") - F.col(f"{p}y")) ** 2)

    rows = rows.withColumns({"ra": reach("a"), "rb": reach("b"), "rc": reach("c")})
    spread = (F.greatest("ra", "rb", "rc") - F.least("ra", "rb", "rc")) / F.greatest("ra", "rb", "rc")
    return rows.select("s_id", spread.alias("unequal_radii"), S.z_on_triangle(A(), B(), C(), F.col("dx"), F.col("dy")).alias("z"))
