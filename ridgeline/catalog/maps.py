"""Queries on the half-node map and reconstruction.

The cloud here is a row of cubes derived from the parts: 100 points per cube, in pairs that
touch one ball beside one of the twelve edges.  Sheets are the edges, two sheets are linked
when their edges share a corner.  In every third cube the balls of one edge are all large, so
its half-nodes are locked.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.catalog.base import CTES, atoms_cte, query, sql
from ridgeline.functions.vec import Vec
from ridgeline.operators import atoms as A
from ridgeline.operators import cmap as M
from ridgeline.operators import reconstruct as B
from ridgeline.operators.analysis import spoke_sides
from ridgeline.plans.pipeline import run_path
from ridgeline.staging import large, new_path

# Axis of the edge, and the coordinates along (k), and across it (k+1, k+2), rotated into x, y, z.
CUBE = """
SELECT s_id, b, face, sheet, t,
 x0 + CASE k WHEN 0 THEN pu WHEN 1 THEN pw ELSE pv END AS px, CASE k WHEN 0 THEN pv WHEN 1 THEN pu ELSE pw END AS py, CASE k WHEN 0 THEN pw WHEN 1 THEN pv ELSE pu END AS pz,
 x0 + CASE k WHEN 0 THEN pu WHEN 1 THEN cw ELSE cv END AS cix, CASE k WHEN 0 THEN cv WHEN 1 THEN pu ELSE cw END AS ciy, CASE k WHEN 0 THEN cw WHEN 1 THEN cv ELSE pu END AS ciz,
 x0 + CASE k WHEN 0 THEN pu WHEN 1 THEN ow ELSE ov END AS cox, CASE k WHEN 0 THEN ov WHEN 1 THEN pu ELSE ow END AS coy, CASE k WHEN 0 THEN ow WHEN 1 THEN ov ELSE pu END AS coz,
 CAST(s_id + 1 - 2*face AS BIGINT) AS qin, CAST((s_id*7+3) % (SELECT count(*) FROM part) AS BIGINT) AS qout
FROM (SELECT *, s1*(5 - face*t) AS pv, s2*(5 - (1-face)*t) AS pw, s1*(5-t) AS cv, s2*(5-t) AS cw, s1*(5+(1-face)*3) AS ov, s2*(5+face*3) AS ow FROM (
 SELECT s_id, b, face, 1 + 12*b + e AS sheet, CAST(floor(e/4) AS INT) AS k, CAST(1-2*(e%2) AS DOUBLE) AS s1, CAST(1-2*(CAST(floor(e/2) AS BIGINT)%2) AS DOUBLE) AS s2,
  CAST(30 AS DOUBLE)*b AS x0, CAST(0.3125 AS DOUBLE)*(i+1) + CASE WHEN b % 3 = 1 AND e = 0 THEN CAST(0.75 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS t, CAST((pair*37)%11-5 AS DOUBLE)*CAST(0.5625 AS DOUBLE) AS pu
 FROM (SELECT s_id, b, face, pair, pair % 12 AS e, CAST(floor(pair/12) AS BIGINT) AS i FROM (
  SELECT p_partkey AS s_id, CAST(floor(p_partkey/100) AS BIGINT) AS b, p_partkey % 2 AS face, CAST(floor(p_partkey % 100 / 2) AS BIGINT) AS pair FROM part) c0) c1) c2) c3"""

# Sheets linked when their edges share a corner: axes differ and the fixed sides agree.
CUBE_LINKS = """
SELECT DISTINCT x.sheet AS a, y.sheet AS b FROM ends x JOIN ends y ON x.cube = y.cube AND x.corner = y.corner AND x.sheet < y.sheet"""
# corner = bits of the signs of x, y, z
ENDS = """
SELECT DISTINCT b AS cube, sheet, CAST(CASE k WHEN 0 THEN tip + 2*n1 + 4*n2 WHEN 1 THEN n2 + 2*tip + 4*n1 ELSE n1 + 2*n2 + 4*tip END AS BIGINT) AS corner FROM (
 SELECT b, sheet, tip, CAST(floor((sheet-1-12*b)/4) AS BIGINT) AS k, (sheet-1-12*b)%2 AS n1, CAST(floor((sheet-1-12*b)/2) AS BIGINT)%2 AS n2 FROM cube, (SELECT 0 AS tip UNION ALL SELECT 1) tips) d"""

CTES["cube"] = (CUBE, [])
CTES["cube_atoms"] = (atoms_cte("cube"), ["cube"])
CTES["cube_in"] = ("SELECT * FROM cube_atoms WHERE side = 'in'", ["cube_atoms"])
CTES["ends"] = (ENDS, ["cube"])
CTES["cube_links"] = (CUBE_LINKS, ["ends"])


def cube(t):
    return t.share("cube", lambda: t.adapter(CUBE, "part"))


def cube_links(t):
    def make():
        ends = t.spark.sql(ENDS.replace("FROM cube,", "FROM {cube} CROSS JOIN"), cube=cube(t).select("b", "sheet").distinct())
        return t.spark.sql(CUBE_LINKS.replace("FROM ends x JOIN ends y", "FROM {ends} x JOIN {ends} y"), ends=ends)
    return t.share("cube_links", make)


def cube_sided(t):
    def make():
        wide = cube(t)
        atoms = A.derive_atoms(wide, A.stack_sides(wide), center=False).where("side = 'in'")
        labels = atoms.select("ma_id", "s_id").join(large(wide.select("s_id", F.col("sheet").alias("seg"))), "s_id").select("ma_id", "seg")
        return spoke_sides(atoms, labels)
    return t.share("cube_sided", make)


def cube_nodes(t):
    return t.share("cube_nodes", lambda: M.half_nodes(cube_sided(t)))


def cube_match(t):
    return t.share("cube_match", lambda: M.match_edges(cube_links(t), cube_nodes(t)))


# In SQL the half of a spoke is known from the face it ends on; which half is the first follows
# from the sign convention of the sheet axis: the axis is the edge, pointing to its positive end.
SIDED = {
    "sided": "SELECT m.*, CASE CAST(floor((c.sheet-1-12*c.b)/4) AS BIGINT) WHEN 0 THEN m.kx WHEN 1 THEN m.ky ELSE m.kz END > 0 AS one_side FROM cube_in m JOIN cube c ON c.s_id = m.s_id",
    "spoke_rows": """SELECT seg, CASE WHEN one_side THEN 1 ELSE 2 END AS half, s_id, f1x AS fx, f1y AS fy, f1z AS fz FROM sided
      UNION ALL SELECT seg, CASE WHEN one_side THEN 2 ELSE 1 END, q_id, f2x, f2y, f2z FROM sided""",
    "nodes": """SELECT 2*h.seg + half - 1 AS h, h.seg, half, points, fx, fy, fz, mbx AS bx, mby AS by, mbz AS bz, minr > 0.8 AS locked FROM
      (SELECT seg, half, count(*) AS points, avg(fx) AS fx, avg(fy) AS fy, avg(fz) AS fz FROM spoke_rows GROUP BY seg, half) h
      JOIN (SELECT seg, avg(theta) AS mt, min(r) AS minr, avg(bx) AS mbx, avg(by) AS mby, avg(bz) AS mbz FROM sided GROUP BY seg) s ON s.seg = h.seg WHERE mt <= radians(170)""",
    "quads": """SELECT l.a, l.b, x.h AS hx, y.h AS hy, acos(greatest(-1.0, least(1.0, (x.fx*y.fx+x.fy*y.fy+x.fz*y.fz)/(sqrt(x.fx*x.fx+x.fy*x.fy+x.fz*x.fz)*sqrt(y.fx*y.fx+y.fy*y.fy+y.fz*y.fz))))) AS g
      FROM cube_links l JOIN nodes x ON x.seg = l.a JOIN nodes y ON y.seg = l.b""",
    "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(g, 6), hx, hy) AS n FROM quads) q WHERE n = 1 AND g < radians(5)",
    "matched": "SELECT p.hx AS x, p.hy AS y, p.g AS angle, o.g AS other_angle, CASE WHEN o.g < radians(30) THEN 'match' ELSE 'intersect' END AS other_kind FROM best p JOIN quads o ON o.a = p.a AND o.b = p.b AND o.hx = xor(p.hx, 1) AND o.hy = xor(p.hy, 1) WHERE o.g <= radians(165)",
    "removed": "SELECT h FROM nodes WHERE locked",
    "undirected": "SELECT DISTINCT least(x, y) AS x, greatest(x, y) AS y FROM matched",
    "both_ways": "SELECT x, y FROM undirected UNION ALL SELECT y, x FROM undirected",
    "inner_walk": "SELECT h AS root, h AS node FROM removed UNION SELECT w.root, b.y FROM inner_walk w JOIN both_ways b ON b.x = w.node JOIN removed r ON r.h = b.y",
    "inner_comp": "SELECT node AS h, min(root) AS hub FROM inner_walk GROUP BY node",
    "members": "SELECT DISTINCT c.hub, b.y AS h FROM inner_comp c JOIN both_ways b ON b.x = c.h WHERE b.y NOT IN (SELECT h FROM removed)",
    "contracted": "SELECT x, y FROM undirected WHERE x NOT IN (SELECT h FROM removed) AND y NOT IN (SELECT h FROM removed) UNION SELECT p.h, q.h FROM members p JOIN members q ON q.hub = p.hub AND p.h < q.h",
    "degrees": "SELECT h, count(*) AS d FROM (SELECT x AS h FROM contracted UNION ALL SELECT y FROM contracted) d GROUP BY h",
    "left_links": "SELECT x, y FROM contracted c WHERE NOT ((SELECT d FROM degrees WHERE h = x) > 2 AND (SELECT d FROM degrees WHERE h = y) > 2)",
    "face_walk": "SELECT h AS root, h AS node FROM nodes WHERE NOT locked UNION SELECT w.root, l.y FROM face_walk w JOIN (SELECT x, y FROM left_links UNION ALL SELECT y, x FROM left_links) l ON l.x = w.node",
    "face_of": "SELECT node AS h, min(root) AS face FROM face_walk GROUP BY node",
    "left_degree": "SELECT h, count(*) AS d FROM (SELECT x AS h FROM left_links UNION ALL SELECT y FROM left_links) d GROUP BY h",
    "faces": "SELECT f.h, f.face, (min(coalesce(d, 0)) OVER (PARTITION BY face) = 2 AND max(coalesce(d, 0)) OVER (PARTITION BY face) = 2) AS cycle FROM face_of f LEFT JOIN left_degree g ON g.h = f.h",
}


def map_sql(body: str, upto: str, **kw) -> str:
    keys = list(SIDED)
    return sql(body, "cube_in", "cube_links", extra={k: SIDED[k] for k in keys[: keys.index(upto) + 1]}, **kw)


NODE_COLS = "fx fy fz bx by bz"


@query("half_nodes", map_sql("SELECT h, seg, half, points, fx, fy, fz, bx, by, bz, locked FROM nodes", "nodes", rounded=NODE_COLS), rounded=NODE_COLS)
def half_nodes(t):
    return cube_nodes(t)


@query("half_pairs", map_sql("SELECT x, y, angle FROM matched", "matched", rounded="angle:4"), rounded="angle:4")
def half_pairs(t):
    return cube_match(t).select("x", "y", "angle")


@query("match_edges", map_sql("SELECT x, y, angle, other_angle, other_kind FROM matched", "matched", rounded="angle:4 other_angle:4"), rounded="angle:4 other_angle:4")
def match_edges(t):
    return cube_match(t)


# All points of a half-node lie on one side of its cube, so the plane through them is level in the axis without spread.
HALF_PLANES = {
    "half_points": "SELECT 2*s.seg + s.half - 1 AS h, c.px, c.py, c.pz FROM spoke_rows s JOIN cube c ON c.s_id = s.s_id",
    "half_planes": "SELECT h, count(*) AS n, avg(px) AS mx, avg(py) AS my, avg(pz) AS mz, var_pop(px) < 1e-9 AS flat_x, var_pop(py) < 1e-9 AS flat_y FROM half_points GROUP BY h",
    "verdicts": """SELECT m.x, m.y, avg(CASE WHEN CASE WHEN g.flat_x THEN abs(q.px - g.mx) WHEN g.flat_y THEN abs(q.py - g.my) ELSE abs(q.pz - g.mz) END < 0.1 THEN 1 ELSE 0 END) > 0.9 AS matches
      FROM matched m JOIN half_planes a ON a.h = xor(m.x, 1) JOIN half_planes b ON b.h = xor(m.y, 1)
      JOIN half_planes g ON g.h = CASE WHEN a.n > b.n THEN a.h ELSE b.h END JOIN half_points q ON q.h = CASE WHEN a.n > b.n THEN b.h ELSE a.h END GROUP BY m.x, m.y""",
}


@query("match_edges_surface", sql(
    "SELECT m.x, m.y, CASE WHEN v.matches THEN 'match' ELSE 'intersect' END AS other_kind FROM matched m LEFT JOIN verdicts v ON v.x = m.x AND v.y = m.y",
    "cube_in", "cube_links", extra={**{k: SIDED[k] for k in list(SIDED)[: list(SIDED).index("matched") + 1]}, **HALF_PLANES}))
def match_edges_surface(t):
    return M.match_edges(cube_links(t), cube_nodes(t), variant="surface", points=M.half_node_points(cube_sided(t)), surface=cube(t)).select("x", "y", "other_kind")


def removed(t):
    return M.removed_nodes(cube_match(t), cube_nodes(t), merge_matching=False)


@query("contract_half_nodes", map_sql(
    """SELECT 'link' AS kind, x, y FROM undirected WHERE x NOT IN (SELECT h FROM removed) AND y NOT IN (SELECT h FROM removed)
     UNION ALL SELECT 'group', hub, h FROM members""", "members"))
def contract_half_nodes(t):
    """Links that stay, and all groups of survivors whole, as members of their hub."""
    links, groups = M.contract(cube_match(t).select("x", "y"), removed(t))
    return links.select(F.lit("link").alias("kind"), "x", "y").unionByName(groups.select(F.lit("group").alias("kind"), F.col("hub").alias("x"), F.col("h").alias("y")))


def left(t):
    return t.share("cube_left", lambda: M.drop_splitting(*M.contract(cube_match(t).select("x", "y"), removed(t))))


@query("drop_splitting", map_sql("SELECT x, y FROM left_links", "left_links"))
def drop_splitting(t):
    return left(t)


def found(t):
    return t.share("cube_faces", lambda: M.faces(cube_nodes(t).join(removed(t), "h", "left_anti"), left(t)))


@query("map_faces", map_sql("SELECT h, face, cycle FROM faces", "faces"))
def map_faces(t):
    return found(t)


# Walk around each closed face: from its lowest half-node toward the lower neighbour.
ORDER = {
    "closed": "SELECT l.x, l.y FROM (SELECT x, y FROM left_links UNION ALL SELECT y, x FROM left_links) l JOIN faces f ON f.h = l.x WHERE f.cycle",
    "steps": "SELECT f.face, f.face AS h, (SELECT min(y) FROM closed WHERE x = f.face) AS next_h, 0 AS pos FROM (SELECT DISTINCT face FROM faces WHERE cycle) f UNION ALL SELECT s.face, s.next_h, c.y, s.pos + 1 FROM steps s JOIN closed c ON c.x = s.next_h AND c.y <> s.h WHERE s.next_h <> s.face",
    "sized": "SELECT s.*, count(*) OVER (PARTITION BY face) AS size FROM steps s",
}


def ordered(t):
    return t.share("cube_order", lambda: M.face_order(left(t), found(t)))


def order_sql(body: str, **kw) -> str:
    return sql(body, "cube_in", "cube_links", extra={**SIDED, **ORDER}, **kw)


@query("face_order", order_sql("SELECT face, h, CAST(pos AS BIGINT) AS pos, next_h, size FROM sized"))
def face_order(t):
    return ordered(t)


FLIP = """SELECT z.face, z.h, CASE WHEN turn > 0 THEN (size - pos) % size ELSE pos END AS pos FROM sized z JOIN (
 SELECT face, (uy*wz-uz*wy)*sx + (uz*wx-ux*wz)*sy + (ux*wy-uy*wx)*sz AS turn FROM (
  SELECT a.face, n1.bx-n0.bx AS ux, n1.by-n0.by AS uy, n1.bz-n0.bz AS uz, n2.bx-n1.bx AS wx, n2.by-n1.by AS wy, n2.bz-n1.bz AS wz, n0.fx AS sx, n0.fy AS sy, n0.fz AS sz
  FROM sized a JOIN sized b ON b.face = a.face AND b.pos = 1 JOIN sized c ON c.face = a.face AND c.pos = 2
  JOIN nodes n0 ON n0.h = a.h JOIN nodes n1 ON n1.h = b.h JOIN nodes n2 ON n2.h = c.h WHERE a.pos = 0) d) e ON e.face = z.face"""


def oriented(t):
    return t.share("cube_oriented", lambda: M.orient(ordered(t), cube_nodes(t)))


@query("orient_faces", order_sql(f"SELECT face, h, CAST(pos AS BIGINT) AS pos FROM ({FLIP}) f"))
def orient_faces(t):
    return oriented(t).select("face", "h", "pos")


# Rounds go on while a spoke of any sheet changes its half; sheets that have settled stay as they are.
LLOYD = {
    **{k: SIDED[k] for k in ("sided", "spoke_rows")},
    "lloyd": """
      SELECT 0 AS step, row_number() OVER (ORDER BY seg, half, s_id) AS id, seg, -fx/l AS x, -fy/l AS y, -fz/l AS z, half, true AS changed
      FROM (SELECT *, nullif(sqrt(fx*fx+fy*fy+fz*fz), 0) AS l FROM spoke_rows) u WHERE l IS NOT NULL
      UNION ALL
      SELECT step + 1, id, seg, x, y, z, near, near <> half FROM (
       SELECT r.*, CASE WHEN m.x2 IS NULL OR (r.x-m.x1)*(r.x-m.x1)+(r.y-m.y1)*(r.y-m.y1)+(r.z-m.z1)*(r.z-m.z1) <= (r.x-m.x2)*(r.x-m.x2)+(r.y-m.y2)*(r.y-m.y2)+(r.z-m.z2)*(r.z-m.z2) THEN 1 ELSE 2 END AS near
       FROM lloyd r JOIN (SELECT seg, avg(x) FILTER (half = 1) AS x1, avg(y) FILTER (half = 1) AS y1, avg(z) FILTER (half = 1) AS z1,
         avg(x) FILTER (half = 2) AS x2, avg(y) FILTER (half = 2) AS y2, avg(z) FILTER (half = 2) AS z2 FROM lloyd GROUP BY seg) m ON m.seg = r.seg
       WHERE (SELECT bool_or(changed) FROM lloyd)) n""",
}


@query("two_means", sql(
    "SELECT seg, half, count(*) AS points, avg(x) AS fx, avg(y) AS fy, avg(z) AS fz FROM lloyd WHERE step = (SELECT max(step) FROM lloyd) GROUP BY seg, half",
    "cube_in", extra=LLOYD, rounded="fx fy fz"), rounded="fx fy fz")
def two_means(t):
    return M.two_means(cube_sided(t))[1]


def planes(t):
    return t.share("cube_planes", lambda: B.face_planes(found(t), M.half_node_points(cube_sided(t)), cube(t)))


# Planes are known by the axis in which the points of a face have no spread.
PLANES = {
    "used": "SELECT h, face FROM faces WHERE cycle OR h = face",
    "face_points": "SELECT DISTINCT u.face, s.s_id FROM used u JOIN spoke_rows s ON 2*s.seg + s.half - 1 = u.h",
    "face_spread": """SELECT f.face, count(*) AS n, avg(px) AS rx, avg(py) AS ry, avg(pz) AS rz, var_pop(px) < 1e-9 AS flat_x, var_pop(py) < 1e-9 AS flat_y
      FROM face_points f JOIN cube c ON c.s_id = f.s_id GROUP BY f.face""",
    "planes": """SELECT face, n, rx, ry, rz, CASE WHEN flat_x THEN 1.0 ELSE 0.0 END::DOUBLE AS nx, CASE WHEN flat_y AND NOT flat_x THEN 1.0 ELSE 0.0 END::DOUBLE AS ny,
      CASE WHEN flat_x OR flat_y THEN 0.0 ELSE 1.0 END::DOUBLE AS nz FROM face_spread""",
}
PLANE_COLS = "rx ry rz nx ny nz"


@query("face_planes", sql("SELECT * FROM planes", "cube_in", "cube_links", extra={**SIDED, **PLANES}, rounded=PLANE_COLS), rounded=PLANE_COLS)
def face_planes(t):
    return planes(t)


def lines(t):
    return t.share("cube_ridges", lambda: B.ridge_lines(found(t), planes(t)))


LINE_COLS = "rx ry rz tx ty tz"


# The planes of a sheet stand upright on each other along two axes: each gives one coordinate of the line.
@query("ridge_lines", sql(
    """SELECT a.h // 2 AS seg, p.nx*p.rx + q.nx*q.rx AS rx, p.ny*p.ry + q.ny*q.ry AS ry, p.nz*p.rz + q.nz*q.rz AS rz,
      p.ny*q.nz - p.nz*q.ny AS tx, p.nz*q.nx - p.nx*q.nz AS ty, p.nx*q.ny - p.ny*q.nx AS tz
     FROM faces a JOIN faces b ON b.h = a.h + 1 JOIN planes p ON p.face = a.face JOIN planes q ON q.face = b.face WHERE a.h % 2 = 0""",
    "cube_in", "cube_links", extra={**SIDED, **PLANES}, rounded=LINE_COLS), rounded=LINE_COLS)
def ridge_lines(t):
    return lines(t)


# A corner of a cube is known where all three faces around it are closed; it lies at +-5 of the centre.
CORNERS = {
    **SIDED,
    **ORDER,
    "turned": f"SELECT f.face, f.h, f.pos, z.size FROM ({FLIP}) f JOIN sized z ON z.h = f.h",
    "darts": "SELECT a.face, a.h, a.pos, a.size, b.h AS next_h FROM turned a JOIN turned b ON b.face = a.face AND b.pos = (a.pos + 1) % a.size",
    "meeting": """SELECT d.face, d.h, d.pos, d.size, e.cube, e.corner, count(*) OVER w AS around, min(d.h) OVER w AS hub FROM darts d
      JOIN ends e ON e.sheet = d.h // 2 JOIN ends f ON f.sheet = d.next_h // 2 AND f.cube = e.cube AND f.corner = e.corner WINDOW w AS (PARTITION BY e.cube, e.corner)""",
    "corners": """SELECT face, h, pos, size, hub AS corner, CAST(30*cube + 5 - 10*(corner % 2) AS DOUBLE) AS x, CAST(5 - 10*((corner // 2) % 2) AS DOUBLE) AS y, CAST(5 - 10*(corner // 4) AS DOUBLE) AS z
      FROM meeting WHERE around = 3""",
}


# Beside a locked edge an orbit may close around two corners at once; no two of its lines cross in plan.
ORBITS = {
    **CORNERS,
    "turns": "SELECT h, xor(next_h, 1) AS onto FROM darts",
    "orbit_walk": "SELECT h AS root, h AS node FROM turns UNION SELECT w.root, t.onto FROM orbit_walk w JOIN turns t ON t.h = w.node WHERE t.onto IN (SELECT h FROM turns)",
    "orbits": "SELECT w.root AS h, min(w.node) AS corner FROM orbit_walk w JOIN turns t ON t.h = w.node GROUP BY w.root HAVING bool_or(t.onto = w.root)",
}


@query("corner_points", sql(
    "SELECT o.h, o.corner, c.x, c.y, c.z FROM orbits o LEFT JOIN corners c ON c.h = o.h", "cube_in", "cube_links", extra=ORBITS, rounded="x y z", digits=5),
    rounded="x y z", digits=5)
def corner_points(t):
    return B.corner_points(oriented(t), lines(t))


# A closed face of n half-nodes becomes n - 2 triangles if all its corners are known: twelve for a whole
# cube.  The corners at the ends of a locked edge have no closed orbit, so the faces that touch them stay
# open and the two faces away from that edge remain.  All corners lie at +-5 of the centre.
@query("reconstruct", map_sql(
    """SELECT b, CAST(sum(n - 2) AS BIGINT) AS triangles, CAST(b*30 - 5 AS DOUBLE) AS min_x, CAST(b*30 + 5 AS DOUBLE) AS max_x, CAST(-5 AS DOUBLE) AS min_z, CAST(5 AS DOUBLE) AS max_z
     FROM (SELECT face, CAST(floor((floor(face / 2) - 1) / 12) AS BIGINT) AS b, count(*) AS n FROM faces f LEFT JOIN (
      SELECT DISTINCT e.sheet FROM ends e JOIN ends l ON l.cube = e.cube AND l.corner = e.corner JOIN (SELECT DISTINCT seg FROM nodes WHERE locked) k ON k.seg = l.sheet) t
      ON t.sheet = CAST(floor(f.h / 2) AS BIGINT) WHERE cycle GROUP BY face HAVING count(t.sheet) = 0) g GROUP BY b""",
    "faces", rounded="min_x max_x min_z max_z", digits=5), rounded="min_x max_x min_z max_z", digits=5)
def reconstruct(t):
    built = B.reconstruct(cube_sided(t), cube(t), found(t), oriented(t))
    cube_no = F.expr("(face DIV 2 - 1) DIV 12")
    ends = [F.least("ax", "bx", "cx"), F.greatest("ax", "bx", "cx"), F.least("az", "bz", "cz"), F.greatest("az", "bz", "cz")]
    return built.withColumn("b", cube_no).groupBy("b").agg(
        F.count("*").alias("triangles"), F.min(ends[0]).alias("min_x"), F.max(ends[1]).alias("max_x"), F.min(ends[2]).alias("min_z"), F.max(ends[3]).alias("max_z")
    )


TRIANGLE_COLS = " ".join(f"{p}{a}" for p in "abcn" for a in "xyz")


TRIANGLES_SQL = sql(
    """SELECT a.face, CAST(b.pos - 1 AS BIGINT) AS tri, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz, p.nx, p.ny, p.nz
     FROM corners a JOIN corners b ON b.face = a.face AND b.pos >= 1 JOIN corners c ON c.face = a.face AND c.pos = b.pos + 1 JOIN planes p ON p.face = a.face
     WHERE a.pos = 0 AND a.face IN (SELECT face FROM corners GROUP BY face HAVING count(*) = max(size))""",
    "cube_in", "cube_links", extra={**CORNERS, **PLANES}, rounded=TRIANGLE_COLS, digits=5)


@query("reconstruct_triangles", TRIANGLES_SQL, rounded=TRIANGLE_COLS, digits=5)
def reconstruct_triangles(t):
    return B.reconstruct(cube_sided(t), cube(t), found(t), oriented(t)).select("face", "tri", *(f"{p}{a}" for p in ("a", "b", "c", "n") for a in "xyz"))


def cube_job(t, **options):
    """The whole path over both sides of the cubes, with the sheets they are made of."""
    wide = cube(t)
    labels = wide.select(F.col("s_id").alias("ma_id"), F.col("sheet").alias("seg"))
    return run_path(t.spark, wide, A.stack_sides(wide), new_path(t.spark, "whole"), labels=labels, links=cube_links(t), **options)


@query("whole_path", TRIANGLES_SQL, rounded=TRIANGLE_COLS, digits=5)
def whole_path(t):
    """From balls of both sides to triangles in one job of resumable steps."""
    return cube_job(t).table("triangles").select("face", "tri", *(f"{p}{a}" for p in ("a", "b", "c", "n") for a in "xyz"))


@query("whole_path_surface", TRIANGLES_SQL, rounded=TRIANGLE_COLS, digits=5)
def whole_path_surface(t):
    """The same with interior balls only and links matched by surface; no two sides of a cube are coplanar twice."""
    job = cube_job(t, only_interior=True, variant="surface")
    return job.table("triangles").select("face", "tri", *(f"{p}{a}" for p in ("a", "b", "c", "n") for a in "xyz"))


# On the ridge cloud the ridge of a sheet is the line x = x0, z = 10, over the extent of its balls.
@query("wedge", sql(
    "SELECT sheet AS seg, CAST(20*b AS DOUBLE) AS x0, CAST(10 AS DOUBLE) AS z0, max(y1) - min(y1) AS length FROM (SELECT sheet, b, ciy AS y1 FROM ridge) r GROUP BY sheet, b", "ridge", rounded="x0:4 z0:4 length:4"), rounded="x0:4 z0:4 length:4")
def wedge(t):
    sided = t.share("sided", lambda: spoke_sides(t.ridge_in(), t.ridge_labels()))
    tetra = B.wedge(sided, t.ridge())
    length = F.sqrt((F.col("v1x") - F.col("v0x")) ** 2 + (F.col("v1y") - F.col("v0y")) ** 2 + (F.col("v1z") - F.col("v0z")) ** 2)
    return tetra.select("seg", F.col("v0x").alias("x0"), F.col("v0z").alias("z0"), length.alias("length"))


# Upper edges of a cube: 0 and 1 run along x at y = +-5, 4 and 6 along y at x = +-5.
@query("flat_box", sql(
    """SELECT b AS match, CAST(10 AS BIGINT) AS triangles, CAST(10 AS BIGINT) AS true_normals, CAST(b*30 - 5 AS DOUBLE) AS min_x, CAST(b*30 + 5 AS DOUBLE) AS max_x, CAST(-5 AS DOUBLE) AS min_y, CAST(5 AS DOUBLE) AS max_y, CAST(5 AS DOUBLE) AS max_z, min(pz) AS min_z
     FROM cube WHERE (sheet - 1) % 12 IN (0, 1, 4, 6) GROUP BY b""", "cube", rounded="min_x:4 max_x:4 min_y:4 max_y:4 max_z:4 min_z:4"), rounded="min_x:4 max_x:4 min_y:4 max_y:4 max_z:4 min_z:4")
def flat_box(t):
    """The four upper edges of each cube, in a ring, are a flat-roof pattern."""
    ring = cube(t).select("b").distinct().select(F.col("b").alias("match"), *((1 + 12 * F.col("b") + e).alias(f"v{i}") for i, e in enumerate((0, 4, 1, 6))))
    built = B.flat_box(ring, cube_sided(t), cube(t))
    normal = (Vec.of("b") - Vec.of("a")).cross(Vec.of("c") - Vec.of("a")).unit()
    parallel = F.abs(normal.dot(Vec.of("n").unit())) > 1 - 1e-6
    spans = [(F.min(F.least(f"a{x}", f"b{x}", f"c{x}")).alias(f"min_{x}"), F.max(F.greatest(f"a{x}", f"b{x}", f"c{x}")).alias(f"max_{x}")) for x in "xyz"]
    return built.groupBy("match").agg(F.count("*").alias("triangles"), F.count_if(parallel).alias("true_normals"), *(c for pair in spans for c in pair))
