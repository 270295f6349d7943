"""Queries on the grid mesh and on points against it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.catalog.base import query, sql
from ridgeline.operators import tin as M

CORNER = {
    "tri": "SELECT f_id, v0, v1, v2, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM tin_face JOIN tin_vertex a ON a.v_id = v0 JOIN tin_vertex b ON b.v_id = v1 JOIN tin_vertex c ON c.v_id = v2",
}
SIDES = {"sides": "SELECT f_id, least(v0,v1) AS a, greatest(v0,v1) AS b FROM tin_face UNION ALL SELECT f_id, least(v1,v2), greatest(v1,v2) FROM tin_face UNION ALL SELECT f_id, least(v2,v0), greatest(v2,v0) FROM tin_face"}
# Points over the mesh: face centroids pushed up or down by a third of a unit per part size class.
PROBES = "SELECT p_partkey AS id, (p_partkey * 37 % 1900) / CAST(100 AS DOUBLE) AS x, (p_partkey * 53 % (5 * (SELECT count(*) FROM part))) / CAST(100 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) + (p_partkey % 7 - 3) / CAST(4 AS DOUBLE) AS z FROM part"


def probes(t):
    return t.adapter(PROBES, "part")


def tin_sql(body: str, extra=None, **kw) -> str:
    return sql(body, "tin_vertex", "tin_face", extra=extra, **kw)


@query("tin_edges", tin_sql("SELECT a, b, min(f_id) AS f1, CASE WHEN count(*) > 1 THEN max(f_id) END AS f2 FROM sides GROUP BY a, b", SIDES))
def tin_edges(t):
    return M.edges(t.tin_face())


@query("big_faces_edge", tin_sql(
    "SELECT f_id FROM tri WHERE greatest((ax-bx)^2+(ay-by_)^2+(az-bz)^2, (bx-cx)^2+(by_-cy)^2+(bz-cz)^2, (cx-ax)^2+(cy-ay)^2+(cz-az)^2) > 900", CORNER))
def big_faces_edge(t):
    return M.big_faces(t.tin_face(), t.tin_vertex(), max_sq_edge=900)


@query("big_faces_area", tin_sql("SELECT f_id FROM tri WHERE (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) > 0.5", CORNER))
def big_faces_area(t):
    return M.big_faces(t.tin_face(), t.tin_vertex(), max_double_area=0.5)


def contour_ctes(tolerance: str, condition: str) -> dict[str, str]:
    signs = ", ".join(f"CASE WHEN {c}z < iso - {tolerance} THEN -1 WHEN {c}z > iso + {tolerance} THEN 1 ELSE 0 END AS s{c}" for c in "abc")
    points = []
    for c, y in (("a", "ay"), ("b", "by_"), ("c", "cy")):
        points.append(f"SELECT f_id, iso, {c}x AS x, {y} AS y, 1 AS on_it FROM signed WHERE s{c} = 0 AND NOT (sa = sb AND sb = sc)")
    for (m, my), (n, ny) in ((("a", "ay"), ("b", "by_")), (("b", "by_"), ("c", "cy")), (("c", "cy"), ("a", "ay"))):
        share = f"((iso-{m}z)/({n}z-{m}z))"
        points.append(f"SELECT f_id, iso, (1-{share})*{m}x + {share}*{n}x, (1-{share})*{my} + {share}*{ny}, 0 FROM signed WHERE s{m} * s{n} = -1")
    return {
        **CORNER,
        "signed": f"SELECT *, {signs} FROM tri, (SELECT unnest([10.0, 20.5, 33.25]::DOUBLE[]) AS iso) i WHERE {condition}",
        "hits": " UNION ALL ".join(points),
        "segments": "SELECT f_id, iso, min(struct_pack(x := x, y := y)) AS p, max(struct_pack(x := x, y := y)) AS q, sum(on_it) AS on_it FROM hits GROUP BY f_id, iso HAVING count(*) = 2",
    }


ENDS = "iso, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2"
ISOS = [10.0, 20.5, 33.25]


@query("contours", tin_sql(f"SELECT {ENDS} FROM segments WHERE on_it < 2 UNION ALL SELECT DISTINCT {ENDS} FROM segments WHERE on_it = 2", contour_ctes("1e-7", "true"), rounded="x1 y1 x2 y2"), rounded="x1 y1 x2 y2")
def contours(t):
    return M.contours(t.tin_face(), t.tin_vertex(), ISOS)


SMALL = "greatest((ax-bx)^2+(ay-by_)^2+(az-bz)^2, (bx-cx)^2+(by_-cy)^2+(bz-cz)^2, (cx-ax)^2+(cy-ay)^2+(cz-az)^2) <= 900"


@query("contours_small_faces", tin_sql(f"SELECT {ENDS} FROM segments", contour_ctes("0", SMALL), rounded="x1 y1 x2 y2"), rounded="x1 y1 x2 y2")
def contours_small_faces(t):
    face, vertex = t.tin_face(), t.tin_vertex()
    return M.contours(face, vertex, ISOS, skip=M.big_faces(face, vertex, max_sq_edge=900))


LAPLACE = {
    **CORNER, **SIDES,
    "centred": "SELECT f_id, ax + ((cy-ay)*((bx-ax)^2+(by_-ay)^2) - (by_-ay)*((cx-ax)^2+(cy-ay)^2)) / d AS ox, ay + ((bx-ax)*((cx-ax)^2+(cy-ay)^2) - (cx-ax)*((bx-ax)^2+(by_-ay)^2)) / d AS oy FROM (SELECT *, nullif(2*((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax)), 0) AS d FROM tri) t",
    "edge_pairs": "SELECT a, b, count(*) AS faces, min(f_id) AS f1, max(f_id) AS f2 FROM sides GROUP BY a, b",
    "weighted": "SELECT e.a, e.b, e.faces, sqrt((m.ox-n.ox)^2+(m.oy-n.oy)^2)/sqrt((p.x-q.x)^2+(p.y-q.y)^2) AS w, p.z AS za, q.z AS zb FROM edge_pairs e JOIN centred m ON m.f_id = e.f1 JOIN centred n ON n.f_id = e.f2 JOIN tin_vertex p ON p.v_id = e.a JOIN tin_vertex q ON q.v_id = e.b",
    "laplace": "SELECT v_id, sum(w*z)/sum(w) AS z_hat FROM (SELECT a AS v_id, faces, w, zb AS z FROM weighted UNION ALL SELECT b, faces, w, za FROM weighted) r GROUP BY v_id HAVING min(faces) = 2",
}


@query("laplace_z", tin_sql("SELECT v_id, z_hat FROM laplace", LAPLACE, rounded="z_hat"), rounded="z_hat")
def laplace_z(t):
    return M.laplace_z(t.tin_vertex(), t.tin_face())


@query("vertex_error", tin_sql("SELECT v.v_id, z - z_hat AS error FROM tin_vertex v JOIN laplace l ON l.v_id = v.v_id", LAPLACE, rounded="error"), rounded="error")
def vertex_error(t):
    return M.vertex_error(t.tin_vertex(), t.tin_face())


@query("smooth_up", tin_sql("SELECT v.v_id, x, y, greatest(z, z_hat) AS z FROM tin_vertex v LEFT JOIN laplace l ON l.v_id = v.v_id", LAPLACE, rounded="z"), rounded="z")
def smooth_up(t):
    return M.smooth(t.tin_vertex().drop("flag"), t.tin_face())


@query("smooth_both_ways", tin_sql("SELECT v.v_id, x, y, coalesce(z_hat, z) AS z FROM tin_vertex v LEFT JOIN laplace l ON l.v_id = v.v_id", LAPLACE, rounded="z"), rounded="z")
def smooth_both_ways(t):
    return M.smooth(t.tin_vertex().drop("flag"), t.tin_face(), up_only=False)


CANDIDATES = """SELECT s.v_id, s.error FROM small s WHERE NOT EXISTS (SELECT 1 FROM (SELECT a AS v, b AS o FROM edge_pairs UNION ALL SELECT b, a FROM edge_pairs) n
 JOIN small t ON t.v_id = n.o WHERE n.v = s.v_id AND (abs(t.error) < abs(s.error) OR (abs(t.error) = abs(s.error) AND t.v_id < s.v_id)))"""


def _small(condition: str) -> dict[str, str]:
    return {**LAPLACE, "small": f"SELECT v.v_id, z - z_hat AS error FROM tin_vertex v JOIN laplace l ON l.v_id = v.v_id WHERE {condition}"}


@query("simplify_candidates", tin_sql(CANDIDATES, _small("abs(z - z_hat) < 6 AND z - z_hat < -1e-5"), rounded="error"), rounded="error")
def simplify_candidates(t):
    return M.simplify_candidates(t.tin_vertex(), t.tin_face(), threshold=6)


@query("simplify_candidates_both", tin_sql(CANDIDATES, _small("abs(z - z_hat) < 6"), rounded="error"), rounded="error")
def simplify_candidates_both(t):
    return M.simplify_candidates(t.tin_vertex(), t.tin_face(), threshold=6, up_only=False)


def side(p: str, q: str) -> str:
    cols = {"a": ("ax", "ay"), "b": ("bx", "by_"), "c": ("cx", "cy")}
    (px, py), (qx, qy) = cols[p], cols[q]
    return f"({qx}-{px})*(p.y-{py})-({qy}-{py})*(p.x-{px})"


LOCATE = {
    **CORNER, "probes": PROBES,
    "hits": f"SELECT p.id, f_id, az - (((by_-ay)*(cz-az)-(bz-az)*(cy-ay))*(p.x-ax) + ((bz-az)*(cx-ax)-(bx-ax)*(cz-az))*(p.y-ay)) / ((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax)) AS z_hat, row_number() OVER (PARTITION BY p.id ORDER BY f_id) AS n FROM probes p JOIN tri ON p.x BETWEEN least(ax,bx,cx) AND greatest(ax,bx,cx) AND p.y BETWEEN least(ay,by_,cy) AND greatest(ay,by_,cy) AND least({side('a','b')}, {side('b','c')}, {side('c','a')}) >= 0",
    "located": "SELECT p.id, f_id, z_hat FROM probes p LEFT JOIN (SELECT * FROM hits WHERE n = 1) h ON h.id = p.id",
    "errors": "SELECT p.id, p.x, p.y, p.z, p.z - z_hat AS error FROM probes p JOIN located l ON l.id = p.id",
}


@query("locate_on_mesh", tin_sql("SELECT id, f_id, z_hat FROM located", LOCATE, rounded="z_hat"), rounded="z_hat")
def locate_on_mesh(t):
    return M.locate_on_mesh(probes(t), t.tin_face(), t.tin_vertex())


@query("vertical_error", tin_sql("SELECT id, error FROM errors", LOCATE, rounded="error"), rounded="error")
def vertical_error(t):
    return M.vertical_error(probes(t), t.tin_face(), t.tin_vertex())


@query("metric_safety", tin_sql("SELECT coalesce(error > 1e-5, false) AS unsafe, count(*) AS points FROM errors GROUP BY 1", LOCATE))
def metric_safety(t):
    return M.metric_safety(probes(t), t.tin_face(), t.tin_vertex()).groupBy("unsafe").agg(F.count("*").alias("points"))


@query("diff_table", tin_sql("SELECT id, round(x,2) AS x, round(y,2) AS y, round(z,2) AS z, round(CASE WHEN abs(error) < 1e-5 THEN 0 ELSE error + 1e-9 END, 2) + 0.0 AS d FROM errors", LOCATE))
def diff_table(t):
    # errors are multiples of 1/400 here; the nudge keeps halves from rounding either way
    found = M.diff_table(probes(t).withColumn("z", F.col("z") + 1e-9), t.tin_face(), t.tin_vertex())
    return found.withColumn("d", F.col("d") + 0.0)


@query("densify", tin_sql(
    "SELECT c.f_id, ox AS x, oy AS y, z FROM centred c LEFT JOIN (SELECT f_id, avg(z) AS z FROM (SELECT f_id, CASE WHEN f_id % 2 = 0 THEN (bz + cz) / 2 ELSE (az + cz) / 2 END AS z FROM tri) q GROUP BY f_id) h ON h.f_id = c.f_id",
    LAPLACE, rounded="x y z"), rounded="x y z")
def densify(t):
    return M.densify(t.tin_vertex(), t.tin_face())


# --- distance to a mesh -----------------------------------------------------------------

def clamped(p: str, q: str) -> str:
    c = {"a": ("ax", "ay", "az"), "b": ("bx", "by_", "bz"), "c": ("cx", "cy", "cz")}
    (px, py, pz), (qx, qy, qz) = c[p], c[q]
    share = f"greatest(0.0, least(1.0, ((p.x-{px})*({qx}-{px})+(p.y-{py})*({qy}-{py})+(p.z-{pz})*({qz}-{pz}))/(({qx}-{px})^2+({qy}-{py})^2+({qz}-{pz})^2)))"
    return f"(p.x-{px}-{share}*({qx}-{px}))^2+(p.y-{py}-{share}*({qy}-{py}))^2+(p.z-{pz}-{share}*({qz}-{pz}))^2"


NEAREST = {
    **CORNER, "probes": PROBES,
    "spanned": "SELECT *, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS nz FROM tri",
    "feet": f"""SELECT p.id, f_id, least({clamped('a','b')}, {clamped('b','c')}, {clamped('c','a')}) AS border2, ax,ay,az,bx,by_,bz,cx,cy,cz,nx,ny,nz, nx*nx+ny*ny+nz*nz AS n2, p.x AS px, p.y AS py, p.z AS pz,
       ((p.x-ax)*nx+(p.y-ay)*ny+(p.z-az)*nz) AS h FROM probes p, spanned""",
    "inside": """SELECT id, f_id, border2, h*h/n2 AS plane2, px-h/n2*nx AS fx, py-h/n2*ny AS fy, pz-h/n2*nz AS fz, ax,ay,az,bx,by_,bz,cx,cy,cz,nx,ny,nz FROM feet""",
    "best": """SELECT id, min(CASE WHEN
       nx*((by_-ay)*(fz-az)-(bz-az)*(fy-ay)) + ny*((bz-az)*(fx-ax)-(bx-ax)*(fz-az)) + nz*((bx-ax)*(fy-ay)-(by_-ay)*(fx-ax)) >= 0 AND
       nx*((cy-by_)*(fz-bz)-(cz-bz)*(fy-by_)) + ny*((cz-bz)*(fx-bx)-(cx-bx)*(fz-bz)) + nz*((cx-bx)*(fy-by_)-(cy-by_)*(fx-bx)) >= 0 AND
       nx*((ay-cy)*(fz-cz)-(az-cz)*(fy-cy)) + ny*((az-cz)*(fx-cx)-(ax-cx)*(fz-cz)) + nz*((ax-cx)*(fy-cy)-(ay-cy)*(fx-cx)) >= 0 THEN plane2 ELSE border2 END) AS d2 FROM inside GROUP BY id""",
}


def nearest(t):
    return t.share("nearest_probe", lambda: M.nearest_on_mesh(probes(t), t.tin_face(), t.tin_vertex()))


@query("nearest_on_mesh", tin_sql("SELECT id, d2 FROM best", NEAREST, rounded="d2"), rounded="d2")
def nearest_on_mesh(t):
    return nearest(t).select("id", "d2")


@query("rms_to_mesh", tin_sql("SELECT count(*) AS n, sqrt(avg(d2)) AS rms FROM best", NEAREST, rounded="rms"), rounded="rms")
def rms_to_mesh(t):
    return M.rms_to_mesh(probes(t), t.tin_face(), t.tin_vertex())


FLAT = {**NEAREST, "probes": "SELECT v_id AS id, x, y, z + 1 AS z FROM tin_vertex"}


@query("metric_l2", tin_sql("SELECT count(*) AS n, min(d2) AS lowest, max(d2) AS highest FROM best", FLAT, rounded="lowest highest"), rounded="lowest highest")
def metric_l2(t):
    lifted = t.tin_vertex().withColumn("z", F.col("z") + 1)
    return M.metric_l2(lifted, t.tin_face(), t.tin_vertex()).agg(F.count("*").alias("n"), F.min("d2").alias("lowest"), F.max("d2").alias("highest"))


KEPT = {**NEAREST, "tri": CORNER["tri"].replace("SELECT f_id", "SELECT f_id") + " WHERE v0 % 9 <> 4 AND v1 % 9 <> 4 AND v2 % 9 <> 4", "probes": "SELECT v_id AS id, x, y, z FROM tin_vertex"}


@query("simplification_error", tin_sql("SELECT count(*) AS n, sqrt(avg(d2)) AS rms FROM best", KEPT, rounded="rms"), rounded="rms")
def simplification_error(t):
    vertex = t.tin_vertex()
    mask = vertex.select("v_id", (F.col("v_id") % 9 != 4).alias("flag"))
    return M.simplification_error(vertex.select(F.col("v_id").alias("id"), "x", "y", "z"), t.tin_face(), vertex, mask)
