"""Queries on ball derivation, masks, neighbours and point-table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ridgeline.catalog.base import query, sql
from ridgeline.functions.vec import Vec
from ridgeline.operators import atoms as A
from ridgeline.operators.nearest import knn

XYZ = "xyz"


def v3(prefix: str) -> str:
    return " ".join(f"{prefix}{a}" for a in XYZ)


def c3(*prefixes: str) -> str:
    return ", ".join(f"{p}{a}" for p in prefixes for a in XYZ)


@query("center_on_mean", sql(
    f"SELECT s_id, {', '.join(f'p{a} - m{a} AS p{a}, ci{a} - m{a} AS ci{a}, co{a} - m{a} AS co{a}' for a in XYZ)} FROM emb, (SELECT avg(px) AS mx, avg(py) AS my, avg(pz) AS mz FROM emb) m",
    "emb", rounded=f"{v3('p')} {v3('ci')} {v3('co')}"), rounded=f"{v3('p')} {v3('ci')} {v3('co')}")
def center_on_mean(t):
    wide = t.emb()
    surface, mat = A.center_on_mean(wide.select("s_id", "px", "py", "pz"), A.stack_sides(wide))
    sides = mat.groupBy("s_id").agg(*(F.max(F.when(F.col("side") == s, F.col(f"c{a}"))).alias(f"c{s[0]}{a}") for s in ("in", "out") for a in XYZ))
    return surface.join(sides, "s_id")


@query("ball_radius", sql("SELECT ma_id, s_id, side, r FROM ridge_atoms", "ridge_atoms", rounded="r"), rounded="r")
def ball_radius(t):
    return t.ridge_atoms().select("ma_id", "s_id", "side", "r")


@query("spokes", sql(f"SELECT ma_id, {c3('f1', 'f2')} FROM emb_atoms", "emb_atoms", rounded=f"{v3('f1')} {v3('f2')}"), rounded=f"{v3('f1')} {v3('f2')}")
def spokes(t):
    return t.emb_atoms().select("ma_id", *(f"{p}{a}" for p in ("f1", "f2") for a in XYZ))


@query("bisector", sql("SELECT ma_id, bx, by, bz FROM emb_atoms", "emb_atoms", rounded=v3("b")), rounded=v3("b"))
def bisector(t):
    return t.emb_atoms().select("ma_id", "bx", "by", "bz")


@query("separation_angle", sql("SELECT ma_id, theta FROM ridge_atoms", "ridge_atoms", rounded="theta:4"), rounded="theta:4")
def separation_angle(t):
    return t.ridge_atoms().select("ma_id", "theta")


@query("stack_atoms", sql(f"SELECT ma_id, s_id, side, q_id, {c3('c')} FROM emb_atoms", "emb_atoms", rounded=v3("c")), rounded=v3("c"))
def stack_atoms(t):
    return t.emb_atoms().select("ma_id", "s_id", "side", "q_id", "cx", "cy", "cz")


@query("feature_points", sql(f"SELECT ma_id, {c3('p', 'q')} FROM emb_atoms", "emb_atoms", rounded=f"{v3('p')} {v3('q')}"), rounded=f"{v3('p')} {v3('q')}")
def feature_points(t):
    return t.emb_atoms().select("ma_id", *(f"{p}{a}" for p in ("p", "q") for a in XYZ))


@query("spoke_cross", sql(
    f"SELECT ma_id, {c3('k')}, nx/nl AS nx, ny/nl AS ny, nz/nl AS nz FROM (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS nl FROM (SELECT *, ky*bz-kz*by AS nx, kz*bx-kx*bz AS ny, kx*by-ky*bx AS nz FROM emb_atoms) a) b",
    "emb_atoms", rounded=f"{v3('k')} {v3('n')}"), rounded=f"{v3('k')} {v3('n')}")
def spoke_cross(t):
    return t.emb_atoms().select("ma_id", *(f"{p}{a}" for p in ("k", "n") for a in XYZ))


@query("spoke_count", sql(
    "SELECT e.s_id, coalesce(n, 0) AS spoke_cnt FROM emb e LEFT JOIN (SELECT q_id, count(*) AS n FROM emb_atoms GROUP BY q_id) c ON c.q_id = e.s_id", "emb", "emb_atoms"))
def spoke_count(t):
    return A.spoke_count(t.emb_atoms(), t.emb())


@query("bisector_spread", sql(
    "SELECT u AS ma_id, max(acos(greatest(-1.0, least(1.0, a.bx*b.bx+a.by*b.by+a.bz*b.bz)))) AS bisec_diff FROM emb_knn JOIN emb_atoms a ON a.ma_id = u JOIN emb_atoms b ON b.ma_id = v WHERE rank <= 4 GROUP BY u",
    "emb_knn", rounded="bisec_diff:4"), rounded="bisec_diff:4")
def bisector_spread(t):
    return A.bisector_spread(t.emb_atoms(), t.emb_knn())


# --- masks and id spaces ------------------------------------------------------

@query("mask_atoms", sql(
    "SELECT ma_id, r FROM emb_atoms WHERE r < 6 AND s_id IN (SELECT s_id FROM emb WHERE pz > 0)", "emb", "emb_atoms", rounded="r"), rounded="r")
def mask_atoms(t):
    atoms, surface = t.emb_atoms(), t.emb()
    masks = [(surface.where("pz > 0").select("s_id"), "s"), None, (atoms.where("r < 6").select("ma_id"), "ma")]
    return A.apply_masks(atoms.select("ma_id", "s_id", "r"), *masks, atoms=atoms).select("ma_id", "r")


@query("mask_surface", sql(
    "SELECT s_id, pz FROM emb WHERE pz > 0 AND s_id IN (SELECT s_id FROM emb_atoms WHERE r < 2 UNION SELECT q_id FROM emb_atoms WHERE r < 2)", "emb", "emb_atoms", rounded="pz"), rounded="pz")
def mask_surface(t):
    atoms, surface = t.emb_atoms(), t.emb()
    masks = [(atoms.where("r < 2").select("ma_id"), "ma"), (surface.where("pz > 0").select("s_id"), "s")]
    return A.apply_masks(surface.select("s_id", "pz"), *masks, atoms=atoms)


@query("surface_to_atoms", sql("SELECT ma_id FROM emb_atoms WHERE s_id IN (SELECT s_id FROM emb WHERE label = 3)", "emb", "emb_atoms"))
def surface_to_atoms(t):
    return A.to_atoms(t.emb().where("label = 3").select("s_id"), t.emb_atoms())


@query("atoms_to_surface", sql("SELECT s_id FROM emb_atoms WHERE seg = 3 UNION SELECT q_id FROM emb_atoms WHERE seg = 3", "emb_atoms"))
def atoms_to_surface(t):
    return A.to_surface(t.emb_atoms().join(t.emb_labels().where("seg = 3"), "ma_id", "left_semi"))


@query("atoms_to_spokes", sql("SELECT ma_id, 1 AS spoke, s_id FROM emb_atoms UNION ALL SELECT ma_id, 2, q_id FROM emb_atoms", "emb_atoms"))
def atoms_to_spokes(t):
    return A.to_surface(t.emb_atoms(), distinct=False)


@query("masked_points", sql("SELECT v_id, x, y, z FROM tin_vertex WHERE flag", "tin_vertex"))
def masked_points(t):
    vertex = t.tin_vertex()
    return A.masked(vertex.select("v_id", "x", "y", "z"), vertex.select("v_id", "flag"), "v_id")


# --- point-table jobs ---------------------------------------------------------

@query("class_filter", sql("SELECT s_id, px, py, pz FROM emb WHERE label = 2", "emb", rounded=v3("p")), rounded=v3("p"))
def class_filter(t):
    return A.filter_class(t.emb(), 2, "label").select("s_id", "px", "py", "pz")


OFFSET = "SELECT " + ", ".join(f"min(p{a}) + (max(p{a}) - min(p{a})) / 2 AS off{a}" for a in XYZ) + " FROM emb"


@query("center_on_bbox", sql(f"SELECT s_id, {', '.join(f'p{a} - off{a} AS p{a}' for a in XYZ)} FROM emb, off", "emb", extra={"off": OFFSET}, rounded=v3("p")), rounded=v3("p"))
def center_on_bbox(t):
    return A.center_on_bbox(t.emb())[0].select("s_id", "px", "py", "pz")


@query("quantise", sql(
    "SELECT s_id, " + ", ".join(f"CAST(trunc((p{a} - off{a})*100) AS BIGINT) + CAST(trunc(off{a}*100) AS BIGINT) AS p{a}_q" for a in XYZ) + " FROM emb, off",
    "emb", extra={"off": OFFSET}))
def quantise(t):
    centred, offset = A.center_on_bbox(t.emb())
    return A.quantise(centred, offset).select("s_id", "px_q", "py_q", "pz_q")


@query("select_keys", sql("SELECT s_id, nx, nz FROM emb", "emb", rounded="nx nz"), rounded="nx nz")
def select_keys(t):
    return t.emb().select("s_id", "nx", "nz")


@query("extents", sql("SELECT " + ", ".join(f"min(p{a}) AS lo{a}, max(p{a}) AS hi{a}" for a in XYZ) + " FROM emb", "emb", rounded=f"{v3('lo')} {v3('hi')}"), rounded=f"{v3('lo')} {v3('hi')}")
def extents(t):
    return A.bbox(t.emb(), "p")


# --- neighbours -----------------------------------------------------------------

@query("knn_atoms", sql("SELECT u, v, rank, d2 FROM emb_knn WHERE rank <= 9", "emb_knn", rounded="d2"), rounded="d2")
def knn_atoms(t):
    return t.emb_knn().where("rank <= 9").select("u", "v", F.col("rank").cast("bigint").alias("rank"), "d2")


@query("knn_ridge", sql("SELECT u, v, rank, d2 FROM ridge_knn", "ridge_knn", rounded="d2"), rounded="d2")
def knn_ridge(t):
    return t.ridge_knn().select("u", "v", F.col("rank").cast("bigint").alias("rank"), "d2")


CROSS = """SELECT u, v, rank, d2 FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY d2, v) AS rank FROM (
 SELECT s.s_id AS u, a.ma_id AS v, (s.px-a.cx)*(s.px-a.cx)+(s.py-a.cy)*(s.py-a.cy)+(s.pz-a.cz)*(s.pz-a.cz) AS d2 FROM emb s, emb_atoms a) d) r WHERE rank <= 10"""


@query("knn_surface_atoms", sql(CROSS, "emb", "emb_atoms", rounded="d2"), rounded="d2")
def knn_surface_atoms(t):
    near = t.share("cross_knn", lambda: knn(t.emb(), 10, key="s_id", prefix="p", points=t.emb_atoms()))
    return near.select("u", "v", F.col("rank").cast("bigint").alias("rank"), "d2")


@query("nearest_three_balls", sql("SELECT u, v, rank FROM ridge_knn WHERE rank <= 3", "ridge_knn"))
def nearest_three_balls(t):
    w = Window.partitionBy("u").orderBy("d2", "v")
    top = t.ridge_knn().withColumn("n", F.row_number().over(w)).where("n <= 3")
    return top.select("u", "v", F.col("n").cast("bigint").alias("rank"))


@query("id_sets", sql("""
 SELECT 'union' AS op, s_id FROM (SELECT s_id FROM emb WHERE px > 0 UNION SELECT s_id FROM emb WHERE py > 0) a
 UNION ALL SELECT 'difference', s_id FROM emb WHERE px > 0 AND NOT py > 0
 UNION ALL SELECT 'intersection', s_id FROM emb WHERE px > 0 AND py > 0""", "emb"))
def id_sets(t):
    a, b = t.emb().where("px > 0").select("s_id"), t.emb().where("py > 0").select("s_id")
    parts = {"union": a.union(b).distinct(), "difference": a.join(b, "s_id", "left_anti"), "intersection": a.join(b, "s_id", "left_semi")}
    out = None
    for op, ids in parts.items():
        rows = ids.select(F.lit(op).alias("op"), "s_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("scatter_matrix", sql(
    "SELECT label, count(*) AS n, avg(px) AS mx, avg(py) AS my, avg(pz) AS mz, " + ", ".join(
        f"sum((p{a}-g{a})*(p{b}-g{b})) AS s{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) +
    " FROM (SELECT *, avg(px) OVER w AS gx, avg(py) OVER w AS gy, avg(pz) OVER w AS gz FROM emb WINDOW w AS (PARTITION BY label)) e GROUP BY label",
    "emb", rounded="mx my mz sxx:4 sxy:4 sxz:4 syy:4 syz:4 szz:4"), rounded="mx my mz sxx:4 sxy:4 sxz:4 syy:4 syz:4 szz:4")
def scatter_matrix(t):
    from ridgeline.operators.fitting import moments
    return moments(t.emb(), ["label"])


@query("local_feature_size", sql("SELECT u AS s_id, median(sqrt(d2)) AS lfs FROM cross_knn GROUP BY u", "emb", "emb_atoms", extra={"cross_knn": CROSS}, rounded="lfs"), rounded="lfs")
def local_feature_size(t):
    from ridgeline.operators.thinning import local_feature_size as lfs
    return lfs(t.emb(), t.emb_atoms())
