"""Queries on segments, growth, the sheet graph, clusters and sheet analysis."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ridgeline.catalog.atoms import v3
from ridgeline.catalog.base import query, sql
from ridgeline.operators import analysis as N
from ridgeline.operators import clusters as C
from ridgeline.operators import fitting as P
from ridgeline.operators import growth as G
from ridgeline.operators import relations as R
from ridgeline.operators import thinning as T
from ridgeline.operators.components import components

COS = {d: repr(math.cos(math.radians(d))) for d in (2, 5, 10, 60)}
RAD = {d: repr(math.radians(d)) for d in (5, 10, 15, 40, 60, 120, 175)}

EDGES = {
    # neighbour edges with both ends' measures
    "emb_pairs": """SELECT e.u, e.v, e.rank, a.seg AS su, b.seg AS sv, a.theta AS tu, b.theta AS tv, a.r AS ru, b.r AS rv, e.d2,
      a.bx*b.bx+a.by*b.by+a.bz*b.bz AS bb,
      (a.kx*b.kx+a.ky*b.ky+a.kz*b.kz)/(sqrt(a.kx*a.kx+a.ky*a.ky+a.kz*a.kz)*sqrt(b.kx*b.kx+b.ky*b.ky+b.kz*b.kz)) AS kk,
      a.ky*a.bz-a.kz*a.by AS nxu, a.kz*a.bx-a.kx*a.bz AS nyu, a.kx*a.by-a.ky*a.bx AS nzu,
      b.ky*b.bz-b.kz*b.by AS nxv, b.kz*b.bx-b.kx*b.bz AS nyv, b.kx*b.by-b.ky*b.bx AS nzv
      FROM emb_knn e JOIN emb_atoms a ON a.ma_id = e.u JOIN emb_atoms b ON b.ma_id = e.v""",
}


def edge_sql(condition: str, k: int = 10) -> str:
    return sql(f"SELECT u, v FROM emb_pairs WHERE rank < {k} AND {condition}", "emb_knn", extra=EDGES)


predicate_specs = {
    "edges_bisector": (f"bb > {COS[60]}", lambda: G.similar_bisector(60)),
    "edges_theta": (f"abs(tu - tv) < {RAD[10]}", lambda: G.similar_theta(10)),
    "edges_bisector_theta": (f"bb > {COS[60]} AND abs(tu - tv) < {RAD[40]}", lambda: G.all_of(G.similar_bisector(60), G.similar_theta(40))),
    "edges_ball_overlap": ("(d2 = 0 OR (ru + rv) / sqrt(d2) > 2.0)", lambda: G.ball_overlap(2.0)),
    "edges_spokecross": (f"kk > {COS[60]}", lambda: G.similar_spokecross(60)),
    "edges_normal": (
        f"abs(nxu*nxv+nyu*nyv+nzu*nzv) / (sqrt(nxu*nxu+nyu*nyu+nzu*nzu)*sqrt(nxv*nxv+nyv*nyv+nzv*nzv)) > {COS[5]}", lambda: G.similar_normal(5)),
    "edges_user_predicate": ("(ru < rv AND su = sv)", lambda: (lambda u, v: (u("r") < v("r")) & (u("seg") == v("seg")))),
}


def _register_predicates():
    def bind(name, condition, make):
        @query(name, edge_sql(condition))
        def run(t):
            atoms = t.emb_atoms()
            if name == "edges_user_predicate":
                atoms = atoms.join(t.emb_labels(), "ma_id")
            return G.candidate_edges(atoms, t.emb_knn(), make())

    for name, (condition, make) in predicate_specs.items():
        bind(name, condition, make)


_register_predicates()

SPREAD = "SELECT u, max(acos(greatest(-1.0, least(1.0, bb)))) AS diff FROM emb_pairs WHERE rank <= 4 GROUP BY u"


@query("edges_bisector_spread", sql(
    f"SELECT p.u, p.v FROM emb_pairs p JOIN spread a ON a.u = p.u JOIN spread b ON b.u = p.v WHERE rank < 10 AND abs(a.diff - b.diff) < {RAD[5]} AND su = sv",
    "emb_knn", extra={**EDGES, "spread": SPREAD}))
def edges_bisector_spread(t):
    from ridgeline.operators.atoms import bisector_spread
    atoms = t.emb_atoms().join(t.emb_labels(), "ma_id").join(bisector_spread(t.emb_atoms(), t.emb_knn()), "ma_id")
    return G.candidate_edges(atoms, t.emb_knn(), G.similar_bisector_spread(5))


@query("edges_spoke_count", sql(
    "SELECT p.u, p.v FROM emb_pairs p JOIN cnt a ON a.ma_id = p.u JOIN cnt b ON b.ma_id = p.v WHERE rank < 10 AND ((a.n < 1 AND b.n < 1) OR (a.n > 1 AND b.n > 1))",
    "emb_knn", extra={**EDGES, "cnt": "SELECT m.ma_id, coalesce(c.n, 0) AS n FROM emb_atoms m LEFT JOIN (SELECT q_id, count(*) AS n FROM emb_atoms GROUP BY q_id) c ON c.q_id = m.s_id"}))
def edges_spoke_count(t):
    from ridgeline.operators.atoms import spoke_count
    atoms = t.emb_atoms().join(spoke_count(t.emb_atoms(), t.emb()), "s_id")
    return G.candidate_edges(atoms, t.emb_knn(), G.same_spoke_count_side(1))


# --- growth ---------------------------------------------------------------------

def flood_ctes(atoms: str, edges: str, condition: str, mincount: int, k: int = 10) -> dict[str, str]:
    return {
        "accepted": f"SELECT e.u, e.v FROM {edges} e JOIN {atoms} a ON a.ma_id = e.u JOIN {atoms} b ON b.ma_id = e.v WHERE e.rank < {k} AND {condition}",
        "reach": f"SELECT ma_id AS seed, ma_id AS node FROM {atoms} UNION SELECT r.seed, a.v FROM reach r JOIN accepted a ON a.u = r.node",
        "first_label": "SELECT node AS ma_id, min(seed) + 1 AS seg FROM reach GROUP BY node",
        "pass1": f"SELECT ma_id, CASE WHEN count(*) OVER (PARTITION BY seg) >= {mincount} THEN seg ELSE 0 END AS seg FROM first_label",
    }


DENSE = "SELECT p.ma_id, CASE WHEN p.seg = 0 THEN 0 ELSE d.dense END AS seg FROM {0} p LEFT JOIN (SELECT seg, row_number() OVER (ORDER BY seg) AS dense FROM (SELECT DISTINCT seg FROM {0} WHERE seg <> 0) x) d ON d.seg = p.seg"
SAME_THETA_BISEC = f"a.bx*b.bx+a.by*b.by+a.bz*b.bz > {COS[10]} AND abs(a.theta - b.theta) < {RAD[10]}"
RIDGE_GROWN = flood_ctes("ridge_in", "ridge_knn", SAME_THETA_BISEC, 10)


def grown(t):
    return t.share("ridge_grown", lambda: G.segment(t.ridge_in(), edges=t.ridge_knn(), second_pass_deg=None))


@query("grow_regions", sql(DENSE.format("pass1"), "ridge_knn", extra=RIDGE_GROWN))
def grow_regions(t):
    return grown(t)


EMB_FLOOD = {
    **flood_ctes("emb_atoms", "emb_knn", f"a.bx*b.bx+a.by*b.by+a.bz*b.bz > {COS[60]} AND abs(a.theta - b.theta) < {RAD[40]}", 3),
    "loose": "SELECT m.* FROM emb_atoms m JOIN pass1 p ON p.ma_id = m.ma_id WHERE p.seg = 0",
    "accepted2": f"SELECT e.u, e.v FROM emb_knn e JOIN loose a ON a.ma_id = e.u JOIN loose b ON b.ma_id = e.v WHERE e.rank < 10 AND abs(a.theta - b.theta) < {RAD[40]}",
    "reach2": f"SELECT ma_id AS seed, ma_id AS node FROM loose WHERE theta > {RAD[120]} UNION SELECT r.seed, a.v FROM reach2 r JOIN accepted2 a ON a.u = r.node",
    "late": "SELECT node AS ma_id, 1000000000 + min(seed) AS seg FROM reach2 GROUP BY node",
    "both_passes": "SELECT p.ma_id, coalesce(l.seg, p.seg) AS seg FROM pass1 p LEFT JOIN late l ON l.ma_id = p.ma_id",
    "pass2": "SELECT ma_id, CASE WHEN seg <> 0 AND count(*) OVER (PARTITION BY seg) >= 3 THEN seg ELSE 0 END AS seg FROM both_passes",
}


@query("segment_two_pass", sql(DENSE.format("pass2"), "emb_knn", extra=EMB_FLOOD))
def segment_two_pass(t):
    return G.segment(t.emb_atoms(), edges=t.emb_knn(), bisec_deg=60, theta_deg=40, mincount=3, second_pass_deg=120)


@query("segment_ball_overlap", sql(
    "SELECT seg, CAST(0 AS BIGINT) AS part, list_sort(list(ma_id)) AS members FROM (" + DENSE.format("pass1") + ") s GROUP BY seg",
    "ridge_knn", extra=flood_ctes("ridge_in", "ridge_knn", "(e.d2 = 0 OR (a.r + b.r) / sqrt(e.d2) > 4.0)", 2)))
def segment_ball_overlap(t):
    return G.members(G.segment_balloverlap(t.ridge_in(), edges=t.ridge_knn(), thres=4.0))


RUNNING_MEAN = {
    # both ends of the neighbour edges, and the edges that starts are compared along, both ways
    "flat": f"""SELECT e.u, e.v, a.bx*b.bx+a.by*b.by+a.bz*b.bz AS bb FROM ridge_knn e JOIN ridge_in a ON a.ma_id = e.u JOIN ridge_in b ON b.ma_id = e.v
      WHERE e.rank < 10 AND abs(a.theta - b.theta) < {RAD[10]}""",
    "alike": f"SELECT u, v FROM flat WHERE bb > {COS[2]} UNION SELECT v, u FROM flat WHERE bb > {COS[2]}",
    # a step starts regions if the last one labelled no ball, else every region grows by one ring
    "grow": f"""
      SELECT 0 AS step, ma_id, CAST(NULL AS BIGINT) AS seg, false AS fresh FROM ridge_in
      UNION ALL
      SELECT g.step + 1, g.ma_id, coalesce(g.seg, j.seg), j.seg IS NOT NULL
      FROM grow g LEFT JOIN (
        SELECT a.ma_id, a.ma_id + 1 AS seg FROM grow a
        WHERE a.seg IS NULL AND NOT (SELECT bool_or(fresh) FROM grow)
          AND NOT EXISTS (SELECT 1 FROM alike s JOIN grow b ON b.ma_id = s.v
            WHERE s.u = a.ma_id AND b.seg IS NULL AND (md5(CAST(s.v AS VARCHAR)), s.v) < (md5(CAST(s.u AS VARCHAR)), s.u))
        UNION ALL
        SELECT f.v, min(m.seg) FROM flat f JOIN grow x ON x.ma_id = f.u JOIN grow y ON y.ma_id = f.v JOIN ridge_in b ON b.ma_id = f.v
        JOIN (SELECT r.seg, sum(i.bx) AS mx, sum(i.by) AS my, sum(i.bz) AS mz FROM grow r JOIN ridge_in i ON i.ma_id = r.ma_id
          WHERE r.seg IS NOT NULL GROUP BY r.seg) m ON m.seg = x.seg
        WHERE y.seg IS NULL AND (SELECT bool_or(fresh) FROM grow)
          AND (m.mx*b.bx+m.my*b.by+m.mz*b.bz)/sqrt(m.mx*m.mx+m.my*m.my+m.mz*m.mz) > {COS[2]}
        GROUP BY f.v) j ON j.ma_id = g.ma_id
      WHERE (SELECT bool_or(seg IS NULL) FROM grow)""",
    "last_step": "SELECT ma_id, seg FROM grow WHERE step = (SELECT max(step) FROM grow)",
    "region_sums": "SELECT l.seg, sum(i.bx) AS x, sum(i.by) AS y, sum(i.bz) AS z FROM last_step l JOIN ridge_in i ON i.ma_id = l.ma_id GROUP BY l.seg",
    "close_pairs": f"""SELECT DISTINCT a.seg AS a, b.seg AS b FROM alike s JOIN last_step a ON a.ma_id = s.u JOIN last_step b ON b.ma_id = s.v JOIN region_sums p ON p.seg = a.seg JOIN region_sums q ON q.seg = b.seg
      WHERE a.seg <> b.seg AND (p.x*q.x+p.y*q.y+p.z*q.z)/(sqrt(p.x*p.x+p.y*p.y+p.z*p.z)*sqrt(q.x*q.x+q.y*q.y+q.z*q.z)) > {COS[2]}""",
    "joined_walk": "SELECT DISTINCT seg AS root, seg AS node FROM last_step UNION SELECT w.root, c.b FROM joined_walk w JOIN close_pairs c ON c.a = w.node",
    "joined": "SELECT l.ma_id, m.seg FROM last_step l JOIN (SELECT node, min(root) AS seg FROM joined_walk GROUP BY node) m ON m.node = l.seg",
    "kept": "SELECT ma_id, CASE WHEN count(*) OVER (PARTITION BY seg) >= 10 THEN seg ELSE 0 END AS seg FROM joined",
}


@query("segment_running_mean", sql(DENSE.format("kept"), "ridge_knn", extra=RUNNING_MEAN))
def segment_running_mean(t):
    return G.segment_running_mean(t.ridge_in(), edges=t.ridge_knn(), theta_deg=10.0)


@query("interior_atoms_knn", sql("SELECT u, v FROM ridge_knn WHERE rank < 10", "ridge_knn"))
def interior_atoms_knn(t):
    return t.ridge_knn().where("rank < 10").select("u", "v")


@query("unsegmented_report", sql(
    "SELECT u AS ma_id, count(*) AS neighbours, min(acos(greatest(-1.0, least(1.0, (a.bx*(b.cx-a.cx)+a.by*(b.cy-a.cy)+a.bz*(b.cz-a.cz))/nullif(sqrt(e.d2),0))))) AS min_angle FROM emb_knn e JOIN emb_atoms a ON a.ma_id=u JOIN emb_atoms b ON b.ma_id=v WHERE a.seg = 0 AND rank < 10 GROUP BY u",
    "emb_knn", rounded="min_angle:4"), rounded="min_angle:4")
def unsegmented_report(t):
    return G.unsegmented_report(t.emb_atoms(), t.emb_labels(), t.emb_knn())


@query("seed_order_radius", sql("SELECT ma_id AS id, row_number() OVER (ORDER BY r DESC, ma_id) - 1 AS rank FROM (SELECT ma_id, round(r, 9) AS r FROM emb_atoms) a", "emb_atoms"))
def seed_order_radius(t):
    return G.rank_seeds(t.emb_atoms().withColumn("r", F.round("r", 9)), "radius")


# --- segments and relations --------------------------------------------------------

@query("unmark_small_segments", sql("SELECT ma_id, CASE WHEN seg <> 0 AND count(*) OVER (PARTITION BY seg) >= 90 THEN seg ELSE 0 END AS seg FROM emb_atoms", "emb_atoms"))
def unmark_small_segments(t):
    return G.unmark_small(t.emb_labels(), 90)


@query("flip_relations", sql(
    "SELECT least(seg_in, seg_out) AS a, greatest(seg_in, seg_out) AS b, count(*) AS cnt FROM emb WHERE seg_in <> 0 AND seg_out <> 0 GROUP BY 1, 2", "emb"))
def flip_relations(t):
    return R.flip_relations(t.emb_atoms(), t.emb_labels())


ADJ = "SELECT least(su, sv) AS a, greatest(su, sv) AS b, count(*) AS cnt FROM emb_pairs WHERE su <> 0 AND sv <> 0 AND su <> sv GROUP BY 1, 2"


@query("adjacency_relations", sql(ADJ, "emb_knn", extra=EDGES))
def adjacency_relations(t):
    return R.adjacency_relations(t.emb_labels(), t.emb_knn())


RIDGE_LABELS = {**RIDGE_GROWN, "grown": DENSE.format("pass1")}
RIDGE_ADJ = "SELECT least(a.seg, b.seg) AS a, greatest(a.seg, b.seg) AS b, count(*) AS cnt FROM ridge_knn e JOIN grown a ON a.ma_id = e.u JOIN grown b ON b.ma_id = e.v WHERE a.seg <> 0 AND b.seg <> 0 AND a.seg <> b.seg GROUP BY 1, 2"


@query("adjacency_interior", sql(RIDGE_ADJ, "ridge_knn", extra=RIDGE_LABELS))
def adjacency_interior(t):
    return R.find_relations(t.ridge_atoms(), grown(t), t.ridge_knn(), only_interior=True)[0]


@query("find_relations", sql(f"SELECT 'adjacent' AS kind, a, b, cnt FROM adj UNION ALL SELECT 'flip', least(seg_in, seg_out), greatest(seg_in, seg_out), count(*) FROM emb WHERE seg_in <> 0 AND seg_out <> 0 GROUP BY 2, 3", "emb", "emb_knn", extra={**EDGES, "adj": ADJ}))
def find_relations(t):
    adjacent, flips = R.find_relations(t.emb_atoms(), t.emb_labels(), t.emb_knn())
    return adjacent.select(F.lit("adjacent").alias("kind"), "a", "b", "cnt").unionByName(flips.select(F.lit("flip").alias("kind"), "a", "b", "cnt"))


MEANS = "SELECT seg, count(*) AS n, " + ", ".join(f"avg({p}{a}) AS {p}{a}_mean" for p in ("c", "b") for a in "xyz") + ", avg(theta) AS theta_mean, avg(r) AS r_mean, max(r) AS r_max, min(r) AS r_min, min(theta) AS theta_min FROM {0} WHERE seg <> 0 GROUP BY seg"
MEAN_COLS = " ".join(f"{p}{a}_mean" for p in ("c", "b") for a in "xyz") + " theta_mean r_mean r_max r_min theta_min"


@query("sheet_means", sql(MEANS.format("emb_atoms"), "emb_atoms", rounded=MEAN_COLS), rounded=MEAN_COLS)
def sheet_means(t):
    return R.sheet_means(t.emb_atoms(), t.emb_labels())


@query("segment_members", sql("SELECT seg, CAST((n - 1) // 40 AS BIGINT) AS part, list_sort(list(ma_id)) AS members FROM (SELECT seg, ma_id, row_number() OVER (PARTITION BY seg ORDER BY ma_id) AS n FROM emb_atoms) m GROUP BY 1, 2", "emb_atoms"))
def segment_members(t):
    return G.members(t.emb_labels(), chunk=40)


FLIPS = "SELECT least(seg_in, seg_out) AS a, greatest(seg_in, seg_out) AS b FROM emb WHERE seg_in <> 0 AND seg_out <> 0 GROUP BY 1, 2"
LINKS = "SELECT j.a, j.b, j.cnt AS adj_count, f.a IS NOT NULL AS is_fliprel FROM adj j LEFT JOIN flips f ON f.a = j.a AND f.b = j.b"
GRAPH = {**EDGES, "adj": ADJ, "flips": FLIPS, "links": LINKS, "sheets": MEANS.format("emb_atoms")}


def emb_graph(t):
    sheets, links = R.sheet_graph(t.emb_atoms(), t.emb_labels(), t.emb_knn())
    return t.share("emb_sheets", lambda: sheets), t.share("emb_links", lambda: links)


@query("flip_marked_links", sql(LINKS, "emb", "emb_knn", extra={k: GRAPH[k] for k in ("emb_pairs", "adj", "flips")}))
def flip_marked_links(t):
    return emb_graph(t)[1]


@query("sheet_graph", sql(
    "SELECT a, b, adj_count, is_fliprel, x.n AS n_a, y.n AS n_b, x.theta_mean AS theta_a, y.theta_mean AS theta_b FROM links JOIN sheets x ON x.seg = a JOIN sheets y ON y.seg = b",
    "emb", "emb_knn", extra=GRAPH, rounded="theta_a theta_b"), rounded="theta_a theta_b")
def sheet_graph(t):
    sheets, links = emb_graph(t)
    for end in ("a", "b"):
        links = links.join(sheets.select(F.col("seg").alias(end), F.col("n").alias(f"n_{end}"), F.col("theta_mean").alias(f"theta_{end}")), end)
    return links


@query("filter_regions", sql(
    "SELECT ma_id, seg FROM emb_atoms WHERE seg IN (SELECT seg FROM emb_atoms WHERE seg <> 0 GROUP BY seg HAVING max(r) < 4 AND avg(theta) > 1.0)", "emb_atoms"))
def filter_regions(t):
    return R.filter_regions(t.emb_atoms(), t.emb_labels(), max_r=4, min_theta=1.0)


@query("dense_relabel", sql("SELECT ma_id, CASE WHEN seg = 0 THEN 0 ELSE dense_rank() OVER (ORDER BY CASE WHEN seg = 0 THEN 1000000 ELSE seg END) END AS seg FROM (SELECT ma_id, seg * 7 AS seg FROM emb_atoms) m", "emb_atoms"))
def dense_relabel(t):
    return G.relabel(t.emb_labels().withColumn("seg", F.col("seg") * 7))


@query("largest_ball", sql(
    "SELECT seg, ma_id, r, cx, cy, cz FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY r DESC, ma_id) AS n FROM emb_atoms WHERE seg <> 0) m WHERE n = 1",
    "emb_atoms", rounded=f"r {v3('c')}"), rounded=f"r {v3('c')}")
def largest_ball(t):
    rows = t.emb_atoms().join(t.emb_labels().where("seg <> 0"), "ma_id")
    top = rows.groupBy("seg").agg(F.max_by(F.struct("ma_id", "r", "cx", "cy", "cz"), F.struct(F.col("r"), -F.col("ma_id"))).alias("m"))
    return top.select("seg", "m.*")


# --- clusters -----------------------------------------------------------------------

SMALL_GRAPH = {
    # a sparser graph: sheets are (label, octant) groups, so that pruning and components matter
    "fine": "SELECT *, 1 + label * 8 + CAST(px > 0 AS INT) * 4 + CAST(py > 0 AS INT) * 2 + CAST(pz > 0 AS INT) AS cell FROM emb",
    "fine_atoms": "SELECT m.* REPLACE (CASE WHEN m.side = 'in' THEN f.cell WHEN f.s_id % 5 = 0 THEN 0 ELSE 101 + f.cell END AS seg) FROM emb_atoms m JOIN fine f ON f.s_id = m.s_id",
    "fine_pairs": "SELECT a.seg AS su, b.seg AS sv FROM emb_knn e JOIN fine_atoms a ON a.ma_id = e.u JOIN fine_atoms b ON b.ma_id = e.v WHERE a.seg <> 0 AND b.seg <> 0 AND a.seg <> b.seg",
    "adj": "SELECT least(su, sv) AS a, greatest(su, sv) AS b, count(*) AS cnt FROM fine_pairs GROUP BY 1, 2",
    "flips": "SELECT DISTINCT cell AS a, 101 + cell AS b FROM fine WHERE s_id % 5 <> 0",
    "links": LINKS,
    "sheets": MEANS.format("fine_atoms"),
}


def fine_labels(t):
    cell = t.emb().select("s_id", (1 + F.col("label") * 8 + F.col("px").__gt__(0).cast("int") * 4 + F.col("py").__gt__(0).cast("int") * 2 + F.col("pz").__gt__(0).cast("int")).alias("cell"))
    seg = F.when(F.col("side") == "in", F.col("cell")).when(F.col("s_id") % 5 == 0, F.lit(0)).otherwise(F.col("cell") + 101)
    return t.share("fine_labels", lambda: t.emb_atoms().select("ma_id", "s_id", "side").join(cell, "s_id").select("ma_id", seg.cast("bigint").alias("seg")))


def fine_graph(t):
    sheets, links = R.sheet_graph(t.emb_atoms(), fine_labels(t), t.emb_knn())
    return t.share("fine_sheets", lambda: sheets), t.share("fine_links", lambda: links)


def graph_sql(body: str, extra: dict[str, str] | None = None, **kw) -> str:
    return sql(body, "emb", "emb_knn", extra={**SMALL_GRAPH, **(extra or {})}, **kw)


STRONG = "SELECT * FROM links WHERE adj_count > 12 AND NOT is_fliprel"
KEPT = "SELECT * FROM sheets WHERE seg IN (SELECT a FROM strong UNION SELECT b FROM strong)"
WALK = {
    "strong": STRONG,
    "kept": KEPT,
    "walk": "SELECT seg AS root, seg AS node FROM kept UNION SELECT w.root, s.b FROM walk w JOIN (SELECT a, b FROM strong UNION ALL SELECT b, a FROM strong) s ON s.a = w.node",
    "comp": "SELECT node AS seg, min(root) AS component FROM walk GROUP BY node",
    "sizes": "SELECT component, sheets, row_number() OVER (ORDER BY sheets DESC, component) AS cluster FROM (SELECT component, count(*) AS sheets FROM comp GROUP BY component) c",
    "clusters": "SELECT c.seg, row_number() OVER (ORDER BY c.seg) AS s_no, s.cluster, s.sheets FROM comp c JOIN sizes s ON s.component = c.component",
}


@query("prune_links", graph_sql("SELECT a, b, adj_count FROM strong", {"strong": STRONG}))
def prune_links(t):
    return C.prune(*fine_graph(t), min_count=12)[1].select("a", "b", "adj_count")


@query("prune_sheets", graph_sql("SELECT seg, n FROM kept", {"strong": STRONG, "kept": KEPT}))
def prune_sheets(t):
    return C.prune(*fine_graph(t), min_count=12)[0].select("seg", "n")


@query("drop_radius_theta", graph_sql("SELECT seg, r_max, theta_min FROM sheets WHERE NOT (r_max > 9 AND theta_min < 1.0)", rounded="r_max theta_min"), rounded="r_max theta_min")
def drop_radius_theta(t):
    return C.drop_radius_theta(*fine_graph(t))[0].select("seg", "r_max", "theta_min")


DEGREE = "SELECT seg, count(*) AS d FROM (SELECT a AS seg FROM links UNION ALL SELECT b FROM links) x GROUP BY seg"


@query("drop_high_degree", graph_sql(
    "SELECT s.seg FROM sheets s LEFT JOIN degree g ON g.seg = s.seg WHERE coalesce(g.d, 0) <= (SELECT min(d) FROM (SELECT d FROM degree ORDER BY d DESC LIMIT 5) t)", {"degree": DEGREE}))
def drop_high_degree(t):
    return C.drop_high_degree(*fine_graph(t), 5)[0].select("seg")


@query("connected_components", graph_sql("SELECT seg, component FROM comp", {k: WALK[k] for k in ("strong", "kept", "walk", "comp")}))
def connected_components(t):
    sheets, links = C.prune(*fine_graph(t), min_count=12)
    return components(links, sheets.select("seg"), key="seg")


@query("cluster_order", graph_sql("SELECT component, sheets, cluster FROM sizes", {k: WALK[k] for k in ("strong", "kept", "walk", "comp", "sizes")}))
def cluster_order(t):
    found, _ = C.get_clusters(*fine_graph(t), min_count=12)
    return found.groupBy("cluster").agg(F.min("seg").alias("component"), F.first("sheets").alias("sheets"))


@query("get_clusters", graph_sql("SELECT seg, s_no, cluster, sheets FROM clusters", WALK))
def get_clusters(t):
    return C.get_clusters(*fine_graph(t), min_count=12)[0]


@query("push_labels", graph_sql("SELECT m.ma_id, coalesce(c.s_no, 0) AS seg FROM fine_atoms m LEFT JOIN clusters c ON c.seg = m.seg", WALK))
def push_labels(t):
    found, _ = C.get_clusters(*fine_graph(t), min_count=12)
    return C.push_labels(fine_labels(t), found)


SIMILAR = {
    "near": f"""SELECT a, b FROM links JOIN sheets x ON x.seg = a JOIN sheets y ON y.seg = b WHERE acos(greatest(-1.0, least(1.0,
      (x.bx_mean*y.bx_mean+x.by_mean*y.by_mean+x.bz_mean*y.bz_mean)/(sqrt(x.bx_mean*x.bx_mean+x.by_mean*x.by_mean+x.bz_mean*x.bz_mean)*sqrt(y.bx_mean*y.bx_mean+y.by_mean*y.by_mean+y.bz_mean*y.bz_mean))))) <= {RAD[15]}""",
    "walk": "SELECT seg AS root, seg AS node FROM sheets UNION SELECT w.root, s.b FROM walk w JOIN (SELECT a, b FROM near UNION ALL SELECT b, a FROM near) s ON s.a = w.node",
    "mapping": "SELECT node AS seg, min(root) AS merged FROM walk GROUP BY node",
}


@query("contract_similar", graph_sql(
    "SELECT merged AS seg, count(*) AS parts, CAST(sum(n) AS BIGINT) AS n, avg(theta_mean) AS theta_mean, avg(bz_mean) AS bz_mean, avg(cx_mean) AS cx_mean FROM sheets s JOIN mapping m ON m.seg = s.seg GROUP BY merged",
    SIMILAR, rounded="theta_mean bz_mean cx_mean"), rounded="theta_mean bz_mean cx_mean")
def contract_similar(t):
    return C.contract_similar(*fine_graph(t), deg=15)[0].select("seg", "parts", "n", "theta_mean", "bz_mean", "cx_mean")


@query("contract_similar_links", graph_sql(
    "SELECT least(x.merged, y.merged) AS a, greatest(x.merged, y.merged) AS b, CAST(sum(adj_count) AS BIGINT) AS adj_count, CAST(sum(CAST(is_fliprel AS INT)) AS BIGINT) AS flips FROM links JOIN mapping x ON x.seg = a JOIN mapping y ON y.seg = b WHERE x.merged <> y.merged GROUP BY 1, 2", SIMILAR))
def contract_similar_links(t):
    return C.contract_similar(*fine_graph(t), deg=15)[1]


@query("grow_by_flip", graph_sql("""
 SELECT a, b, count(*) AS flip_count FROM (
  SELECT m.seg AS a, CASE WHEN i.seg = m.seg THEN o.seg ELSE i.seg END AS b
  FROM (SELECT seg, s_id FROM fine_atoms UNION ALL SELECT seg, q_id FROM fine_atoms) m
  JOIN fine_atoms i ON i.s_id = m.s_id AND i.side = 'in' JOIN fine_atoms o ON o.s_id = m.s_id AND o.side = 'out'
  WHERE m.seg IN (SELECT seg FROM clusters WHERE cluster = 1)) x WHERE b <> 0 GROUP BY a, b HAVING count(*) > 3""", WALK))
def grow_by_flip(t):
    found, _ = C.get_clusters(*fine_graph(t), min_count=12)
    return C.grow_by_flip(found.where("cluster = 1"), t.emb_atoms(), fine_labels(t), min_flip=3)


CLASSIFY = {
    **WALK,
    "steep": "SELECT c.cluster, m.bz, row_number() OVER (PARTITION BY c.cluster ORDER BY m.bz, m.ma_id) - 1 AS i, count(*) OVER (PARTITION BY c.cluster) AS l FROM fine_atoms m JOIN clusters c ON c.seg = m.seg WHERE m.theta < pi() * 0.9 AND m.bz IS NOT NULL",
    "tenths": "SELECT cluster, max(l) AS balls, avg(bz) FILTER (i < l // 10) AS bottom, avg(bz) FILTER (i >= l - l // 10) AS top FROM steep GROUP BY cluster",
    "facts": "SELECT k.cluster, (SELECT count(*) FROM strong s JOIN clusters c ON c.seg = s.a WHERE c.cluster = k.cluster) AS links, coalesce(t.balls, 0) AS balls, t.bottom, t.top, (SELECT avg(s.theta_mean) FROM sheets s JOIN clusters c ON c.seg = s.seg WHERE c.cluster = k.cluster) AS theta_mean FROM (SELECT DISTINCT cluster FROM clusters) k LEFT JOIN tenths t ON t.cluster = k.cluster",
    "classed": "SELECT *, CASE WHEN links = 0 THEN 0 WHEN coalesce(abs(top)/nullif(abs(bottom),0) > 1.05 OR bottom > 0, false) THEN CASE WHEN theta_mean > pi()/4 THEN 4 ELSE 3 END WHEN coalesce(abs(top)/nullif(abs(bottom),0) > 0.95, false) THEN 1 ELSE 2 END AS class FROM facts",
}


@query("classify_clusters", graph_sql(
    "SELECT cluster, class, CASE class WHEN 0 THEN 'never classified' WHEN 1 THEN 'other' WHEN 2 THEN 'exterior' WHEN 3 THEN 'interior' ELSE 'building' END AS name, links, balls, bottom, top, theta_mean FROM classed",
    CLASSIFY, rounded="bottom top theta_mean"), rounded="bottom top theta_mean")
def classify_clusters(t):
    sheets, links = fine_graph(t)
    found, strong = C.get_clusters(sheets, links, min_count=12)
    return C.classify(found, strong, sheets, t.emb_atoms(), fine_labels(t))


@query("decile_means", graph_sql("SELECT cluster, balls, bottom, top FROM tenths", {k: v for k, v in CLASSIFY.items() if k not in ("facts", "classed")}, rounded="bottom top"), rounded="bottom top")
def decile_means(t):
    sheets, links = fine_graph(t)
    found, strong = C.get_clusters(sheets, links, min_count=12)
    return C.classify(found, strong, sheets, t.emb_atoms(), fine_labels(t)).where("balls > 0").select("cluster", "balls", "bottom", "top")


PATTERN = """SELECT p.s AS v0, q.s AS v1, r.s AS v2, w.s AS v3 FROM both_ways p
 JOIN both_ways q ON q.s = p.t JOIN both_ways r ON r.s = q.t AND EXISTS (SELECT 1 FROM both_ways d WHERE d.s = p.s AND d.t = r.s)
 JOIN both_ways w ON w.s = r.t AND w.t = p.s WHERE p.s <> r.s AND q.s <> w.s"""


@query("match_flat_top", graph_sql(PATTERN, {"strong": "SELECT * FROM links WHERE adj_count > 12 AND NOT is_fliprel",
       "both_ways": "SELECT a AS s, b AS t FROM strong UNION SELECT b, a FROM strong"}))
def match_flat_top(t):
    return C.match_flat_top(C.prune(*fine_graph(t), min_count=12)[1])


# ridge clouds carry no exterior sheets: interior graph, clusters and classes in one report
RIDGE_REPORT = {
    **RIDGE_LABELS,
    "adj": RIDGE_ADJ,
    "fine_atoms": "SELECT m.* REPLACE (g.seg AS seg) FROM ridge_in m JOIN grown g ON g.ma_id = m.ma_id",
    "sheets": MEANS.format("fine_atoms"),
    "links": "SELECT a, b, cnt AS adj_count, false AS is_fliprel FROM adj",
    **{**CLASSIFY, "strong": STRONG.replace("> 12", "> 20")},
}


@query("cluster_report", sql(
    "SELECT c.cluster, k.class, count(*) AS sheets, CAST(sum(s.n) AS BIGINT) AS balls, avg(s.theta_mean) AS theta_mean, max(s.r_max) AS r_max FROM clusters c JOIN classed k ON k.cluster = c.cluster JOIN sheets s ON s.seg = c.seg GROUP BY 1, 2",
    "ridge_knn", extra=RIDGE_REPORT, rounded="theta_mean:5 r_max"), rounded="theta_mean:5 r_max")
def cluster_report(t):
    from ridgeline.plans.pipeline import cluster_report as report
    return report(t.ridge_in(), edges=t.ridge_knn())


# --- sheet analysis ------------------------------------------------------------------

def sided(t):
    return t.share("sided", lambda: N.spoke_sides(t.ridge_in(), t.ridge_labels()))


# On the ridge cloud the axis of a sheet is the y axis, so the side is the sign of ky.
RIDGE_SIDED = {
    "sided": "SELECT *, ky > 0 AS one_side FROM ridge_in",
    "halves": """SELECT seg, CASE WHEN one_side THEN 1 ELSE 2 END AS half, s_id, f1x AS fx, f1y AS fy, f1z AS fz FROM sided
      UNION ALL SELECT seg, CASE WHEN one_side THEN 2 ELSE 1 END, q_id, f2x, f2y, f2z FROM sided""",
    "means": """SELECT seg, avg(r) AS mr, avg(theta) AS mt, avg(bx) AS mbx, avg(by) AS mby, avg(bz) AS mbz, avg(cx) AS mcx, avg(cy) AS mcy, avg(cz) AS mcz,
      avg(CASE WHEN one_side THEN kx ELSE -kx END) AS gx, avg(CASE WHEN one_side THEN ky ELSE -ky END) AS gy, avg(CASE WHEN one_side THEN kz ELSE -kz END) AS gz FROM sided GROUP BY seg""",
    "normals": "SELECT *, gy*mbz-gz*mby AS ux, gz*mbx-gx*mbz AS uy, gx*mby-gy*mbx AS uz FROM means",
    "measures": """SELECT s.seg, s.ma_id, s.one_side, mr/cos(mt/2) + (mcx-cx)*mbx+(mcy-cy)*mby+(mcz-cz)*mbz AS x, r AS radius, theta AS ma_theta,
      ((cx-mcx)*ux+(cy-mcy)*uy+(cz-mcz)*uz)/sqrt(ux*ux+uy*uy+uz*uz) AS ma_planfit,
      acos(greatest(-1.0, least(1.0, (mbx*bx+mby*by+mbz*bz)/(sqrt(mbx*mbx+mby*mby+mbz*mbz)*sqrt(bx*bx+by*by+bz*bz))))) AS ma_bisec_diff,
      acos(greatest(-1.0, least(1.0, CASE WHEN one_side THEN 1 ELSE -1 END*(gx*kx+gy*ky+gz*kz)/(sqrt(gx*gx+gy*gy+gz*gz)*sqrt(kx*kx+ky*ky+kz*kz))))) AS biseco_diff
      FROM sided s JOIN normals m ON m.seg = s.seg""",
    "six": "SELECT *, CASE WHEN radius <= abs(x) THEN 2*acos(greatest(-1.0, least(1.0, radius/x))) END AS ma_thetap FROM measures",
}


@query("spoke_sides", sql("SELECT seg, ma_id, one_side FROM sided", "ridge_in", extra={"sided": RIDGE_SIDED["sided"]}))
def spoke_sides(t):
    return sided(t).select("seg", "ma_id", "one_side")


@query("half_sheets", sql("SELECT seg, half, count(*) AS points, avg(fx) AS fx, avg(fy) AS fy, avg(fz) AS fz FROM halves GROUP BY seg, half", "ridge_in", extra={k: RIDGE_SIDED[k] for k in ("sided", "halves")}, rounded="fx fy fz", digits=5), rounded="fx fy fz", digits=5)
def half_sheets(t):
    return N.half_sheets(sided(t)).select("seg", F.col("half"), "points", "fx", "fy", "fz")


@query("sheet_axis", sql("SELECT seg, ma_id, x FROM measures", "ridge_in", extra=RIDGE_SIDED, rounded="x:5"), rounded="x:5")
def sheet_axis(t):
    return N.sheet_measures(sided(t)).select("seg", "ma_id", "x")


SIX = " ".join(f"{m}:4" for m in N.MEASURES)


@query("sheet_measures", sql(f"SELECT seg, ma_id, one_side, x, {', '.join(N.MEASURES)} FROM six", "ridge_in", extra=RIDGE_SIDED, rounded="x:4 " + SIX), rounded="x:4 " + SIX)
def sheet_measures(t):
    return N.sheet_measures(sided(t))


@query("sheet_regularity", sql(
    "SELECT seg, greatest(count(*) FILTER (one_side), count(*) FILTER (NOT one_side)) / count(*) AS regularity_ratio, sqrt(avg(ma_planfit*ma_planfit)) AS ma_planfit_rms FROM measures GROUP BY seg",
    "ridge_in", extra=RIDGE_SIDED, rounded="regularity_ratio ma_planfit_rms:4"), rounded="regularity_ratio ma_planfit_rms:4")
def sheet_regularity(t):
    return N.sheet_regularity(N.sheet_measures(sided(t)))


# Least squares of each measure (to 6 digits, so that what is constant but for rounding is constant) on x.  The p-value
# is the finite sum of the t distribution for whole degrees of freedom v: terms are quotients of gamma functions.
REGRESSED = {
    **RIDGE_SIDED,
    "tall": " UNION ALL ".join(f"SELECT seg, x, '{m}' AS measure, round({m}, 6) + 0.0 AS y FROM six" for m in N.MEASURES),
    "figures": """SELECT seg, measure, count(*) AS n, count(y) = count(*) AND count(x) = count(*) AND var_pop(x) > 0 AS whole, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
      CASE WHEN var_pop(y) > 0 THEN greatest(-1.0, least(1.0, covar_pop(y, x) / sqrt(var_pop(x) * var_pop(y)))) ELSE 0.0 END AS r, var_pop(y) AS vy, var_pop(x) AS vx FROM tall GROUP BY seg, measure""",
    "angled": "SELECT *, CAST(n - 2 AS DOUBLE) AS v, sqrt(1 - r*r) AS cs, abs(r) AS sn, asin(abs(r)) AS angle FROM figures",
    "regressed": """SELECT seg, measure, n, CASE WHEN whole THEN slope END AS slope, CASE WHEN whole THEN intercept END AS intercept, CASE WHEN whole THEN r END AS r_value,
      CASE WHEN whole THEN sqrt((1 - r*r) * vy / vx / v) END AS std_err,
      CASE WHEN whole THEN 1 - CASE WHEN n % 2 = 0
        THEN sn * list_sum(list_transform(range(0, CAST(v / 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(cs, 2 * k)))
        ELSE 2 / pi() * (angle + sn * coalesce(list_sum(list_transform(range(0, CAST((v - 1) / 2 AS BIGINT)), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * pow(cs, 2 * k + 1))), 0)) END END AS p_value
      FROM angled""",
}
FIVE = ("slope", "intercept", "r_value", "p_value", "std_err")
DIGITS = "slope:4 intercept:4 r_value:4 p_value:5 std_err:5"


@query("sheet_regressions", sql("SELECT * FROM regressed", "ridge_in", extra=REGRESSED, rounded=DIGITS), rounded=DIGITS)
def sheet_regressions(t):
    """All six measures with their five figures; the measures are taken to six digits."""
    measures = N.sheet_measures(sided(t))
    return N.regressions(measures.withColumns({m: F.round(m, 6) for m in N.MEASURES}))


WIDE_DIGITS = "regularity_ratio ma_planfit_rms:4 " + " ".join(f"{m}_{f}" for m in N.MEASURES for f in DIGITS.split())


@query("analyse_sheets", sql(
    f"""SELECT r.seg, greatest(one, others) / (one + others) AS regularity_ratio, rms AS ma_planfit_rms, w.* EXCLUDE (seg) FROM (
      SELECT seg, count(*) FILTER (one_side) AS one, count(*) FILTER (NOT one_side) AS others, sqrt(avg(round(ma_planfit, 6)*round(ma_planfit, 6))) AS rms FROM measures GROUP BY seg) r
      JOIN (SELECT seg, {', '.join(f"max({f}) FILTER (measure = '{m}') AS {m}_{f}" for m in N.MEASURES for f in FIVE)} FROM regressed GROUP BY seg) w ON w.seg = r.seg""",
    "ridge_in", extra=REGRESSED, rounded=WIDE_DIGITS), rounded=WIDE_DIGITS)
def analyse_sheets(t):
    return N.analyse_sheets(t.ridge_in(), t.ridge_labels(), digits=6)


# --- fitting and thinning --------------------------------------------------------------

# A face of a ridge falls off at half the ridge's angle to either side; its normal has its larger component positive.
@query("fit_planes", sql(
    """SELECT sheet, face, count(*) AS n, avg(px) AS rx, avg(py) AS ry, avg(pz) AS rz, any_value(CASE WHEN steep THEN cos(alpha/2) ELSE (1-2*face)*cos(alpha/2) END) AS nx, 0.0::DOUBLE AS ny,
      any_value(CASE WHEN steep THEN (1-2*face)*sin(alpha/2) ELSE sin(alpha/2) END) AS nz
     FROM (SELECT *, cos(alpha/2) >= sin(alpha/2)*(1-1e-6) AS steep FROM ridge) r GROUP BY sheet, face""",
    "ridge", rounded="rx ry rz nx:4 ny:4 nz:4"), rounded="rx ry rz nx:4 ny:4 nz:4")
def fit_planes(t):
    return P.fit_plane(t.ridge(), ["sheet", "face"])


# Ball centres of a sheet lie in the plane x = x0, where the axis has a closed form.
@query("fit_lines", sql(
    """SELECT seg, n, rx, ry, rz, 0.0::DOUBLE AS tx, CASE WHEN lead < 0 THEN -ty ELSE ty END AS ty, CASE WHEN lead < 0 THEN -tz ELSE tz END AS tz FROM (
      SELECT *, CASE WHEN abs(ty) >= abs(tz)*(1-1e-6) THEN ty ELSE tz END AS lead FROM (
       SELECT seg, n, rx, ry, rz, cos(turn) AS ty, sin(turn) AS tz FROM (
        SELECT seg, count(*) AS n, avg(cx) AS rx, avg(cy) AS ry, avg(cz) AS rz, atan2(2*covar_pop(cy, cz), var_pop(cy) - var_pop(cz))/2 AS turn FROM ridge_in GROUP BY seg) a) b) c""",
    "ridge_in", rounded="rx ry rz tx:4 ty:4 tz:4"), rounded="rx ry rz tx:4 ty:4 tz:4")
def fit_lines(t):
    return P.fit_line(t.ridge_in().join(t.ridge_labels(), "ma_id"), ["seg"], "c")


def _ransac_round(no: int, points: str) -> dict[str, str]:
    """Names of one round: the lots, the planes through the three lowest, and the best of them."""
    return {
        f"lots{no}": f"""SELECT p.*, trial, row_number() OVER (PARTITION BY sheet, trial ORDER BY md5(concat_ws(' ', '0', '{no}', CAST(trial AS VARCHAR), CAST(s_id AS VARCHAR))), s_id) AS place
          FROM {points} p, (SELECT unnest(range(10)) AS trial) t""",
        f"three{no}": f"""SELECT sheet, trial, {', '.join(f"max(p{a}) FILTER (place = {i}) AS {n}{a}" for i, n in ((1, 'a'), (2, 'b'), (3, 'c')) for a in 'xyz')},
          {', '.join(f"max(s_id) FILTER (place = {i}) AS k{i}" for i in (1, 2, 3))} FROM lots{no} WHERE place <= 3 GROUP BY sheet, trial HAVING count(*) = 3""",
        f"cross{no}": f"""SELECT *, (by-ay)*(cz-az)-(bz-az)*(cy-ay) AS ux, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS uy, (bx-ax)*(cy-ay)-(by-ay)*(cx-ax) AS uz FROM three{no}""",
        f"plane{no}": f"""SELECT sheet, trial, k1, k2, k3, ax AS rx, ay AS ry, az AS rz, ux/l AS nx, uy/l AS ny, uz/l AS nz
          FROM (SELECT *, sqrt(ux*ux+uy*uy+uz*uz) AS l FROM cross{no}) c WHERE l*l >= 1e-28""",
        f"near{no}": f"SELECT p.sheet, p.trial, q.s_id FROM plane{no} p JOIN {points} q ON q.sheet = p.sheet WHERE abs((q.px-p.rx)*p.nx+(q.py-p.ry)*p.ny+(q.pz-p.rz)*p.nz) < 0.05",
        f"best{no}": f"""SELECT * FROM (SELECT p.*, c.inliers, row_number() OVER (PARTITION BY p.sheet ORDER BY c.inliers DESC, p.trial) AS n
          FROM plane{no} p JOIN (SELECT sheet, trial, count(*) AS inliers FROM near{no} GROUP BY sheet, trial) c ON c.sheet = p.sheet AND c.trial = p.trial) x WHERE n = 1""",
    }


RANSAC = {
    **_ransac_round(1, "ridge"),
    "left1": """SELECT r.* FROM ridge r JOIN best1 b ON b.sheet = r.sheet
      WHERE NOT EXISTS (SELECT 1 FROM near1 x WHERE x.sheet = b.sheet AND x.trial = b.trial AND x.s_id = r.s_id)""",
    **_ransac_round(2, "left1"),
}
RANSAC_COLS = "sheet, inliers, k1, k2, k3, rx, ry, rz, nx, ny, nz"


@query("ransac_planes", sql(
    f"SELECT 1 AS round, {RANSAC_COLS} FROM best1 UNION ALL SELECT 2, {RANSAC_COLS} FROM best2", "ridge", extra=RANSAC, rounded="rx ry rz nx:4 ny:4 nz:4"),
    rounded="rx ry rz nx:4 ny:4 nz:4")
def ransac_planes(t):
    """The picks are columns, so the rows can be recomputed from them."""
    return P.ransac_planes(t.ridge(), "sheet")


DECIMATE = """SELECT s_id, (((s_id*1103515245+12345) % 2147483648) / 2147483648.0 <= {area} / pow({mean} * 0.4, {dims}) / n) AS keep FROM (
 SELECT s_id, lfs, count(*) OVER w AS n, avg(lfs) OVER w AS m, max(pz) OVER w - min(pz) OVER w AS rise FROM (
  SELECT e.s_id, e.pz, l.lfs, {cells} FROM ridge e JOIN lfs l ON l.s_id = e.s_id, (SELECT min(px) AS lox, min(py) AS loy, min(pz) AS loz FROM ridge) b) g
 WINDOW w AS (PARTITION BY {keys})) d"""
RIDGE_LFS = {"lfs": "SELECT s_id, r AS lfs FROM ridge_in"}
CELLS = {2: ("floor((px-lox)/1.5) AS c1, floor((py-loy)/1.5) AS c2", "c1, c2"), 3: ("floor((px-lox)/1.5) AS c1, floor((py-loy)/1.5) AS c2, floor((pz-loz)/1.5) AS c3", "c1, c2, c3")}


def _decimate_sql(dims: int, mean: str) -> str:
    cells, keys = CELLS[dims]
    return sql(DECIMATE.format(area=2.25, mean=mean, dims=dims, cells=cells, keys=keys), "ridge_in", extra=RIDGE_LFS)


def _with_lfs(t):
    return t.ridge().select("s_id", "px", "py", "pz").join(t.ridge_in().select("s_id", F.col("r").alias("lfs")), "s_id")


@query("decimate_grid", _decimate_sql(2, "m"))
def decimate_grid(t):
    return T.decimate(_with_lfs(t), cell=1.5).select("s_id", "keep")


@query("decimate_edge_preserving", _decimate_sql(3, "(CASE WHEN rise > 0.5 THEN m/10 ELSE m END)"))
def decimate_edge_preserving(t):
    return T.decimate(_with_lfs(t), cell=1.5, dims=3, edge_preserve=True).select("s_id", "keep")
