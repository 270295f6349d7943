"""Input adapters, registration and rounding shared by all catalogue queries.

The given tables hold no point clouds, so three clouds are derived from them by SQL that
both engines run: ``emb`` (labelled cloud from the embeddings), ``ridge`` (exact two-plane
roof ridges from the parts) and the grid mesh ``tin_vertex``/``tin_face`` (from the parts).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators import atoms as A
from ridgeline.operators.nearest import knn
from ridgeline.staging import spread, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EMB = """
SELECT s_id, label, px, py, pz, ax/l AS nx, ay/l AS ny, az/l AS nz,
 px - r*ax/l AS cix, py - r*ay/l AS ciy, pz - r*az/l AS ciz, px + r*ax/l AS cox, py + r*ay/l AS coy, pz + r*az/l AS coz,
 (s_id*7+3) % (SELECT count(*) FROM embeddings) AS qin, (s_id*11+5) % (SELECT count(*) FROM embeddings) AS qout,
 1 + label AS seg_in, CASE WHEN s_id % 5 = 0 THEN 0 ELSE 1 + (label + s_id % 3) % 10 END AS seg_out
FROM (SELECT *, sqrt(ax*ax+ay*ay+az*az) AS l FROM (
 SELECT CAST(vec_id AS BIGINT) AS s_id, CAST(label AS BIGINT) AS label,
  10*CAST(embedding[{0}] AS DOUBLE) AS px, 10*CAST(embedding[{1}] AS DOUBLE) AS py, 10*CAST(embedding[{2}] AS DOUBLE) AS pz,
  CAST(embedding[{3}] AS DOUBLE) AS ax, CAST(embedding[{4}] AS DOUBLE) AS ay, CAST(embedding[{5}] AS DOUBLE) AS az,
  0.5+10*abs(CAST(embedding[{6}] AS DOUBLE)) AS r FROM embeddings) e0) e1"""

RIDGE = """
SELECT s_id, CAST(b AS BIGINT) AS b, CAST(face AS BIGINT) AS face, CAST(alpha AS DOUBLE) AS alpha, CAST(t AS DOUBLE) AS t,
 CAST(1 + 2*b + half AS BIGINT) AS sheet,
 CAST(round(x0 + (1-2*face)*t*sin(alpha/2),6) AS DOUBLE) AS px, CAST(round(y,6) AS DOUBLE) AS py, CAST(round(10 - t*cos(alpha/2),6) AS DOUBLE) AS pz,
 CAST(round((1-2*face)*cos(alpha/2),6) AS DOUBLE) AS nx, CAST(0.0 AS DOUBLE) AS ny, CAST(round(sin(alpha/2),6) AS DOUBLE) AS nz,
 CAST(round(x0,6) AS DOUBLE) AS cix, CAST(round(y,6) AS DOUBLE) AS ciy, CAST(round(10 - t/cos(alpha/2),6) AS DOUBLE) AS ciz,
 CAST(s_id + 1 - 2*face AS BIGINT) AS qin,
 CAST(round(x0 + (1-2*face)*(t*sin(alpha/2)+200*cos(alpha/2)),6) AS DOUBLE) AS cox, CAST(round(y,6) AS DOUBLE) AS coy,
 CAST(round(10 - t*cos(alpha/2)+200*sin(alpha/2),6) AS DOUBLE) AS coz, CAST((s_id*7+3) % (SELECT count(*) FROM part) AS BIGINT) AS qout
FROM (
 SELECT s_id, b, j % 2 AS face, CAST(floor(j/50) AS BIGINT) AS half,
  CASE (b + CAST(floor(j/50) AS BIGINT)) % 3 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(1.5707963267948966 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END AS alpha,
  CAST(0.5 AS DOUBLE) + CAST(floor(j/2) AS BIGINT) % 10 * CAST(0.25 AS DOUBLE) + ((CAST(floor(s_id/2) AS BIGINT)*7919) % 1009)/CAST(10090 AS DOUBLE) AS t,
  CAST(floor(j/20) AS BIGINT)*CAST(0.3 AS DOUBLE) + ((CAST(floor(s_id/2) AS BIGINT)*104729) % 997)/CAST(9970 AS DOUBLE) AS y, CAST(20 AS DOUBLE)*b AS x0
 FROM (SELECT p_partkey AS s_id, CAST(floor(p_partkey/100) AS BIGINT) AS b, p_partkey % 100 AS j FROM part) r0) r1"""

TIN_VERTEX = """
SELECT CAST(p_partkey AS BIGINT) AS v_id, CAST(p_partkey % 20 AS DOUBLE) AS x, CAST(floor(p_partkey/20) AS DOUBLE) AS y,
 CAST(p_size AS DOUBLE) AS z, p_partkey % 10 = 0 AS flag FROM part"""

TIN_FACE = """
SELECT CAST(2*p_partkey AS BIGINT) AS f_id, CAST(p_partkey AS BIGINT) AS v0, CAST(p_partkey+1 AS BIGINT) AS v1, CAST(p_partkey+20 AS BIGINT) AS v2
FROM part WHERE p_partkey % 20 < 19 AND p_partkey + 20 < (SELECT count(*) FROM part)
UNION ALL SELECT CAST(2*p_partkey+1 AS BIGINT), CAST(p_partkey+1 AS BIGINT), CAST(p_partkey+21 AS BIGINT), CAST(p_partkey+20 AS BIGINT)
FROM part WHERE p_partkey % 20 < 19 AND p_partkey + 20 < (SELECT count(*) FROM part)"""


def atoms_cte(src: str) -> str:
    """SQL for the derived balls of an adapter, without centring."""
    def unit(v, length):
        return ", ".join(f"{v}{a}/{length} AS {v}{a}h" for a in "xyz")
    return f"""
SELECT ma_id, s_id, side, q_id, r, acos(greatest(-1.0, least(1.0, f1xh*f2xh+f1yh*f2yh+f1zh*f2zh))) AS theta, cx,cy,cz, px,py,pz, qx,qy,qz,
 f1x,f1y,f1z, f2x,f2y,f2z, (f1xh+f2xh)/bl AS bx, (f1yh+f2yh)/bl AS by, (f1zh+f2zh)/bl AS bz,
 f1y*f2z-f1z*f2y AS kx, f1z*f2x-f1x*f2z AS ky, f1x*f2y-f1y*f2x AS kz, seg
FROM (SELECT *, nullif(sqrt((f1xh+f2xh)*(f1xh+f2xh)+(f1yh+f2yh)*(f1yh+f2yh)+(f1zh+f2zh)*(f1zh+f2zh)),0) AS bl
 FROM (SELECT *, {unit('f1', 'r')}, {unit('f2', 'r2')} FROM (
  SELECT *, sqrt(f1x*f1x+f1y*f1y+f1z*f1z) AS r, sqrt(f2x*f2x+f2y*f2y+f2z*f2z) AS r2 FROM (
   SELECT b.*, p.px,p.py,p.pz, q.px AS qx,q.py AS qy,q.pz AS qz,
    p.px-b.cx AS f1x, p.py-b.cy AS f1y, p.pz-b.cz AS f1z, q.px-b.cx AS f2x, q.py-b.cy AS f2y, q.pz-b.cz AS f2z
   FROM (SELECT s_id AS ma_id, s_id, 'in' AS side, cix AS cx, ciy AS cy, ciz AS cz, qin AS q_id, {'seg_in' if src == 'emb' else 'sheet'} AS seg FROM {src}
         UNION ALL SELECT s_id + (SELECT max(s_id)+1 FROM {src}), s_id, 'out', cox, coy, coz, qout, {'seg_out' if src == 'emb' else '0'} FROM {src}) b
   JOIN {src} p ON p.s_id = b.s_id JOIN {src} q ON q.s_id = b.q_id) s1) s2) s3) s4"""


def knn_cte(src: str, k: int) -> str:
    """Neighbour edges by brute force, ranked as the library ranks them."""
    return f"""
SELECT u, v, rank, d2 FROM (SELECT u, v, d2, row_number() OVER (PARTITION BY u ORDER BY d2, v) AS rank FROM (
 SELECT a.ma_id AS u, b.ma_id AS v, (a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz) AS d2
 FROM {src} a JOIN {src} b ON a.ma_id <> b.ma_id) k0) k1 WHERE rank <= {k}"""


CTES = {
    "emb": (EMB.format(*range(1, 8)), []),
    "ridge": (RIDGE, []),
    "tin_vertex": (TIN_VERTEX, []),
    "tin_face": (TIN_FACE, []),
    "emb_atoms": (atoms_cte("emb"), ["emb"]),
    "ridge_atoms": (atoms_cte("ridge"), ["ridge"]),
    "ridge_in": ("SELECT * FROM ridge_atoms WHERE side = 'in'", ["ridge_atoms"]),
    "emb_knn": (knn_cte("emb_atoms", 24), ["emb_atoms"]),
    "ridge_knn": (knn_cte("ridge_in", 24), ["ridge_in"]),
}


def sql(body: str, *names: str, extra: dict[str, str] | None = None, rounded: str = "", digits: int = 6) -> str:
    """Put the named adapters, then ``extra`` definitions, before ``body``."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][1]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({CTES[n][0]})" for n in order] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    if rounded:
        fixes = ", ".join(f"round({c}, {d}) + 0.0 AS {c}" for c, d in _digits(rounded, digits))
        body = f"SELECT * REPLACE ({fixes}) FROM ({body}) last_step"
    text = ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
    return re.sub(r'(?<![\w."])by(?![\w"])', '"by"', text)  # a column named like a keyword


def _digits(rounded: str, digits: int) -> list[tuple[str, int]]:
    """'a b:4' -> [('a', digits), ('b', 4)]."""
    out = []
    for word in rounded.split():
        name, _, own = word.partition(":")
        out.append((name, int(own or digits)))
    return out


class Inputs:
    """Derived tables of one scale folder; shared ones are staged once per session."""

    _shared: dict[tuple, DataFrame] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _key(self, name: str) -> tuple:
        return (self.spark.sparkContext.applicationId, self.folder, name)

    def share(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = self._key(name)
        if key not in Inputs._shared:
            Inputs._shared[key] = stage(make(), name)
        return Inputs._shared[key]

    @classmethod
    def forget(cls) -> None:
        cls._shared.clear()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def part(self) -> DataFrame:
        """``part`` in tasks of bounded rows: its files are small and every row becomes balls or faces."""
        rows = self.table("part")
        return spread(rows, rows.count())

    def adapter(self, text: str, *names: str) -> DataFrame:
        for name in names:
            text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
        return self.spark.sql(text, **{name: self.part() if name == "part" else self.table(name) for name in names})

    def emb(self) -> DataFrame:
        return self.adapter(EMB.format(*range(7)), "embeddings")

    def ridge(self) -> DataFrame:
        return self.adapter(RIDGE, "part")

    def tin_vertex(self) -> DataFrame:
        return self.adapter(TIN_VERTEX, "part")

    def tin_face(self) -> DataFrame:
        return self.adapter(TIN_FACE, "part")

    def emb_atoms(self) -> DataFrame:
        wide = self.emb()
        return self.share("emb_atoms", lambda: A.derive_atoms(wide, A.stack_sides(wide), center=False))

    def ridge_atoms(self) -> DataFrame:
        wide = self.ridge()
        return self.share("ridge_atoms", lambda: A.derive_atoms(wide, A.stack_sides(wide), center=False))

    def ridge_in(self) -> DataFrame:
        return self.ridge_atoms().where("side = 'in'")

    def emb_labels(self) -> DataFrame:
        wide = self.emb()
        pair = F.array(F.struct(F.lit("in").alias("side"), F.col("seg_in").alias("seg")), F.struct(F.lit("out").alias("side"), F.col("seg_out").alias("seg")))
        labels = wide.select("s_id", F.explode(pair).alias("e")).select("s_id", "e.side", F.col("e.seg").cast("bigint").alias("seg"))
        return self.emb_atoms().select("ma_id", "s_id", "side").join(labels, ["s_id", "side"]).select("ma_id", "seg")

    def ridge_labels(self) -> DataFrame:
        sheets = self.ridge().select("s_id", F.col("sheet").alias("seg"))
        return self.ridge_in().select("ma_id", "s_id").join(sheets, "s_id").select("ma_id", "seg")

    def emb_knn(self) -> DataFrame:
        return self.share("emb_knn", lambda: knn(self.emb_atoms(), 24))

    def ridge_knn(self) -> DataFrame:
        return self.share("ridge_knn", lambda: knn(self.ridge_in(), 24))


def query(name: str, oracle: str | None = None, *, rounded: str = "", digits: int = 6):
    """Register ``fn(inputs) -> DataFrame``; ``rounded`` columns are rounded as in the SQL."""

    def register(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = fn(Inputs(spark, folder))
            if rounded:
                df = df.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in _digits(rounded, digits)})
            return df

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register
