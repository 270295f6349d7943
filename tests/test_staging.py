"""Tables whose files are far smaller than their rows."""

import math

from ridgeline import staging
from ridgeline.catalog.base import Inputs
from ridgeline.operators import cmap, fitting, growth, reconstruct, tin
from ridgeline.staging import ROWS, stage


def test_parts_are_dealt_to_tasks_by_rows(spark, tmp_path):
    """One small file of many rows must not become one task."""
    spark.range(3 * ROWS).selectExpr("id AS p_partkey", "cast(1 + id % 50 AS int) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    ridge = Inputs(spark, str(tmp_path)).ridge()
    sizes = ridge.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 3 * ROWS and max(sizes) <= math.ceil(1.1 * ROWS)


def broadcasts(monkeypatch, make):
    """Broadcasts that are planned from sizes of files, over all tables that ``make`` stages and the one it returns."""
    plans, write = [], staging.stage_at

    def noted(df, path):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(df, path)

    monkeypatch.setattr(staging, "stage_at", noted)
    plans.append(make()._jdf.queryExecution().sparkPlan().toString())
    return [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line]


def ring(spark, faces=5, size=4):
    """Closed faces of ``size`` half-nodes each: links, and faces as the map has them."""
    nodes = [(10 * f + i, 10 * f) for f in range(faces) for i in range(size)]
    links = [tuple(sorted((10 * f + i, 10 * f + (i + 1) % size))) for f in range(faces) for i in range(size)]
    found = spark.createDataFrame([(h, f, True) for h, f in nodes], "h bigint, face bigint, cycle boolean")
    return stage(spark.createDataFrame(links, "x bigint, y bigint")), stage(found)


def test_walks_and_lines_of_faces_are_not_broadcast(spark, monkeypatch):
    """Ids in files are few bytes a row, so millions of rows would be sent through the driver."""
    links, found = ring(spark)
    planes = stage(spark.range(5).selectExpr("10 * id AS face", "0D AS rx", "0D AS ry", "0D AS rz", "1D AS nx", "0D AS ny", "0D AS nz"))
    nodes = stage(found.selectExpr("h", "1D AS fx", "0D AS fy", "0D AS fz", "0D AS bx", "0D AS by", "1D AS bz"))
    assert broadcasts(monkeypatch, lambda: cmap.face_order(links, found)) == []
    ordered = stage(cmap.face_order(links, found))
    assert ordered.count() == 20 and ordered.where("pos = 3").count() == 5
    assert broadcasts(monkeypatch, lambda: cmap.orient(ordered, nodes)) == []
    assert broadcasts(monkeypatch, lambda: reconstruct.ridge_lines(found, planes)) == []
    assert broadcasts(monkeypatch, lambda: cmap.faces(nodes, links)) == []


def test_balls_and_edges_are_not_broadcast(spark, monkeypatch):
    balls = stage(spark.range(50).selectExpr("id AS ma_id", "cast(0 AS double) AS theta", "1D AS bx", "0D AS by", "0D AS bz"))
    edges = stage(spark.range(49).selectExpr("id AS u", "id + 1 AS v", "1 AS rank", "1D AS d2"))
    assert broadcasts(monkeypatch, lambda: growth.candidate_edges(balls, edges, growth.similar_bisector())) == []


def test_new_points_of_faces_are_not_broadcast(spark, monkeypatch):
    vertex = stage(spark.range(40).selectExpr("id AS v_id", "cast(id % 5 AS double) AS x", "cast(id div 5 AS double) AS y", "1D AS z"))
    face = stage(spark.range(30).where("id % 5 < 4").selectExpr("id AS f_id", "id AS v0", "id + 1 AS v1", "id + 5 AS v2"))
    assert broadcasts(monkeypatch, lambda: tin.densify(vertex, face)) == []
    assert tin.densify(vertex, face).where("z = 1").count() == 24


def test_plane_picks_are_dealt_by_rows(spark, monkeypatch):
    """Small groups make several candidates of each point, so a task must not hold as many points as fit in its bytes."""
    monkeypatch.setattr(staging, "ROWS", 100)
    monkeypatch.setattr(fitting, "ROWS", 100)
    points = spark.range(2000).selectExpr("id AS s_id", "CASE WHEN id < 500 THEN 0 ELSE id div 20 END AS g", "cast(id % 7 AS double) AS px", "cast(id % 11 AS double) AS py", "0D AS pz")
    dealt, repartition = [], staging.spread

    def noted(df, rows, *keys):
        out = repartition(df, rows, *keys)
        dealt.append(max(out.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()))
        return out

    monkeypatch.setattr(fitting, "spread", noted)
    found = {r.g: r for r in fitting.ransac_planes(points.coalesce(1), "g", n_planes=1).collect()}
    assert dealt and max(dealt) <= 400
    assert len(found) == 76 and all(r.inliers == (500 if g == 0 else 20) for g, r in found.items())
