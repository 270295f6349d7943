"""Round trips through the text formats and table folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.catalog.atoms import v3
from ridgeline.catalog.base import query, sql
from ridgeline.sources import tables as S
from ridgeline.sources import text as X
from ridgeline.staging import new_path

POINTS = "SELECT s_id, px, py, pz FROM ridge"


def ridge_points(t):
    return t.ridge().select("s_id", "px", "py", "pz")


@query("xyz_round_trip", sql("SELECT row_number() OVER (ORDER BY s_id) - 1 AS s_id, px, py, pz FROM ridge", "ridge", rounded=v3("p")), rounded=v3("p"))
def xyz_round_trip(t):
    path = new_path(t.spark, "xyz")
    X.write_xyz(ridge_points(t), path)
    return X.read_xyz(t.spark, path)


@query("xyz_to_origin", sql(
    "SELECT row_number() OVER (ORDER BY s_id) - 1 AS s_id, " + ", ".join(f"p{a} - first_value(p{a}) OVER (ORDER BY s_id) AS p{a}" for a in "xyz") + " FROM ridge", "ridge", rounded=v3("p")), rounded=v3("p"))
def xyz_to_origin(t):
    path = new_path(t.spark, "xyz")
    X.write_xyz(ridge_points(t), path)
    return X.read_xyz(t.spark, path, to_origin=True).select("s_id", "px", "py", "pz")


@query("xyz_colours", sql("SELECT s_id - (SELECT min(s_id) FROM ridge) AS s_id, CAST((s_id % 256) / 255.0 AS DOUBLE) AS red, CAST(1 AS DOUBLE) AS alpha FROM ridge", "ridge", rounded="red:5"), rounded="red:5")
def xyz_colours(t):
    path = new_path(t.spark, "xyz")
    tinted = t.ridge().withColumns({"red": F.col("s_id") % 256, "green": F.lit(7), "blue": F.lit(9)})
    X.write_xyz(tinted, path, columns=["px", "py", "pz", "red", "green", "blue"])
    back = X.read_xyz(t.spark, path, rgb=True, rgb_divider=255)
    return back.select("s_id", F.col("rgba")[0].cast("double").alias("red"), F.col("rgba")[3].cast("double").alias("alpha"))


@query("xyz_bounds", sql("SELECT " + ", ".join(f"min(p{a}) AS lo{a}, max(p{a}) AS hi{a}" for a in "xyz") + " FROM ridge", "ridge", rounded=f"{v3('lo')} {v3('hi')}"), rounded=f"{v3('lo')} {v3('hi')}")
def xyz_bounds(t):
    path = new_path(t.spark, "xyz")
    X.write_xyz(ridge_points(t), path, decimals=2, bounds=path + ".bounds")
    return X.read_bounds(t.spark, path + ".bounds")


@query("ply_round_trip", sql("SELECT row_number() OVER (ORDER BY s_id) - 1 AS s_id, px, py, pz, nx, ny, nz FROM ridge", "ridge", rounded=f"{v3('p')} {v3('n')}"), rounded=f"{v3('p')} {v3('n')}")
def ply_round_trip(t):
    path = new_path(t.spark, "ply")
    X.write_ply(t.ridge(), path, normals=True)
    return X.read_ply(t.spark, path)[0]


@query("obj_round_trip", sql(
    "SELECT v_id + 1 AS v_id, x - (SELECT (min(x)+max(x))/2 FROM tin_vertex) AS x, y - (SELECT (min(y)+max(y))/2 FROM tin_vertex) AS y, 2*(z - (SELECT (min(z)+max(z))/2 FROM tin_vertex)) AS z FROM (SELECT row_number() OVER (ORDER BY v_id) - 1 AS v_id, x, y, z FROM tin_vertex) v",
    "tin_vertex", rounded="x y z"), rounded="x y z")
def obj_round_trip(t):
    path = new_path(t.spark, "obj")
    X.write_obj(t.tin_vertex(), t.tin_face(), path, z_scale=2.0)
    return X.read_obj(t.spark, path)[0]


@query("obj_faces", sql("SELECT row_number() OVER (ORDER BY f_id) AS f_id, v0 - lo + 1 AS v0, v1 - lo + 1 AS v1, v2 - lo + 1 AS v2 FROM tin_face, (SELECT min(v_id) AS lo FROM tin_vertex) m", "tin_vertex", "tin_face"))
def obj_faces(t):
    path = new_path(t.spark, "obj")
    X.write_obj(t.tin_vertex(), t.tin_face(), path)
    return X.read_obj(t.spark, path)[1]


@query("table_round_trip", sql(POINTS, "ridge", rounded=v3("p")), rounded=v3("p"))
def table_round_trip(t):
    folder = new_path(t.spark, "tables")
    S.write_tables({"surface": ridge_points(t), "unused": t.tin_face()}, folder, only=["surface"])
    return S.read_tables(t.spark, folder, ["surface"])["surface"]
