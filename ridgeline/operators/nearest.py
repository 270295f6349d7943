"""Exact nearest-neighbour joins; the search itself is in ``regions``.

Copies at one location are reduced to the ``k + 1`` lowest ids before anything is joined, which is exact because
ties go to the lower id, and a location is asked for once however many points lie there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.regions import nearest
from ridgeline.staging import large, stage


def places(points: DataFrame, key: str, prefix: str, keep: int) -> DataFrame:
    """``id, xs, ids``: distinct locations with their ``keep`` lowest ids; ``id`` is the lowest.  Missing and NaN
    coordinates are left out."""
    at = points.selectExpr(f"{key} AS id", *(f"cast({prefix}{a} AS double) + 0D AS {a}" for a in "xyz"))
    at = at.where(" AND ".join(f"{a} IS NOT NULL AND NOT isnan({a})" for a in "xyz"))
    low = at.withColumn("_n", F.expr("row_number() OVER (PARTITION BY x, y, z ORDER BY id)")).where(f"_n <= {keep}")
    held = low.groupBy("x", "y", "z").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return held.selectExpr("ids[0] AS id", "array(x, y, z) AS xs", "ids")


def knn(
    queries: DataFrame, k: int, *, key: str = "ma_id", prefix: str = "c",
    points: DataFrame | None = None, points_key: str = "ma_id", points_prefix: str = "c",
) -> DataFrame:
    """Exact ``k`` nearest neighbours: ``u, v, rank, d2``, ordered by (d2, id).

    Without ``points`` it is a self join and every point is left out of its own list, by id.
    """
    itself = points is None
    need = k + 1 if itself else k
    asked = stage(places(queries, key, prefix, need if itself else 1), "places")
    held = asked if itself else places(points, points_key, points_prefix, need)
    items = stage(held.select(F.explode("ids").alias("id"), "xs"), "points")
    lists = nearest(asked.select("id", "xs"), items, need)
    at = [f"xs[{i}] AS q{a}" for i, a in enumerate("xyz")]
    rows = queries.selectExpr(f"{key} AS u", *(f"cast({prefix}{a} AS double) + 0D AS q{a}" for a in "xyz"))
    rows = rows.join(large(lists.selectExpr("found", *at)), ["qx", "qy", "qz"])
    # a self join asked for one more; whether or not the point is listed itself, k remain
    others = f"slice(filter(found, e -> e.id <> u), 1, {k})" if itself else "found"
    return rows.selectExpr("u", f"posexplode({others}) AS (pos, e)").selectExpr("u", "e.id AS v", "pos + 1 AS rank", "e.d2 AS d2")
