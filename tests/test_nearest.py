import numpy as np
import pandas as pd
import pytest

from ridgeline.operators import regions
from ridgeline.operators.nearest import knn


def frame(spark, xyz, key="ma_id", prefix="c"):
    return spark.createDataFrame(pd.DataFrame({key: np.arange(len(xyz)), **{f"{prefix}{a}": xyz[:, i] for i, a in enumerate("xyz")}}))


def brute(queries, points, k, itself):
    gap = (queries[:, None] - points[None]) ** 2
    key = gap[..., 0] + gap[..., 1] + gap[..., 2]
    out = []
    for i, row in enumerate(key):
        order = np.lexsort((np.arange(len(points)), row))
        out.append([int(j) for j in order if not (itself and j == i)][:k])
    return out


def lists(df):
    rows = df.toPandas().sort_values(["u", "rank"])
    return {u: g["v"].tolist() for u, g in rows.groupby("u")}


def clouds():
    rng = np.random.default_rng(3)
    even = rng.random((400, 3))
    skewed = np.vstack([rng.random((150, 3)) * 100, 50 + rng.random((150, 3)) * 1e-3, np.repeat([[7.0, 7.0, 7.0]], 100, axis=0)])
    return {"even": even, "skewed": np.round(skewed, 9)}


@pytest.mark.parametrize("size", [4096, 40])
@pytest.mark.parametrize("name", ["even", "skewed"])
def test_self_join_is_exact(spark, monkeypatch, name, size):
    """Also with many small regions, so that most queries are asked in several."""
    monkeypatch.setattr(regions, "SIZE", size)
    xyz = clouds()[name]
    got = lists(knn(frame(spark, xyz), 9))
    expected = brute(xyz, xyz, 9, True)
    assert [got[i] for i in range(len(xyz))] == expected


@pytest.mark.parametrize("unit", [1e-6, 1.0, 1e6])
def test_order_does_not_depend_on_the_unit(spark, unit):
    xyz = np.vstack([np.random.default_rng(8).random((120, 3)), [[50.0, 0, 0]]]) * unit
    got = lists(knn(frame(spark, xyz), 5))
    assert [got[i] for i in range(len(xyz))] == brute(xyz, xyz, 5, True)


@pytest.mark.parametrize(("size", "asked"), [(4096, 1 << 16), (20, 7)])
def test_two_tables(spark, monkeypatch, size, asked):
    """Queries far from all points and regions with fewer points than neighbours; many queries for a region."""
    monkeypatch.setattr(regions, "SIZE", size)
    monkeypatch.setattr(regions, "ASKED", asked)
    rng = np.random.default_rng(5)
    queries, points = rng.normal(size=(60, 3)) * 3, rng.normal(size=(300, 3))
    got = lists(knn(frame(spark, queries, "s_id", "p"), 4, key="s_id", prefix="p", points=frame(spark, points)))
    assert [got[i] for i in range(len(queries))] == brute(queries, points, 4, False)


def test_fewer_points_than_neighbours_and_missing_balls(spark):
    xyz = np.array([[0.0, 0, 0], [1, 0, 0], [5, 0, 0], [np.nan, 0, 0]])
    got = lists(knn(frame(spark, xyz), 9))
    assert got == {0: [1, 2], 1: [0, 2], 2: [1, 0]}


def test_a_task_answers_several_regions(spark, monkeypatch):
    """Tasks of the search follow the regions at a fraction, and no query is lost where regions share a task."""
    rng = np.random.default_rng(5)
    at = rng.random((4000, 3))
    monkeypatch.setattr(regions, "SIZE", 8)
    whole, tasks = regions._asked, []

    def counted(*given):
        found = whole(*given)
        tasks.append(found.rdd.getNumPartitions())
        return found

    monkeypatch.setattr(regions, "_asked", counted)
    items = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(at)], "id bigint, xs array<double>")
    found = {r.id: r.found[0] for r in regions.nearest(items.where("id % 5 = 0"), items.where("id % 5 <> 0"), 1).collect()}
    assert len(tasks) == 2 and max(tasks) <= 100  # 512 regions
    other = np.flatnonzero(np.arange(4000) % 5)
    for i in range(0, 4000, 5):
        gap = at[other] - at[i]
        d2 = gap[:, 0] ** 2 + gap[:, 1] ** 2 + gap[:, 2] ** 2
        assert (found[i].d2, found[i].id) == (d2.min(), other[np.argmin(d2)])
    assert len(found) == 800
