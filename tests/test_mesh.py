"""Locating points on meshes of thin and large faces, and nearest locations beside brute force."""

import numpy as np
import pandas as pd
import pytest

from ridgeline.operators import regions, tin


def mesh(spark, triangles):
    """Each triangle (three rows of x, y, z) with vertices of its own."""
    at = np.asarray(triangles, float).reshape(-1, 3)
    vertex = spark.createDataFrame(pd.DataFrame({"v_id": range(len(at)), "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]}))
    n = len(at) // 3
    face = spark.createDataFrame(pd.DataFrame({"f_id": range(n)} | {f"v{i}": range(i, 3 * n, 3) for i in range(3)}))
    return face, vertex


def table(spark, at):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(at)), "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]}))


def below(points, triangles):
    """Lowest triangle that holds each point in plan, border included."""
    found = {}
    for f, t in enumerate(triangles):
        side = [(t[(i + 1) % 3][0] - t[i][0]) * (points[:, 1] - t[i][1]) - (t[(i + 1) % 3][1] - t[i][1]) * (points[:, 0] - t[i][0]) for i in range(3)]
        flat = (t[1][0] - t[0][0]) * (t[2][1] - t[0][1]) - (t[1][1] - t[0][1]) * (t[2][0] - t[0][0]) == 0
        inside = np.all([s >= 0 for s in side], axis=0) | np.all([s <= 0 for s in side], axis=0)
        for i in np.flatnonzero(inside) if not flat else ():
            found.setdefault(int(i), f)
    return found


def slivers(rng, n):
    """Long thin triangles in all directions, upright and level ones among them."""
    out = []
    for i in range(n):
        start, turn = rng.random(2) * 1000, [0, np.pi / 2, rng.random() * 2 * np.pi][i % 3]
        along, across = np.array([np.cos(turn), np.sin(turn)]), np.array([-np.sin(turn), np.cos(turn)])
        if i % 3 < 2:
            along, across = np.round(along), np.round(across)
        length, width = 200 + rng.random() * 300, 0.2 + rng.random() * 0.3
        corners = [start, start + along * length, start + along * length * rng.random() + across * width]
        out.append([[*c, rng.random()] for c in corners])
    return out


def test_faces_below_points_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    triangles = slivers(rng, 60) + [[[0, 0, 1], [900, 0, 2], [0, 900, 3]], [[5, 5, 0], [6, 6, 0], [7, 7, 0]], [[8, 8, 0], [8, 8, 0], [9, 7, 0]]]
    corners = np.array(triangles).reshape(-1, 3)
    on = corners[rng.integers(0, len(corners), 300)]
    points = np.vstack([rng.random((800, 3)) * 1000, on, (on + corners[rng.integers(0, len(corners), 300)]) / 2])
    got = {r.id: r.f_id for r in tin.locate_on_mesh(table(spark, points), *mesh(spark, triangles)).collect() if r.f_id is not None}
    assert got == below(points, triangles)


def test_thin_faces_meet_few_points(spark):
    rng = np.random.default_rng(2)
    face, vertex = mesh(spark, slivers(rng, 2000))
    points = table(spark, rng.random((20_000, 3)) * 1000)
    met = tin._met(points, tin.corners(face, vertex), "id").count()
    inside = tin.locate_on_mesh(points, face, vertex).where("f_id is not null").count()
    assert inside > 1000 and met <= 8 * 20_000  # each face crosses the cells of 2,000 others


@pytest.mark.parametrize("size", [4096, 25])
def test_nearest_location_equals_brute_force(spark, monkeypatch, size):
    """Faces without area and long ones too, with one region and with many."""
    monkeypatch.setattr(regions, "SIZE", size)
    rng = np.random.default_rng(3)
    small = [(rng.random(3) * 50)[None] + rng.random((3, 3)) for _ in range(150)]
    triangles = [t.tolist() for t in small] + slivers(rng, 5) + [[[1, 1, 1]] * 3, [[2, 2, 2], [3, 3, 3], [4, 4, 4]]]
    points = rng.random((200, 3)) * 60 - 5
    found = tin.nearest_on_mesh(table(spark, points), *mesh(spark, triangles)).toPandas().sort_values("id")
    # brute force: the foot in the plane where it is inside, else the closest of many places on the sides
    for row, p in zip(found.itertuples(), points):
        best = np.inf
        for t in np.array(triangles):
            u, v = t[1] - t[0], t[2] - t[0]
            g = np.array([[u @ u, u @ v], [u @ v, v @ v]])
            if abs(np.linalg.det(g)) > 1e-12:
                s, w = np.linalg.solve(g, [u @ (p - t[0]), v @ (p - t[0])])
                if s >= 0 and w >= 0 and s + w <= 1:
                    best = min(best, np.sum((p - t[0] - s * u - w * v) ** 2))
            for i in range(3):
                e = t[(i + 1) % 3] - t[i]
                share = np.clip(e @ (p - t[i]) / (e @ e), 0, 1) if e @ e else 0
                best = min(best, np.sum((p - t[i] - share * e) ** 2))
        assert row.d2 == pytest.approx(best, rel=1e-9, abs=1e-12)
        assert np.sum((np.array([row.fx, row.fy, row.fz]) - p) ** 2) == pytest.approx(row.d2, rel=1e-9, abs=1e-12)
