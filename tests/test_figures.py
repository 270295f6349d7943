import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import analysis, clusters, fitting, growth, thinning


def points(spark, xyz, **extra):
    return spark.createDataFrame(pd.DataFrame({"s_id": np.arange(len(xyz)), **extra, **{f"p{a}": xyz[:, i] for i, a in enumerate("xyz")}}))


def test_planes_and_lines_match_eigenvectors(spark):
    rng = np.random.default_rng(1)
    parts, groups = [], []
    for g in range(6):
        turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        parts.append(1e4 + (rng.normal(size=(50, 3)) * [5, 2, 0.1]) @ turn.T)
        groups += [g] * 50
    xyz = np.vstack(parts)
    df = points(spark, xyz, g=groups)
    planes = {r.g: r for r in fitting.fit_plane(df, ["g"]).collect()}
    lines = {r.g: r for r in fitting.fit_line(df, ["g"]).collect()}
    for g, part in enumerate(parts):
        _, vectors = np.linalg.eigh(np.cov((part - part.mean(0)).T))
        assert abs(abs(np.dot(vectors[:, 0], [planes[g].nx, planes[g].ny, planes[g].nz])) - 1) < 1e-9
        assert abs(abs(np.dot(vectors[:, 2], [lines[g].tx, lines[g].ty, lines[g].tz])) - 1) < 1e-9


def test_degenerate_fits_have_no_normal(spark):
    xyz = np.array([[0.0, 0, 0], [1, 1, 1], [2, 2, 2], [5, 5, 5], [0, 0, 0], [1, 0, 0]])
    rows = {r.g: r.nx for r in fitting.fit_plane(points(spark, xyz, g=[0, 0, 0, 0, 1, 1]), ["g"]).collect()}
    assert rows == {0: None, 1: None}


def test_p_values(spark):
    # two-sided t probabilities: r = 0.5 with n = 12, and r = 0.9 with n = 5
    df = spark.createDataFrame([(0.5, 12), (0.9, 5), (0.0, 8), (1.0, 4), (None, 9), (0.3, 2)], "r double, n bigint")
    got = [row.p for row in df.select(analysis.two_sided_p("r", "n").alias("p")).collect()]
    assert got[0] == pytest.approx(0.09785461, abs=1e-6)
    assert got[1] == pytest.approx(0.03738607, abs=1e-6)
    assert got[2] == pytest.approx(1.0, abs=1e-9)
    assert got[3] == pytest.approx(0.0, abs=1e-9)
    assert got[4] is None or math.isnan(got[4])
    assert got[5] == 0.0


def test_ransac_finds_both_planes(spark):
    rng = np.random.default_rng(2)
    flat = np.column_stack([rng.random((60, 2)) * 10, np.zeros(60)])
    wall = np.column_stack([np.full(40, 20.0), 1 + rng.random((40, 2)) * 10])
    df = points(spark, np.vstack([flat, wall]), g=[1] * 100)
    rows = fitting.ransac_planes(df, "g", iterations=40).orderBy("round").collect()
    assert [r.inliers for r in rows] == [60, 40]
    assert abs(rows[0].nz) == pytest.approx(1) and abs(rows[1].nx) == pytest.approx(1)


def test_small_and_unlinked_clusters(spark):
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "seg bigint, cluster bigint")
    links = spark.createDataFrame([(1, 2, 30, False)], "a bigint, b bigint, adj_count bigint, is_fliprel boolean")
    sheets = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "seg bigint, theta_mean double")
    atoms = spark.createDataFrame([(i, 1.0, 0.5) for i in range(5)], "ma_id bigint, theta double, bz double")
    labels = spark.createDataFrame([(i, 1) for i in range(5)], "ma_id bigint, seg bigint")
    rows = {r.cluster: r["class"] for r in clusters.classify(found, links, sheets, atoms, labels).collect()}
    assert rows == {1: 2, 2: 0}


def test_flat_top_has_four_mappings(spark):
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 3), (0, 2)], "a bigint, b bigint")
    rows = {tuple(r) for r in clusters.match_flat_top(links).collect()}
    assert rows == {(0, 1, 2, 3), (0, 3, 2, 1), (2, 1, 0, 3), (2, 3, 0, 1)}


def test_relabel_keeps_zero(spark):
    labels = spark.createDataFrame([(0, 70), (1, 0), (2, 9), (3, 70)], "ma_id bigint, seg bigint")
    assert {r.ma_id: r.seg for r in growth.relabel(labels).collect()} == {0: 2, 1: 0, 2: 1, 3: 2}


def test_thinning_keeps_points_of_sparse_cells(spark):
    df = points(spark, np.array([[0.0, 0, 0], [10, 10, 0]]), lfs=[0.5, 0.5])
    assert thinning.decimate(df, cell=0.5).where("keep").count() == 2
    with pytest.raises(ValueError):
        thinning.decimate(df, dims=4)


def test_sqrt_variant_of_feature_size(spark):
    near = spark.createDataFrame([(1, 5, 1, 4.0), (1, 6, 2, 16.0), (1, 7, 3, 36.0)], "u bigint, v bigint, rank int, d2 double")
    plain = thinning.local_feature_size(None, None, k=3, near=near).collect()[0].lfs
    rooted = thinning.local_feature_size(None, None, k=3, near=near, sqrt_compat=True).collect()[0].lfs
    assert plain == 4.0 and rooted == 2.0


def test_thinning_takes_large_ids(spark):
    from ridgeline.operators.thinning import hashed_uniform

    rows = spark.createDataFrame([(9_000_000_000,), (10**12,), (7,)], "k bigint").select("k", hashed_uniform(F.col("k")).alias("u")).collect()
    assert {r.k: r.u for r in rows} == {k: (k * 1103515245 + 12345) % 2**31 / 2**31 for k in (9_000_000_000, 10**12, 7)}


def test_running_mean_growth_goes_to_the_end_of_a_strip(spark):
    from ridgeline.operators.growth import segment_running_mean

    n = 56
    atoms = spark.createDataFrame([(i, 0.0, 0.0, 1.0, 1.0) for i in range(n)], "ma_id bigint, bx double, by double, bz double, theta double")
    edges = [(i, j, 1) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n]
    found = segment_running_mean(atoms, edges=spark.createDataFrame(edges, "u bigint, v bigint, rank int"), mincount=2)
    assert {r.seg for r in found.collect()} == {1}


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    from ridgeline.staging import staging_root

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        staging_root(session)


def test_flat_top_pattern_at_a_hub(spark):
    ring = [(0, i) for i in range(1, 2001)] + [(1, 2), (2, 3)]
    links = spark.createDataFrame(ring, "a bigint, b bigint")
    found = {tuple(r) for r in clusters.match_flat_top(links).collect()}
    assert found == {(0, 1, 2, 3), (0, 3, 2, 1), (2, 1, 0, 3), (2, 3, 0, 1)}


def test_faces_without_area_are_left_out_of_location(spark):
    from ridgeline.operators.tin import locate_on_mesh

    vertex = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 1.0), (2, 0.0, 1.0, 1.0), (3, 5.0, 5.0, 0.0)], "v_id bigint, x double, y double, z double")
    face = spark.createDataFrame([(i, 3, 3, 3) for i in range(50)] + [(99, 0, 1, 2), (98, 0, 1, 1)], "f_id bigint, v0 bigint, v1 bigint, v2 bigint")
    points = spark.createDataFrame([(1, 0.2, 0.2), (2, 5.0, 5.0)], "id bigint, x double, y double")
    assert {tuple(r) for r in locate_on_mesh(points, face, vertex).collect()} == {(1, 99, 1.0), (2, None, None)}
