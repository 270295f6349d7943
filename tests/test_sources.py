import numpy as np
from pyspark.sql import functions as F

from ridgeline.operators.atoms import derive_atoms
from ridgeline.sources import arrays, text


def test_arrays_read_in_ranges(spark, tmp_path):
    m = 250
    rng = np.random.default_rng(0)
    coords = rng.random((m, 3)).astype("f4")
    np.save(tmp_path / "coords.npy", coords)
    for side in ("in", "out"):
        np.save(tmp_path / f"ma_coords_{side}.npy", coords - 1)
        np.save(tmp_path / f"ma_qidx_{side}.npy", np.arange(m)[::-1].astype("i8"))
    read = arrays.read_npy_dir(spark, str(tmp_path), keys=["coords", "ma_coords_in", "ma_coords_out", "ma_qidx_in", "ma_qidx_out", "missing"], rows_per_task=100)
    assert "missing" not in read and read["coords"].rdd.getNumPartitions() == 3
    got = read["coords"].orderBy("id").toPandas()
    assert np.array_equal(got[["c0", "c1", "c2"]].to_numpy().astype("f4"), coords)
    surface, mat = arrays.assemble(read)
    assert mat.count() == 2 * m and surface.count() == m
    atoms = derive_atoms(surface, mat)
    assert atoms.count() == 2 * m
    assert atoms.where("abs(r - sqrt(3)) > 1e-4").count() == 0


def test_ply_with_faces(spark, tmp_path):
    body = ["ply", "format ascii 1.0", "comment x", "element vertex 4", "property float nx", "property float ny", "property float nz",
            "property float x", "property float y", "property float z", "element face 2", "property list uchar int vertex_indices", "end_header",
            "0 0 1 5 6 7", "0 0 1 1 0 0", "0 1 0 1 1 0", "1 0 0 0 1 0", "3 0 1 2", "4 0 1 2 3"]
    (tmp_path / "m.ply").write_text("\n".join(body) + "\n")
    vertex, face = text.read_ply(spark, str(tmp_path / "m.ply"))
    assert vertex.orderBy("s_id").select("px", "nz").first() == (5.0, 1.0)
    assert vertex.count() == 4
    assert [r.vertices for r in face.orderBy("f_id").collect()] == [[0, 1, 2], [0, 1, 2, 3]]
    moved, _ = text.read_ply(spark, str(tmp_path / "m.ply"), to_origin=True, limit=2)
    assert [tuple(r) for r in moved.orderBy("s_id").select("px", "py", "pz", "offx").collect()] == [(0.0, 0.0, 0.0, 5.0), (-4.0, -6.0, -7.0, 5.0)]


def test_xyz_limit_and_regions(spark, tmp_path):
    (tmp_path / "p.xyz").write_text("1,2,3,0\n4,5,6,1\n7,8,9,1\n")
    rows = text.read_xyz(spark, str(tmp_path / "p.xyz"), sep=",", limit=2, region=True).orderBy("s_id").collect()
    assert [tuple(r) for r in rows] == [(0, 1.0, 2.0, 3.0, False), (1, 4.0, 5.0, 6.0, True)]


def test_obj_with_other_lines(spark, tmp_path):
    (tmp_path / "m.obj").write_text("o thing\nv 0 0 0\nv 1 0 0\nvn 0 0 1\nv 0 1 0\nusemtl m\nf 1//1 2//1 3//1\n")
    vertex, face = text.read_obj(spark, str(tmp_path / "m.obj"))
    assert [tuple(r) for r in vertex.orderBy("v_id").collect()] == [(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 0.0, 1.0, 0.0)]
    assert [tuple(r) for r in face.collect()] == [(1, 1, 2, 3)]


def test_obj_with_many_corners_and_negative_numbers(spark, tmp_path):
    body = ["v 0 0 0", "v 1 0 0", "v 1 1 0", "f 1 2 3", "v 0 1 0", "f 1 2 3 4", "", "f -4/1 -3/1 -2/1", "v 2 2 2", "f 1 2 3 4 -1"]
    (tmp_path / "q.obj").write_text("\n".join(body) + "\n")
    vertex, face = text.read_obj(spark, str(tmp_path / "q.obj"))
    assert [r.v_id for r in vertex.orderBy("v_id").collect()] == [1, 2, 3, 4, 5]
    expected = [(1, 2, 3), (1, 2, 3), (1, 3, 4), (1, 2, 3), (1, 2, 3), (1, 3, 4), (1, 4, 5)]
    assert [tuple(r) for r in face.orderBy("f_id").collect()] == [(i + 1, *f) for i, f in enumerate(expected)]


def test_blank_lines_do_not_count(spark, tmp_path):
    (tmp_path / "b.xyz").write_text("\n1 2 3\n\n4 5 6\n")
    path = str(tmp_path / "b.xyz")
    assert [tuple(r)[:4] for r in text.read_xyz(spark, path, to_origin=True).orderBy("s_id").collect()] == [(0, 0.0, 0.0, 0.0), (1, 3.0, 3.0, 3.0)]
    assert [tuple(r) for r in text.read_xyz(spark, path, limit=1).collect()] == [(0, 1.0, 2.0, 3.0)]


def test_long_ply_header(spark, tmp_path):
    body = ["ply", "format ascii 1.0", *["comment x"] * 2000, "element vertex 1", "property float x", "property float y", "property float z", "end_header", "1 2 3"]
    (tmp_path / "h.ply").write_text("\n".join(body) + "\n")
    assert [tuple(r) for r in text.read_ply(spark, str(tmp_path / "h.ply"), normals=False)[0].collect()] == [(0, 1.0, 2.0, 3.0)]


def test_line_numbers_over_many_files(spark, tmp_path):
    spark.range(1000).select(F.col("id").cast("string").alias("line")).orderBy("line").write.text(str(tmp_path / "t"))
    rows = text.numbered_lines(spark, str(tmp_path / "t")).orderBy("row").collect()
    assert [r.row for r in rows] == list(range(1000))
    assert [r.value for r in rows] == sorted(str(i) for i in range(1000))
