"""The whole path as one resumable job."""

import os

import numpy as np
import pytest

from ridgeline.catalog import maps
from ridgeline.catalog.base import Inputs
from ridgeline.operators import atoms as A
from ridgeline.plans import pipeline

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def cube_steps(t):
    wide = maps.cube(t)
    labels = wide.selectExpr("s_id AS ma_id", "sheet AS seg")
    return pipeline.steps_to_triangles(wide, A.stack_sides(wide), labels=labels, links=maps.cube_links(t))


def test_a_lost_run_goes_on_where_it_ended(spark, tmp_path):
    steps, made = cube_steps(Inputs(spark, FOLDER)), []

    def counted(step, fails):
        def make(*tables):
            made.append(step.name)
            if fails:
                raise RuntimeError("the driver is lost")
            return step.make(*tables)

        return pipeline.Step(step.name, step.needs, make)

    out = str(tmp_path / "out")
    with pytest.raises(RuntimeError):
        pipeline.Job(spark, out, pipeline.RESULTS).run([counted(s, s.name == "oriented") for s in steps])
    before = list(made)
    assert before[-1] == "oriented" and "left" in before
    made.clear()
    job = pipeline.Job(spark, out, pipeline.RESULTS)
    job.run([counted(s, False) for s in steps])
    assert made == ["oriented", "triangles"]  # what was finished is found again
    assert sorted(f for f in os.listdir(out) if f != "_spent") == ["faces", "figures", "labels", "triangles"]  # spent ones are gone
    assert not job.table("triangles").isEmpty()
    made.clear()
    pipeline.Job(spark, out, pipeline.RESULTS).run([counted(s, False) for s in steps])
    assert made == []


def test_arrays_to_triangles_and_clusters(spark, tmp_path):
    """From array files on, with growth and clusters, both sides and the interior alone."""
    t = Inputs(spark, FOLDER)
    rows = t.ridge().orderBy("s_id").toPandas()
    folder = tmp_path / "arrays"
    folder.mkdir()
    np.save(folder / "coords.npy", rows[["px", "py", "pz"]].to_numpy())
    for side, q in (("in", "qin"), ("out", "qout")):
        np.save(folder / f"ma_coords_{side}.npy", rows[[f"c{side[0]}{a}" for a in "xyz"]].to_numpy())
        np.save(folder / f"ma_qidx_{side}.npy", rows[q].to_numpy(np.int64))
    first = int(rows.s_id.min())
    assert first == 0 or (rows.s_id.to_numpy() == np.arange(len(rows)) + first).all()
    found = {}
    for name, only in (("both", False), ("inner", True)):
        job = pipeline.run_arrays(spark, str(folder), str(tmp_path / name), only_interior=only, mincount=5, min_count=5)
        found[name] = job
        assert {n for n in pipeline.RESULTS if job.finished(n) and not job.spent(n)} == pipeline.RESULTS
    inner = found["inner"].table("labels")
    assert inner.count() == len(rows) and found["both"].table("labels").count() == 2 * len(rows)
    assert inner.where("seg > 0").count() > len(rows) // 2
    assert found["inner"].table("figures").count() == inner.where("seg > 0").select("seg").distinct().count()
