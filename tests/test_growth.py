"""Growth against running means, beside a plain version of its rounds."""

import hashlib
import math
import random

import numpy as np
import pandas as pd

from ridgeline.operators import growth


def plain(bisectors, flat, similar, deg, mincount):
    """Regions in synchronous rounds; starts are the free balls that come first among their free neighbours."""
    n, least = len(bisectors), math.cos(math.radians(deg))
    order = {i: (hashlib.md5(str(i).encode()).hexdigest(), i) for i in range(n)}
    seg = [None] * n
    while None in seg:
        starts = [i for i in range(n) if seg[i] is None and all(seg[j] is not None or order[i] < order[j] for j in similar[i])]
        for i in starts:
            seg[i] = i + 1
        while True:
            sums = {}
            for i, s in enumerate(seg):
                if s is not None:
                    sums[s] = sums.get(s, 0) + bisectors[i]
            won = {}
            for u in range(n):
                for v in flat[u] if seg[u] is not None else ():
                    mean = sums[seg[u]] / np.linalg.norm(sums[seg[u]])
                    if seg[v] is None and mean @ bisectors[v] > least:
                        won[v] = min(won.get(v, seg[u]), seg[u])
            if not won:
                break
            for v, s in won.items():
                seg[v] = s
    sums = {s: sum(b for b, own in zip(bisectors, seg) if own == s) for s in set(seg)}
    moved = True
    merged = {s: s for s in sums}
    while moved:
        moved = False
        for u in range(n):
            for v in similar[u]:
                a, b = sums[seg[u]], sums[seg[v]]
                low = min(merged[seg[u]], merged[seg[v]])
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) > least and max(merged[seg[u]], merged[seg[v]]) > low:
                    merged[seg[u]] = merged[seg[v]] = low
                    moved = True
    seg = [merged[s] for s in seg]
    size = {s: seg.count(s) for s in seg}
    kept = {s: i for i, s in enumerate(sorted(s for s in size if size[s] >= mincount), 1)}
    return [kept.get(s, 0) for s in seg]


def balls(spark, bisectors, theta):
    frame = {"ma_id": range(len(theta)), "theta": theta} | {f"b{a}": bisectors[:, i] for i, a in enumerate("xyz")}
    return spark.createDataFrame(pd.DataFrame(frame))


def test_running_mean_equals_plain_rounds(spark):
    rng = random.Random(4)
    n, k = 240, 6
    angle = np.cumsum([rng.choice([0, 0.004, 0.02, 0.3]) for _ in range(n)])
    bisectors = np.stack([np.cos(angle), np.sin(angle), np.zeros(n)], axis=1)
    theta = np.array([rng.choice([1.0, 1.05, 1.4]) for _ in range(n)])
    near = {u: sorted({v for v in (u + rng.choice([-3, -2, -1, 1, 2, 3]) for _ in range(k)) if 0 <= v < n and v != u}) for u in range(n)}
    edges = spark.createDataFrame([(u, v, i + 1) for u, vs in near.items() for i, v in enumerate(vs)], "u bigint, v bigint, rank int")
    limit = math.radians(10)
    flat = {u: [v for v in vs if abs(theta[u] - theta[v]) < limit] for u, vs in near.items()}
    similar = {u: set() for u in range(n)}
    for u, vs in flat.items():
        for v in vs:
            if bisectors[u] @ bisectors[v] > math.cos(math.radians(2)):
                similar[u].add(v)
                similar[v].add(u)
    found = growth.segment_running_mean(balls(spark, bisectors, theta), edges=edges, theta_deg=10.0, mincount=4)
    got = {r.ma_id: r.seg for r in found.collect()}
    expected = plain(bisectors, flat, similar, 2.0, 4)
    assert [got[i] for i in range(n)] == expected and max(expected) > 3


def test_rounds_stay_few_however_ids_run(spark, monkeypatch):
    """A row of 10,000 equal balls with rising ids."""
    n, rounds = 10_000, []
    plain_stage = growth.stage
    monkeypatch.setattr(growth, "stage", lambda df, label="stage": (rounds.append(label), plain_stage(df, label))[1])
    edges = spark.range(n).selectExpr("id AS u", "posexplode(array(-4, -3, -2, -1, 1, 2, 3, 4)) AS (rank, by)")
    edges = edges.selectExpr("u", "u + by AS v", "rank + 1 AS rank").where(f"v BETWEEN 0 AND {n - 1}")
    bisectors = np.tile([0.0, 0.0, 1.0], (n, 1))
    found = growth.segment_running_mean(balls(spark, bisectors, np.ones(n)), edges=edges, mincount=1)
    assert {(r.seg, r["count"]) for r in found.groupBy("seg").count().collect()} == {(1, n)}
    assert rounds.count("joined") <= 60


def test_empty_cloud(spark):
    none = balls(spark, np.zeros((1, 3)), [1.0]).limit(0)
    edges = spark.createDataFrame([], "u bigint, v bigint, rank int")
    assert growth.segment_running_mean(none, edges=edges).collect() == []
