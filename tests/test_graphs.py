import random

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import cmap
from ridgeline.operators.components import components, lowest_reaching


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def sequential_flood(n, edges, seeds):
    """Seeds in order, each absorbing what is still free along directed edges."""
    label, out = {}, {}
    for u, v in edges:
        out.setdefault(u, []).append(v)
    for rank, seed in seeds:
        if seed in label:
            continue
        label[seed], stack = rank, [seed]
        while stack:
            for v in out.get(stack.pop(), []):
                if v not in label:
                    label[v] = rank
                    stack.append(v)
    return label


@pytest.mark.parametrize("seed", range(3))
def test_flood_equals_sequential_growth(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = [(u, v) for u in range(n) for v in rng.sample(range(n), 2) if u != v]
    edges += [(v, u) for u, v in edges if rng.random() < 0.4]
    order = rng.sample(range(n), 25)
    seeds = list(enumerate(order))
    nodes = table(spark, [(i, dict((s, r) for r, s in seeds).get(i)) for i in range(n)], "id bigint, rank bigint")
    got = {r.id: r["rank"] for r in lowest_reaching(table(spark, edges, "u bigint, v bigint"), nodes).collect()}
    assert got == sequential_flood(n, edges, seeds)


@pytest.mark.parametrize("seed", range(4))
def test_flood_of_sparse_one_way_links(spark, seed):
    """Trees, rings, long runs and dense kernels in one graph, so that every part of the contraction is used."""
    rng = random.Random(100 + seed)
    edges, n = [], 0
    for _ in range(6):  # trees with runs
        root, size = n, rng.randrange(2, 60)
        edges += [(root + rng.randrange(max(0, i - rng.choice([1, 1, 1, 20])), i), root + i) for i in range(1, size)]
        n += size
    for _ in range(5):  # rings with tails
        size = rng.randrange(2, 12)
        edges += [(n + i, n + (i + 1) % size) for i in range(size)] + [(n + size - 1, n + size), (n + size, n + size + 1)]
        n += size + 2
    for _ in range(3):  # dense kernels
        edges += [(n + rng.randrange(30), n + rng.randrange(30)) for _ in range(90)]
        n += 30
    edges += [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 10)]
    edges = [(u, v) for u, v in edges if u != v]
    seeds = list(enumerate(rng.sample(range(n), n if seed % 2 else n // 3)))
    ranks = {s: r for r, s in seeds}
    nodes = table(spark, [(i, ranks.get(i)) for i in range(n)], "id bigint, rank bigint")
    got = {r.id: r["rank"] for r in lowest_reaching(table(spark, edges, "u bigint, v bigint"), nodes).collect()}
    assert got == sequential_flood(n, edges, seeds)


@pytest.mark.parametrize("shape", ["up", "down", "mixed"])
def test_long_one_way_chain(spark, shape):
    """100,000 links one after the other, with labels that rise, fall, or are shuffled along the chain."""
    n = 100_000
    ranks = {"up": F.col("id"), "down": n - F.col("id"), "mixed": F.pmod(F.xxhash64("id"), F.lit(10**12))}[shape]
    nodes = spark.range(n).select("id", ranks.alias("rank"))
    edges = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = {r.id: r["rank"] for r in lowest_reaching(edges, nodes).collect()}
    given, low = {r.id: r["rank"] for r in nodes.collect()}, 10**13
    for i in range(n):
        low = min(low, given[i])
        assert got[i] == low


def test_long_chain_components(spark):
    edges = [(i, i + 1) for i in range(200) if i != 120]
    got = {r.id: r.component for r in components(table(spark, edges, "a bigint, b bigint"), spark.range(210)).collect()}
    assert got == {i: 0 if i <= 120 else 121 if i <= 200 else i for i in range(210)}


def sequential_contraction(links, removed):
    near = {}
    for x, y in links:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    for r in removed:
        around = near.pop(r, set())
        for a in around:
            near[a].discard(r)
            near[a] |= around - {a}
    return {(min(x, y), max(x, y)) for x in near for y in near[x]}


@pytest.mark.parametrize("seed", range(3))
def test_contraction_and_splitting(spark, seed):
    rng = random.Random(seed)
    n = 30
    links = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(40)}
    removed = rng.sample(range(n), 8)
    left, hubs = cmap.contract(table(spark, sorted(links), "x bigint, y bigint"), table(spark, [(r,) for r in removed], "h bigint"))
    pairs = {(r.x, r.y) for r in left.collect()}
    groups = {}
    for r in hubs.collect():
        groups.setdefault(r.hub, []).append(r.h)
    cliques = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    expected = sequential_contraction(links, removed)
    assert pairs | cliques == expected
    degree = {}
    for x, y in expected:
        degree[x] = degree.get(x, 0) + 1
        degree[y] = degree.get(y, 0) + 1
    kept = {(x, y) for x, y in expected if not (degree[x] > 2 and degree[y] > 2)}
    assert {(r.x, r.y) for r in cmap.drop_splitting(left, hubs).collect()} == kept


def test_contracted_groups_are_whole(spark):
    spokes = [(0, i) for i in range(1, 7)]
    left, hubs = cmap.contract(table(spark, spokes, "x bigint, y bigint"), table(spark, [(0,)], "h bigint"))
    assert left.collect() == [] and sorted(r.h for r in hubs.collect()) == [1, 2, 3, 4, 5, 6]


def test_face_order_walks_cycles(spark):
    ring = [(10, 12), (12, 14), (14, 16), (16, 18), (10, 18)]
    path = [(20, 22), (22, 24)]
    links = table(spark, ring + path, "x bigint, y bigint")
    nodes = table(spark, [(h,) for h in (10, 12, 14, 16, 18, 20, 22, 24, 30)], "h bigint")
    found = cmap.faces(nodes, links)
    assert {(r.h, r.face, r.cycle) for r in found.collect() if not r.cycle} == {(20, 20, False), (22, 20, False), (24, 20, False), (30, 30, False)}
    order = {r.pos: (r.h, r.next_h) for r in cmap.face_order(links, found).collect()}
    assert order == {0: (10, 12), 1: (12, 14), 2: (14, 16), 3: (16, 18), 4: (18, 10)}
