"""Connected components and directed reachability as alternating joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.staging import discard, large, new_path, stage, stage_at


def _stars(pairs: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (u, v) with u > v.

    Both pull neighbours toward the smallest id seen; the number of rounds grows with the
    logarithm of the component size, not with its diameter.
    """
    both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    pulled = both.where("v > u").join(large(low), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    floor = pulled.groupBy("u").agg(F.min("v").alias("m"))
    moved = pulled.join(large(floor), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return floor.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def components(edges: DataFrame, vertices: DataFrame | None = None, *, key: str = "id", ends: tuple[str, str] = ("a", "b")) -> DataFrame:
    """``key, component``: the lowest id in each undirected component."""
    a, b = (F.col(e) for e in ends)
    pairs = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    spark = pairs.sparkSession
    path = new_path(spark, "links")
    pairs = stage_at(pairs, path)

    def size(df: DataFrame):
        # the set of pairs as a fingerprint: equal when a round changed nothing
        h = F.xxhash64("u", "v").cast("decimal(20,0)")
        return tuple(df.agg(F.count("*"), F.sum(h), F.sum(h % 1000003)).first())

    mark = size(pairs)
    while mark[0]:
        before, path = path, new_path(spark, "stars")
        pairs = stage_at(_stars(pairs), path)
        discard(spark, before)
        new = size(pairs)
        if new == mark:
            break
        mark = new
    found = pairs.select(F.col("u").alias(key), F.col("v").alias("component"))
    if vertices is None:
        roots = pairs.select(F.col("v").alias(key)).distinct()
        return found.unionByName(roots.select(key, F.col(key).alias("component")))
    return vertices.select(key).join(large(found), key, "left").select(key, F.coalesce("component", F.col(key)).alias("component"))


def lowest_reaching(edges: DataFrame, nodes: DataFrame, *, label: str = "rank") -> DataFrame:
    """Per node the lowest ``label`` among nodes that reach it along directed ``u -> v``.

    ``nodes`` has ``id`` and ``label`` (NULL where a node starts nothing); the result has
    ``id, label`` for the reached nodes.  Nodes linked in both directions share their
    answer, so they are merged first in logarithmic rounds; the one-way links between merged groups
    are settled by ``settle``.
    """
    one_way = edges.select("u", "v").where("u <> v").distinct()
    one_way = stage(one_way, "steps")
    mutual = one_way.where("u < v").join(large(one_way.select(F.col("u").alias("v"), F.col("v").alias("u"))), ["u", "v"], "left_semi")
    groups = stage(components(mutual, nodes, key="id", ends=("u", "v")), "groups")
    start = nodes.join(large(groups), "id").groupBy("component").agg(F.min(label).alias("label"))
    start = stage(start.select(F.col("component").alias("id"), "label"), "start")
    first = groups.select(F.col("id").alias("u"), F.col("component").alias("cu"))
    second = groups.select(F.col("id").alias("v"), F.col("component").alias("cv"))
    links = stage(one_way.join(large(first), "u").join(large(second), "v").where("cu <> cv").select("cu", "cv").distinct(), "links")
    found = settle(links, start).select(F.col("id").alias("component"), F.col("label").alias(label))
    return groups.join(large(found), "component").where(F.col(label).isNotNull()).select("id", label)


HOPS = 4  # steps along links before the graph is contracted
MERGE = 8  # increments that are merged into the table of labels


def settle(links: DataFrame, known: DataFrame) -> DataFrame:
    """``id, label``: the lowest label of ``known`` (``id, label``) that reaches each id along ``cu -> cv``.

    Labels first move a few hops; only nodes whose label fell offer it on, and only falls are written.
    What is still moving then lies at the ends of long paths, so the graph is contracted: nodes without
    predecessors hand on their label and go, nodes without successors wait for the answer, and a run of nodes
    with a single predecessor each is hung to its start by pointer doubling, whatever its length.  Where
    contraction removes little, more hops are made between contractions.  Answers are carried back in reverse order.
    """
    waiting: list[tuple[DataFrame, DataFrame, DataFrame, DataFrame]] = []
    hops, size = HOPS, links.count()
    while True:
        known, moving = _hop(links, known, hops)
        if not moving:
            break
        links, inner, *rest = _contract(links, known)
        waiting.append((known, *rest))
        known, before, size = inner, size, links.count()
        if size * 8 > before * 7:
            hops *= 4
    for whole, hung, sinks, into in reversed(waiting):
        # known: answers of the inner nodes; sources keep their labels
        done = _lowest(known, whole.join(known, "id", "left_anti").join(hung, "id", "left_anti").join(sinks, "id", "left_anti"))
        done = stage(done, "settled")
        offers = into.join(done, F.col("cu") == F.col("id")).select(F.col("cv").alias("id"), "label")
        last = _lowest(sinks, offers)
        up = done.select(F.col("id").alias("up"), F.col("label").alias("above"))
        tails = hung.join(up, "up", "left").select("id", F.least("label", "above").alias("label"))
        known = stage(done.unionByName(last).unionByName(tails), "settled")
    return known


def _lowest(*tables: DataFrame) -> DataFrame:
    """``id, label``: the lowest label of each id over all tables."""
    rows = tables[0].select("id", "label")
    for table in tables[1:]:
        rows = rows.unionByName(table.select("id", "label"))
    return rows.groupBy("id").agg(F.min("label").alias("label"))


def _hop(links: DataFrame, known: DataFrame, hops: int) -> tuple[DataFrame, bool]:
    """Labels after at most ``hops`` steps, and whether any fell in the last one.

    A step writes the labels that fell and nothing else; every ``MERGE`` steps they become part of the table.
    """
    spark, moved = links.sparkSession, known.where("label IS NOT NULL")
    falls: list[DataFrame] = []
    paths: list[str] = []
    merged, moving = None, True
    for _ in range(hops):
        offers = links.join(moved, F.col("cu") == F.col("id")).groupBy(F.col("cv").alias("id")).agg(F.min("label").alias("offer"))
        now = _lowest(known, *falls) if falls else known
        better = F.col("label").isNull() | (F.col("offer") < F.col("label"))
        paths.append(new_path(spark, "falls"))
        moved = stage_at(offers.join(now, "id").where(better).select("id", F.col("offer").alias("label")), paths[-1])
        moving = not moved.isEmpty()
        if not moving:
            break
        falls.append(moved)
        if len(falls) == MERGE:
            path = new_path(spark, "labels")
            known = stage_at(_lowest(known, *falls), path)
            for old in [*paths[:-1], *([merged] if merged else [])]:
                discard(spark, old)
            falls, paths, merged = [], paths[-1:], path
    if falls:
        known = stage(_lowest(known, *falls), "labels")
        for old in [*paths, *([merged] if merged else [])]:
            discard(spark, old)
    return known, moving


def _contract(links: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Smaller ``links`` and ``known``, and what is answered from them.

    The rest are: nodes hung to a start (``id, up, label``, ``up`` NULL where nothing is above but a ring), nodes without
    successors (``id, label``), and links into these.
    """
    ins = links.groupBy(F.col("cv").alias("id")).agg(F.count("*").alias("n"), F.min("cu").alias("parent"))
    outs = links.select(F.col("cu").alias("id")).distinct().withColumn("out", F.lit(True))
    kind = F.when(F.col("n").isNull(), "source").when(F.col("n") == 1, "single").when(F.col("out").isNull(), "sink").otherwise("inner")
    kinds = stage(ins.join(outs, "id", "full").select("id", kind.alias("kind"), "parent"), "kinds")
    hung = stage(_hang(kinds.where("kind = 'single'").join(known, "id").select("id", F.col("parent").alias("up"), "label")), "hung")

    named = kinds.select("id", "kind")
    targets = named.where("kind IN ('inner', 'sink')").select(F.col("id").alias("cv"), F.col("kind").alias("to"))
    runs = hung.select(F.col("id").alias("cu"), "up", F.col("label").alias("passed"), F.lit(True).alias("hangs"))
    moved = links.join(targets, "cv").join(runs, "cu", "left")
    moved = moved.select("cv", "to", F.when(F.col("hangs"), F.col("up")).otherwise(F.col("cu")).alias("cu"), "passed")
    sources = named.where("kind = 'source'").join(known, "id").select(F.col("id").alias("cu"), F.col("label").alias("given"), F.lit(True).alias("starts"))
    moved = stage(moved.join(sources, "cu", "left").select("cu", "cv", "to", F.least("passed", "given").alias("label"), "starts"), "moved")
    offers = moved.where("label IS NOT NULL").select(F.col("cv").alias("id"), "label")
    rest = known.join(named.where("kind IN ('inner', 'sink')"), "id").select("id", "label", "kind")
    better = offers.groupBy("id").agg(F.min("label").alias("offer"))
    rest = stage(rest.join(better, "id", "left").select("id", F.least("label", "offer").alias("label"), "kind"), "rest")
    kept = moved.where("cu IS NOT NULL AND starts IS NULL AND cu <> cv")
    left = stage(kept.where("to = 'inner'").select("cu", "cv").distinct(), "links")
    into = stage(moved.where("cu IS NOT NULL AND to = 'sink'").select("cu", "cv").distinct(), "into")
    inner, sinks = rest.where("kind = 'inner'").select("id", "label"), rest.where("kind = 'sink'").select("id", "label")
    return left, inner, hung, sinks, into


def _hang(singles: DataFrame) -> DataFrame:
    """Nodes (``id, up, label``) with one predecessor ``up`` each, hung to the first node above that is none of them.

    ``label`` becomes the lowest of the run down to the node.  Pointers double; those that still find one another after
    more doublings than a run can have lie on or behind a ring and know all labels above: their ``up`` is NULL.
    """
    spark, before = singles.sparkSession, new_path(singles.sparkSession, "runs")
    state, doublings = stage_at(singles.withColumn("open", F.lit(True)), before), 0
    most = state.count().bit_length() + 1
    while True:
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("label").alias("over"))
        step = state.where("open").join(above, "up", "left")
        step = step.select("id", F.coalesce("next", "up").alias("up"), F.least("label", "over").alias("label"), F.col("next").isNotNull().alias("open"))
        path = new_path(spark, "runs")
        state = stage_at(step.unionByName(state.where("NOT open")), path)
        discard(spark, before)
        before, doublings = path, doublings + 1
        if state.where("open").isEmpty():
            break
        if doublings > most:
            break
    return state.select("id", F.when(~F.col("open"), F.col("up")).alias("up"), "label")
