"""Half-node map of a sheet cluster: matching, contraction, faces and their orientation.

Every sheet has two half-nodes ``h = 2*seg`` and ``2*seg + 1`` (twins), one per supported
plane.  Half-nodes are rows, links between them are rows, and the cycles of all clusters are
found together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.shapes import Plane, point_plane_distance
from ridgeline.functions.vec import Vec, angle, put
from ridgeline.operators.analysis import half_sheet_points, half_sheets
from ridgeline.operators.components import components
from ridgeline.operators.fitting import fit_plane
from ridgeline.staging import fixpoint, large, stage


def twin(h: Column) -> Column:
    return h.bitwiseXOR(F.lit(1))


def half_nodes(sided: DataFrame, *, converge_deg: float = 170.0, min_balls: int = 1, lock_r: float = 0.8, halves: DataFrame | None = None) -> DataFrame:
    """``h, seg, half, points, f*, b*, locked``: two half-nodes per sheet.

    Sheets whose mean separation angle exceeds ``converge_deg`` or with fewer than
    ``min_balls`` balls get none; a sheet without a ball of radius ``lock_r`` or less is locked.
    """
    stats = sided.groupBy("seg").agg(
        F.count("*").alias("_n"), F.avg("theta").alias("_t"), F.min("r").alias("_r"), *(F.avg(f"b{a}").alias(f"b{a}") for a in "xyz")
    ).where((F.col("_t") <= math.radians(converge_deg)) & (F.col("_n") >= min_balls))
    parts = halves if halves is not None else half_sheets(sided)
    return parts.join(large(stats), "seg").select(
        (F.col("seg") * 2 + F.col("half") - 1).alias("h"), "seg", "half", "points", "fx", "fy", "fz", "bx", "by", "bz", (F.col("_r") > lock_r).alias("locked")
    )


def half_node_points(sided: DataFrame) -> DataFrame:
    """``h, s_id`` with repeats."""
    return half_sheet_points(sided).select((F.col("seg") * 2 + F.col("half") - 1).alias("h"), "s_id")


def two_means(sided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split the unit spokes (pointing to the ball centre) of every sheet around two means.

    Rounds run for all sheets together from the halves by spoke side; a sheet without a change has
    settled and takes no further part.  Returns the spokes with ``half`` and the means
    ``seg, half, points, f*``.
    """
    spokes = half_sheet_points(sided)
    spokes = put(spokes, "f", -Vec.of("f").unit()).where("fx IS NOT NULL").withColumn("changed", F.lit(True))

    def means(rows: DataFrame) -> DataFrame:
        wide = [F.avg(F.when(F.col("half") == i, F.col(f"f{a}"))).alias(f"m{i}{a}") for i in (1, 2) for a in "xyz"]
        return rows.groupBy("seg").agg(*wide)

    def step(rows: DataFrame) -> DataFrame:
        at = rows.join(large(means(rows)), "seg")
        d1, d2 = ((Vec.of("f") - Vec.of(f"m{i}")).abs2() for i in (1, 2))
        near = F.when(d2.isNull() | (d1 <= d2), 1).otherwise(2)
        return at.select("seg", "ma_id", "s_id", "fx", "fy", "fz", near.alias("half"), (near != F.col("half")).alias("changed"))

    busy, settled = stage(spokes, "spokes"), []
    while True:  # every round lowers the spread of each sheet that takes part
        moved = stage(step(busy), "means")
        lively = moved.where("changed").select("seg").distinct()
        settled.append(moved.join(lively, "seg", "left_anti").drop("changed"))
        if lively.isEmpty():
            break
        busy = stage(moved.join(lively, "seg", "left_semi"), "means")
    rows = settled[0]
    for part in settled[1:]:
        rows = rows.unionByName(part)
    centres = rows.groupBy("seg", "half").agg(F.count("*").alias("points"), *(F.avg(f"f{a}").alias(f"f{a}") for a in "xyz"))
    return rows, centres


def surface_match(pairs: DataFrame, points: DataFrame, surface: DataFrame, *, within: float = 0.10, share: float = 0.9) -> DataFrame:
    """``p, q, matches``: does the smaller half lie on the plane of the larger one?"""
    at = points.join(large(surface.select("s_id", "px", "py", "pz")), "s_id")
    planes = fit_plane(at, ["h"])
    sizes = planes.select("h", "n")
    sized = pairs.join(large(sizes.toDF("p", "np")), "p").join(large(sizes.toDF("q", "nq")), "q")
    first_big = F.col("np") > F.col("nq")
    sized = sized.select("p", "q", F.when(first_big, F.col("p")).otherwise(F.col("q")).alias("big"), F.when(first_big, F.col("q")).otherwise(F.col("p")).alias("small"))
    shape = planes.select(F.col("h").alias("big"), *Plane.of("").cols("big_"))
    rows = sized.join(large(shape), "big").join(large(at.select(F.col("h").alias("small"), "px", "py", "pz")), "small")
    near = (point_plane_distance(Vec.of("p"), Plane.of("big_")) < within).cast("double")
    return rows.groupBy("p", "q").agg((F.avg(F.coalesce(near, F.lit(0.0))) > share).alias("matches"))


def match_edges(
    links: DataFrame, nodes: DataFrame, *, match_deg: float = 5.0, parallel_deg: float = 165.0, variant: str = "angle",
    points: DataFrame | None = None, surface: DataFrame | None = None,
) -> DataFrame:
    """``x, y, angle, other_angle, other_kind``: the two half-nodes that share a plane, per sheet link.

    Of the four pairs the one at the smallest angle is taken, if below ``match_deg``; links
    whose other pair is (anti)parallel beyond ``parallel_deg`` are left out.  ``other_kind``
    is 'match' where the other pair is coplanar too: by angle (below 30 degrees) or, with
    ``variant='surface'``, by ``surface_match``.
    """
    wide = nodes.groupBy("seg").agg(*(F.max(F.when(F.col("half") == i, F.col(f"f{a}"))).alias(f"m{i}{a}") for i in (1, 2) for a in "xyz"))
    rows = links.select("a", "b")
    for end in ("a", "b"):
        rows = rows.join(large(wide.select(F.col("seg").alias(end), *(F.col(f"m{i}{x}").alias(f"{end}{i}{x}") for i in (1, 2) for x in "xyz"))), end)
    rows = rows.withColumns({f"g{i}{j}": angle(Vec.of(f"a{i}"), Vec.of(f"b{j}")) for i in (1, 2) for j in (1, 2)})
    choices = F.array_compact(F.array(*(
        F.when(F.col(f"g{i}{j}").isNotNull(), F.struct(F.col(f"g{i}{j}").alias("g"), (F.col("a") * 2 + i - 1).alias("x"), (F.col("b") * 2 + j - 1).alias("y"), F.col(f"g{3 - i}{3 - j}").alias("o")))
        for i in (1, 2) for j in (1, 2)
    )))
    best = rows.select(F.array_min(choices).alias("m")).select(F.col("m.x").alias("x"), F.col("m.y").alias("y"), F.col("m.g").alias("angle"), F.col("m.o").alias("other_angle"))
    best = best.where((F.col("angle") < math.radians(match_deg)) & ~F.coalesce(F.col("other_angle") > math.radians(parallel_deg), F.lit(False)))
    if variant == "surface":
        others = best.select(twin(F.col("x")).alias("p"), twin(F.col("y")).alias("q"))
        verdict = surface_match(others, points, surface).select(twin(F.col("p")).alias("x"), twin(F.col("q")).alias("y"), "matches")
        return best.join(large(verdict), ["x", "y"], "left").select(
            "x", "y", "angle", "other_angle", F.when(F.coalesce("matches", F.lit(False)), "match").otherwise("intersect").alias("other_kind")
        )
    if variant != "angle":
        raise ValueError(f"unknown variant {variant!r}")
    return best.withColumn("other_kind", F.when(F.col("other_angle") < math.radians(30), "match").otherwise("intersect"))


def removed_nodes(matched: DataFrame, nodes: DataFrame, *, merge_matching: bool = True) -> DataFrame:
    """Half-nodes to contract: the first of each doubly matching pair, and the locked ones."""
    locked = nodes.where("locked").select("h")
    return matched.where("other_kind = 'match'").select(F.col("x").alias("h")).union(locked).distinct() if merge_matching else locked


def contract(links: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links ``x < y`` among surviving half-nodes after contracting the removed ones.

    Survivors joined by a path of removed half-nodes only become neighbours of each other.  Every
    such group is returned as ``hub, h`` rows, one for each member, whatever its size; the links
    that were there before come first.
    """
    links = stage(links.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct(), "matched")
    gone = removed.select("h", F.lit(True).alias("_gone"))
    marked = stage(
        links.join(large(gone.toDF("x", "gx")), "x", "left").join(large(gone.toDF("y", "gy")), "y", "left").select(
            "x", "y", F.col("gx").isNotNull().alias("gx"), F.col("gy").isNotNull().alias("gy")
        ),
        "marked",
    )
    kept = marked.where("NOT gx AND NOT gy").select("x", "y")
    groups = components(marked.where("gx AND gy"), removed.select("h"), key="h", ends=("x", "y"))
    edge = marked.where("gx AND NOT gy").select(F.col("x").alias("h"), F.col("y").alias("s")).unionByName(
        marked.where("gy AND NOT gx").select(F.col("y").alias("h"), F.col("x").alias("s"))
    )
    members = stage(edge.join(large(groups), "h").select(F.col("component").alias("hub"), F.col("s").alias("h")).distinct(), "members")
    return kept, members


def drop_splitting(links: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """Drop links whose ends both have more than two neighbours, all at once.

    ``hubs`` are groups as ``contract`` returns them.  A group of more than three gives each
    member at least three neighbours, so none of its own links remains; smaller ones are linked here.
    """
    if hubs is not None:
        sizes = hubs.groupBy("hub").agg(F.count("*").alias("n"))
        small = hubs.join(large(sizes.where("n <= 3")), "hub")
        pairs = small.select("hub", F.col("h").alias("x")).join(large(small.select("hub", F.col("h").alias("y"))), "hub").where("x < y")
        links = links.select("x", "y").unionByName(pairs.select("x", "y")).distinct()
        hubs = hubs.join(large(sizes.where("n > 3").select("hub")), "hub", "left_semi")
    degree = links.select(F.explode(F.array("x", "y")).alias("h")).groupBy("h").agg(F.count("*").alias("d"))
    high = degree.where("d > 2").select("h")
    if hubs is not None:
        high = high.union(hubs.select("h")).distinct()
    flag = high.select("h", F.lit(True).alias("_high"))
    return links.join(large(flag.toDF("x", "hx")), "x", "left").join(large(flag.toDF("y", "hy")), "y", "left").where("hx IS NULL OR hy IS NULL").select("x", "y")


def faces(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``h, face, cycle``: linked half-nodes form a face, closed when all have two neighbours.

    A face is named after its lowest half-node.
    """
    ids = nodes.select("h")
    found = components(links, ids, key="h", ends=("x", "y"))
    degree = links.select(F.explode(F.array("x", "y")).alias("h")).groupBy("h").agg(F.count("*").alias("d"))
    both = stage(found.join(large(degree), "h", "left").select("h", F.col("component").alias("face"), F.coalesce("d", F.lit(0)).alias("d")), "faces")
    closed = both.groupBy("face").agg(((F.min("d") == 2) & (F.max("d") == 2)).alias("cycle"))
    return both.join(large(closed), "face").select("h", "face", "cycle")


def face_order(links: DataFrame, found: DataFrame) -> DataFrame:
    """``face, h, pos, next_h, size`` for closed faces: walk from the lowest half-node toward its
    lower neighbour.

    Positions come from pointer doubling over the directed links, so a cycle of n half-nodes
    takes log2(n) rounds; links already at their end take no further part in the joins.
    """
    closed = found.where("cycle").select("h", "face")
    both = links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    both = stage(both.join(large(closed.select(F.col("h").alias("x"), "face")), "x"), "darts")
    starts = both.where("x = face").groupBy("x").agg(F.min("y").alias("y")).withColumn("start", F.lit(True))
    onward = both.select(F.col("x").alias("y"), F.col("y").alias("z"))
    darts = both.join(large(onward), "y").where("z <> x").join(large(starts), ["x", "y"], "left")
    # a dart at a start ends the walk; the walks the other way round meet no start and are dropped below
    state = darts.select(
        "face", "x", "y", F.coalesce("start", F.lit(False)).alias("ended"),
        F.col("y").alias("nx"), F.col("z").alias("ny"), F.when(F.col("start"), 0).otherwise(1).cast("bigint").alias("dist"),
    )
    sizes = found.where("cycle").groupBy("face").agg(F.count("*").alias("size"))
    state = state.join(large(sizes), "face").withColumn("changed", F.lit(True))

    def double(now: DataFrame, _: int) -> DataFrame:
        ahead = now.select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("nx").alias("ax"), F.col("ny").alias("ay"), F.col("dist").alias("ad"), F.col("ended").alias("ae"))
        walking = now.where(~F.col("ended") & (F.col("dist") <= F.col("size")))
        moved = walking.join(large(ahead), ["nx", "ny"]).select(
            "face", "x", "y", F.col("ae").alias("ended"), F.when(F.col("ae"), F.col("nx")).otherwise(F.col("ax")).alias("nx"),
            F.when(F.col("ae"), F.col("ny")).otherwise(F.col("ay")).alias("ny"), (F.col("dist") + F.col("ad")).alias("dist"), "size", F.lit(True).alias("changed"),
        )
        rest = now.where(F.col("ended") | (F.col("dist") > F.col("size"))).withColumn("changed", F.lit(False))
        return rest.unionByName(moved.select(rest.columns))

    state = fixpoint(stage(state, "darts"), double, label="darts")
    walked = state.where("ended")
    pos = (F.col("size") - F.col("dist")) % F.col("size")
    return walked.select("face", F.col("x").alias("h"), pos.alias("pos"), F.col("y").alias("next_h"), "size")


def orient(ordered: DataFrame, nodes: DataFrame) -> DataFrame:
    """Turn each closed face to run counter-clockwise seen along its spokes.

    The turn of the first three sheets' mean bisectors is compared with the spoke of the first.
    """
    first = ordered.where("pos < 3").join(large(nodes.select("h", "fx", "fy", "fz", "bx", "by", "bz")), "h")
    picks = [F.max(F.when(F.col("pos") == i, F.col(f"b{a}"))).alias(f"b{i}{a}") for i in range(3) for a in "xyz"]
    spoke = [F.max(F.when(F.col("pos") == 0, F.col(f"f{a}"))).alias(f"s{a}") for a in "xyz"]
    turned = first.groupBy("face").agg(*picks, *spoke)
    turn = (Vec.of("b1") - Vec.of("b0")).cross(Vec.of("b2") - Vec.of("b1")).dot(Vec.of("s"))
    flips = turned.select("face", F.coalesce(turn > 0, F.lit(False)).alias("flip"))
    before = ordered.select("face", F.col("next_h").alias("h"), F.col("h").alias("prev_h"))
    rows = ordered.join(large(before), ["face", "h"]).join(large(flips), "face")
    return rows.select(
        "face", "h", F.when(F.col("flip"), (F.col("size") - F.col("pos")) % F.col("size")).otherwise(F.col("pos")).alias("pos"),
        F.when(F.col("flip"), F.col("prev_h")).otherwise(F.col("next_h")).alias("next_h"), "size",
    )


def map_links(sided: DataFrame, links: DataFrame, nodes: DataFrame, *, variant: str = "angle", surface: DataFrame | None = None) -> DataFrame:
    """``match_edges`` with the points of the half-nodes at hand."""
    return match_edges(links, nodes, variant=variant, points=half_node_points(sided), surface=surface)


def build_map(
    sided: DataFrame, links: DataFrame, *, variant: str = "angle", surface: DataFrame | None = None, merge_matching: bool | None = None, **node_options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Half-nodes, faces and oriented closed faces of all clusters.

    Doubly matching pairs are merged with ``variant='surface'`` unless asked otherwise.
    """
    nodes = stage(half_nodes(sided, **node_options), "half_nodes")
    matched = stage(map_links(sided, links, nodes, variant=variant, surface=surface), "match")
    merge = variant == "surface" if merge_matching is None else merge_matching
    removed = stage(removed_nodes(matched, nodes, merge_matching=merge), "removed")
    left = stage(drop_splitting(*contract(matched.select("x", "y"), removed)), "left")
    kept = nodes.join(large(removed), "h", "left_anti")
    found = stage(faces(kept, left), "found")
    return nodes, found, stage(orient(face_order(left, found), nodes), "oriented")
