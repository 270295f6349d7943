"""The whole path from balls to classified clusters, and a staged run over tables on disk."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators import analysis as N
from ridgeline.operators import clusters as C
from ridgeline.operators import cmap as M
from ridgeline.operators import reconstruct as B
from ridgeline.operators import relations as R
from ridgeline.operators.atoms import derive_atoms
from ridgeline.operators.growth import segment
from ridgeline.operators.nearest import knn
from ridgeline.staging import discard, exists, mark, stage, stage_at


def build_sheets(atoms: DataFrame, *, edges: DataFrame | None = None, adjacency_k: int = 25, **growth) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, sheets and links; the neighbour edges are computed once for growth and relations."""
    if edges is None:
        edges = stage(knn(atoms, adjacency_k - 1), "edges")
    labels = stage(segment(atoms, edges=edges, **growth), "labels")
    sheets, links = R.sheet_graph(atoms, labels, edges, k=adjacency_k)
    return labels, stage(sheets, "sheets"), stage(links, "links")


def cluster_report(atoms: DataFrame, *, edges: DataFrame | None = None, min_count: int = 20, **growth) -> DataFrame:
    """One row per cluster: class, number of sheets and balls, mean angle, largest radius."""
    labels, sheets, links = build_sheets(atoms, edges=edges, **growth)
    clusters, strong = C.get_clusters(sheets, links, min_count=min_count)
    clusters = stage(clusters, "clusters")
    classes = C.classify(clusters, strong, sheets, atoms, labels).select("cluster", "class")
    rows = clusters.drop("sheets").join(sheets, "seg").groupBy("cluster").agg(
        F.count("*").alias("sheets"), F.sum("n").alias("balls"), F.avg("theta_mean").alias("theta_mean"), F.max("r_max").alias("r_max")
    )
    return rows.join(classes, "cluster").select("cluster", "class", "sheets", "balls", "theta_mean", "r_max")


@dataclass(frozen=True)
class Step:
    """One table of a job: what it is made from, and how."""

    name: str
    needs: tuple[str, ...]
    make: Callable[..., DataFrame]


class Job:
    """Steps that leave their tables below one folder of the cluster's file system.

    A step is finished when its table is whole (Spark's ``_SUCCESS`` file), so a run that was lost with its driver
    goes on after the last finished step.  A table that no unfinished step needs is deleted unless it is to be
    kept; a mark remembers that it was there.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: set[str]) -> None:
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def spent(self, name: str) -> bool:
        return exists(self.spark, f"{self.folder}/_spent/{name}")

    def finished(self, name: str) -> bool:
        return self.spent(name) or exists(self.spark, f"{self.path(name)}/_SUCCESS")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def run(self, steps: list[Step]) -> None:
        """Make what is not finished, in order.  A step can only need steps before it."""
        for i, step in enumerate(steps):
            if not self.finished(step.name):
                stage_at(step.make(*(self.table(n) for n in step.needs)), self.path(step.name))
            later = {n for s in steps[i + 1 :] if not self.finished(s.name) for n in s.needs}
            for s in steps[: i + 1]:
                if s.name not in self.keep | later and not self.spent(s.name):
                    mark(self.spark, f"{self.folder}/_spent/{s.name}")
                    discard(self.spark, self.path(s.name))


RESULTS = {"labels", "sheets", "links", "clusters", "classes", "figures", "faces", "triangles"}


def steps_to_triangles(
    surface: DataFrame, mat: DataFrame, *, only_interior: bool = False, labels: DataFrame | None = None, links: DataFrame | None = None,
    min_count: int = 20, adjacency_k: int = 25, variant: str = "angle", **growth,
) -> list[Step]:
    """The whole path: balls, neighbours, segments, sheets and their links, clusters and classes, figures of each
    sheet, map and triangles.

    ``only_interior`` leaves exterior balls out before neighbours are looked for.  With ``labels`` (``ma_id, seg``)
    and ``links`` (``a, b``) given, sheets are taken as they are and growth and clusters are left out.
    """

    def balls(points: DataFrame) -> DataFrame:
        atoms = derive_atoms(points, mat, center=False)
        return atoms.where("side = 'in'") if only_interior else atoms

    steps = [Step("surface", (), lambda: surface), Step("atoms", ("surface",), balls)]
    if labels is None:
        steps += [
            Step("edges", ("atoms",), lambda atoms: knn(atoms, adjacency_k - 1)),
            Step("labels", ("atoms", "edges"), lambda atoms, edges: segment(atoms, edges=edges, **growth)),
            Step("sheets", ("atoms", "labels", "edges"), lambda atoms, found, edges: R.sheet_graph(atoms, found, edges, k=adjacency_k)[0]),
            Step("links", ("atoms", "labels", "edges"), lambda atoms, found, edges: R.sheet_graph(atoms, found, edges, k=adjacency_k)[1]),
            Step("clusters", ("sheets", "links"), lambda sheets, all_links: C.get_clusters(sheets, all_links, min_count=min_count)[0]),
            Step("strong", ("sheets", "links"), lambda sheets, all_links: C.get_clusters(sheets, all_links, min_count=min_count)[1]),
            Step(
                "classes", ("clusters", "strong", "sheets", "atoms", "labels"),
                lambda clusters, strong, sheets, atoms, found: C.classify(clusters, strong, sheets, atoms, found),
            ),
        ]
    else:
        steps += [Step("labels", (), lambda: labels), Step("strong", (), lambda: links.select("a", "b"))]
    return steps + [
        Step("sided", ("atoms", "labels"), N.spoke_sides),
        Step("figures", ("atoms", "labels"), N.analyse_sheets),
        Step("nodes", ("sided",), M.half_nodes),
        Step("linked", ("sided", "strong", "nodes", "surface"), lambda sided, strong, nodes, points: M.map_links(sided, strong, nodes, variant=variant, surface=points)),
        Step("removed", ("linked", "nodes"), lambda linked, nodes: M.removed_nodes(linked, nodes, merge_matching=variant == "surface")),
        Step("left", ("linked", "removed"), lambda linked, removed: M.drop_splitting(*M.contract(linked.select("x", "y"), removed))),
        Step("faces", ("nodes", "removed", "left"), lambda nodes, removed, left: M.faces(nodes.join(removed, "h", "left_anti"), left)),
        Step("oriented", ("left", "faces", "nodes"), lambda left, found, nodes: M.orient(M.face_order(left, found), nodes)),
        Step("triangles", ("sided", "surface", "faces", "oriented"), B.reconstruct),
    ]


def run_path(spark: SparkSession, surface: DataFrame, mat: DataFrame, out: str, **options) -> Job:
    """Run the whole path below ``out``; called again after a loss, it goes on."""
    job = Job(spark, out, RESULTS)
    job.run(steps_to_triangles(surface, mat, **options))
    return job


def run_arrays(spark: SparkSession, folder: str, out: str, **options) -> Job:
    """``run_path`` over a folder of arrays."""
    from ridgeline.sources.arrays import assemble, read_npy_dir

    return run_path(spark, *assemble(read_npy_dir(spark, folder)), out, **options)


def run_tables(spark: SparkSession, folder: str, out: str, *, min_count: int = 20, **growth) -> None:
    """Read ``surface`` and ``mat`` tables, write labels, sheets, links, clusters and classes."""
    from ridgeline.sources.tables import read_tables, write_tables

    given = read_tables(spark, folder, ["surface", "mat"])
    atoms = stage(derive_atoms(given["surface"], given["mat"]), "atoms")
    labels, sheets, links = build_sheets(atoms, **growth)
    clusters, strong = C.get_clusters(sheets, links, min_count=min_count)
    clusters = stage(clusters, "clusters")
    classes = C.classify(clusters, strong, sheets, atoms, labels)
    write_tables({"labels": labels, "sheets": sheets, "links": links, "clusters": clusters, "classes": classes}, out)
