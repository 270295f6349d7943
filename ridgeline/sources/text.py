"""ASCII point and mesh formats: XYZ, PLY and OBJ, read in parallel with stable row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ridgeline.operators.atoms import bbox, subtract
from ridgeline.staging import number_rows, stage


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: file, block start and position within the block's task."""
    raw = spark.read.text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_mono"))


def _number(lines: DataFrame, name: str = "row", *, weight: Column | None = None) -> DataFrame:
    """Row numbers from 0 in file order, or the sum of ``weight`` over the rows before.

    A block is read by one task in order, so only the sums per block (one row per block of
    the input) are put in sequence.
    """
    lines = lines.withColumn("_w", F.lit(1).cast("bigint") if weight is None else weight)
    blocks = lines.groupBy("_file", "_block").agg(F.sum("_w").alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    above = Window.partitionBy("_file", "_block").orderBy("_mono").rowsBetween(Window.unboundedPreceding, -1)
    ranked = lines.withColumn("_in", F.coalesce(F.sum("_w").over(above), F.lit(0)))
    return ranked.join(offsets, ["_file", "_block"]).withColumn(name, (F.col("_offset") + F.col("_in")).cast("bigint")).drop("_in", "_offset", "_w")


def numbered_lines(spark: SparkSession, path: str, *, blank: bool = True) -> DataFrame:
    """``row, value`` of a text file or folder; rows count from 0, without blank lines if not ``blank``."""
    lines = stage(_lines(spark, path), "lines")
    return _number(lines if blank else lines.where(F.length(F.trim("value")) > 0)).select("row", "value")


def _to_origin(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    first = df.where(F.col(key) == 0).select(*(F.col(f"p{a}").alias(f"off{a}") for a in "xyz"))
    return subtract(df, "p", first, "off"), first


def read_xyz(
    spark: SparkSession, path: str, *, sep: str = " ", rgb: bool = False, rgb_divider: float = 1.0, limit: int | None = None,
    to_origin: bool = False, region: bool = False,
) -> DataFrame:
    """``s_id, px, py, pz[, rgba][, region]``, one point per line.

    With ``to_origin`` the first point is subtracted and kept in ``off*``; ``limit`` keeps that
    many first points.  Blank lines do not count.
    """
    rows = numbered_lines(spark, path, blank=False)
    if limit is not None:
        rows = rows.where(F.col("row") < limit)
    cells = F.split(F.trim("value"), r"\s+" if sep == " " else f"\\Q{sep}\\E")

    def number(i: int) -> Column:
        return F.element_at(cells, i + 1).cast("double")

    out = [F.col("row").alias("s_id"), *(number(i).alias(f"p{a}") for i, a in enumerate("xyz"))]
    if rgb:
        out.append(F.array(*((number(3 + i) / float(rgb_divider)).cast("float") for i in range(3)), F.lit(1.0).cast("float")).alias("rgba"))
    if region:
        out.append((number(3) != 0).alias("region"))
    df = rows.select(*out)
    if not to_origin:
        return df
    moved, first = _to_origin(df, "s_id")
    return moved.crossJoin(F.broadcast(first))  # exactly one row


def read_bounds(spark: SparkSession, path: str) -> DataFrame:
    """One row ``lo*, hi*`` from an extents file: min and max per axis on six lines."""
    rows = numbered_lines(spark, path).withColumn("v", F.col("value").cast("double"))
    names = [f"{end}{a}" for a in "xyz" for end in ("lo", "hi")]
    return rows.agg(*(F.max(F.when(F.col("row") == i, F.col("v"))).alias(n) for i, n in enumerate(names)))


def _ply_header(rows: DataFrame) -> tuple[int, list[str], int, int]:
    """Line count, vertex properties, number of vertices and of faces; only the header is collected."""
    end = rows.where(F.trim("value") == "end_header").agg(F.min("row")).first()[0]
    if end is None:
        raise ValueError("no end_header")
    head = [r.value.split() for r in rows.where(F.col("row") <= end).orderBy("row").collect()]
    properties, counts, element = [], {"vertex": 0, "face": 0}, ""
    for words in head:
        if words[:1] == ["element"]:
            element = words[1]
            counts[element] = int(words[2])
        elif words[:1] == ["property"] and element == "vertex":
            properties.append(words[-1])
    return end + 1, properties, counts["vertex"], counts["face"]


def read_ply(spark: SparkSession, path: str, *, normals: bool = True, to_origin: bool = False, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices ``s_id, p*[, n*]`` and faces ``f_id, vertices`` of an ASCII PLY file."""
    rows = stage(numbered_lines(spark, path), "ply")
    size, properties, n_vertex, n_face = _ply_header(rows)
    cells = F.split(F.trim("value"), r"\s+")

    def named(prop: str) -> Column:
        return F.element_at(cells, properties.index(prop) + 1).cast("double")

    body = rows.withColumn("row", F.col("row") - size)
    wanted = n_vertex if limit is None else min(limit, n_vertex)
    columns = [F.col("row").alias("s_id"), *(named(a).alias(f"p{a}") for a in "xyz")]
    if normals:
        columns += [named(f"n{a}").alias(f"n{a}") for a in "xyz"]
    vertex = body.where((F.col("row") >= 0) & (F.col("row") < wanted)).select(*columns)
    if to_origin:
        moved, first = _to_origin(vertex, "s_id")
        vertex = moved.crossJoin(F.broadcast(first))  # exactly one row
    face = body.where((F.col("row") >= n_vertex) & (F.col("row") < n_vertex + n_face))
    ids = F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda c: c.cast("bigint"))
    return vertex, face.select((F.col("row") - n_vertex).alias("f_id"), ids.alias("vertices"))


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``vertex(v_id, x, y, z)`` and ``face(f_id, v0, v1, v2)`` of an OBJ mesh; ids count from 1.

    A face of more corners becomes a fan of triangles around its first one; a negative number
    counts back from the last vertex above the face.
    """
    lines = stage(_lines(spark, path), "obj")
    cells = F.split(F.trim("value"), r"\s+")
    is_vertex = F.trim("value").rlike(r"^v\s").cast("bigint")
    used = _number(lines.where(F.trim("value").rlike(r"^[vf]\s")), "above", weight=is_vertex)
    vertex = used.where(is_vertex == 1).select((F.col("above") + 1).alias("v_id"), *(F.element_at(cells, i + 2).cast("double").alias(a) for i, a in enumerate("xyz")))
    corners = F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda c: F.split(c, "/")[0].cast("bigint"))
    corners = F.transform(corners, lambda c: F.when(c < 0, F.col("above") + 1 + c).otherwise(c))
    faces = used.where(is_vertex == 0).withColumn("_c", corners).where(F.size("_c") >= 3)
    fans = _number(faces.withColumn("_t", F.size("_c") - 2), "first", weight=F.col("_t").cast("bigint"))
    fan = fans.select("first", "_c", F.explode(F.sequence(F.lit(1), F.col("_t"))).alias("i"))
    return vertex, fan.select((F.col("first") + F.col("i")).alias("f_id"), F.col("_c")[0].alias("v0"), F.col("_c")[F.col("i")].alias("v1"), F.col("_c")[F.col("i") + 1].alias("v2"))


# --- sinks -----------------------------------------------------------------------

def _write_sorted(lines: DataFrame, order: list[str], path: str) -> None:
    """Part files in order; put end to end they are the document."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def _joined(columns: list[Column]) -> Column:
    return F.concat_ws(" ", *(c.cast("string") for c in columns))


def write_xyz(df: DataFrame, path: str, *, columns: list[str] | None = None, key: str = "s_id", decimals: int | None = None, bounds: str | None = None) -> None:
    """One line per row, values separated by spaces; optional fixed decimals and extents file."""
    names = columns or ["px", "py", "pz"]
    cells = [F.col(c) if decimals is None else F.col(c).cast(f"decimal(38,{decimals})") for c in names]
    _write_sorted(df.select(F.col(key), _joined(cells).alias("line")), [key], path)
    if bounds is not None:
        at = [f"{end}{a}" for a in "xyz" for end in ("lo", "hi")]
        box = df.agg(*(F.expr(f"{'min' if n.startswith('lo') else 'max'}({names['xyz'.index(n[2])]})").alias(n) for n in at))
        rows = box.select(F.posexplode(F.array(*at)).alias("no", "v")).select("no", F.col("v").cast("string").alias("line"))
        _write_sorted(rows, ["no"], bounds)


def obj_tables(vertex: DataFrame, face: DataFrame, *, z_scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Vertices about the middle of their box with 1-based numbers ``no``, and faces in those numbers."""
    box = bbox(vertex, "")
    middle = box.select(*(F.expr(f"(hi{a} - lo{a}) / 2 + lo{a}").alias(f"mid{a}") for a in "xyz"))
    moved = vertex.crossJoin(F.broadcast(middle))  # exactly one row
    placed = moved.select("v_id", *((F.col(a) - F.col(f"mid{a}")).alias(a) for a in "xy"), ((F.col("z") - F.col("midz")) * z_scale).alias("z"))
    numbered = stage(number_rows(placed, [F.col("v_id")], "no", start=1, label="vertices"), "vertices")
    out = face.select("f_id", "v0", "v1", "v2")
    for i in range(3):
        out = out.join(numbered.select(F.col("v_id").alias(f"v{i}"), F.col("no").alias(f"n{i}")), f"v{i}")
    return numbered.select("no", "x", "y", "z"), out.select("f_id", *(F.col(f"n{i}").alias(f"v{i}") for i in range(3)))


def write_obj(vertex: DataFrame, face: DataFrame, path: str, *, z_scale: float = 1.0) -> None:
    numbered, faces = obj_tables(vertex, face, z_scale=z_scale)
    v = numbered.select(F.lit(0).alias("kind"), F.col("no"), F.concat(F.lit("v "), _joined([F.col(a) for a in "xyz"])).alias("line"))
    f = faces.select(F.lit(1).alias("kind"), F.col("f_id").alias("no"), F.concat(F.lit("f "), _joined([F.col(f"v{i}") for i in range(3)])).alias("line"))
    _write_sorted(v.unionByName(f), ["kind", "no"], path)


def write_ply(df: DataFrame, path: str, *, normals: bool = False, key: str = "s_id") -> None:
    names = [f"p{a}" for a in "xyz"] + ([f"n{a}" for a in "xyz"] if normals else [])
    labels = list("xyz") + (["nx", "ny", "nz"] if normals else [])
    head = ["ply", "format ascii 1.0", f"element vertex {df.count()}", *(f"property float {p}" for p in labels), "end_header"]
    spark = df.sparkSession
    top = spark.range(1).select(F.posexplode(F.array(*(F.lit(h) for h in head))).alias("no", "line")).select(F.lit(0).alias("kind"), F.col("no").cast("bigint").alias("no"), "line")
    body = df.select(F.lit(1).alias("kind"), F.col(key).alias("no"), _joined([F.col(n) for n in names]).alias("line"))
    _write_sorted(top.unionByName(body), ["kind", "no"], path)
