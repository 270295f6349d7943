"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Everything is DataFrame and SQL expressions.  Sources share the total size by weight; no target
exceeds ``most`` times its source, and what is cut off is shared again by weight.  From each source whole
epochs are taken first.  For the rest, every document draws an exponential variate divided by its
quality weight; documents are taken in ascending order of these keys while the middle of the next one lies
within the budget.  That is weighted sampling without replacement.

The order is never sorted whole: keys are counted into 2^20 cells, sums over cells (at most 1,024
for each source and step) find the one cell where the budget ends, and only that cell, about a millionth
of the source, is sorted.  A source with a third of all rows is thus spread over all tasks.

A null text has size 0 and a null source is a source of its own, last in order.  Rows equal in id
and text have equal keys and are taken together.  Draws depend on id, text and seed only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import WORD
from ridgeline.staging import number_rows, stage

CELLS = 1 << 20
#: Rows of the plan (under 100 bytes and a name each) up to which it is broadcast.
FEW_SOURCES = 50_000


def quality_weight(text: Column) -> Column:
    """Weight in 0.05 to 1: one less the symbols for each word."""
    t = F.coalesce(text, F.lit(""))
    return F.greatest(F.lit(0.05), 1 - F.regexp_count(t, F.lit("[#*$%&|<>]")) / (F.regexp_count(t, F.lit(WORD)) + F.lit(1.0)))


def _keyed(docs: DataFrame, carry: Column, weight: Column, seed: int) -> DataFrame:
    """``row``, source, size and the exponential key of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seeded = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    bits = F.conv(F.substring(F.md5(seeded.cast("binary")), 1, 13), 16, 10).cast("bigint")
    uniform = (bits.cast("double") + 0.5) / F.lit(float(1 << 52))
    return docs.select(
        carry.alias("row"),
        F.col("source").cast("string").alias("_source"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("_size"),
        (-F.ln(uniform) / weight).alias("_key"),
    )


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``_source, source_size, target`` from ``_source, source_size``, one row each.

    Weights repeat along the sources in order of code points, null last.
    """
    order = [F.col("_source").isNull(), F.col("_source")]
    ranked = number_rows(sizes, order, "_n", label="sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    ranked = stage(ranked.select("_source", "source_size", weight.alias("_weight")), "source-weights")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, -1
    while True:  # every round caps at least one more source
        cap = F.col("source_size") * F.lit(most)
        full = cap <= F.lit(level) * F.col("_weight")
        n, cut, open_ = ranked.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("_weight")))).first()
        if n == capped or not open_:
            break
        level, capped = (total - (cut or 0.0)) / open_, n
    return ranked.select("_source", "source_size", F.least(cap, F.lit(level) * F.col("_weight")).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def plan(keyed: DataFrame, **options) -> DataFrame:
    """One row for each source: ``_s, source_size, target, epochs`` and the last key taken besides (or null)."""
    goal = targets(keyed.groupBy("_source").agg(F.sum("_size").alias("source_size")), **options)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = stage(goal.withColumnRenamed("_source", "_s"), "mix-goals")
    cell = F.least(F.floor(F.col("_key") / (F.col("_key") + 1) * CELLS), F.lit(CELLS - 1)).cast("int")
    rows = keyed.select("_source", "_size", "_key", cell.alias("cell"))

    def border(sums: DataFrame, wanted: DataFrame) -> DataFrame:
        """The first part in which the running sum reaches what is wanted, and the sum before it."""
        run = Window.partitionBy("_source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        upto = sums.withColumn("upto", F.sum("sum").over(run)).join(wanted, _same("_source", "_s"))
        hit = upto.where(F.col("before") + F.col("upto") >= F.col("rest")).groupBy("_s", "rest")
        return hit.agg(F.min_by(F.struct("part", (F.col("before") + F.col("upto") - F.col("sum")).alias("before")), "part").alias("hit"))

    coarse = border(
        rows.groupBy("_source", F.shiftright("cell", 10).alias("part")).agg(F.sum("_size").alias("sum")),
        goal.where("rest > 0").select("_s", "rest", F.lit(0).cast("bigint").alias("before")),
    ).select("_s", "rest", F.col("hit.part").alias("high"), F.col("hit.before").alias("before"))
    coarse = stage(coarse, "mix-coarse")
    inside = rows.join(coarse, _same("_source", "_s") & (F.shiftright("cell", 10) == F.col("high")))
    fine = border(
        inside.groupBy("_source", F.col("cell").alias("part")).agg(F.sum("_size").alias("sum")), coarse.select("_s", "rest", "before")
    ).select("_s", "rest", F.col("hit.part").alias("cell"), F.col("hit.before").alias("before"))
    fine = stage(fine, "mix-fine")
    last = rows.join(fine.withColumnRenamed("cell", "at"), _same("_source", "_s") & (F.col("cell") == F.col("at")))
    run = Window.partitionBy("_s").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    within = last.withColumn("sum", F.col("before") + F.coalesce(F.sum("_size").over(run), F.lit(0)))
    ends = within.groupBy("_s", "at").agg(F.max(F.when(F.col("sum") + F.col("_size") / 2 <= F.col("rest"), F.col("_key"))).alias("last_key"))
    ends = stage(ends.select("_s", "at", "last_key"), "mix-ends")
    ends = ends.select(F.col("_s").alias("_e"), (F.col("at") / CELLS).alias("_floor"), "last_key")
    # cells before the border are taken whole: any key below it
    return stage(goal.join(ends, _same("_s", "_e"), "left").drop("_e"), "mix-plan")


def _planned(keyed: DataFrame, planned: DataFrame) -> DataFrame:
    """Documents beside the plan of their source.

    Up to ``FEW_SOURCES`` rows the plan is broadcast, so that documents stay where they are; beyond,
    an ordinary join on the unique source follows, whose hot keys can be split.
    """
    few = planned.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    return keyed.join(F.broadcast(planned) if few else planned, _same("_source", "_s"))


def _times(planned: DataFrame) -> Column:
    """How often a document is taken."""
    below = F.floor(F.col("_key") / (F.col("_key") + 1) * CELLS) / CELLS < F.col("_floor")
    return F.col("epochs") + F.when((F.col("_size") > 0) & (F.coalesce(below, F.lit(False)) | F.coalesce(F.col("_key") <= F.col("last_key"), F.lit(False))), 1).otherwise(0)


def mix(docs: DataFrame, *, weight: Column | None = None, seed: int = 7, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row; ``taken`` counts repeats."""
    keyed = _keyed(docs, F.struct("doc_id"), quality_weight(F.col("text")) if weight is None else weight, seed)
    keyed = stage(keyed, "mix-keys")
    rows = _planned(keyed, plan(keyed, **options))
    taken = (F.col("_size") * _times(rows)).alias("taken")
    return rows.select("row.doc_id", F.col("_size").alias("size"), "source_size", "target", taken)


def mixed_rows(docs: DataFrame, *, weight: Column | None = None, seed: int = 7, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    keyed = _keyed(docs, F.struct(*docs.columns), quality_weight(F.col("text")) if weight is None else weight, seed)
    planned = plan(stage(keyed.drop("row"), "mix-keys"), **options)
    rows = _planned(keyed, planned)
    return rows.select(F.explode(F.array_repeat("row", _times(rows).cast("int"))).alias("row")).select("row.*")


#: The whole mix in SQL: weights 1, 2, 3, three times at most, seed 7; closed form by capping sources in order.
ORACLE = r"""
WITH k AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  -ln((('0x' || md5('7|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, ''))[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
   / greatest(0.05::DOUBLE, 1 - len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) / (len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1::DOUBLE)) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS w FROM k GROUP BY source),
o AS (SELECT *, coalesce(sum(3.0::DOUBLE * source_size) OVER below, 0) AS cut, sum(w) OVER rest AS open, (SELECT sum(source_size) FROM s) AS total FROM s
  WINDOW below AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
   rest AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT max((total - cut) / open) FILTER (WHERE 3.0::DOUBLE * source_size > (total - cut) / open * w) AS level FROM o),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, coalesce(level * w, 3.0::DOUBLE * source_size)) AS target FROM s, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
  coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN before + size / 2 <= rest AND rest > 0 THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
