"""Per-sheet analysis: spoke sides, half-sheets, measures and their regressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.symmetric3 import with_axis
from ridgeline.functions.vec import Vec, angle, choose, put
from ridgeline.operators.fitting import moments
from ridgeline.staging import large

MEASURES = ("radius", "ma_theta", "ma_bisec_diff", "ma_thetap", "ma_planfit", "biseco_diff")


def spoke_sides(atoms: DataFrame, labels: DataFrame) -> DataFrame:
    """Balls with ``seg`` and ``one_side``: which way the spoke pair turns about the sheet's axis."""
    rows = atoms.join(large(labels.where("seg <> 0")), "ma_id")
    axes = with_axis(moments(rows, ["seg"], "k"), "s", "t", largest=True).select("seg", "tx", "ty", "tz")
    turned = rows.join(axes, "seg")
    return turned.withColumn("one_side", F.coalesce(Vec.of("t").dot(Vec.of("k")) > 0, F.lit(False))).drop("tx", "ty", "tz")


def half_sheet_points(sided: DataFrame) -> DataFrame:
    """``seg, half, s_id, f*``: one row per spoke; the second spoke lies on the other half."""
    spokes = F.array(*(
        F.struct(
            F.when(F.col("one_side") == first, 1).otherwise(2).alias("half"), F.col(point).alias("s_id"),
            *(F.col(f"{f}{a}").alias(f"f{a}") for a in "xyz"),
        )
        for first, point, f in ((True, "s_id", "f1"), (False, "q_id", "f2"))
    ))
    return sided.select("seg", "ma_id", F.explode(spokes).alias("e")).select("seg", "ma_id", "e.*")


def half_sheets(sided: DataFrame) -> DataFrame:
    """Per (seg, half): number of points with repeats and the mean raw spoke ``f*``."""
    return half_sheet_points(sided).groupBy("seg", "half").agg(F.count("*").alias("points"), *(F.avg(f"f{a}").alias(f"f{a}") for a in "xyz"))


def sheet_measures(sided: DataFrame) -> DataFrame:
    """Per ball: position ``x`` along the sheet and the six measures regressed on it."""
    aligned = put(sided, "g", choose(F.col("one_side"), Vec.of("k"), -Vec.of("k")))
    means = aligned.groupBy("seg").agg(
        F.avg("r").alias("_r"), F.avg("theta").alias("_theta"),
        *(F.avg(f"{p}{a}").alias(f"_{p}{a}") for p in ("b", "c", "g") for a in "xyz"),
    )
    means = put(means, "_n", Vec.of("_g").cross(Vec.of("_b")).unit())
    rows = aligned.join(means, "seg")
    x = F.try_divide(F.col("_r"), F.cos(F.col("_theta") / 2)) + (Vec.of("_c") - Vec.of("c")).dot(Vec.of("_b"))
    rows = rows.withColumn("x", x)
    ratio = F.try_divide(F.col("r"), F.col("x"))
    return rows.select(
        "seg", "ma_id", "one_side", "x",
        F.col("r").alias("radius"),
        F.col("theta").alias("ma_theta"),
        angle(Vec.of("_b"), Vec.of("b")).alias("ma_bisec_diff"),
        F.when(F.abs(ratio) <= 1, F.acos(ratio) * 2).alias("ma_thetap"),
        (Vec.of("c") - Vec.of("_c")).dot(Vec.of("_n")).alias("ma_planfit"),
        angle(Vec.of("_g"), Vec.of("g")).alias("biseco_diff"),
    )


def _log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series 15 further on, and back by the recurrence."""
    s, product = z + 15.0, z
    for i in range(1, 15):
        product = product * (z + float(i))
    series = 1.0 / (12.0 * s) - 1.0 / (360.0 * s**3) + 1.0 / (1260.0 * s**5) - 1.0 / (1680.0 * s**7)
    return (s - 0.5) * F.log(s) - s + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def _beta_fraction(p: Column, q: Column, z: Column, rounds: Column) -> Column:
    """Continued fraction of the incomplete beta function, folded from the front (modified Lentz)."""

    def solid(x: Column) -> Column:
        return F.when(F.abs(x) < 1e-300, 1e-300).otherwise(x)

    def state(c: Column, d: Column, h: Column) -> Column:
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def further(acc: Column, top: Column) -> Column:
        d = 1.0 / solid(1.0 + top * acc["d"])
        c = solid(1.0 + top / acc["c"])
        return state(c, d, acc["h"] * d * c)

    def step(acc: Column, term: Column) -> Column:
        # term i is the odd one of round m = (i + 1) / 2 or the even one of m = i / 2
        m = F.ceil(term / 2).cast("double")
        even = -(p + m) * (p + q + m) * z / ((p + 2.0 * m) * (p + 2.0 * m + 1.0))
        odd = m * (q - m) * z / ((p + 2.0 * m - 1.0) * (p + 2.0 * m))
        return further(acc, F.when(term % 2 == 1, odd).otherwise(even))

    first = 1.0 / solid(1.0 - (p + q) * z / (p + 1.0))
    return F.aggregate(F.sequence(F.lit(1), rounds), state(F.lit(1.0), first, first), step)["h"]


def two_sided_p(r: Column | str, n: Column | str) -> Column:
    """p-value of a correlation: t distribution with n - 2 degrees of freedom, which is an incomplete beta function
    of 1 - r^2.  NULL without a correlation or below two points; 0 for two points."""
    r, n = (F.col(c) if isinstance(c, str) else c for c in (r, n))
    free = (n - 2) / 2.0
    rest = (1.0 - r) * (1.0 + r)
    swap = rest > (free + 1.0) / (free + 2.5)
    given = F.struct(
        free.alias("a"), swap.alias("swap"), F.when(swap, 0.5).otherwise(free).alias("p"), F.when(swap, free).otherwise(0.5).alias("q"),
        F.when(swap, r * r).otherwise(rest).alias("z"), (100 + 8 * F.sqrt(free)).cast("int").alias("rounds"),
    )

    def value(g: Column) -> Column:
        log_beta = _log_gamma(g["a"] + 0.5) - _log_gamma(g["a"]) - 0.5 * math.log(math.pi)
        front = F.exp(log_beta + g["p"] * F.log(g["z"]) + g["q"] * F.log(1.0 - g["z"])) / g["p"]
        part = F.when(g["z"] > 0, front * _beta_fraction(g["p"], g["q"], g["z"], g["rounds"])).otherwise(0.0)
        return F.when(g["swap"], 1.0 - part).otherwise(part)

    known = F.when(r.isNotNull() & (n > 2), F.array(given))
    return F.when(r.isNotNull() & (n == 2), 0.0).otherwise(F.transform(known, value)[0])


def regressions(measures: DataFrame) -> DataFrame:
    """``seg, measure, n, slope, intercept, r_value, std_err, p_value`` by least squares on ``x``.

    A measure missing on one ball leaves its five figures NULL for the sheet.
    """
    aggs = [F.count("*").alias("n"), F.count("x").alias("n_x"), F.var_pop("x").alias("vx")]
    for m in MEASURES:
        aggs += [F.count(m).alias(f"{m}_n"), F.covar_pop("x", m).alias(f"{m}_c"), F.var_pop(m).alias(f"{m}_v"), F.avg(m).alias(f"{m}_m")]
    wide = measures.groupBy("seg").agg(*aggs, F.avg("x").alias("mx"))
    entries = F.array(*(F.struct(F.lit(m).alias("measure"), *(F.col(f"{m}_{s}").alias(s) for s in ("n", "c", "v", "m"))) for m in MEASURES))
    tall = wide.select("seg", F.col("n").alias("balls"), "n_x", "vx", "mx", F.explode(entries).alias("e")).select("seg", "balls", "n_x", "vx", "mx", "e.*")
    whole = (F.col("n") == F.col("balls")) & (F.col("n_x") == F.col("balls")) & (F.col("vx") > 0)
    slope = F.when(whole, F.col("c") / F.col("vx"))
    r = F.when(whole, F.when(F.col("v") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c") / F.sqrt(F.col("vx") * F.col("v"))))).otherwise(F.lit(0.0)))
    tall = tall.withColumns({"slope": slope, "r_value": r})
    error = F.when(F.col("balls") > 2, F.sqrt((1 - F.col("r_value") ** 2) * F.col("v") / F.col("vx") / (F.col("balls") - 2)))
    out = tall.withColumns({
        "intercept": F.col("m") - F.col("slope") * F.col("mx"),
        "std_err": F.when(whole, F.when(F.col("balls") == 2, F.lit(0.0)).otherwise(error)),
    })
    p_value = two_sided_p(F.col("r_value"), F.col("balls")).alias("p_value")
    return out.select("seg", "measure", F.col("balls").alias("n"), "slope", "intercept", "r_value", "std_err", p_value)


def sheet_regularity(measures: DataFrame) -> DataFrame:
    """Per sheet the larger share of balls turning one way and the rms distance from its plane."""
    one = F.count_if(F.col("one_side"))
    return measures.groupBy("seg").agg(
        (F.greatest(one, F.count("*") - one) / F.count("*")).alias("regularity_ratio"),
        F.sqrt(F.avg(F.col("ma_planfit") * F.col("ma_planfit"))).alias("ma_planfit_rms"),
    )


def analyse_sheets(atoms: DataFrame, labels: DataFrame, *, digits: int | None = None) -> DataFrame:
    """One wide row per sheet with all figures; measures may be rounded to ``digits`` first."""
    measures = sheet_measures(spoke_sides(atoms, labels))
    if digits is not None:
        measures = measures.withColumns({m: F.round(m, digits) for m in MEASURES})
    figures = ("slope", "intercept", "r_value", "p_value", "std_err")
    tall = regressions(measures)
    wide = tall.groupBy("seg").agg(*(F.max(F.when(F.col("measure") == m, F.col(f))).alias(f"{m}_{f}") for m in MEASURES for f in figures))
    return sheet_regularity(measures).join(wide, "seg")
