"""Closed-form eigen solve of symmetric 3x3 matrices as column expressions.

The matrix lives in six columns ``<m>xx <m>xy <m>xz <m>yy <m>yz <m>zz``.  Eigenvalues
come from the trigonometric form of the cubic; an eigenvector is the longest cross
product of two rows of (A - value*I), turned so that its largest component is positive.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vec import Vec, choose, clamp, put


def _largest_positive(v: Vec) -> Vec:
    ax, ay, az = F.abs(v.x), F.abs(v.y), F.abs(v.z)
    # components that are equal but for rounding count as equal, so the sign does not hang on the last bits
    near = 1.0 - 1e-6
    lead = F.when((ax >= ay * near) & (ax >= az * near), v.x).when(ay >= az * near, v.y).otherwise(v.z)
    sign = F.when(lead < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return v * sign


def with_axis(df: DataFrame, matrix: str, out: str, *, largest: bool) -> DataFrame:
    """Add the unit eigenvector ``<out>x,y,z`` of the largest or smallest eigenvalue and
    its value ``<out>_val``.  NULL where the eigenvalue is not separated from the rest."""
    keep = df.columns
    m = {k: F.col(f"{matrix}{k}") for k in ("xx", "xy", "xz", "yy", "yz", "zz")}
    work = df.withColumns({
        "_q": (m["xx"] + m["yy"] + m["zz"]) / 3.0,
        "_off": m["xy"] * m["xy"] + m["xz"] * m["xz"] + m["yz"] * m["yz"],
    })
    q = F.col("_q")
    a, b, c = m["xx"] - q, m["yy"] - q, m["zz"] - q
    work = work.withColumn("_p", F.sqrt((a * a + b * b + c * c + 2.0 * F.col("_off")) / 6.0))
    p = F.when(F.col("_p") > 0, F.col("_p"))
    det = (
        a * (b * c - m["yz"] * m["yz"])
        - m["xy"] * (m["xy"] * c - m["yz"] * m["xz"])
        + m["xz"] * (m["xy"] * m["yz"] - b * m["xz"])
    )
    work = work.withColumn("_phi", F.acos(clamp(det / (2.0 * p * p * p))) / 3.0)
    turn = 0.0 if largest else 2.0 * math.pi / 3.0
    work = work.withColumn(f"{out}_val", q + 2.0 * p * F.cos(F.col("_phi") + turn))
    value = F.col(f"{out}_val")
    r0 = Vec(m["xx"] - value, m["xy"], m["xz"])
    r1 = Vec(m["xy"], m["yy"] - value, m["yz"])
    r2 = Vec(m["xz"], m["yz"], m["zz"] - value)
    for name, vec in (("_u", r0.cross(r1)), ("_v", r0.cross(r2)), ("_w", r1.cross(r2))):
        work = put(work, name, vec)
    u, v, w = Vec.of("_u"), Vec.of("_v"), Vec.of("_w")
    work = work.withColumns({"_u2": u.abs2(), "_v2": v.abs2(), "_w2": w.abs2()})
    u2, v2, w2 = F.col("_u2"), F.col("_v2"), F.col("_w2")
    work = put(work, "_e", choose((u2 >= v2) & (u2 >= w2), u, choose(v2 >= w2, v, w)))
    work = put(work, "_e", Vec.of("_e").unit())
    work = put(work, out, _largest_positive(Vec.of("_e")))
    return work.select(*keep, f"{out}_val", *(f"{out}{axis}" for axis in "xyz"))
