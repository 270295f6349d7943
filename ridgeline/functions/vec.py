"""3D vectors as triples of Spark columns.

A vector named ``c`` lives in the flat columns ``cx, cy, cz``: flat columns keep
parquet pruning and whole-stage codegen intact.  Everything here only builds
column expressions; nothing runs until Spark evaluates the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def num(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


@dataclass(frozen=True)
class Vec:
    x: Column
    y: Column
    z: Column

    @staticmethod
    def of(prefix: str, table: str | None = None) -> "Vec":
        head = f"{table}." if table else ""
        return Vec(*(F.col(f"{head}{prefix}{axis}") for axis in "xyz"))

    @staticmethod
    def lit(x, y, z) -> "Vec":
        return Vec(num(x), num(y), num(z))

    def map(self, fn) -> "Vec":
        return Vec(fn(self.x), fn(self.y), fn(self.z))

    def __add__(self, other: "Vec") -> "Vec":
        return Vec(self.x + other.x, self.y + other.y, self.z + other.z)

    def __sub__(self, other: "Vec") -> "Vec":
        return Vec(self.x - other.x, self.y - other.y, self.z - other.z)

    def __mul__(self, factor) -> "Vec":
        return self.map(lambda c: c * num(factor))

    def __truediv__(self, divisor) -> "Vec":
        return self.map(lambda c: c / num(divisor))

    def __neg__(self) -> "Vec":
        return self.map(lambda c: -c)

    def dot(self, other: "Vec") -> Column:
        return self.x * other.x + self.y * other.y + self.z * other.z

    def cross(self, other: "Vec") -> "Vec":
        return Vec(
            self.y * other.z - self.z * other.y,
            self.z * other.x - self.x * other.z,
            self.x * other.y - self.y * other.x,
        )

    def abs2(self) -> Column:
        return self.dot(self)

    def norm(self) -> Column:
        return F.sqrt(self.abs2())

    def unit(self) -> "Vec":
        """Unit vector; NULL when the length is zero."""
        length = self.norm()
        return self.map(lambda c: F.when(length > 0, c / length))

    def parallel_to(self, axis: "Vec") -> "Vec":
        return axis * (self.dot(axis) / axis.abs2())

    def orthogonal_to(self, axis: "Vec") -> "Vec":
        return self - self.parallel_to(axis)

    def agg(self, fn) -> "Vec":
        return self.map(fn)

    def cols(self, prefix: str) -> list[Column]:
        return [c.alias(f"{prefix}{axis}") for c, axis in zip((self.x, self.y, self.z), "xyz")]


def put(df: DataFrame, prefix: str, vec: Vec) -> DataFrame:
    """Store a vector in the flat columns ``<prefix>x, <prefix>y, <prefix>z``."""
    return df.withColumns({f"{prefix}x": vec.x, f"{prefix}y": vec.y, f"{prefix}z": vec.z})


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def acos_clamped(c: Column) -> Column:
    return F.acos(clamp(c))


def angle(a: Vec, b: Vec) -> Column:
    """Angle between two vectors in radians, any lengths; NULL for a zero vector."""
    lengths = a.norm() * b.norm()
    return F.when(lengths > 0, acos_clamped(a.dot(b) / lengths))


def radians(degrees: float) -> float:
    return math.radians(degrees)


def choose(condition: Column, yes: Vec, no: Vec | None = None) -> Vec:
    """Component-wise ``when``; NULL components where neither side applies."""
    if no is None:
        return yes.map(lambda c: F.when(condition, c))
    return Vec(
        F.when(condition, yes.x).otherwise(no.x),
        F.when(condition, yes.y).otherwise(no.y),
        F.when(condition, yes.z).otherwise(no.z),
    )
