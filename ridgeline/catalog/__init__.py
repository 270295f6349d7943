"""Queries over the given tables, each with its SQL counterpart where SQL can state it."""

from ridgeline.catalog.base import ORACLES, QUERIES
from ridgeline.catalog import atoms, sheets, meshes, shapes, maps, files  # noqa: F401  (registration)

__all__ = ["QUERIES", "ORACLES"]
