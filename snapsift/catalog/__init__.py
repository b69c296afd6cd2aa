"""Checkable queries over the driver's tables."""

from . import diffs, reports, scoring, whole  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
