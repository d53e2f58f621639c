"""Boxes on a page: structs of x0, y0, x1, y1 in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*(F.coalesce(c, F.lit(None)).cast("double").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))))


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def normalize(b: Column, width: Column, height: Column, flip: bool = False) -> Column:
    """page units to [0, 1]; ``flip`` for a y axis that points up."""
    x0, x1 = _clamp(b["x0"] / width), _clamp(b["x1"] / width)
    y0, y1 = (1 - b["y1"] / height, 1 - b["y0"] / height) if flip else (b["y0"] / height, b["y1"] / height)
    return box(x0, _clamp(y0), x1, _clamp(y1))


def is_valid(b: Column) -> Column:
    return (b["x0"] >= 0) & (b["x0"] <= b["x1"]) & (b["x1"] <= 1) & (b["y0"] >= 0) & (b["y0"] <= b["y1"]) & (b["y1"] <= 1)


def contains(a: Column, b: Column, slack: float = 0.01) -> Column:
    """``b`` inside ``a``."""
    return (a["x0"] - slack <= b["x0"]) & (a["y0"] - slack <= b["y0"]) & (a["x1"] + slack >= b["x1"]) & (a["y1"] + slack >= b["y1"])


def intersects(a: Column, b: Column) -> Column:
    """Touching counts."""
    return ~((a["x1"] < b["x0"]) | (b["x1"] < a["x0"]) | (a["y1"] < b["y0"]) | (b["y1"] < a["y0"]))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def union(b: str) -> Column:
    """F11 as an aggregate: the least box around all."""
    return box(F.min(f"{b}.x0"), F.min(f"{b}.y0"), F.max(f"{b}.x1"), F.max(f"{b}.y1"))
