"""Boxes as structs of x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def overlap_area(a: Column, b: Column) -> Column:
    dx = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    dy = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((dx >= 0) & (dy >= 0), dx * dy)


def overlaps(a: Column, b: Column) -> Column:
    """Touching counts."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared area over the smaller area; 0 where they are apart or the smaller is empty."""
    smaller = F.least(area(a), area(b))
    return F.coalesce(F.when(smaller > 0, overlap_area(a, b) / smaller), F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    both = box(
        F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])
    )
    return F.when(overlaps(a, b), both)


def expand(b: Column, margin: float) -> Column:
    return box(b["x0"] - margin, b["y0"] - margin, b["x1"] + margin, b["y1"] + margin)


def bounding() -> Column:
    """Aggregate: the box around all words of a group."""
    return box(F.min("x0"), F.min("top"), F.max("x1"), F.max("bottom"))
