"""Algebra of image boxes (structs x1, y1, x2, y2) and of axis-aligned boxes in space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))


def _side(a: Column) -> Column:
    return F.greatest(F.lit(0.0), a)


def area(b: Column) -> Column:
    """0 for a null box."""
    return F.coalesce(_side(b["x2"] - b["x1"]) * _side(b["y2"] - b["y1"]), F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(_side(w) * _side(h))


def iou(a: Column, b: Column) -> Column:
    shared = intersection(a, b)
    return F.try_divide(shared, area(a) + area(b) - shared)


def overlap(a: Column, b: Column) -> Column:
    """Shared area over the area of ``a``."""
    return F.coalesce(F.try_divide(intersection(a, b), area(a)), F.lit(0.0))


def centre_x(b: Column) -> Column:
    return (b["x1"] + b["x2"]) / 2.0


def centre_y(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / 2.0


def gap(a: Column, b: Column) -> Column:
    dx = F.greatest(F.lit(0.0), a["x1"] - b["x2"], b["x1"] - a["x2"])
    dy = F.greatest(F.lit(0.0), a["y1"] - b["y2"], b["y1"] - a["y2"])
    return F.when(a.isNotNull() & b.isNotNull(), F.sqrt(dx * dx + dy * dy))


def centre_distance(a: Column, b: Column, diagonal: Column) -> Column:
    """Distance of centres as a share of the image's diagonal; null without one."""
    dx, dy = centre_x(a) - centre_x(b), centre_y(a) - centre_y(b)
    return F.when(a.isNotNull() & b.isNotNull() & (diagonal > 0), F.sqrt(dx * dx + dy * dy) / diagonal)


def crop_around(b: Column, width: Column, height: Column, margin: float) -> Column:
    """Whole-pixel crop with a margin of the box's own size on each side, inside the image."""
    mx, my = (b["x2"] - b["x1"]) * margin, (b["y2"] - b["y1"]) * margin
    return F.struct(
        F.greatest(F.lit(0), F.floor(b["x1"] - mx)).alias("x1"),
        F.greatest(F.lit(0), F.floor(b["y1"] - my)).alias("y1"),
        F.least(width, F.ceil(b["x2"] + mx)).alias("x2"),
        F.least(height, F.ceil(b["y2"] + my)).alias("y2"),
    )


def moved(b: Column, dx: Column, dy: Column) -> Column:
    """A crop's box in the coordinates of the full image."""
    return box(b["x1"] + dx, b["y1"] + dy, b["x2"] + dx, b["y2"] + dy)


def nearest_source(target: Column, target_size: Column, source_size: Column) -> Column:
    """Index of the source pixel that a nearest-neighbour resize puts at a target pixel."""
    return F.least(F.floor((target + 0.5) * source_size / target_size), source_size - 1)


def gap_3d(low_a: list[Column], high_a: list[Column], low_b: list[Column], high_b: list[Column]) -> Column:
    parts = [F.greatest(F.lit(0.0), la - hb, lb - ha) for la, ha, lb, hb in zip(low_a, high_a, low_b, high_b, strict=True)]
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
