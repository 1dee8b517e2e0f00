"""Column functions over boxes given as x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span(a: Column, b: Column) -> Column:
    return F.greatest(b - a, F.lit(0.0))


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return span(x0, x1) * span(y0, y1)


def iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    shared = span(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * span(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    union = area(*a) + area(*b) - shared
    return F.when(union <= 0, F.lit(0.0)).otherwise(shared / union)


def match_score(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Vertical overlap for three quarters, horizontal for one, each against the smaller extent."""
    across = span(F.greatest(a[0], b[0]), F.least(a[2], b[2])) / F.greatest(F.least(a[2] - a[0], b[2] - b[0]), F.lit(1.0))
    down = span(F.greatest(a[1], b[1]), F.least(a[3], b[3])) / F.greatest(F.least(a[3] - a[1], b[3] - b[1]), F.lit(1.0))
    return 0.75 * F.least(down, F.lit(1.0)) + 0.25 * F.least(across, F.lit(1.0))


def polygon_kind(w: Column, h: Column, a: Column) -> Column:
    """normal, narrow or null: what the detector's filter makes of a polygon."""
    return F.when((w >= 8) & (h >= 6) & (a >= 96), F.lit("normal")).when((w >= 3) & (h >= 10) & (a >= 28) & (h / F.greatest(w, F.lit(1.0)) >= 1.35), F.lit("narrow"))
