"""Rectangles as four columns x1, y1, x2, y2; all expressions run inside the JVM."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rect(NamedTuple):
    """An axis-parallel rectangle of column expressions."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(prefix: str = "") -> "Rect":
        return Rect(*(F.col(f"{prefix}{k}") for k in ("x1", "y1", "x2", "y2")))

    @staticmethod
    def from_box(x: Column, y: Column, width: Column, height: Column) -> "Rect":
        return Rect(x, y, x + width, y + height)


def width(r: Rect) -> Column:
    return r.x2 - r.x1


def height(r: Rect) -> Column:
    return r.y2 - r.y1


def area(r: Rect) -> Column:
    return width(r) * height(r)


def overlaps(a: Rect, b: Rect) -> Column:
    """Strict overlap: rectangles that only touch do not overlap."""
    return (a.x1 < b.x2) & (b.x1 < a.x2) & (a.y1 < b.y2) & (b.y1 < a.y2)


def intersection(a: Rect, b: Rect) -> Rect:
    """Greatest of the lower and least of the upper bounds; not clamped."""
    return Rect(F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1), F.least(a.x2, b.x2), F.least(a.y2, b.y2))


def iou(a: Rect, b: Rect) -> Column:
    i = intersection(a, b)
    return F.when((width(i) <= 0) | (height(i) <= 0), F.lit(0.0)).otherwise(area(i) / (area(a) + area(b) - area(i)))


def covered(a: Rect, b: Rect, share: float = 0.3) -> Column:
    """Whether more than ``share`` of ``a`` lies in ``b`` (not symmetric)."""
    i = intersection(a, b)
    return (iou(a, b) > 0) & (area(i) / area(a) > share)
