"""Planes through three points and projections onto them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[float, float, float]


def _dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def _unit(a):
    size = math.sqrt(_dot(a, a))
    if size < 1e-12:
        raise ValueError("the three points lie on one line")
    return tuple(x / size for x in a)


def plane_basis(p: Point, q: Point, r: Point) -> tuple[Point, Point, Point]:
    """Origin and two orthonormal axes of the plane through three points; the first axis points from p to q."""
    first = _unit(tuple(b - a for a, b in zip(p, q, strict=True)))
    rest = tuple(b - a for a, b in zip(p, r, strict=True))
    along = _dot(rest, first)
    return p, first, _unit(tuple(x - along * f for x, f in zip(rest, first, strict=True)))


def on_plane(point: list[Column], basis, vector: bool = False) -> tuple[Column, Column]:
    """Coordinates of a point (or of a vector) on the plane."""
    origin, first, second = basis
    moved = [c if vector else c - F.lit(o) for c, o in zip(point, origin, strict=True)]
    return tuple(sum((c * x for c, x in zip(moved, axis, strict=True)), F.lit(0.0)) for axis in (first, second))


def off_plane(a: Column, b: Column, basis, vector: bool = False) -> tuple[Column, Column, Column]:
    """The point (or vector) in space of coordinates on the plane."""
    origin, first, second = basis
    return tuple(a * f + b * s + (0.0 if vector else o) for o, f, s in zip(origin, first, second, strict=True))
