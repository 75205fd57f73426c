"""Segments, points and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetloom.functions.names import strip

# Fixed values, in page units: snap distance of segment ends, tolerance of label boxes,
# tolerance around detector boxes for points and for line midpoints, naming distance.
SNAP = 0.5
LABEL_TOLERANCE = 5.0
POINT_TOLERANCE = 5.0
LINE_TOLERANCE = 3.0
NAMING_DISTANCE = 200.0


def is_dashed(pattern: Column) -> Column:
    """True for a dash pattern in brackets that is not blank."""
    inner = F.replace(F.split_part(pattern, F.lit("]"), F.lit(1)), F.lit("["), F.lit(""))
    return F.coalesce(F.contains(pattern, F.lit("[")) & (strip(inner) != ""), F.lit(False))


def segment_length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean length."""
    return F.hypot(x2 - x1, y2 - y1)


def snap(v: Column) -> Column:
    """Integer lattice key of a coordinate, half to even."""
    return F.rint(v / SNAP).cast("bigint")


def distance_to_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment; a segment without length counts as a point."""
    dx, dy = x2 - x1, y2 - y1
    along = ((x - x1) * dx + (y - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    along = F.coalesce(along, F.lit(0.0))
    return (
        F.when(along < 0, F.hypot(x - x1, y - y1))
        .when(along > 1, F.hypot(x - x2, y - y2))
        .otherwise(F.hypot(x - (x1 + along * dx), y - (y1 + along * dy)))
    )


def crosses_ray(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """True when the ray from the point to the right crosses the half-open segment."""
    spans = ((y1 <= y) & (y < y2)) | ((y2 <= y) & (y < y1))
    at = x1 + (y - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0))
    return F.coalesce(spans & (at > x), F.lit(False))


def in_box(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column, tol: float) -> Column:
    """Inclusive containment in a box widened by ``tol``."""
    return x.between(x1 - tol, x2 + tol) & y.between(y1 - tol, y2 + tol)


def clamp_points(points: Column, width: Column, height: Column) -> Column:
    """Move every point of an ``array<struct<x,y>>`` into the image."""
    return F.transform(
        points,
        lambda p: F.struct(
            F.least(F.greatest(p["x"], F.lit(0.0)), width.cast("double")).alias("x"),
            F.least(F.greatest(p["y"], F.lit(0.0)), height.cast("double")).alias("y"),
        ),
    )
