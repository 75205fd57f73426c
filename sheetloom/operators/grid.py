"""Range joins of points and boxes as equi-joins on grid cells.

Every box goes to the grid level whose cells are half to one times its longer side, so it
covers at most three cells per axis whatever its size. A point is looked up once per level
in use. A pair of point and box therefore meets in exactly one cell: no duplicates, no
nested-loop join, and no copy count that grows with box size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(side: Column) -> Column:
    # Sides below 2**-20 share the finest level.
    return F.floor(F.log2(F.greatest(side, F.lit(2.0**-20)))).cast("int")


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level.cast("double")))


def _leveled(boxes: DataFrame, axes: Sequence[tuple[str, str]], tol: float, wider: int = 0) -> DataFrame:
    side = F.greatest(*[F.col(hi) - F.col(lo) for lo, hi in axes], F.lit(0.0)) + 2 * tol
    return boxes.withColumn("_level", _level(side) + wider)


def _box_cells(boxes: DataFrame, axes: Sequence[tuple[str, str]], tol: float, wider: int = 0) -> DataFrame:
    """Boxes once per cell; with ``wider`` 1, cells are one to two times the longer side, so at most two per axis."""
    out = _leveled(boxes, axes, tol, wider)
    for n, (lo, hi) in enumerate(axes):
        cells = F.sequence(
            _cell(F.col(lo) - tol, F.col("_level")), _cell(F.col(hi) + tol, F.col("_level"))
        )
        out = out.withColumn(f"_cell{n}", F.explode(cells))
    return out


def _point_cells(points: DataFrame, leveled: DataFrame, coords: Sequence[str]) -> DataFrame:
    # At most a few dozen levels exist between the smallest and the largest double side.
    levels = leveled.agg(F.collect_set("_level")).scalar()
    out = points.withColumn("_level", F.explode(levels))
    for n, c in enumerate(coords):
        out = out.withColumn(f"_cell{n}", _cell(F.col(c), F.col("_level")))
    return out


def _condition(p: str, b: str, keys, coords, axes, tol) -> Column:
    return _inside(p, b, ["_level", *keys, *[f"_cell{n}" for n in range(len(axes))]], coords, axes, tol)


def _inside(p: str, b: str, same, coords, axes, tol) -> Column:
    cond = F.lit(True)
    for k in same:
        cond = cond & (F.col(f"{p}.{k}") == F.col(f"{b}.{k}"))
    for c, (lo, hi) in zip(coords, axes, strict=True):
        cond = cond & F.col(f"{p}.{c}").between(F.col(f"{b}.{lo}") - tol, F.col(f"{b}.{hi}") + tol)
    return cond


def range_pairs(
    points: DataFrame,
    boxes: DataFrame,
    keys: Sequence[str],
    coords: Sequence[str] = ("x", "y"),
    axes: Sequence[tuple[str, str]] = (("x1", "x2"), ("y1", "y2")),
    tol: float = 0.0,
) -> DataFrame:
    """All (point, box) pairs with the point inside the widened box, one row each.

    One axis gives interval containment, two axes box containment. Columns other than
    ``keys`` must differ between the inputs.
    """
    cells = _box_cells(boxes, axes, tol)
    probes = _point_cells(points, _leveled(boxes, axes, tol), coords)
    pairs = probes.alias("p").join(cells.alias("b"), _condition("p", "b", keys, coords, axes, tol))
    return pairs.select(
        *[F.col(f"p.{c}") for c in points.columns],
        *[F.col(f"b.{c}") for c in boxes.columns if c not in keys],
    )


def points_hit(
    points: DataFrame,
    boxes: DataFrame,
    keys: Sequence[str],
    ids: Sequence[str],
    coords: Sequence[str] = ("x", "y"),
    axes: Sequence[tuple[str, str]] = (("x1", "x2"), ("y1", "y2")),
    tol: float = 0.0,
    own_tol: str | None = None,
) -> DataFrame:
    """Distinct ``ids`` of points inside at least one widened box.

    ``own_tol`` names a column with each point's tolerance, at most ``tol``. A left-semi join stops at the first hit, so piles of repeated boxes never multiply rows.
    """
    sides = [c for axis in axes for c in axis]
    # Repeats go before the boxes are dealt to cells, so that only boxes that differ travel once per cell.
    boxes = boxes.select(*keys, *sides).distinct()
    cells, probes = _box_cells(boxes, axes, tol, wider=1), _point_cells(points, _leveled(boxes, axes, tol, 1), coords)
    at = F.xxhash64("_level", *[f"_cell{n}" for n in range(len(axes))])
    # One number stands for the cell; the box decides, so cells that share it do no harm.
    cells = cells.select(*keys, *sides, at.alias("_at"))
    probes = probes.select(*points.columns, at.alias("_at"))
    within = F.lit(tol) if own_tol is None else F.col(f"p.{own_tol}")
    same = _inside("p", "b", [*keys, "_at"], coords, axes, within)
    return probes.alias("p").join(cells.alias("b"), same, "left_semi").select(*ids).distinct()
