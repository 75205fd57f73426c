"""Closed loops of dashed segments.

A vertex is a snapped segment end. Where exactly two ends meet, walking in along one segment
means walking out along the other, so every (segment, end) has at most one successor. Loops
are then the cycles of a one-to-one successor table, found by pointer doubling: joins on
unique keys, a number of rounds logarithmic in loop length, and no vertex with many segments
ever takes part in a join.

Most loops are small, and their vertices lie close together. If asked for, successors are dealt by
place first, and a task settles the loops that lie whole in a batch of rows; only what is left,
at the borders of places and batches and in long loops, goes through the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.functions import shapes
from sheetloom.operators.ordinals import number_within
from sheetloom.session import cut_lineage

_MAX_ROUNDS = 62
MIN_EDGES = 3
# Fixed value: power of two of lattice steps per side of the squares that links are dealt by.
_SQUARE = 9


def dashed_edges(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dashed segments with integer lattice keys for both ends."""
    return segments.where("dashed").select(
        *keys,
        F.col("seg_id").cast("bigint").alias("seg_id"),
        *[shapes.snap(F.col(c)).alias(f"v{c}") for c in ("x1", "y1", "x2", "y2")],
    )


def vertex_degrees(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vertices with the number of segment ends on them and the first and last such end.

    An end is ``2 * seg_id`` for the first point and ``2 * seg_id + 1`` for the second.
    """
    ends = edges.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("vx1").alias("vx"), F.col("vy1").alias("vy"), (F.col("seg_id") * 2).alias("half")),
                F.struct(F.col("vx2").alias("vx"), F.col("vy2").alias("vy"), (F.col("seg_id") * 2 + 1).alias("half")),
            )
        ).alias("e"),
    ).select(*keys, "e.*")
    return ends.groupBy(*keys, "vx", "vy").agg(
        F.count(F.lit(1)).alias("degree"), F.min("half").alias("first"), F.max("half").alias("last")
    )


def _successors(degrees: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(at, next): arriving at end ``at`` one leaves along the other segment of the vertex."""

    def step(at: str, out: str):
        # Leaving from end h of a segment means arriving at its other end, h xor 1.
        return F.struct(
            F.col(at).alias("at"), F.col(out).bitwiseXOR(F.lit(1)).cast("bigint").alias("next")
        )

    place = [F.shiftright(c, _SQUARE).alias(f"_{c}") for c in ("vx", "vy")]
    return (
        degrees.where("degree = 2")
        .select(*keys, *place, F.explode(F.array(step("first", "last"), step("last", "first"))).alias("s"))
        .select(*keys, "_vx", "_vy", "s.*")
    )


def _close(links: pd.DataFrame, keys: Sequence[str]) -> pd.DataFrame:
    """``links`` with ``end``, ``steps`` and ``length`` where their cycle lies whole in them, else with -1."""
    n = len(links)
    group = links.groupby(list(keys), sort=False).ngroup().to_numpy(np.int64)
    at, after = links["at"].to_numpy(np.int64), links["next"].to_numpy(np.int64)
    ends, number = np.unique(np.concatenate((at, after)), return_inverse=True)
    own, wanted = group * ends.size + number[:n], group * ends.size + number[n:]
    # Only links that are alone with their end and with their successor are settled here.
    once = lambda v: (lambda u: (u[2] == 1)[u[1]])(np.unique(v, return_inverse=True, return_counts=True))
    order = np.argsort(own, kind="stable")
    found = np.minimum(np.searchsorted(own[order], wanted), n - 1)
    ahead = np.append(np.where(once(own) & once(wanted) & (own[order][found] == wanted), order[found], n), n)
    # Ways that stop run into the row n; the others go round.
    jump, reach = ahead.copy(), 1
    while reach < n:
        jump, reach = jump[jump], reach * 2
    open_way = jump == n
    ahead[open_way] = n
    low, steps, jump, half = np.arange(n + 1), np.zeros(n + 1, np.int64), ahead, 1
    value = np.append(at, 0)
    while True:
        better = value[low[jump]] < value[low]
        if not better[~open_way].any():
            break
        steps = np.where(better, steps[jump] + half, steps)
        low = np.where(better, low[jump], low)
        jump, half = jump[jump], half * 2
    low, steps, closed = low[:n], steps[:n], ~open_way[:n]
    length = np.bincount(low[closed], minlength=n + 1)[low]
    fill = lambda v: np.where(closed, v, -1)
    return links.assign(end=fill(value[low]), steps=fill(steps), length=fill(length))


def _near_cycles(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``_cycles``, those of neighbouring links without a round.

    Cycles that lie whole in a batch of neighbouring links are settled there; which ones these
    are does not change the result. The others go through the rounds.
    """
    keys, columns = list(keys), [*keys, "at", "next"]
    # Links of a missing key have no successor.
    known = links.where(" and ".join(f"`{k}` is not null" for k in keys)) if keys else links
    near = known.repartition(*keys, "_vx", "_vy").sortWithinPartitions(*keys, "_vx", "_vy").select(*columns)

    def settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield _close(batch, keys)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in near.schema], "end bigint", "steps bigint", "length bigint"])
    tried = cut_lineage(near.mapInPandas(settled, schema))
    whole = tried.where("length > 0")
    rest = tried.where("length < 0").select(*columns)
    return whole if rest.isEmpty() else whole.unionByName(_cycles(rest, keys))


def _cycles(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ends on cycles with the smallest end of the cycle (``end``), the steps to reach it, and the cycle's length.

    Each round doubles the way that an end looks ahead. Where both halves of its way have the same
    smallest end, the way has come round, and the steps between are the length. A cycle leaves
    when a half is as long as itself, as all its ends know the length then; a round writes only
    the ends of longer ones.
    """
    none = F.lit(None).cast("bigint")
    state = cut_lineage(
        links.select(*keys, "at", "next", F.col("at").alias("end"), F.lit(0).cast("bigint").alias("steps"), none.alias("length"))
    )
    settled = state.where(F.lit(False))
    for turn in range(_MAX_ROUNDS):
        half = F.lit(1 << turn).cast("bigint")
        ahead = state.select(*keys, F.col("at").alias("next"), F.col("next").alias("_far"), F.col("end").alias("_end"), F.col("steps").alias("_steps"))
        moved = F.col("_steps") + half
        round_trip = F.when(F.col("_end") == F.col("end"), moved - F.col("steps"))
        # Ends whose path stops within reach find no partner and drop out here.
        joined = state.join(ahead, [*keys, "next"]).select(
            *keys,
            "at",
            F.col("_far").alias("next"),
            F.least("end", "_end").alias("end"),
            F.when(F.col("_end") < F.col("end"), moved).otherwise(F.col("steps")).alias("steps"),
            F.coalesce("length", round_trip).alias("length"),
        )
        written = cut_lineage(joined)
        done = F.coalesce(F.col("length") <= half, F.lit(False))
        settled = settled.unionByName(written.where(done))
        state = written.where(~done)
        if state.isEmpty():
            return settled
    raise RuntimeError("loop search did not settle")


def _loop_edges(degrees: DataFrame, keys: Sequence[str], by_place: bool = False) -> DataFrame:
    """Segments of closed loops: ``loop`` (smallest segment) and ``pos`` in walk order.

    Every loop is walked in both directions; the walk that passes its smallest segment from
    first to second point is kept.
    """
    ends = (_near_cycles if by_place else _cycles)(_successors(degrees, keys), keys)
    return ends.where((F.col("end") % 2 == 1) & (F.col("length") >= MIN_EDGES)).select(
        *keys,
        F.shiftright("end", 1).alias("loop"),
        F.shiftright("at", 1).alias("seg_id"),
        F.pmod(F.col("length") - F.col("steps"), F.col("length")).alias("pos"),
        F.col("length").alias("n_edges"),
    )


def _spur_edges(edges: DataFrame, degrees: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments of chains that run out into a vertex with a single end."""
    tips = degrees.where("degree = 1").select(*keys, F.col("first").alias("at"))
    dead = cut_lineage(tips)
    ways = cut_lineage(_successors(degrees, keys).drop("_vx", "_vy"))
    before = ways.count()
    for _ in range(_MAX_ROUNDS):
        if before == 0:
            break
        reach = ways.join(dead.select(*keys, F.col("at").alias("next")), [*keys, "next"], "left_semi")
        dead = cut_lineage(dead.union(reach.select(*keys, "at")).distinct())
        ahead = ways.select(*keys, F.col("at").alias("next"), F.col("next").alias("_far"))
        ways = cut_lineage(
            ways.join(ahead, [*keys, "next"]).select(*keys, "at", F.col("_far").alias("next"))
        )
        left = ways.count()
        if left == before:  # only rings of one or two segments are left; no tip is ahead
            break
        before = left
    else:
        raise RuntimeError("spur search did not settle")
    return dead.select(*keys, F.shiftright("at", 1).alias("seg_id")).distinct()


def closed_loops(
    segments: DataFrame, keys: Sequence[str] = ("doc_id", "page"), strict: bool = True, by_place: bool = False
) -> DataFrame:
    """Segments of closed loops with ``loop``, ``pos``, ``n_edges`` and ``ambiguous``.

    ``strict=True`` finds loops whose vertices carry two ends each, which do not depend on
    segment order. ``strict=False`` first drops segments that snap to one vertex, and strips
    dead-end chains again and again; loops that needed this are ``ambiguous``. With ``by_place``,
    which suits corpora of small loops, loops that lie close together are settled without rounds;
    the result is the same where a segment number stands once in a drawing.
    """
    edges = dashed_edges(segments, keys)
    degrees = vertex_degrees(edges, keys)
    pure = _loop_edges(degrees, keys, by_place).withColumn("ambiguous", F.lit(False))
    if strict:
        return pure
    pure = cut_lineage(pure)
    open_edges = edges.where("vx1 <> vx2 or vy1 <> vy2").join(
        pure.select(*keys, "seg_id"), [*keys, "seg_id"], "left_anti"
    )
    found = pure
    for _ in range(_MAX_ROUNDS):
        open_edges = cut_lineage(open_edges)
        degrees = cut_lineage(vertex_degrees(open_edges, keys))
        loops = cut_lineage(_loop_edges(degrees, keys, by_place).withColumn("ambiguous", F.lit(True)))
        found = found.unionByName(loops)
        rest = cut_lineage(
            open_edges.join(loops.select(*keys, "seg_id"), [*keys, "seg_id"], "left_anti")
        )
        degrees = cut_lineage(vertex_degrees(rest, keys))
        if degrees.where("degree = 1").isEmpty():
            return found
        spurs = _spur_edges(rest, degrees, keys)
        open_edges = rest.join(spurs, [*keys, "seg_id"], "left_anti")
    raise RuntimeError("spur stripping did not settle")


def contour_edges(
    loops: DataFrame, segments: DataFrame, keys: Sequence[str] = ("doc_id", "page")
) -> DataFrame:
    """Loop segments with ``contour_id`` and their raw ends, as a written copy.

    Loops of a drawing are numbered by their smallest segment.
    """
    heads = loops.where("seg_id = loop").select(*keys, "loop")
    numbered = number_within(heads, keys, "loop", "contour_id")
    ends = segments.where("dashed").select(*keys, "seg_id", "x1", "y1", "x2", "y2")
    return cut_lineage(loops.join(ends, [*keys, "seg_id"]).join(numbered, [*keys, "loop"]))


def contours_of(edges: DataFrame, keys: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """One row per contour: bounds and centre over the raw segment ends."""
    return (
        edges.groupBy(*keys, "contour_id")
        .agg(
            F.min(F.least("x1", "x2")).alias("min_x"),
            F.min(F.least("y1", "y2")).alias("min_y"),
            F.max(F.greatest("x1", "x2")).alias("max_x"),
            F.max(F.greatest("y1", "y2")).alias("max_y"),
            F.count(F.lit(1)).alias("n_edges"),
            F.bool_or("ambiguous").alias("ambiguous"),
        )
        .withColumns(
            {
                "cx": (F.col("min_x") + F.col("max_x")) / 2,
                "cy": (F.col("min_y") + F.col("max_y")) / 2,
            }
        )
    )
