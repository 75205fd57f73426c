"""Names for contours from nearby texts and configured objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions import names, shapes
from sheetloom.operators.grid import range_pairs
from sheetloom.session import cut_lineage

# Score factors for (configured and inside), configured, inside.
FACTORS = (0.1, 0.3, 0.8)


def name_dictionary(objects: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Upper-case object names with the object's ``name_eplan``; the last object wins."""
    both = F.array(
        F.struct(F.lit(0).alias("pos"), F.col("name_eplan").alias("known")),
        F.struct(F.lit(1).alias("pos"), F.col("name_BC").alias("known")),
    )
    return (
        objects.select(*key, "obj_ord", "name_eplan", F.explode(both).alias("n"))
        .where(F.coalesce(F.col("n.known"), F.lit("")) != "")
        .groupBy(*key, F.upper("n.known").alias("known"))
        .agg(
            F.max_by(
                F.struct("name_eplan"), F.struct(F.col("obj_ord"), F.col("n.pos"))
            ).alias("object")
        )
    )


def name_candidates(texts: DataFrame) -> DataFrame:
    """Texts with a contour name candidate."""
    return texts.withColumn("candidate", names.contour_candidate(F.col("text"))).where(
        F.col("candidate").isNotNull()
    )


def configured_names(
    candidates: DataFrame, dictionary: DataFrame, key: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Add ``configured`` and ``final_name``: exact name, then TANK plus rest, then M plus digits.

    The dictionary is joined once; the three keys a candidate may use are exploded before.
    The final name of an exact hit is the object's ``name_eplan``, null or empty included.
    """
    upper = F.upper("candidate")
    tank = F.startswith(upper, F.lit("TANK"))
    motor = upper.rlike(r"^M\p{Nd}+$")
    options = F.array_compact(
        F.array(
            F.struct(F.lit(0).alias("rank"), upper.alias("known")),
            F.when(tank, F.struct(F.lit(1).alias("rank"), F.lit("TANK").alias("known"))),
            F.when(motor, F.struct(F.lit(2).alias("rank"), F.lit("M").alias("known"))),
        )
    )
    distinct = candidates.select(*key, "candidate").distinct()
    hits = (
        distinct.withColumn("o", F.explode(options))
        .select(*key, "candidate", "o.*")
        .join(dictionary, [*key, "known"])
        .groupBy(*key, "candidate")
        .agg(F.min_by(F.struct("rank", "object"), "rank").alias("hit"))
    )
    rank = F.col("hit.rank")
    final = (
        F.when(rank == 0, F.col("hit.object.name_eplan"))
        .when(rank == 1, F.concat(F.lit("TANK"), F.replace(upper, F.lit("TANK"), F.lit(""))))
        .when(rank == 2, F.concat(F.lit("M"), F.replace(upper, F.lit("M"), F.lit(""))))
        .otherwise(F.col("candidate"))
    )
    return (
        candidates.join(hits, [*key, "candidate"], "left")
        .withColumns({"configured": rank.isNotNull(), "final_name": final})
        .drop("hit")
    )


def distances(
    texts: DataFrame, edges: DataFrame, keys: Sequence[str], max_distance: float
) -> DataFrame:
    """Smallest distance per contour and text, up to ``max_distance``."""
    boxes = edges.select(
        *keys,
        "contour_id",
        "x1",
        "y1",
        "x2",
        "y2",
        F.least("x1", "x2").alias("lo_x"),
        F.greatest("x1", "x2").alias("hi_x"),
        F.least("y1", "y2").alias("lo_y"),
        F.greatest("y1", "y2").alias("hi_y"),
    )
    points = texts.select(*keys, "text_id", "cx", "cy")
    near = range_pairs(
        points, boxes, keys, ("cx", "cy"), (("lo_x", "hi_x"), ("lo_y", "hi_y")), max_distance
    )
    away = shapes.distance_to_segment(*[F.col(c) for c in ("cx", "cy", "x1", "y1", "x2", "y2")])
    return (
        near.withColumn("dist", away)
        .where(F.col("dist") <= max_distance)
        .groupBy(*keys, "contour_id", "text_id")
        .agg(F.min("dist").alias("dist"), F.first("cx").alias("cx"), F.first("cy").alias("cy"))
    )


def inside_pairs(pairs: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(contour, text) pairs with the text inside by the even-odd rule.

    Only edges whose y range holds the text can cross its ray, so the edges of a contour are
    joined by interval, not all with all.
    """
    own = [*keys, "contour_id"]
    spans = edges.select(
        *own,
        "x1",
        "y1",
        "x2",
        "y2",
        F.least("y1", "y2").alias("lo_y"),
        F.greatest("y1", "y2").alias("hi_y"),
    )
    rows = range_pairs(
        pairs.select(*own, "text_id", "cx", "cy"), spans, own, ("cy",), (("lo_y", "hi_y"),)
    )
    crossing = shapes.crosses_ray(*[F.col(c) for c in ("cx", "cy", "x1", "y1", "x2", "y2")])
    return (
        rows.where(crossing)
        .groupBy(*own, "text_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n % 2 = 1")
        .drop("_n")
    )


def score(dist: Column, configured: Column, inside: Column) -> Column:
    """Distance weighted by the evidence for the pair."""
    both, known, within = FACTORS
    return (
        F.when(configured & inside, dist * both)
        .when(configured, dist * known)
        .when(inside, dist * within)
        .otherwise(dist)
    )


def text_candidates(
    edges: DataFrame,
    texts: DataFrame,
    dictionary: DataFrame,
    max_distance: float = shapes.NAMING_DISTANCE,
    keys: Sequence[str] = ("doc_id", "page"),
) -> DataFrame:
    """Scored (contour, text) pairs; ``edges`` carries contour_id and the raw segment ends."""
    named = configured_names(name_candidates(texts), dictionary)
    pairs = cut_lineage(distances(named, edges, keys, max_distance))
    within = inside_pairs(pairs, edges, keys).withColumn("inside", F.lit(True))
    details = named.select(*keys, "text_id", "candidate", "configured", "final_name")
    return (
        pairs.join(within, [*keys, "contour_id", "text_id"], "left")
        .withColumn("inside", F.coalesce("inside", F.lit(False)))
        .join(details, [*keys, "text_id"])
        .withColumn("score", score(F.col("dist"), F.col("configured"), F.col("inside")))
    )


def _rank() -> Column:
    return F.struct("area", "contour_id")


def _proposals(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    best = F.struct("score", "text_id")
    return (
        pairs.groupBy(*keys, "contour_id", "area")
        .agg(F.min(best).alias("best"))
        .select(*keys, "contour_id", "area", "best.text_id", "best.score")
    )


def assign_texts(candidates: DataFrame, keys: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """One text per contour: smaller contours choose first, each its lowest score still free.

    In rounds, each contour proposes to its best text and each text holds the smallest contour
    that proposes. A larger contour can never get a text that is held, so such pairs leave. When
    none leaves, every contour has its text alone, and the proposals are what choosing in turn
    gives. A round removes at least one pair or is the last; most drawings need a few.
    """
    pairs = cut_lineage(candidates.select(*keys, "contour_id", "text_id", "area", "score"))
    left = pairs.count()
    while True:
        holders = _proposals(pairs, keys).groupBy(*keys, "text_id").agg(F.min(_rank()).alias("_holder"))
        kept = cut_lineage(
            pairs.join(holders, [*keys, "text_id"], "left").where(F.col("_holder").isNull() | (_rank() <= F.col("_holder"))).drop("_holder")
        )
        before, left = left, kept.count()
        if left == before:
            return _proposals(kept, keys).select(*keys, "contour_id", "text_id")
        pairs = kept


def name_contours(
    contours: DataFrame,
    candidates: DataFrame,
    keys: Sequence[str] = ("doc_id", "page"),
) -> DataFrame:
    """Contours with name, original name and name position; contours without text stay null."""
    candidates = cut_lineage(candidates)
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    sized = candidates.join(
        contours.select(*keys, "contour_id", area.alias("area")), [*keys, "contour_id"]
    )
    chosen = assign_texts(sized, keys)
    details = candidates.select(
        *keys,
        "contour_id",
        "text_id",
        F.col("final_name").alias("name"),
        F.col("candidate").alias("original_name"),
        F.col("cx").alias("name_x"),
        F.col("cy").alias("name_y"),
    )
    picked = chosen.join(details, [*keys, "contour_id", "text_id"])
    return contours.join(picked, [*keys, "contour_id"], "left")
