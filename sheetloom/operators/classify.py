"""Detector boxes mapped to the drawing, and drawing primitives classified by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions import shapes
from sheetloom.functions.numbers import number_or
from sheetloom.operators.grid import points_hit

# Fixed value: detections below this confidence are dropped.
MIN_CONFIDENCE = 0.25
KINDS = ("l", "re", "c")
PAGE = ["doc_id", "page"]


def image_boxes(detections: DataFrame) -> DataFrame:
    """Confident detections in image pixels: truncated, then moved by the tile origin."""
    moved = {c: F.col(c).cast("int") + F.col(f"tile_{c[0]}") for c in ("x1", "y1", "x2", "y2")}
    return detections.where(F.col("conf") >= MIN_CONFIDENCE).withColumns(moved)


def page_boxes(detections: DataFrame, pages: DataFrame) -> DataFrame:
    """Confident detections in page units; repeats from overlapping tiles stay."""
    wide, high = F.col("page_w") / F.col("img_w"), F.col("page_h") / F.col("img_h")
    scaled = {c: F.col(c) * (wide if c[0] == "x" else high) for c in ("x1", "y1", "x2", "y2")}
    return (
        image_boxes(detections)
        .join(pages.select("image_id", *PAGE, "page_w", "page_h", "img_w", "img_h"), "image_id")
        .withColumns(scaled)
        .drop("page_w", "page_h", "img_w", "img_h")
    )


def stroke_width(width: Column) -> Column:
    """Stroke width as a number, 1.0 when unreadable."""
    return number_or(width, 1.0)


def readable(primitives: DataFrame) -> Column:
    """True where a primitive carries the values its kind needs."""
    points = F.when(F.col("kind") == "l", 2).when(F.col("kind") == "c", 4).otherwise(0)
    filled = (F.size("pts") == points) & F.forall("pts", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    rect = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    return (
        F.when(F.col("kind").isin("l", "c"), F.coalesce(filled, F.lit(False)))
        .when(F.col("kind") == "re", rect)
        .otherwise(True)
    )


def decision_points(primitives: DataFrame) -> DataFrame:
    """Points that decide a primitive: line midpoint, rectangle centre, four curve points."""

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.alias("px"), y.alias("py"))

    p = F.col("pts")
    first, second = F.get(p, 0), F.get(p, 1)
    mid = point((first["x"] + second["x"]) / 2, (first["y"] + second["y"]) / 2)
    centre = point(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2)
    points = (
        F.when(F.col("kind") == "l", F.array(mid))
        .when(F.col("kind") == "re", F.array(centre))
        .when(F.col("kind") == "c", F.transform(p, lambda q: point(q["x"], q["y"])))
    )
    return primitives.select(*PAGE, "prim_id", "kind", F.explode(points).alias("t")).select(
        *PAGE, "prim_id", "kind", "t.px", "t.py"
    )


def _hits(points: DataFrame, boxes: DataFrame, tol: float, ids: list[str]) -> DataFrame:
    return points_hit(points, boxes, PAGE, ids, ("px", "py"), tol=tol)


def classify_primitives(primitives: DataFrame, boxes: DataFrame) -> DataFrame:
    """Primitives with ``class`` device, pipe or other, and a numeric stroke width."""
    good = primitives.where(readable(primitives))
    points = decision_points(good.where(F.col("kind").isin(*KINDS)))
    ids = [*PAGE, "prim_id"]
    tolerance = F.when(F.col("kind") == "l", shapes.LINE_TOLERANCE).otherwise(shapes.POINT_TOLERANCE)
    largest = max(shapes.LINE_TOLERANCE, shapes.POINT_TOLERANCE)
    hit = points_hit(points.withColumn("_tol", tolerance), boxes, PAGE, ids, ("px", "py"), tol=largest, own_tol="_tol").withColumn("_hit", F.lit(True))
    label = (
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "other")
        .when(F.col("_hit"), "device")
        .otherwise("pipe")
    )
    return (
        good.join(hit, ids, "left")
        .withColumns({"class": label, "stroke": stroke_width(F.col("stroke_width"))})
        .drop("_hit")
    )


def rejected_primitives(primitives: DataFrame) -> DataFrame:
    """Primitives that cannot be classified because values are missing."""
    return primitives.where(~readable(primitives))


def classify_texts(texts: DataFrame, boxes: DataFrame) -> DataFrame:
    """Texts with ``class`` by their upper left corner."""
    ids = [*PAGE, "text_id"]
    corners = texts.select(*ids, F.col("bbox.x1").alias("px"), F.col("bbox.y1").alias("py"))
    hit = _hits(corners, boxes, shapes.POINT_TOLERANCE, ids).withColumn("_hit", F.lit(True))
    return (
        texts.join(hit, ids, "left")
        .withColumn("class", F.when(F.col("_hit"), "device").otherwise("pipe"))
        .drop("_hit")
    )


def class_counts(classified: DataFrame) -> DataFrame:
    """Devices, pipes and other primitives per drawing page."""
    return classified.groupBy(*PAGE).agg(
        *[F.count_if(F.col("class") == c).alias(n) for c, n in (("device", "devices"), ("pipe", "pipes"), ("other", "others"))]
    )
