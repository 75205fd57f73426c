"""Training-tile tables cut from annotated images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.operators.ordinals import number_within

# Tile side, overlap of neighbours, share of training images, class numbers.
TILE = 1024
OVERLAP = 256
STEP = TILE - OVERLAP
TRAIN_SHARE = 0.8
CLASSES = {"valve": 0, "valve1": 0, "valve2": 0, "valve3": 0, "sensor": 1, "pump": 2}


def class_number(name: Column) -> Column:
    """Class of an annotation name, null when unknown."""
    table = F.create_map(*[F.lit(v) for pair in CLASSES.items() for v in pair])
    return F.try_element_at(table, name)


def known_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes of known classes with ``cls``."""
    return boxes.withColumn("cls", class_number(F.col("name"))).where(F.col("cls").isNotNull())


def tile_count(size: Column, cover_edges: bool = False) -> Column:
    """Tiles along one image side; by default the last strip stays uncovered."""
    over = F.ceil((size - TILE) / STEP)
    if cover_edges:
        return F.when(size > 0, F.greatest(over, F.lit(0)) + 1).otherwise(0).cast("int")
    return F.greatest(over, F.lit(0)).cast("int")


def tile_grid(images: DataFrame, cover_edges: bool = False) -> DataFrame:
    """All tile origins of every image, also the work list of the detector."""

    def starts(side: str) -> Column:
        n = tile_count(F.col(side), cover_edges)
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    return (
        images.select("image_id", "width", "height")
        .withColumn("ty", F.explode(starts("height")))
        .withColumn("tx", F.explode(starts("width")))
        .select(
            "image_id",
            (F.col("tx") * STEP).alias("tile_x"),
            (F.col("ty") * STEP).alias("tile_y"),
        )
    )


def tile_labels(boxes: DataFrame, images: DataFrame, cover_edges: bool = False) -> DataFrame:
    """Boxes clipped to every tile they touch, with centre and size relative to the tile.

    The tiles of a box follow from its corners, so nothing is joined but the image size, and
    boxes without an image drop out in that join.
    """

    def touched(lo: str, hi: str, side: str) -> Column:
        first = F.greatest(F.floor((F.col(lo) - TILE) / STEP) + 1, F.lit(0))
        last = F.least(F.ceil(F.col(hi) / STEP), tile_count(F.col(side), cover_edges)) - 1
        return F.when(
            (F.col(lo) < F.col(hi)) & (last >= first), F.sequence(first.cast("int"), last.cast("int"))
        ).otherwise(F.array().cast("array<int>"))

    def local(lo: str, hi: str, start: str, centre: str, size: str) -> dict[str, Column]:
        a = F.greatest(F.col(lo), F.col(start)) - F.col(start)
        b = F.least(F.col(hi), F.col(start) + TILE) - F.col(start)
        return {centre: (a + b) / 2 / TILE, size: (b - a) / TILE}

    sized = images.select("image_id", "width", "height")
    cut = (
        known_boxes(boxes)
        .join(sized, "image_id")
        .withColumn("ty", F.explode(touched("ymin", "ymax", "height")))
        .withColumn("tx", F.explode(touched("xmin", "xmax", "width")))
        .withColumns({"tile_x": F.col("tx") * STEP, "tile_y": F.col("ty") * STEP})
    )
    return cut.select(
        "image_id",
        "box_id",
        "cls",
        "tile_x",
        "tile_y",
        *[c.alias(n) for n, c in local("xmin", "xmax", "tile_x", "cx", "bw").items()],
        *[c.alias(n) for n, c in local("ymin", "ymax", "tile_y", "cy", "bh").items()],
    )


def tile_numbers(labels: DataFrame) -> DataFrame:
    """Running number of the tiles with labels, row by row within an image, from 0."""
    place = F.shiftleft((F.col("tile_y") / STEP).cast("bigint"), 32) + (F.col("tile_x") / STEP).cast("bigint")
    tiles = labels.select("image_id", "tile_x", "tile_y").distinct().withColumn("_place", place)
    return number_within(tiles, ["image_id"], "_place", "tile_id").drop("_place")


def numbered_labels(labels: DataFrame) -> DataFrame:
    """Labels with their tile number and tile name."""
    name = F.concat_ws("_", "image_id", "tile_id")
    return labels.join(tile_numbers(labels), ["image_id", "tile_x", "tile_y"]).withColumn("tile_name", name)


def label_line(cls: Column, *values: Column) -> Column:
    """``class cx cy w h``; the values have at most 11 binary places, so 11 decimals are exact."""

    def text(v: Column) -> Column:
        short = F.regexp_replace(F.format_string("%.11f", v), "0+$", "")
        return F.regexp_replace(short, r"\.$", ".0")

    return F.concat_ws(" ", cls.cast("string"), *[text(v) for v in values])


def _digest(image_id: Column, seed: int) -> Column:
    """First 60 bits of an MD5 of image and seed."""
    text = F.concat_ws(":", image_id, F.lit(str(seed)))
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(15)), 16, 10).cast("bigint")


def _rank_by_hash(hashed: DataFrame) -> DataFrame:
    """Global rank by hash: 65,536 hash blocks are counted, then ranked inside."""
    blocked = hashed.withColumn("_block", F.shiftright("_h", 44))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocked.groupBy("_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_block").orderBy("_h", "image_id")
    return (
        blocked.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(starts, "_block")
        .withColumn("_rank", F.col("_start") + F.col("_inside"))
    )


def split_images(images: DataFrame, seed: int = 42, exact: bool = True) -> DataFrame:
    """Random but repeatable subset per image: the first 80 percent by hash train.

    ``exact=True`` gives floor(0.8 n) training images; ``exact=False`` decides every image by
    its own hash, without a shuffle of ranks.
    """
    hashed = images.select("image_id").distinct().withColumn("_h", _digest(F.col("image_id"), seed))
    if not exact:
        share = F.pmod("_h", F.lit(10_000)) < int(TRAIN_SHARE * 10_000)
        return hashed.select("image_id", F.when(share, "train").otherwise("val").alias("subset"))
    limit = hashed.agg(F.floor(F.count(F.lit(1)) * TRAIN_SHARE)).scalar()
    return _rank_by_hash(hashed).select(
        "image_id", F.when(F.col("_rank") < limit, "train").otherwise("val").alias("subset")
    )
