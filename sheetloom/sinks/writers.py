"""Exchange files and result tables.

Tables keep full doubles; decimals are cut only in the XML and label texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions.numbers import all_fixed3, fixed3, float_text
from sheetloom.functions.svg import SCALE
from sheetloom.operators.browse import contour_sizes, object_devices
from sheetloom.operators.tiles import label_line

# Tasks that write one document together; each gives one file.
_PARTS = 8


def _xml(df: DataFrame, path: str, root: str, row: str) -> None:
    if "doc_id" not in df.columns:
        df.write.format("xml").option("rootTag", root).option("rowTag", row).mode("overwrite").save(path)
        return
    # Rows of a document meet in a few tasks, so that not every task writes a file for each document.
    plain = [c for c, t in df.dtypes if "map" not in t and "variant" not in t]
    salt = F.pmod(F.xxhash64(*plain, *[F.to_json(c) for c in df.columns if c not in plain]), F.lit(_PARTS))
    clustered = df.repartition("doc_id", salt)
    clustered.write.format("xml").option("rootTag", root).option("rowTag", row).partitionBy("doc_id").mode("overwrite").save(path)


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def text_rows(texts: DataFrame) -> DataFrame:
    """Rows of the text file: attributes with three decimals and the box."""
    sides = ("x1", "y1", "x2", "y2")
    numbers = all_fixed3(F.array("cx", "cy", *[f"bbox.{c}" for c in sides]))
    box = F.struct(*[F.get("_n", i + 2).alias(f"_{c}") for i, c in enumerate(sides)])
    return texts.withColumn("_n", numbers).select(
        "doc_id",
        F.col("text_id").alias("_id"),
        F.col("text").alias("_content"),
        F.get("_n", 0).alias("_x"),
        F.get("_n", 1).alias("_y"),
        F.col("page").alias("_page"),
        box.alias("BBox"),
    )


def write_texts(texts: DataFrame, path: str) -> None:
    """Text elements, one folder per document."""
    _xml(text_rows(texts), path, "TextElements", "Text")


def segment_rows(segments: DataFrame) -> DataFrame:
    """Rows of the segment file."""
    return segments.select(
        "doc_id",
        F.col("page").alias("_page"),
        F.col("seg_id").alias("_id"),
        *[fixed3(F.col(c)).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")],
        F.initcap(F.col("dashed").cast("string")).alias("_dashed"),
    )


def contour_rows(contours: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of the contour file: named contours with page, segment list, bounds, centre and name.

    The format holds a contour's outline in one element, so one row holds its segment list.
    """
    named = contours.where(F.coalesce("name", F.lit("")) != "")
    refs = (
        edges.groupBy("doc_id", "page", "contour_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "seg_id"))).alias("_refs"))
    )
    text = F.array_join(F.transform("_refs", lambda r: r["seg_id"].cast("string")), " ")
    bounds = F.struct(*[fixed3(F.col(c)).alias(f"_{c}") for c in ("min_x", "min_y", "max_x", "max_y")])
    centre = F.struct(fixed3(F.col("cx")).alias("_x"), fixed3(F.col("cy")).alias("_y"))
    name = F.struct(
        F.col("name").alias("_VALUE"), fixed3(F.col("name_x")).alias("_pos_x"), fixed3(F.col("name_y")).alias("_pos_y")
    )
    return named.join(refs, ["doc_id", "page", "contour_id"], "left").select(
        "doc_id",
        F.col("page").alias("_page"),
        F.col("contour_id").alias("_id"),
        text.alias("SegmentRefs"),
        bounds.alias("Bounds"),
        centre.alias("Center"),
        name.alias("Name"),
    )


def write_geometry(segments: DataFrame, contours: DataFrame, edges: DataFrame, path: str) -> None:
    """Segments and named contours as XML, and the contour edges as a table."""
    _xml(segment_rows(segments), f"{path}/segments", "Segments", "Segment")
    _xml(contour_rows(contours, edges), f"{path}/contours", "ClosedContours", "Contour")
    edges.write.mode("overwrite").parquet(f"{path}/contour_edges")


def _joined(*cols: str) -> Column:
    return F.concat_ws(",", *[float_text(F.col(c)) for c in cols])


def _element(fixed: dict[str, Column], extra: Column) -> Column:
    """An element's attributes as a map, which the XML writer prints: fixed ones, then open ones by name.

    Missing values are left out, and so are open names that are fixed ones or no XML names. No
    list of the open names is needed, so it is never gathered.
    """
    own = F.array(*[F.struct(F.lit(f"_{k}").alias("key"), v.cast("string").alias("value")) for k, v in fixed.items()])
    named = lambda k, v: v.isNotNull() & k.rlike(r"^[\p{L}_][\p{L}\p{N}_.\-]*$") & ~k.isin(*fixed)
    found = F.array_sort(F.map_entries(F.map_filter(F.coalesce(extra, F.create_map().cast("map<string,string>")), named)))
    marked = F.transform(found, lambda e: F.struct(F.concat(F.lit("_"), e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.concat(F.filter(own, lambda e: e["value"].isNotNull()), marked))


def matched_rows(enriched: DataFrame, first_contours: DataFrame) -> DataFrame:
    """One row per device, in an element of its object; the first one carries the contour.

    A device has all its open attributes. Readers of the format take elements of the same name
    together, so objects of any size have one form.
    """
    device = _element(
        {
            **{c: F.col(c) for c in ("device_type", "lua_name", "pdf_name")},
            **{c: fixed3(F.col(c)) for c in ("x", "y")},
            "confidence": F.format_string("%.2f", F.col("confidence")),
            **{c: F.col(c) for c in ("descr", "article", "type", "category")},
        },
        F.col("extra"),
    )
    contour = F.struct(
        _joined("min_x", "min_y", "max_x", "max_y").alias("_bounds"),
        _joined("cx", "cy").alias("_center"),
        F.lit(None).cast("string").alias("_VALUE"),
    )
    boxes = first_contours.select("doc_id", "tech_object", F.lit(True).alias("first"), contour.alias("Contour"))
    devices = object_devices(enriched)
    return devices.join(boxes, ["doc_id", "tech_object", "first"], "left").select(
        "doc_id",
        F.col("tech_object").alias("_name"),
        "Contour",
        F.struct(F.array(device).alias("Device")).alias("Devices"),
    )


def write_matched(enriched: DataFrame, first_contours: DataFrame, path: str) -> None:
    """Matched devices as XML, one element per device."""
    _xml(matched_rows(enriched, first_contours), path, "TechnologicalObjects", "TechnologicalObject")


def contour_view_rows(contours: DataFrame) -> DataFrame:
    """Contours of the visualisation file."""
    return contour_sizes(contours).select(
        "doc_id",
        F.col("name").alias("_name"),
        F.col("tech_object").alias("_tech_object"),
        _joined("min_x", "min_y", "max_x", "max_y").alias("_bounds"),
        _joined("cx", "cy").alias("_center"),
        float_text(F.col("width")).alias("_width"),
        float_text(F.col("height")).alias("_height"),
    )


def device_view_rows(matches: DataFrame) -> DataFrame:
    """Devices of the visualisation file; empty attributes are left out."""
    return matches.select(
        "doc_id",
        *[F.col(c).alias(f"_{c}") for c in ("lua_name", "pdf_name", "tech_object")],
        *[float_text(F.col(c)).alias(f"_{c}") for c in ("x", "y", "confidence")],
        *[_filled(F.col(c)).alias(f"_{c}") for c in ("descr", "article", "device_type", "category")],
        F.when(F.size("extra") > 0, F.col("extra")).alias("ExtraData"),
    )


def write_visualisation(
    contours: DataFrame, matches: DataFrame, elements: DataFrame, path: str, scale: float = SCALE
) -> None:
    """Rescaled elements, contours and devices as JSON lines with the scale on every row."""
    factor = F.lit(scale).alias("svg_scale")
    for name, rows in (
        ("contours", contour_view_rows(contours)),
        ("devices", device_view_rows(matches)),
        ("elements", elements),
    ):
        rows.select("*", factor).write.mode("overwrite").json(f"{path}/{name}")


def write_config(tables: dict[str, DataFrame], path: str, exchange: bool = False) -> None:
    """Configuration tables as Parquet, and as JSON lines for exchange."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        if exchange:
            df.write.mode("overwrite").json(f"{path}/json/{name}")


def write_summary(summary: DataFrame, path: str) -> None:
    """Entity counts and samples as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def label_rows(numbered: DataFrame, subsets: DataFrame) -> DataFrame:
    """Label lines with subset and tile name."""
    return numbered.join(subsets, "image_id").select(
        "subset",
        "tile_name",
        "box_id",
        label_line(F.col("cls"), *[F.col(c) for c in ("cx", "cy", "bw", "bh")]).alias("line"),
    )


def write_labels(rows: DataFrame, path: str) -> None:
    """Label lines as one table per subset, clustered by tile.

    One file per tile would swamp the name node of a large corpus; ``tile_name`` keeps them
    apart.
    """
    rows.repartition("subset", "tile_name").sortWithinPartitions("tile_name", "box_id").write.partitionBy(
        "subset"
    ).mode("overwrite").parquet(path)


def annotation_rows(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """Rows of box annotation XML: one element per image."""
    sides = ("xmin", "ymin", "xmax", "ymax")
    box = F.struct(
        "box_id",
        F.struct(
            F.col("name"),
            F.coalesce(F.col("difficult").cast("int"), F.lit(0)).alias("difficult"),
            F.struct(*sides).alias("bndbox"),
        ).alias("o"),
    )
    # Annotations of one image come from one file, so its list fits a row.
    nested = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(box)).alias("_boxes"))
    return images.join(nested, "image_id", "left").select(
        "image_id",
        F.col("image_id").alias("_image_id"),
        F.when(F.col("verified"), "yes").alias("_verified"),
        F.struct("width", "height").alias("size"),
        F.coalesce(F.transform("_boxes", lambda b: b["o"]), F.array()).alias("object"),
    )


def write_annotations(boxes: DataFrame, images: DataFrame, path: str, style: str = "xml") -> None:
    """Annotations as box XML or as a table of label lines relative to the image."""
    if style == "xml":
        rows = annotation_rows(boxes, images)
        rows.drop("image_id").write.format("xml").option("rootTag", "annotations").option("rowTag", "annotation").mode("overwrite").save(path)
        return
    from sheetloom.operators.tiles import class_number

    sized = boxes.join(images.select("image_id", "width", "height"), "image_id")
    relative = [
        (F.col("xmin") + F.col("xmax")) / 2 / F.col("width"),
        (F.col("ymin") + F.col("ymax")) / 2 / F.col("height"),
        (F.col("xmax") - F.col("xmin")) / F.col("width"),
        (F.col("ymax") - F.col("ymin")) / F.col("height"),
    ]
    line = F.concat_ws(" ", class_number(F.col("name")).cast("string"), *[F.format_string("%.6f", v) for v in relative])
    sized.where(class_number(F.col("name")).isNotNull()).select("image_id", "box_id", line.alias("line")).write.mode(
        "overwrite"
    ).parquet(path)


def write_classified(primitives: DataFrame, path: str) -> None:
    """Classified primitives, one folder per class."""
    primitives.write.partitionBy("class").mode("overwrite").parquet(path)


