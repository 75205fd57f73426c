"""Text labels inside contours matched to configured devices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions import names, shapes
from sheetloom.operators.grid import range_pairs

# Device attributes with a column of their own.
DEVICE_FIELDS = ("name", "descr", "article", "type", "category")
BOUNDS = (("min_x", "max_x"), ("min_y", "max_y"))


def label_texts(texts: DataFrame) -> DataFrame:
    """Trimmed texts that look like device labels, with their upper-case ``label``."""
    return texts.where(names.is_label(F.col("text"))).withColumn(
        "label", F.upper(names.label_name(F.col("text")))
    )


def device_parts(devices: DataFrame) -> DataFrame:
    """Devices with a readable name, split into ``tech_object`` and ``short_name``."""
    return devices.withColumns(
        {
            "tech_object": names.device_object(F.col("name")),
            "short_name": names.device_short_name(F.col("name")),
        }
    ).where(F.col("tech_object").isNotNull())


def configured_devices(devices: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One device per object and short name; the last one written wins."""
    parts = device_parts(devices)
    rest = [c for c in devices.columns if c not in key]
    return (
        parts.groupBy(*key, "tech_object", "short_name")
        .agg(F.max_by(F.struct(*rest), "ord").alias("device"))
        .select(*key, "tech_object", "short_name", "device.*")
    )


def contours_with_object(contours: DataFrame) -> DataFrame:
    """Named contours with the object they stand for."""
    named = contours.withColumn("tech_object", names.contour_object(F.col("name")))
    return named.where(F.col("tech_object").isNotNull())


def expected_devices(contours: DataFrame, devices: DataFrame) -> DataFrame:
    """Named contours of configured objects with the number of devices they should show."""
    expected = (
        configured_devices(devices)
        .groupBy("doc_id", "tech_object")
        .agg(F.count(F.lit(1)).alias("expected"))
    )
    return contours_with_object(contours).join(expected, ["doc_id", "tech_object"])


def labels_in_contours(texts: DataFrame, contours: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every label inside the widened box of a contour; overlapping contours share labels."""
    sides = [c for axis in BOUNDS for c in axis]
    boxes = contours.select(*keys, "contour_id", "tech_object", *sides)
    labels = label_texts(texts).select(*keys, "text_id", "label", "cx", "cy")
    return range_pairs(labels, boxes, keys, ("cx", "cy"), BOUNDS, shapes.LABEL_TOLERANCE)


def _inside(
    contours: DataFrame, texts: DataFrame, devices: DataFrame, keys: Sequence[str]
) -> DataFrame:
    objects = configured_devices(devices).select("doc_id", "tech_object").distinct()
    wanted = contours_with_object(contours).join(objects, ["doc_id", "tech_object"], "left_semi")
    return labels_in_contours(texts, wanted, keys)


def match_devices(
    contours: DataFrame,
    texts: DataFrame,
    devices: DataFrame,
    keys: Sequence[str] = ("doc_id", "page"),
) -> DataFrame:
    """Labels inside a contour that name a device configured for the contour's object.

    The range join comes first and the device side is unique per key, so no stage pairs all
    contours of an object with all its devices.
    """
    known = configured_devices(devices).select(
        "doc_id", "tech_object", F.col("short_name").alias("label")
    )
    full = F.concat("tech_object", "label")
    return (
        labels_in_contours(texts, contours_with_object(contours), keys)
        .join(known, ["doc_id", "tech_object", "label"], "left_semi")
        .select(
            *keys,
            "contour_id",
            "text_id",
            full.alias("lua_name"),
            F.col("label").alias("pdf_name"),
            "tech_object",
            F.col("cx").alias("x"),
            F.col("cy").alias("y"),
            F.lit(1.0).alias("confidence"),
            names.device_type(full).alias("device_type"),
        )
    )


def unmatched_labels(contours, texts, devices, keys: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """Labels inside a contour of a configured object that name none of its devices."""
    known = configured_devices(devices).select(
        "doc_id", "tech_object", F.col("short_name").alias("label")
    )
    return _inside(contours, texts, devices, keys).join(
        known, ["doc_id", "tech_object", "label"], "left_anti"
    )


def empty_contours(contours, texts, devices, keys: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """Named contours of configured objects without any label inside."""
    objects = configured_devices(devices).select("doc_id", "tech_object").distinct()
    wanted = contours_with_object(contours).join(objects, ["doc_id", "tech_object"], "left_semi")
    seen = labels_in_contours(texts, wanted, keys).select(*keys, "contour_id").distinct()
    return wanted.join(seen, [*keys, "contour_id"], "left_anti")


def matches_per_object(matches: DataFrame) -> DataFrame:
    """Matched devices per object of a drawing."""
    return matches.groupBy("doc_id", "tech_object").agg(F.count(F.lit(1)).alias("devices"))


def open_attributes(attrs: Column, fixed: Sequence[str]) -> Column:
    """Attributes of a map outside the fixed names, nulls left out."""
    return F.map_filter(attrs, lambda k, v: ~k.isin(*fixed) & v.isNotNull())


def enrich_matches(matches: DataFrame, devices: DataFrame) -> DataFrame:
    """Add device attributes by upper-case full name; the last device of a name wins."""
    fields = [*DEVICE_FIELDS[1:], "extra"]
    latest = (
        devices.where(F.coalesce(F.col("name"), F.lit("")) != "")
        .groupBy("doc_id", F.upper("name").alias("_full"))
        .agg(F.max_by(F.struct(*fields), "ord").alias("_device"))
    )
    return (
        matches.withColumn("_full", F.upper("lua_name"))
        .join(latest, ["doc_id", "_full"], "left")
        .select(*matches.columns, *[F.col(f"_device.{f}").alias(f) for f in fields])
    )


def _distinct_names(contours: DataFrame, key: Sequence[str]) -> DataFrame:
    kept = ["page", "contour_id", "name", "cx", "cy", "min_x", "min_y", "max_x", "max_y"]
    return (
        contours.where(F.coalesce(F.col("name"), F.lit("")) != "")
        .groupBy(*key, F.upper("name").alias("_upper"))
        .agg(F.min_by(F.struct(*kept), F.struct("page", "contour_id")).alias("contour"))
    )


def first_contour_of_object(
    objects: DataFrame, contours: DataFrame, mode: str = "contains", key: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """First contour (by page and number) whose upper-case name contains the object name.

    Contour names are made distinct, then cut into every substring whose length some object
    name has; the test for containment becomes an equi-join. ``mode='exact'`` compares the
    contour's object instead.
    """
    wanted = objects.select(*key, "tech_object").distinct()
    named = _distinct_names(contours, key)
    if mode == "exact":
        parts = named.withColumn("tech_object", names.contour_object(F.col("_upper")))
    else:
        lengths = wanted.agg(F.collect_set(F.length("tech_object"))).scalar()
        size = F.length("_upper")
        parts = (
            named.withColumn("_size", F.explode(lengths))
            .where((F.col("_size") > 0) & (F.col("_size") <= size))
            .withColumn("_at", F.explode(F.sequence(F.lit(1), size - F.col("_size") + 1)))
            .withColumn("tech_object", F.substr("_upper", F.col("_at"), F.col("_size")))
        )
    return (
        parts.join(wanted, [*key, "tech_object"])
        .groupBy(*key, "tech_object")
        .agg(F.min_by("contour", F.struct("contour.page", "contour.contour_id")).alias("contour"))
        .select(*key, "tech_object", "contour.*")
    )
