"""Drawing tables and drawing XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.functions import names, shapes
from sheetloom.functions.numbers import number_or, to_number
from sheetloom.operators.matching import DEVICE_FIELDS, open_attributes
from sheetloom.sources.config_files import document_of


def line_segments(items: DataFrame) -> DataFrame:
    """Straight-line items of a raw drawing table with their dash flag."""
    return items.where("kind = 'l'").select(
        "doc_id", "page", "seg_id", "x1", "y1", "x2", "y2", shapes.is_dashed(F.col("dashes")).alias("dashed")
    )


def text_elements(spans: DataFrame) -> DataFrame:
    """Non-blank text spans, trimmed, with the centre of their box."""
    text = names.strip(F.col("text"))
    return spans.where(text != "").withColumns(
        {
            "text": text,
            "cx": (F.col("bbox.x1") + F.col("bbox.x2")) / 2,
            "cy": (F.col("bbox.y1") + F.col("bbox.y2")) / 2,
        }
    )


_CONTOUR = (
    "_id string, _page string, SegmentRefs string, Bounds struct<_min_x:double,_min_y:double,_max_x:double,_max_y:double>,"
    " Center struct<_x:double,_y:double>, Name struct<_VALUE:string,_pos_x:double,_pos_y:double>"
)


def read_geometry_xml(spark: SparkSession, path: str) -> DataFrame:
    """Contours of geometry files; the folder ``doc_id=...`` or the file name is the document, a missing page is 0."""
    rows = spark.read.format("xml").option("rowTag", "Contour").schema(_CONTOUR).load(path)
    b = {c: F.col(f"Bounds._{c}").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")}
    return rows.select(
        document_of(F.col("_metadata.file_path")).alias("doc_id"),
        F.coalesce(F.col("_page").cast("int"), F.lit(0)).alias("page"),
        F.col("_id").cast("bigint").alias("contour_id"),
        *b.values(),
        F.col("Center._x").alias("cx"),
        F.col("Center._y").alias("cy"),
        F.col("Name._VALUE").alias("name"),
        F.col("Name._pos_x").alias("name_x"),
        F.col("Name._pos_y").alias("name_y"),
        F.transform(F.split(names.strip(F.col("SegmentRefs")), r"\s+"), lambda r: r.cast("bigint")).alias("seg_ids"),
    )


# Device attributes that are no extra data.
DEVICE_ATTRIBUTES = ("lua_name", "pdf_name", "x", "y", "confidence", *DEVICE_FIELDS[1:], "device_type")


def _objects(spark: SparkSession, path: str) -> DataFrame:
    """Object elements with their contour."""
    rows = (
        spark.read.format("xml")
        .option("rowTag", "TechnologicalObject")
        .schema("_name string, Contour struct<_bounds:string,_center:string,_VALUE:string>")
        .load(path)
    )
    return rows.where(F.coalesce("_name", F.lit("")) != "").select(
        document_of(F.col("_metadata.file_path")).alias("doc_id"),
        F.col("_name").alias("tech_object"),
        "Contour",
    )


def read_matched_contours(spark: SparkSession, path: str) -> DataFrame:
    """Contours of matched-device files; contours with unreadable numbers are skipped."""
    rows = _objects(spark, path).where("Contour is not null")
    b = F.transform(F.split("Contour._bounds", ","), to_number)
    c = F.transform(F.split("Contour._center", ","), to_number)
    good = (F.size("_b") == 4) & (F.size("_c") == 2) & F.forall(F.concat("_b", "_c"), lambda v: v.isNotNull())
    return (
        rows.withColumns({"_b": b, "_c": c})
        .where(good)
        .select(
            "doc_id",
            F.col("tech_object").alias("name"),
            "tech_object",
            *[F.get("_b", i).alias(n) for i, n in enumerate(("min_x", "min_y", "max_x", "max_y"))],
            *[F.get("_c", i).alias(n) for i, n in enumerate(("cx", "cy"))],
        )
    )


def _unescape(v: Column) -> Column:
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#10;", "\n"), ("&amp;", "&")):
        v = F.replace(v, F.lit(mark), F.lit(char))
    return v


def _attributes(tag: Column) -> Column:
    """Attributes of one start tag as a map."""
    pair = r"""([\p{L}\p{N}_:.\-]++)\s*+=\s*+("[^"]*+"|'[^']*+')"""

    # Most values hold no mark; the quotes around each are cut first.
    def value(quoted: Column) -> Column:
        text = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
        return F.when(F.contains(text, F.lit("&")), _unescape(text)).otherwise(text)

    found = lambda group: F.regexp_extract_all(tag, F.lit(pair), F.lit(group))
    return F.map_from_arrays(found(1), F.transform(found(2), value))


# End of an element: files are cut there, so that a file of any size is read in parts.
_END = "</TechnologicalObject>"


def _finished(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` built as a unit, so that predicates work on them and not on copies of their expressions."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def element_texts(files: DataFrame) -> DataFrame:
    """``files(doc_id, body)`` cut at the ends of their object elements."""
    # The outer form keeps Spark from testing the size of the list first, which would cut the text once more.
    return files.select("doc_id", F.explode_outer(F.split("body", _END)).alias("element")).where(F.col("element").isNotNull())


def devices_of_elements(elements: DataFrame) -> DataFrame:
    """Devices of ``elements(doc_id, element)``, each the text up to the end of one object element.

    Comments and raw character data are no data. A device with unreadable numbers is skipped.
    """
    tag = r"""(?s)<{}\b(?:"[^"]*+"|'[^']*+'|[^>"']++)*+>""".format
    data = F.regexp_replace("element", r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "")
    objects = F.regexp_extract_all("_data", F.lit(tag("TechnologicalObject")), F.lit(0))
    # Elements without content end in their own tag; the last one that opens holds the devices.
    opened = F.try_element_at(F.filter(objects, lambda o: ~F.endswith(o, F.lit("/>"))), F.lit(-1))
    plain = _finished(elements, "doc_id", data.alias("_data"))
    found = _finished(plain, "doc_id", opened.alias("_o"), "_data").where("_o IS NOT NULL")
    named = _finished(found, "doc_id", F.try_element_at(_attributes(F.col("_o")), F.lit("name")).alias("tech_object"), F.expr("substring_index(_data, _o, -1)").alias("_inner"))
    tags = F.regexp_extract_all("_inner", F.lit(tag("Device")), F.lit(0))
    rows = named.where(F.coalesce("tech_object", F.lit("")) != "").select("doc_id", "tech_object", F.posexplode_outer(tags).alias("ord", "_e"))
    read = _finished(rows.where(F.col("_e").isNotNull()), "doc_id", "tech_object", "ord", _attributes(F.col("_e")).alias("_a"))

    def text(name: str):
        return F.coalesce(F.try_element_at("_a", F.lit(name)), F.lit(""))

    def number(name: str):
        value = F.try_element_at("_a", F.lit(name))
        return F.when(value.isNull(), F.lit(0.0)).otherwise(to_number(value))

    return read.select(
        "doc_id",
        "tech_object",
        "ord",
        text("lua_name").alias("lua_name"),
        text("pdf_name").alias("pdf_name"),
        number("x").alias("x"),
        number("y").alias("y"),
        number("confidence").alias("confidence"),
        text("descr").alias("descr"),
        text("article").alias("article"),
        text("device_type").alias("device_type"),
        text("category").alias("category"),
        open_attributes(F.col("_a"), DEVICE_ATTRIBUTES).alias("extra"),
    ).where("x is not null and y is not null and confidence is not null")


def read_matched_devices(spark: SparkSession, path: str) -> DataFrame:
    """Devices of matched-device files in UTF-8, read by element."""
    # The XML source drops the open attributes of empty elements, and as variants it turns 01 into 1.
    records = spark.read.option("lineSep", _END).option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").text(path)
    return devices_of_elements(records.select(document_of(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("element")))
