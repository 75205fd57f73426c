"""Image annotation files, image lists and class lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.functions import names, shapes

_STEM = r"([^/]+?)(\.[^./]*)?$"
# Image extensions of common toolkits; pass others where a site has more.
IMAGE_TYPES = ("bmp", "cur", "gif", "ico", "jpeg", "jpg", "pbm", "pgm", "png", "ppm", "svg", "svgz", "xbm", "xpm")

_SIDES = ("xmin", "ymin", "xmax", "ymax")
_OBJECT = f"struct<name:string,difficult:string,bndbox:struct<{','.join(f'{s}:string' for s in _SIDES)}>>"
_ANNOTATION = f"_image_id string, object array<{_OBJECT}>, size struct<width:int,height:int>, _verified string"


def _annotations(spark: SparkSession, path: str) -> DataFrame:
    rows = (
        spark.read.format("xml")
        .option("rowTag", "annotation")
        .option("pathGlobFilter", "*.xml")
        .schema(_ANNOTATION)
        .load(path)
    )
    # Files of this package hold many images, each element with its image.
    return rows.withColumn("image_id", F.coalesce("_image_id", F.regexp_extract(F.col("_metadata.file_path"), _STEM, 1)))


def _boxes(rows: DataFrame, entries: Column) -> DataFrame:
    """Boxes of parsed annotations, numbers that cannot be read as null."""
    return rows.select("image_id", F.posexplode(entries).alias("box_id", "o")).select(
        "image_id",
        "box_id",
        F.col("o.name").alias("name"),
        *[F.trim(f"o.bndbox.{s}").try_cast("int").alias(s) for s in _SIDES],
        (F.col("o.difficult") == "1").alias("difficult"),
    )


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.select("image_id", "size.width", "size.height", (F.coalesce("_verified", F.lit("")) == "yes").alias("verified"))


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """``boxes(image_id, box_id, name, xmin, ymin, xmax, ymax, difficult)`` of annotation files."""
    return _boxes(_annotations(spark, path), F.col("object"))


def read_image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``images(image_id, width, height, verified)`` of annotation files."""
    return _sizes(_annotations(spark, path))


def _parsed(texts: DataFrame) -> DataFrame:
    """``image_id`` with the fields of its annotation text, and ``broken`` where the text is no annotation."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    body = F.coalesce(F.col("body"), F.lit(""))
    parsed = F.from_xml(body, f"{_ANNOTATION}, _broken string", options)
    # An empty text has no element, which the parser does not report.
    rows = texts.select("image_id", (F.trim(body) == "").alias("empty"), parsed.alias("a"))
    broken = F.col("empty") | F.col("a").isNull() | F.col("a._broken").isNotNull()
    return rows.select("image_id", broken.alias("broken"), "a.object", "a.size", "a._verified")


def boxes_of_texts(texts: DataFrame) -> DataFrame:
    """Boxes of annotation texts ``(image_id, body)`` whose four numbers can all be read.

    Null, empty and broken texts have none. What is left out here is in ``rejects_of_texts``.
    """
    # Chosen by value: a filter on the parsed text would parse it once more.
    entries = F.when(F.col("broken"), F.array().cast(f"array<{_OBJECT}>")).otherwise(F.col("object"))
    return _boxes(_parsed(texts), entries).dropna(subset=list(_SIDES))


def sizes_of_texts(texts: DataFrame) -> DataFrame:
    """``images(image_id, width, height, verified)`` of annotation texts that are not broken."""
    return _sizes(_parsed(texts).where(~F.col("broken")))


def rejects_of_texts(texts: DataFrame) -> DataFrame:
    """``image_id, box_id, reason`` of what ``boxes_of_texts`` leaves out.

    A text is ``broken`` as a whole (no box number); a box has a ``missing`` or an ``unreadable`` side.
    """
    sides = [F.col(f"o.bndbox.{s}") for s in _SIDES]
    missing = F.greatest(*[s.isNull() for s in sides])
    unreadable = F.greatest(*[F.trim(s).try_cast("int").isNull() for s in sides])
    # One pass: a broken text stands as one entry without a number.
    entries = F.when(F.col("broken"), F.array(F.lit(None).cast(_OBJECT))).otherwise(F.col("object"))
    rows = _parsed(texts).select("image_id", "broken", F.posexplode(entries).alias("box_id", "o"))
    reason = F.when(F.col("broken"), "broken").when(missing, "missing").when(unreadable, "unreadable")
    return rows.select("image_id", F.when(~F.col("broken"), F.col("box_id")).alias("box_id"), reason.alias("reason")).where("reason is not null")


def list_files(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """Paths that fit a pattern, in one folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.regexp_extract("path", _STEM, 1).alias("stem"))


def natural_key(text: Column) -> Column:
    """Sort key that compares digit runs by value."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))

    def padded(run: Column) -> Column:
        short = F.regexp_replace(run, "^0+(?=.)", "")
        return F.when(run.rlike(r"^\d"), F.concat(F.lpad(F.length(short).cast("string"), 6, "0"), short)).otherwise(run)

    return F.transform(runs, padded)


def list_images(spark: SparkSession, path: str, types: tuple[str, ...] = IMAGE_TYPES) -> DataFrame:
    """Image paths below a folder in natural order; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    wanted = F.lower("path").rlike(r"\.(" + "|".join(types) + ")$")
    return files.where(wanted).orderBy(natural_key(F.col("path")), "path")


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """``classes(label, ord)`` of a line-separated list."""
    rows = spark.read.option("wholetext", True).text(path)
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
    return rows.select(F.posexplode(lines).alias("ord", "label")).select(
        names.strip(F.col("label")).alias("label"), "ord"
    )


def preferred_annotations(files: DataFrame) -> DataFrame:
    """One annotation file per stem: XML before text."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = files.select("path", F.regexp_extract("path", _STEM, 1).alias("stem"), kind.alias("kind"))
    rank = F.struct(F.when(F.col("kind") == "xml", 0).otherwise(1).alias("r"), F.col("path").alias("p"))
    return rows.where(F.col("kind").isin("xml", "txt")).groupBy("stem").agg(F.min(rank).alias("_b")).select("stem", F.col("_b.p").alias("path"))


def clamp_shapes(annotated: DataFrame, images: DataFrame) -> DataFrame:
    """Shapes with their points inside the image, and whether any point moved."""
    sized = annotated.join(images.select("image_id", "width", "height"), "image_id")
    inside = shapes.clamp_points(F.col("points"), F.col("width"), F.col("height"))
    return (
        sized.withColumn("_clamped", inside)
        .withColumn("changed", F.col("_clamped") != F.col("points"))
        .withColumn("points", F.col("_clamped"))
        .drop("_clamped", "width", "height")
    )
