"""Device and object configuration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.operators.matching import DEVICE_FIELDS

_STEM = r"([^/]+?)(\.[^./]*)?$"


# Bytes above ASCII that windows-1251 defines. Spark decodes ISO-8859-1 without extra settings,
# and the two encodings differ in these characters only.
_HIGH = bytes(b for b in range(0x80, 0x100) if b != 0x98)


def decode_text(content: Column) -> tuple[Column, Column]:
    """(text, encoding) of bytes: UTF-8, else windows-1251, else ISO-8859-1.

    windows-1251 lacks only the byte 98, and ISO-8859-1 takes every byte, so no other
    encoding can be reached.
    """
    is_utf8 = F.is_valid_utf8(content.cast("string"))
    is_1251 = ~F.contains(content, F.lit(bytes([0x98])))
    text = (
        F.when(is_utf8, F.decode(content, "UTF-8"))
        .when(is_1251, F.translate(F.decode(content, "ISO-8859-1"), _HIGH.decode("latin-1"), _HIGH.decode("cp1251")))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )
    encoding = F.when(is_utf8, "utf-8").when(is_1251, "cp1251").otherwise("latin-1")
    return text, encoding


def document_of(path: Column) -> Column:
    """Document of a file: the folder ``doc_id=...`` it lies in, else its name without ending."""
    folder = F.regexp_extract(path, r"/doc_id=([^/]+)/", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_extract(path, _STEM, 1))


def read_text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``texts(path, doc_id, body, encoding)``, one row per file."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    body, encoding = decode_text(F.col("content"))
    return files.select(
        "path", document_of(F.col("path")).alias("doc_id"), body.alias("body"), encoding.alias("encoding")
    )


def parse_device_configs(texts: DataFrame) -> DataFrame:
    """``configs(path, doc_id, nodes, devices, reason)``; ``reason`` is null for good files."""
    top = F.from_json("body", "nodes string, devices string")
    rows = texts.withColumn("_top", F.when(F.try_parse_json("body").isNotNull(), top))
    is_object = F.coalesce(F.col("body").rlike(r"^\s*\{"), F.lit(False))
    reason = (
        F.when(F.try_parse_json("body").isNull() | ~is_object, "not a JSON object")
        .when(F.col("_top.nodes").isNull(), "no nodes")
        .when(F.col("_top.devices").isNull(), "no devices")
    )
    return rows.select(
        "path", "doc_id", F.col("_top.nodes").alias("nodes"), F.col("_top.devices").alias("devices"), reason.alias("reason")
    )


def _entries(configs: DataFrame, column: str) -> DataFrame:
    good = configs.where(F.col("reason").isNull())
    items = F.from_json(column, "array<string>")
    return good.select("path", "doc_id", F.posexplode(items).alias("ord", "body"))


def nodes_of(configs: DataFrame) -> DataFrame:
    """``nodes(doc_id, path, ord, body)`` of all good files, repeats kept."""
    return _entries(configs, "nodes").withColumn("body", F.try_parse_json("body"))


def devices_of(configs: DataFrame) -> DataFrame:
    """``devices(doc_id, path, ord, name, descr, article, type, category, extra)``.

    ``extra`` holds the other attributes with scalar values.
    """
    rows = _entries(configs, "devices").withColumns(
        {"_m": F.from_json("body", "map<string,string>"), "_v": F.from_json("body", "map<string,variant>")}
    ).where(F.col("_m").isNotNull())
    scalar = F.transform_values("_v", lambda k, v: F.schema_of_variant(v).rlike("^(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL.*)$"))
    extra = F.map_filter(
        "_m", lambda k, v: ~k.isin(*DEVICE_FIELDS) & v.isNotNull() & F.coalesce(F.try_element_at(scalar, k), F.lit(False))
    )
    # Booleans print with a capital letter in attribute texts.
    shown = F.transform_values(
        extra,
        lambda k, v: F.when(F.schema_of_variant(F.try_element_at("_v", k)) == "BOOLEAN", F.initcap(v)).otherwise(v),
    )
    return rows.select(
        "doc_id", "path", "ord", *[F.try_element_at("_m", F.lit(f)).alias(f) for f in DEVICE_FIELDS], shown.alias("extra")
    )


def rejects_of(configs: DataFrame) -> DataFrame:
    """``rejects(path, reason)`` of files that could not be read."""
    return configs.where(F.col("reason").isNotNull()).select("path", "reason")


def file_statistics(configs: DataFrame) -> DataFrame:
    """Readable and all files, nodes and devices of the good ones."""
    good = F.col("reason").isNull()

    def length(column: str):
        return F.sum(F.when(good, F.json_array_length(column)).otherwise(0))

    return configs.agg(
        F.count_if(good).alias("files_ok"),
        F.count(F.lit(1)).alias("files"),
        F.coalesce(length("nodes"), F.lit(0)).alias("nodes"),
        F.coalesce(length("devices"), F.lit(0)).alias("devices"),
    )


def read_object_configs(spark: SparkSession, path: str) -> DataFrame:
    """``config(doc_id, part, body)`` of nested object files, for ``flatten_config``."""
    return read_text_files(spark, path, "*.json").select("doc_id", F.lit(0).alias("part"), "body")


# Flat object files: one list per table.
FLAT_SCHEMAS = {
    "tech_objects": "id string, n bigint, tech_type bigint, name string, name_eplan string, name_BC string,"
    " base_tech_object string, attached_objects string, cooper_param_number bigint",
    "devices": "name string, source string, parent string, obj_id string",
    "operations": "id string, name string, base_operation string, obj_id string, obj_name string, props map<string,string>",
    "states": "state_id string, operation_id string, operation_name string, obj_id string, obj_name string, state_data string",
    "steps": "step_id string, state_id string, step_number string, name string, time_param_n bigint, next_step_n bigint,"
    " baseStep string, opened_devices array<string>, closed_devices array<string>, obj_id string, obj_name string,"
    " operation_id string, operation_name string, state_name string",
    "signals": "name string, type string, parent string",
    "parameters": "obj_id string, obj_name string, id string, name string, value variant, meter string, nameLua string, oper array<int>",
}


def read_flat_table(texts: DataFrame, table: str) -> DataFrame:
    """One table of flat object files with its position ``ord``; a missing list gives no rows."""
    top = F.from_json("body", f"`{table}` string")
    items = F.from_json(top[table], "array<string>")
    rows = texts.select("doc_id", F.posexplode(items).alias("ord", "_raw"))
    return rows.select("doc_id", "ord", F.from_json("_raw", FLAT_SCHEMAS[table]).alias("v")).select("doc_id", "ord", "v.*")


def read_flat_objects(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table of the flat object files in a folder, empty when there is no file."""
    try:
        texts = read_text_files(spark, path, "*.json")
    except Exception as error:  # a missing folder is an empty corpus
        if "PATH_NOT_FOUND" not in str(error):
            raise
        texts = spark.createDataFrame([], "path string, doc_id string, body string, encoding string")
    return read_flat_table(texts, table)
