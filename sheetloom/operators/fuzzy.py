"""Similar object names for contours whose name matches no configured object."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions import names


def device_prefixes(devices: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Distinct name prefixes of the configured devices with the number of devices."""
    return (
        devices.withColumn("prefix", names.name_prefix(F.col("name")))
        .where(F.col("prefix").isNotNull())
        .groupBy(*key, "prefix")
        .agg(F.count(F.lit(1)).alias("devices"))
    )


def _least(size: Column) -> Column:
    """Smallest shared length that passes the threshold against a text of ``size``."""
    return (F.floor(size * names.FUZZY_MIN) + 1).cast("int")


def _heads(df: DataFrame, text: str) -> DataFrame:
    """Every prefix long enough to pass on its own."""
    size = F.length(text)
    return df.withColumn("_k", F.explode(F.sequence(_least(size), size))).withColumn(
        "_key", F.left(F.col(text), F.col("_k"))
    )


def _parts(df: DataFrame, text: str, lengths: Column) -> DataFrame:
    """Every substring long enough to pass whose length the other side has."""
    size = F.length(text)
    return (
        df.withColumn("_k", F.explode(lengths))
        .where((F.col("_k") >= _least(size)) & (F.col("_k") <= size))
        .withColumn("_at", F.explode(F.sequence(F.lit(1), size - F.col("_k") + 1)))
        .withColumn("_key", F.substr(F.col(text), F.col("_at"), F.col("_k")))
        .drop("_at")
    )


def best_similar(
    left: DataFrame, right: DataFrame, a: str, b: str, keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Best ``b`` per ``a`` with similarity above the threshold; ties go to the smaller ``b``.

    A pair can pass only when the common prefix, or the contained text, is longer than 0.6
    of the longer text, so the cases are equi-joins on prefixes and substrings. The score of
    such a join depends on the length of ``b`` only; one ``b`` per key and length is enough
    to find the best, and groups of alike names are never paired with each other.
    """
    lt = left.select(*keys, a, F.upper(a).alias("_a")).where(F.length("_a") > 0)
    rt = right.select(*keys, b, F.upper(b).alias("_b")).where(F.length("_b") > 0)
    cols = [*keys, a, b]

    def smallest(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys, "_k", "_key", F.length("_b").alias("_size")).agg(F.min(b).alias(b))

    on = [*keys, "_k", "_key"]
    by_head = _heads(lt, "_a").join(smallest(_heads(rt, "_b")), on)
    a_lengths = lt.agg(F.collect_set(F.length("_a"))).scalar()
    b_lengths = rt.agg(F.collect_set(F.length("_b"))).scalar()
    whole_a = lt.withColumns({"_k": F.length("_a"), "_key": F.col("_a")})
    whole_b = rt.withColumns({"_k": F.length("_b"), "_key": F.col("_b")})
    a_in_b = whole_a.join(smallest(_parts(rt, "_b", a_lengths)), on)
    b_in_a = _parts(lt, "_a", b_lengths).join(smallest(whole_b), on)
    found = by_head.select(*cols).union(a_in_b.select(*cols)).union(b_in_a.select(*cols))
    score = names.similarity(F.col(a), F.col(b))
    return (
        found.withColumn("score", score)
        .where(F.col("score") > names.FUZZY_MIN)
        .groupBy(*keys, a)
        .agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(b).alias("b"))).alias("_best"))
        .select(*keys, a, F.col("_best.b").alias(b), (-F.col("_best.s")).alias("score"))
    )


def suggest_objects(contours: DataFrame, devices: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Most similar device prefix per distinct contour name."""
    clean = F.element_at(F.split("name", r"\+"), -1)
    wanted = (
        contours.where(F.coalesce("name", F.lit("")) != "")
        .select(*keys, clean.alias("contour_name"))
        .distinct()
    )
    prefixes = device_prefixes(devices, keys).select(*keys, "prefix")
    return best_similar(wanted, prefixes, "contour_name", "prefix", keys)
