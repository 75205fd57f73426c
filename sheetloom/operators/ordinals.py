"""Running numbers inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.session import cut_lineage


def number_within(df: DataFrame, keys: Sequence[str], order: str, out: str) -> DataFrame:
    """Number the rows of each group from 0 by ``order``, which must be unique within a group.

    Rows are dealt into ranges of ``(keys, order)`` with about as many rows in each, whatever
    values ``order`` has. Ranges are counted by group, and numbers follow from the counts before,
    so a group with a large share of all rows is spread over tasks.
    """
    ranged = cut_lineage(df.repartitionByRange(*keys, order).withColumn("_block", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        ranged.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(starts, [*keys, "_block"])
        .withColumn(out, (F.col("_start") + F.col("_inside")).cast("bigint"))
        .drop("_block", "_start", "_inside")
    )
