"""Rendezvous hashing of stable record keys over weighted shards.

Each shard scores each key by a hash of both; the best score takes the key. Adding a shard can
only move keys into the new one, and a shard gets keys in proportion to its weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm.shared import block_count, number_rows, table, written

SHARDS = 40
_HEX = 12
_UNIT = 16**_HEX


def _cost(key: Column, shard: int, weight: float) -> Column:
    """``-ln(u) / weight`` for a hash ``u`` in (0, 1) of key and shard; the smallest cost wins."""
    part = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{shard}")).cast("binary")), 1, _HEX), 16, 10).cast("double")
    return -F.log((part + 0.5) / F.lit(float(_UNIT))) / F.lit(float(weight))


def rendezvous(df: DataFrame, key: str, weights: Sequence[float], out: str, grown: str | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Add the shard of each row's ``key``, and with ``grown`` the shard with one more shard of ``grown_weight``.

    A null key counts as the key text ``null``; equal keys share a shard. Weights must be positive.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    costs = [F.struct(_cost(name, i, w).alias("c"), F.lit(i).alias("i")) for i, w in enumerate(weights)]
    best = F.array_min(F.array(*costs)) if len(costs) > 1 else costs[0]
    df = df.withColumn("_best", best).withColumn(out, F.col("_best.i"))
    if grown:
        more = _cost(name, len(costs), grown_weight)
        df = df.withColumn(grown, F.when(more < F.col("_best.c"), F.lit(len(costs))).otherwise(F.col(out)))
    return df.drop("_best")


def shard_documents(docs: DataFrame, shards: int = SHARDS, weights: Sequence[float] | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    Size is the text's UTF-8 bytes (null: none) plus 16; the CRC of null is that of an empty
    text. ``slot`` numbers the rows of a shard from 0 without gaps, repeated rows included.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = written(rendezvous(narrow, "doc_id", weights or [1.0] * shards, "shard", "grown_shard"))
    numbered = number_rows(placed, ["shard"], ["doc_id", "text_crc32"], "slot", block_count(placed.count()))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 shards of equal weight."""
    return shard_documents(table(spark, sf_dir, "documents"))
