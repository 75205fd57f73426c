"""Exact duplicates by two passes over Bloom filters.

Pass one hashes every text and marks filter bits; a bit is *repeated* when two rows hit it. Pass
two tests each row: only rows whose bits are all repeated can have an equal, and only these are
shuffled. All others pass straight through. Equality is then decided by SHA-256, so a false
positive of the filter costs a little shuffle and never changes the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm.shared import SPACE, block_count, table, written

BITS_PER_ROW = 16
MIN_FILTER_BITS = 1 << 20
#: 32 MB: the largest filter sent to the tasks. Beyond about 16 million rows false positives
#: rise, and with them the rows that shuffle; results stay exact.
MAX_FILTER_BITS = 1 << 28
PROBES = 3
_SLICE_BITS = 16


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """``PROBES`` bit positions per hash, by double hashing."""
    first = hashes.astype(np.uint64)
    step = (first >> np.uint64(32)) | np.uint64(1)
    return np.stack([(first + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)], axis=1)


def filter_bits(rows: int) -> int:
    """Filter size for a number of rows: a power of two within the documented bounds."""
    return min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, 1 << (rows * BITS_PER_ROW - 1).bit_length() if rows else 0))


def repeated_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bytes of the filter of bits that two or more rows hit; ``hashes`` has one bigint column ``h``.

    Each task sends the positions it met once and more than once, cut into slices; slices are
    merged apart from each other, and only the merged bits, of bounded size, reach the driver.
    """

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [_positions(b["h"].to_numpy(np.int64), bits).ravel() for b in batches]
        if parts:
            at, n = np.unique(np.concatenate(parts), return_counts=True)
            piece = at >> np.uint64(_SLICE_BITS)
            cuts = np.flatnonzero(np.diff(piece)) + 1
            for a, c in zip(np.split(at, cuts), np.split(n, cuts), strict=True):
                low = (a & np.uint64((1 << _SLICE_BITS) - 1)).astype(np.uint16)
                yield pd.DataFrame({"piece": [int(a[0]) >> _SLICE_BITS], "once": [low.tobytes()], "twice": [low[c > 1].tobytes()]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        hits = np.zeros(1 << _SLICE_BITS, np.int32)
        for once, twice in zip(group["once"], group["twice"], strict=True):
            hits[np.frombuffer(once, np.uint16)] += 1
            hits[np.frombuffer(twice, np.uint16)] += 1
        return pd.DataFrame({"piece": group["piece"][:1], "bits": [np.packbits(hits > 1, bitorder="little").tobytes()]})

    merged = (
        hashes.select("h")
        .mapInPandas(met, "piece bigint, once binary, twice binary")
        .groupBy("piece")
        .applyInPandas(merge, "piece bigint, bits binary")
    )
    out = np.zeros(bits // 8, np.uint8)
    width = (1 << _SLICE_BITS) // 8
    for row in merged.toLocalIterator():
        out[row["piece"] * width : (row["piece"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return out


def maybe_repeated(hashed: DataFrame, bits: np.ndarray) -> DataFrame:
    """``hashed`` (with column ``h``) and a boolean column ``maybe``: all probes hit repeated bits."""
    sent = hashed.sparkSession.sparkContext.broadcast(bits.tobytes())
    size = bits.size * 8

    @F.pandas_udf("boolean")
    def hit(h: pd.Series) -> pd.Series:
        own = np.frombuffer(sent.value, np.uint8)
        at = _positions(h.to_numpy(np.int64), size)
        found = (own[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        return pd.Series(found.all(axis=1))

    return hashed.withColumn("maybe", hit("h"))


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id``, hash of the normalised text (``text_sha256``), its 64-bit form ``h``, and ``n``, the code points of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.sha2(F.regexp_replace(text, f"{SPACE}+", ""), 256).alias("text_sha256"), F.length(text).alias("n")).withColumn(
        "h", F.xxhash64("text_sha256")
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical without white space; null counts as empty. The row
    with the most code points stays, then the one with the smallest ``doc_id`` (null last); of
    rows that repeat a ``doc_id`` together with a text of the same length one stays. An empty table gives an empty result; further columns are not read.

    Groups of any size are first gathered by a salt, so that a group with a large share of all
    rows is spread over tasks, and its verdict is sent back to those gathered parts.
    """
    sign = written(signed(docs))
    rows = sign.count()
    flagged = maybe_repeated(sign, repeated_filter(sign, filter_bits(rows)))
    through = flagged.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    best = lambda c: F.min(c).alias("best")
    parts = (
        flagged.where("maybe")
        .withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(4 * block_count(rows))).cast("int"))
        .withColumn("me", F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id"))
        .groupBy("text_sha256", "_salt")
        .agg(best("me"), F.collect_list("me").alias("members"))
    )
    parts = written(parts.select("text_sha256", "best", "members"))
    verdicts = parts.groupBy("text_sha256").agg(best("best"), F.sum(F.size("members")).alias("group_size"))
    # Rows equal to the best one have its id, thus its salt, and lie in one part.
    place = F.array_position("members", F.col("best")).alias("_best_at")
    members = parts.drop("best").join(verdicts, "text_sha256").select("text_sha256", "best", "group_size", place, F.posexplode("members").alias("_at", "me"))
    checked = members.select(
        F.col("me.doc_id").alias("doc_id"),
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_at") + 1 == F.col("_best_at")).alias("kept"),
        "text_sha256",
    )
    return through.unionByName(checked)


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, chosen as in ``exact_groups``; all columns stay."""
    sign = written(signed(docs))
    rows = sign.count()
    bits = repeated_filter(sign, filter_bits(rows))
    names = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.struct(*names).alias("_row"), "doc_id", "text")
    whole = whole.select("_row", F.col("doc_id").alias("_id"), F.sha2(F.regexp_replace(text, f"{SPACE}+", ""), 256).alias("_sha"), F.length(text).alias("_n"))
    flagged = maybe_repeated(whole.withColumn("h", F.xxhash64("_sha")), bits)
    again = maybe_repeated(sign, bits).where("maybe")
    me = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
    keepers = again.groupBy("text_sha256").agg(F.min(me).alias("best")).select(F.col("text_sha256").alias("_sha"), "best.*")
    keepers = keepers.select("_sha", (-F.col("n")).alias("_n"), F.coalesce("doc_id", F.lit(0)).alias("_key"), F.col("no_id").alias("_none"))
    chosen = (
        flagged.where("maybe")
        .withColumn("_none", F.col("_id").isNull())
        .withColumn("_key", F.coalesce("_id", F.lit(0)))
        .join(keepers, ["_sha", "_n", "_key", "_none"], "left_semi")
        .groupBy("_sha")
        .agg(F.first("_row").alias("_row"))
    )
    return flagged.where(~F.col("maybe")).select("_row.*").unionByName(chosen.select("_row.*"))


def op10_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH signed AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) = 1 AS kept,
       text_sha256
FROM signed
"""
