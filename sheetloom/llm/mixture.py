"""Mixing sources to target weights by subset sums over exact text lengths.

Documents are counted by source and exact length. A source's budget is met in three steps: whole
passes over the source; then the same share of every length; then a bounded-knapsack dynamic
programme over the lengths that are left for the remaining budget. Which documents of a length
are taken is decided by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetloom.llm.shared import block_count, number_rows, table, word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = 17


def knapsack(lengths: np.ndarray, left: np.ndarray, budget: int, above: bool = False) -> np.ndarray:
    """How many of each length to take, at most ``left``, so that their sum is as near to ``budget`` as can be.

    The sum stays at or below the budget, or with ``above`` at or above it where all of them reach it.

    Counts are split into powers of two, and for each sum the first item that reached it is
    kept, from which the way back follows. Memory is one number per word of the budget.
    """
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return take
    most = budget + (int(lengths.max()) if above else 0)
    first = np.full(most + 1, -1, np.int32)
    reach = np.zeros(most + 1, bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for i, (length, n) in enumerate(zip(lengths.tolist(), left.tolist(), strict=True)):
        if reach[budget] or length <= 0:
            continue
        n, part = min(n, most // length), 1
        while n > 0 and not reach[budget]:
            part = min(part, n)
            weight = part * length
            new = reach[: most + 1 - weight] & ~reach[weight:]
            first[weight:][new] = len(items)
            reach[weight:] |= new
            items.append((i, part))
            n, part = n - part, part * 2
    over = np.flatnonzero(reach[budget:])
    at = budget + int(over[0]) if above and over.size else int(np.flatnonzero(reach[: budget + 1])[-1])
    while at:
        i, part = items[first[at]]
        take[i] += part
        at -= part * int(lengths[i])
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED, above: bool = False) -> np.ndarray:
    """How many documents of each length meet ``budget`` words, or come nearest below it (``above``: above it).

    Each length gives the same share; single documents of seeded lengths follow while they
    leave more than four times the longest text; the programme fits what remains. Of more than
    half of all words, those that stay out are fitted.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    if 2 * budget > total:
        return counts - fit_budget(lengths, counts, total - budget, seed, not above)
    take = np.array([n * budget // total for n in counts.tolist()], np.int64)
    rest = budget - int((take * lengths).sum())
    order = np.random.default_rng(seed).permutation(len(lengths))
    room = 4 * int(lengths.max())
    for i in order:
        if rest <= room:
            break
        if take[i] < counts[i]:
            take[i] += 1
            rest -= int(lengths[i])
    take[order] += knapsack(lengths[order], (counts - take)[order], rest, above)
    return take


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``target`` to one row per source (``key, source_size``).

    Sources in key order get ``weights`` in turn and share ``share`` of all sizes; a target stops
    at ``most`` times its source's size, and the excess is shared again by weight. Sorted by the
    level at which they stop, the sources that stop are the first ones, so one pass of sums
    gives the common level of the others.
    """
    everything = Window.partitionBy().orderBy("key")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("stop", F.col("cap") / F.col("w"))
    whole = Window.partitionBy()
    before = Window.partitionBy().orderBy("stop", "key").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("total", F.sum("source_size").over(whole) * F.lit(share)).withColumn("all_w", F.sum("w").over(whole))
    ranked = ranked.withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    )
    free = F.when(F.col("level") < F.col("stop"), F.col("level"))
    level = F.min_by(free, F.when(free.isNotNull(), F.struct("stop", "key"))).over(whole)
    return ranked.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))).select("key", "source_size", "target")


def _keyed(docs: DataFrame, seed: int) -> dict:
    """Columns that decide over a row: source key, size, and a seeded hash of id and text."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return {"key": key, "size": word_count(text), "r": F.xxhash64(F.lit(seed), "doc_id", F.crc32(text.cast("binary")))}


def _plan(narrow: DataFrame, weights: Sequence[float], share: float, most: float, seed: int) -> DataFrame:
    """By source key and size: whole passes over the source, and how many documents are taken once more."""
    counts = narrow.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))

    def allot(group: pd.DataFrame) -> pd.DataFrame:
        # Rows arrive in any order; reruns must agree.
        group = group.sort_values("size")
        lengths, n = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        passes = min(int(target // total), int(most)) if total else 0
        extra = fit_budget(lengths, n, int(target) - passes * total, seed) if passes < most else np.zeros(len(n), np.int64)
        return group[["key", "size", "source_size", "target"]].assign(passes=passes, extra=extra)

    return (
        counts.join(targets(sizes, weights, share, most), "key")
        .groupBy("key")
        .applyInPandas(allot, "key string, size bigint, source_size bigint, target double, passes bigint, extra bigint")
    )


def _counted(rows: DataFrame, narrow: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the column ``copies``: how often the mix takes each of them."""
    ranked = number_rows(rows, ["key", "size"], ["r", "doc_id"], "_rank", block_count(narrow.count()), plan, narrow)
    more = (F.col("_rank") < F.col("extra")).cast("bigint")
    return ranked.withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + more).otherwise(F.lit(0).cast("bigint")))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for every row of ``docs``.

    Size is the number of words, null text has none. A null source is one source, ordered last.
    Texts without words are never taken. Repeated rows are rows of their own. An empty table
    gives an empty result; further columns are not read. A document is taken whole, once or
    several times, never more than ``most`` times.
    """
    columns = _keyed(docs, seed)
    narrow = written(docs.select("doc_id", *[c.alias(n) for n, c in columns.items()]))
    counted = _counted(narrow, narrow, _plan(narrow, weights, share, most, seed))
    return counted.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them; all columns stay."""
    columns = {n: c.alias(n) for n, c in _keyed(docs, seed).items()}
    narrow = written(docs.select("doc_id", *columns.values()))
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", *columns.values())
    counted = _counted(whole, narrow, written(_plan(narrow, weights, share, most, seed)))
    return counted.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("_row.*")


def op2_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the standard weights."""
    return mix(table(spark, sf_dir, "documents"))
