"""Reading tables, writing intermediate tables, and numbering rows for the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetloom.session import use_checkpoint_dir

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: What a worker holds from task to task, by operator. A task of another operator drops it.
KEPT: dict[str, object] = {}


def _give_back() -> None:
    """Return freed memory to the system; workers are reused, and what they hold counts for the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(work: Callable[[Iterator], Iterator], own: str = "") -> Callable[[Iterator], Iterator]:
    """``work`` over the batches of a task, without what other operators left, and with its memory given back at the end."""

    def run(batches: Iterator) -> Iterator:
        for name in [k for k in KEPT if k != own]:
            del KEPT[name]
        try:
            yield from work(batches)
        finally:
            _give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the folder that ``spark.checkpoint.dir`` names.

    Later steps read the written rows, so a lost executor costs a re-read, not the work before.
    """
    spark = df.sparkSession
    path = f"{use_checkpoint_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table of ``written`` that no later step reads."""
    spark = df.sparkSession
    for file in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column | str) -> Column:
    """Number of words in a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def block_count(rows: int, per_block: int = 10_000) -> int:
    """Blocks to cut a group into so that a group of all rows has about ``per_block`` in each."""
    return 1 << max(4, (max(rows, 1) // per_block).bit_length())


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, blocks: int, per_group: DataFrame | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """Number the rows of each group from 0, and join ``per_group`` (one row per group) to them.

    ``counted`` may name a narrower table of the same rows to count them from.

    Groups are cut into ``blocks`` by a hash of the ``order`` columns; blocks are counted, the
    counts summed up, and rows numbered inside their block. A group that holds a large share of
    all rows is thereby spread over as many tasks. Rows equal in ``order`` are numbered in any
    order. Key columns must not be null.
    """
    block = F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int")
    # Groups are sorted by a hash first, so that rows of like keys, such as long texts, do not follow each other.
    mixed = F.xxhash64(*keys, "_block")
    cut = df.withColumn("_block", block).withColumn("_mixed", mixed)
    counts = (cut if counted is None else counted.withColumn("_block", block)).groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if per_group is not None:
        starts = starts.join(per_group, list(keys))
    own = ["_mixed", *keys, "_block"]
    inside = Window.partitionBy(*own).orderBy(*order)
    return (
        cut.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(starts.withColumn("_mixed", mixed), own)
        .withColumn(out, (F.col("_start") + F.col("_inside")).cast("bigint"))
        .drop("_mixed", "_block", "_start", "_inside")
    )
