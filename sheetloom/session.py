"""Session settings and lineage cutting shared by all jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed side even where that costs one more exchange later on.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Old iteration rounds are dropped from the checkpoint folder once unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "sheetloom", master: str | None = None, **extra: str) -> SparkSession:
    """Create a session with the project settings; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Return the folder for cut lineage.

    The folder named in ``spark.checkpoint.dir`` wins. Where none is named, as in tests, a
    folder in the warehouse is used, which executors share too, and removed at the end.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        context.setCheckpointDir(folder)
        return context.getCheckpointDir()
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_rounds"
    if not context.master.startswith("local") and (folder.startswith("file:") or ":" not in folder):
        # Each executor would write to its own disk.
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share; the warehouse is a local folder")
    context.setCheckpointDir(folder)
    made = context._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
    made.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(made)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written copy.

    The copy is written by column and compressed; a checkpoint would hold whole rows as they are in memory.
    """
    return stored(df)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder, by column and compressed; it goes when the session ends."""
    spark = df.sparkSession
    folder = f"{use_checkpoint_dir(spark)}/{uuid.uuid4().hex}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
