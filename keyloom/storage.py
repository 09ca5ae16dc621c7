"""Cutting lineage, and folders for what must be written, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: With it Spark deletes the shuffle files of a query when that query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, from spark.checkpoint.dir; only a local master without that setting gets a temporary one.

    What is checkpointed there is deleted once no table refers to it any more.
    """
    sc = spark.sparkContext
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="keyloom-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there. The shuffle files that this took are deleted at once."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # the setting counts for tables that are made while it holds
        return df.where(F.lit(True)).checkpoint(eager=True)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _on_disk(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it is deleted when the application ends, or before by remove()."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = _on_disk(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in a scratch folder, and read from there: unlike cut(), a later reader takes the columns it needs alone.

    Rows keep no partitions, and the folder stays until the application ends.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "written") + "/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    files, at = _on_disk(spark, path)
    files.delete(at, True)
