"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder made for a local session that has none; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            found = got.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="ridgework-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that materialize() wrote."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, name: str, *, with_path: bool = False):
    """Write df as a table in the shared folder and read it back, which cuts its lineage.

    A lost executor costs a re-read of the files, not a re-run of what made them.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return (back, path) if with_path else back


def materialize_counting(df: DataFrame, name: str, what: Column) -> tuple[DataFrame, int]:
    """materialize(), and for how many rows `what` holds, counted while they are written."""
    seen = Observation()
    back = materialize(df.observe(seen, F.count_if(what).alias("n")), name)
    return back, seen.get["n"]
