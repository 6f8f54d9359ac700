"""Shared pieces of the corpus operators: table reading, shared-folder tables, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgework.functions.store import materialize, remove, shared_dir, table_path

__all__ = ["components", "materialize", "partitions", "read", "remove", "shared_dir", "small_batches", "table_path", "text_or_empty", "trimmed"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession, least: int = 1) -> int:
    """The session's shuffle width, so that it follows the deployment."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Bytes of an Arrow batch at most, so that a worker's memory doesn't follow the length of texts.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Have this session send Python batches of BATCH_BYTES at most."""
    if int(spark.conf.get(BATCH_KEY).rstrip("b") or 0) > BATCH_BYTES:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    return spark


def trimmed(run):
    """A batch function that gives its worker's free memory back to the system when a task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def text_or_empty(c: str | Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an edge list (a, b): one row (node, component) per endpoint.

    Component = smallest node of the connected set. Alternates the large-star and small-star
    operations (Kiveris et al. 2014); each round is two grouped minima and two equi-joins, so a node
    of any degree is pre-aggregated before its shuffle and split by the skew join, and nothing is
    gathered on the driver. Nulls and self-loops are ignored; an empty list gives an empty result.
    """
    spark = edges.sparkSession
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, path = materialize(e, "edges", with_path=True)
    nodes_path, seen = path, None
    nodes = e.select(F.col("u").alias("node")).union(e.select("v"))
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m0")).select("k", F.least("k", "m0").alias("m"))
        large = both.join(low, both.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(low2, large.u == low2.k).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e, now = materialize(small, "edges", with_path=True)
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if path != nodes_path:
            remove(spark, path)
        path = now
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = nodes.distinct()
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
