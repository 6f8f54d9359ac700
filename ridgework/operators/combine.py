"""Joins and aggregates that put partial results of several stages together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def consolidate(parts: DataFrame, keys: list[str]) -> DataFrame:
    """A1: one row per key from partial rows: the greatest non-null of each column, lists joined and distinct.

    At most one value per key is meant to exist; the greatest makes a conflict deterministic. Partial
    aggregation runs before the shuffle, so the operator can be applied in several passes.
    """
    out = []
    for f in parts.schema.fields:
        if f.name in keys:
            continue
        if isinstance(f.dataType, T.ArrayType):
            out.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list(f.name)))).alias(f.name))
        else:
            out.append(F.max(f.name).alias(f.name))
    return parts.groupBy(*keys).agg(*out)


def latest(rows: DataFrame, keys: list[str], level: str) -> DataFrame:
    """A2: per key the row of the highest level; of equal levels the greatest row."""
    rest = [c for c in rows.columns if c not in (*keys, level)]
    return rows.groupBy(*keys).agg(F.max(F.struct(level, *rest)).alias("_r")).select(*keys, "_r.*")


def crossref(traces: DataFrame, users: DataFrame) -> DataFrame:
    """Traces (s, dir, ...) with the edges (s, ix, edge_dir, up, ...) that use them.

    An edge that starts at the saddle itself takes only its own direction's trace, others any; the
    direction must be of the edge's network: even directions are up.
    """
    t = traces.withColumnRenamed("s", "_s")
    fits = ((F.col("ix") != F.col("s")) | (F.col("edge_dir") == F.col("dir"))) & (F.col("up") == (F.col("dir") % 2 == 0))
    return users.join(t, F.col("s") == F.col("_s")).where(fits).drop("_s")


def split_by_side(facts: DataFrame, peak: Column, saddle: Column) -> tuple[DataFrame, DataFrame]:
    """P20: (up, down): peaks above their saddle, and the others."""
    return facts.where(peak > saddle), facts.where(~(peak > saddle))


def union_with_flags(a: DataFrame, b: DataFrame, keys: list[str], flag_a: str, flag_b: str) -> DataFrame:
    """Distinct keys of both, with which of the two has them."""
    x = a.select(*keys, F.lit(1).alias(flag_a), F.lit(0).alias(flag_b)).unionByName(b.select(*keys, F.lit(0).alias(flag_a), F.lit(1).alias(flag_b)))
    return x.groupBy(*keys).agg(F.max(flag_a).alias(flag_a), F.max(flag_b).alias(flag_b))


def running_maxima(rows: DataFrame, chain: list[str], pos: str, value: str) -> DataFrame:
    """The rows of each chain whose value exceeds all before."""
    from pyspark.sql import Window

    w = Window.partitionBy(*chain).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_m", F.max(value).over(w)).where(F.col("_m").isNull() | (F.col(value) > F.col("_m"))).drop("_m")


def first_where(rows: DataFrame, chain: list[str], pos: str, test: Column) -> DataFrame:
    """The first row of each chain that passes a test."""
    rest = [c for c in rows.columns if c not in chain]
    return rows.where(test).groupBy(*chain).agg(F.min_by(F.struct(*rest), pos).alias("_r")).select(*chain, "_r.*")
