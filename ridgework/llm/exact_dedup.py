"""Exact dedup by an extendible-hash index on shared files (DataFrame operations only)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgework.functions.store import materialize_counting

from .common import materialize, partitions, read, remove, text_or_empty

#: Bits of the directory at most: a value of 16 MB in each task.
MOST_BITS = 24

#: A run of white space that is not one single space already; replacing only those is the same as replacing all runs.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    """The text with each white-space run as one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), RUNS, " ")


def fingerprint(norm: Column) -> Column:
    """The 64-bit key of a normalised text in the index."""
    return F.xxhash64(norm)


def directory(keys: DataFrame, capacity: int, max_depth: int | None = None) -> tuple[DataFrame, int]:
    """(prefix, depth) of the extendible-hash directory over the top bits of distinct keys (fp), and those bits.

    It begins as one bucket. In every round all buckets with more than capacity keys split by one more
    bit, which doubles the directory where its deepest bucket splits, until all fit or max_depth (default:
    three doublings beyond an even spread) is reached; keys that still share a bucket then are chained in
    it. Rounds work on counts per prefix, 2**max_depth rows at most, whatever the number of copies.
    """
    cells, path = materialize(keys.select("fp"), "dedup-keys", with_path=True)
    n = cells.count()
    deep = max_depth if max_depth is not None else min(MOST_BITS, 3 + max(0, math.ceil(math.log2(max(1, n) / capacity))))
    top = F.shiftrightunsigned("fp", 64 - deep) if deep else F.lit(0).cast("long")
    d = materialize(cells.groupBy(top.alias("prefix")).agg(F.count("*").alias("n")).withColumn("depth", F.lit(0)), "dedup-directory")
    remove(keys.sparkSession, path)
    for _ in range(deep):
        d = d.withColumn("bucket", bucket_of(F.col("prefix"), F.col("depth"), deep))
        full = d.groupBy("depth", "bucket").agg(F.sum("n").alias("held")).where(F.col("held") > capacity).drop("held").withColumn("splits", F.lit(1))
        d, some = materialize_counting(d.join(full, ["depth", "bucket"], "left").select("prefix", "n", (F.col("depth") + F.coalesce("splits", F.lit(0))).alias("depth"), "splits"), "dedup-directory", F.col("splits").isNotNull())
        d = d.drop("splits")
        if not some:
            break
    return d.select("prefix", "depth"), deep


def bucket_of(prefix: Column, depth: Column, deep: int) -> Column:
    """The first prefix of the bucket of that depth which holds a prefix of deep bits."""
    rest = F.lit(deep) - depth
    return F.call_function("shiftleft", F.call_function("shiftright", prefix, rest), rest)


def router(where: DataFrame, deep: int):
    """An expression from a key to its bucket: the directory as one array of depths, a value of 2**deep small numbers."""
    every = where.sparkSession.range(1 << deep).select(F.col("id").alias("prefix")).join(where, "prefix", "left").select(F.struct("prefix", F.coalesce("depth", F.lit(deep)).cast("tinyint").alias("depth")).alias("x"))
    table = materialize(every.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["depth"]).alias("depths")), "dedup-router")

    def bucket(fp: Column) -> Column:
        prefix = F.shiftrightunsigned(fp, 64 - deep) if deep else F.lit(0).cast("long")
        return bucket_of(prefix, F.get(table.scalar(), prefix.cast("int")).cast("int"), deep)

    return bucket


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, text_sha256), a narrow row per row of docs, kept in the shared folder."""
    norm = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    return materialize(norm.select("id", fingerprint(F.col("norm")).alias("fp"), F.sha2("norm", 256).alias("text_sha256")), "dedup-keyed")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 65536, max_depth: int | None = None, keys: DataFrame | None = None) -> tuple[DataFrame, Callable[[Column], Column]]:
    """The index as a table of shared files, (bucket, fp, chain, keep_id, group_size, text_sha256), and the way from a key to its bucket.

    The directory is grown from the distinct keys first. Texts then go to their bucket, where those of one
    key are compared by their bytes: each different text is an entry, and entries of one key are chained
    from 0. Copies are combined on the map side, so a text that a third of all rows repeat leaves each map
    task once. Owner tasks each take one range of buckets and write their entries in key order.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("norm")).withColumn("fp", fingerprint(F.col("norm")))
    keys = keyed(docs, id_col, text_col) if keys is None else keys
    bucket = router(*directory(keys.select("fp").distinct(), capacity, max_depth))
    held = rows.groupBy(bucket(F.col("fp")).alias("bucket"), "fp", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = held.select("bucket", "fp", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256"))
    chain = F.row_number().over(Window.partitionBy("bucket", "fp").orderBy("text_sha256")) - 1
    owned = entries.repartitionByRange(partitions(spark), "bucket", "fp").withColumn("chain", chain).sortWithinPartitions("bucket", "fp", "chain")
    return materialize(owned.select("bucket", "fp", "chain", "keep_id", "group_size", "text_sha256"), "dedup-index"), bucket


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 65536, max_depth: int | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, chain.

    Texts are equal when their bytes are after white-space runs become single spaces; null counts as
    empty, and empty texts form a group like any other. The smallest id of a group stays. A row with a
    null id belongs to its group and stays only if the group has no id at all; rows that repeat both id
    and text are one document and share its verdict. Other columns of docs are not read, so their names
    don't matter, and an empty table gives an empty result. A probe goes to its key's bucket and along the
    chain there by digest, so rows are narrow, and a hot group is split by the skew join.
    """
    keys = keyed(docs, id_col, text_col)
    index, bucket = build_index(docs, id_col, text_col, capacity, max_depth, keys)
    out = keys.withColumn("bucket", bucket(F.col("fp"))).join(index, ["bucket", "fp", "text_sha256"])
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "chain")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with docs' own columns.

    Rows with a null id are told apart by their text, so one of them may stay where another goes.
    """
    kept = annotate(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("_kept_id"), F.when(F.col(id_col).isNull(), F.col("text_sha256")).alias("_kept_sha")).distinct()
    sha = F.when(docs[id_col].isNull(), F.sha2(normalised(docs[text_col]), 256))
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]) & sha.eqNullSafe(kept["_kept_sha"]), "left_semi")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's group of equal texts."""
    return annotate(read(spark, sf_dir, "documents"))


#: DuckDB: the same groups by the normalised text itself.
ORACLE = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
       sha256(norm) AS text_sha256, CAST(0 AS INTEGER) AS chain
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
"""
