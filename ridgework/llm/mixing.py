"""Mixing sources to target weights by Pfair scheduling.

A weight of n parts in a total of D gives block k of a source the window of slots
[floor(k D / n), ceil((k + 1) D / n)): its release and its deadline. On one sequence of slots
earliest-deadline-first meets every deadline, so at any slot each source is less than one block away
from its share. All windows repeat after D slots, so one period, made from the configuration alone, is
the schedule of any corpus.
"""

from __future__ import annotations

import heapq
from itertools import chain
from math import gcd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, read

OTHER = "(other)"
#: Production target: parts per source; sources without an entry, and null, share the parts of OTHER.
WEIGHTS = {"src0": 4, "src1": 2, "src2": 2, **{f"src{i}": 1 for i in range(3, 20)}, OTHER: 1}
BLOCK_ROWS = 32
#: Configured sources and total parts at most; the period's table is no larger than the latter.
MOST_SOURCES, MOST_PARTS = 1_000, 100_000


def period(parts: dict[str, int]) -> list[str]:
    """The source of each slot of one period."""
    total = sum(parts.values())
    todo = sorted((0, -(-total // n), s, 0) for s, n in parts.items())  # release, deadline, source, block
    ready, out = [], []
    heapq.heapify(todo)
    for t in range(total):
        while todo and todo[0][0] <= t:
            release, deadline, s, k = heapq.heappop(todo)
            heapq.heappush(ready, (deadline, s, k))
        deadline, s, k = heapq.heappop(ready)
        assert t < deadline
        out.append(s)
        if (k := k + 1) < (n := parts[s]):
            heapq.heappush(todo, (k * total // n, -(-(k + 1) * total // n), s, k))
    return out


def reduced(weights: dict[str, int]) -> dict[str, int]:
    """Positive integer parts without a common factor, with a share for unlisted sources."""
    weights = {s: n for s, n in ({OTHER: 1} | weights).items() if n}
    if len(weights) > MOST_SOURCES or any(int(n) != n or n < 0 for n in weights.values()):
        raise ValueError(f"weights are integer parts of at most {MOST_SOURCES} sources")
    g = gcd(*map(int, weights.values()))
    parts = {s: int(n) // g for s, n in weights.items()}
    if sum(parts.values()) > MOST_PARTS:
        raise ValueError(f"weights have more than {MOST_PARTS} parts in all")
    return parts


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """docs with mix_stream, mix_slot, mix_pos: where each row stands in the mixture.

    Every row is placed exactly once. A source's rows are shuffled by a digest of their id and cut into
    blocks of block_rows; block k of a source takes the source's k-th slot. mix_pos numbers all rows
    from 0 in slot order. Up to the first slot of a source that has no rows left, every prefix holds each
    source's target share to less than one block; after that the source's slots stay empty and the
    others go on in proportion. Of rows that repeat an id any may come first.

    Sources without an entry, null ones too, form the stream OTHER, which has one part unless weights
    give it more, so no row is left out. Null ids come first in their source, rows that repeat an id stand next to each other, empty tables give empty results, and
    columns named mix_stream, mix_slot and mix_pos are replaced; all others go through unchanged, whatever their names. Ranks come from counts per (source, digest range) plus a row number
    inside each range, so a source with a third of all rows is spread over as many tasks as there are.
    """
    spark = docs.sparkSession
    parts = reduced({s: n for s, n in (weights or WEIGHTS).items() if n or s != OTHER})
    slots, total, names = period(parts), sum(parts.values()), list(parts)
    width = 2 if partitions(spark) <= 64 else 3 if partitions(spark) <= 1024 else 4  # hex digits of a range
    src = F.col(source_col).cast("string")
    stream = F.when(src.isin(*[s for s in names if s != OTHER]), src).otherwise(F.lit(OTHER))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    keep = [c for c in docs.columns if c not in ("mix_stream", "mix_slot", "mix_pos")]
    # docs' own columns travel in one struct, so that no name here can clash with theirs
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), stream.alias("stream"), key.alias("key"), F.col(id_col).alias("id")).withColumn("range", F.substring("key", 1, width))
    narrow = docs.select(stream.alias("stream"), F.substring(key, 1, width).alias("range"))
    counts = narrow.groupBy("stream", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("stream").orderBy("range")) - F.col("n")
    base = counts.select("stream", "range", before.alias("before"))  # 16**width rows a source at most
    sizes = {r.stream: r.n for r in counts.groupBy("stream").agg(F.sum("n").alias("n")).collect()}  # a row per configured source
    number = F.row_number().over(Window.partitionBy("stream", "range").orderBy("key", F.col("id").asc_nulls_first())) - 1
    ranked = rows.withColumn("inside", number).join(base, ["stream", "range"]).withColumn("rank", F.col("before") + F.col("inside"))
    # the period as a map from stream to its slots; per slot, the blocks of each stream before it
    of = {s: [t for t, x in enumerate(slots) if x == s] for s in names}
    lit_slots = F.create_map(*chain.from_iterable((F.lit(s), F.array(*map(F.lit, of[s]))) for s in names))
    n_of = F.create_map(*chain.from_iterable((F.lit(s), F.lit(parts[s])) for s in names))
    block = F.expr(f"rank div {block_rows}")
    n = n_of[F.col("stream")]
    slot = F.floor(block / n).cast("long") * total + F.element_at(lit_slots[F.col("stream")], (block % n).cast("int") + 1)
    counted = _done(spark, slots, names)
    placed = ranked.withColumn("slot", slot).withColumn("t", (F.col("slot") % total).cast("int")).join(F.broadcast(counted), "t")  # at most MOST_PARTS rows
    cycle = F.expr(f"slot div {total}")
    quota = F.zip_with(F.array(*[F.lit(parts[s]) for s in names]), F.col("done"), lambda p, d: (cycle * p + d) * block_rows)
    held = F.zip_with(quota, F.array(*[F.lit(int(sizes.get(s, 0))) for s in names]), lambda q, c: F.least(q, c.cast("long")))
    pos = F.aggregate(held, F.lit(0).cast("long"), lambda a, x: a + x) + F.col("rank") % block_rows
    return placed.select("row.*", F.col("stream").alias("mix_stream"), F.col("slot").alias("mix_slot"), pos.alias("mix_pos"))


def _done(spark: SparkSession, slots: list[str], names: list[str]) -> DataFrame:
    """Blocks of each stream before each slot of the period."""
    at, done, rows = {s: i for i, s in enumerate(names)}, [0] * len(names), []
    for t, s in enumerate(slots):
        rows.append((t, list(done)))
        done[at[s]] += 1
    return spark.createDataFrame(rows, "t int, done array<int>")


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's stream, slot and position under the production weights."""
    return mix(read(spark, sf_dir, "documents").select("doc_id", "source"))


def _oracle() -> str:
    parts = reduced(WEIGHTS)
    slots, total = period(parts), sum(parts.values())
    k, rows = dict.fromkeys(parts, 0), []
    for t, s in enumerate(slots):
        rows.append(f"('{s}', {k[s]}, {t}, {parts[s]})")
        k[s] += 1
    return f"""
WITH period(stream, k, t, n) AS (VALUES {', '.join(rows)}),
docs AS (SELECT doc_id, source, CASE WHEN source IN (SELECT stream FROM period) THEN source ELSE '{OTHER}' END AS mix_stream,
         md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS key FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY mix_stream ORDER BY key, doc_id NULLS FIRST) - 1 AS r FROM docs),
placed AS (SELECT doc_id, source, mix_stream, r, (r // {BLOCK_ROWS}) // n * {total} + t AS mix_slot
           FROM ranked JOIN period ON stream = mix_stream AND k = (r // {BLOCK_ROWS}) % n)
SELECT doc_id, source, mix_stream, CAST(mix_slot AS BIGINT) AS mix_slot,
       CAST(row_number() OVER (ORDER BY mix_slot, r) - 1 AS BIGINT) AS mix_pos FROM placed
"""


ORACLE = _oracle()
