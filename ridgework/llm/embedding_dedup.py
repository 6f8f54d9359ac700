"""Embedding near-dedup: a robust-pruned flat graph over overlapping cluster shards.

Each distinct vector belongs to the shards of its two nearest centres. A task builds the pruned
neighbour lists of one shard slice, with an edge back for every edge, however many meet in one vector;
the lists of a vector from all its shards are united. Queries then walk the united graph of every shard
near them, best first, from its medoids and from a vector of each part that no medoid leads to, and go
on expanding for as long as nodes within the widened range turn up. What they reach is verified by cosine in double
precision; pairs are counted where they are found and never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialize, partitions, read

THRESHOLD = 0.95
#: Centres are fitted on this many distinct vectors at most and number this many at most; every vector is indexed.
SAMPLE, MOST_CENTRES, PER_SHARD = 20_000, 8_192, 700
#: Vectors of one slice of a shard, and queries of one search task.
SLICE, QUERIES = 2_000, 2_000
#: Edges kept by pruning, pruning factor (on distances), pool for pruning, nodes expanded at least, medoids.
DEGREE, ALPHA, POOL, BEAM, MEDOIDS = 24, 1.2, 96, 40, 8
#: Nodes of this cosine or more are expanded without end; centres this much farther than the nearest are probed.
WIDE, MARGIN = 0.88, 0.10


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0) & (F.size(v) > 0), F.lit(False))


def unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.asarray(rows, "f8")
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres_of(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        best = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, best, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


def pruned(x: np.ndarray) -> list[np.ndarray]:
    """Neighbour lists of one slice: of each vector's POOL nearest, those no kept neighbour stands in for, and all edges back.

    A hub's list may be as long as the slice: its copies often have no other edge.
    """
    m = len(x)
    if m == 1:
        return [np.zeros(0, "i4")]
    dist = np.sqrt(np.maximum(0, 2 - 2 * (x @ x.T))).astype("f4")
    np.fill_diagonal(dist, np.inf)
    p = min(POOL, m - 1)
    pool = np.argpartition(dist, p - 1, axis=1)[:, :p]
    pool = np.take_along_axis(pool, np.argsort(np.take_along_axis(dist, pool, 1), axis=1), 1)
    own = np.take_along_axis(dist, pool, 1)
    alive, rows = np.ones_like(pool, bool), np.arange(m)
    out: list[list[int]] = [[] for _ in range(m)]
    for _ in range(DEGREE):
        first = alive.argmax(axis=1)
        some = np.flatnonzero(alive[rows, first])
        if not len(some):
            break
        star = pool[some, first[some]]
        for i, s in zip(some.tolist(), star.tolist(), strict=True):
            out[i].append(s)
        alive[some] &= ALPHA * dist[star[:, None], pool[some]] > own[some]
        alive[some, first[some]] = False
    back: list[list[int]] = [[] for _ in range(m)]
    for i, ns in enumerate(out):
        for j in ns:
            back[j].append(i)
    return [np.array(list(dict.fromkeys(a + b)), "i4") for a, b in zip(out, back, strict=True)]


def medoids(x: np.ndarray, n: int = MEDOIDS) -> np.ndarray:
    """The vector nearest to the mean, then those farthest from the medoids so far."""
    at = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[at[0]]
    while len(at) < min(n, len(x)):
        at.append(int(near.argmin()))
        near = np.maximum(near, x @ x[at[-1]])
    return np.array(at)


def seeds(x: np.ndarray, deg: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Where a walk begins: the medoids, and a vector of each part of the graph that they don't lead to."""
    ends = np.cumsum(deg)
    start = np.unique(medoids(x)).tolist()  # equal vectors may be one medoid again and again
    seen = np.zeros(len(x), bool)
    more = list(start)
    for i in range(-1, len(x)):
        if i >= 0:
            if seen[i]:
                continue
            start.append(i)
            more = [i]
        seen[more] = True
        while more:
            j = more.pop()
            near = flat[ends[j] - deg[j] : ends[j]]
            fresh = near[~seen[near]]
            seen[fresh] = True
            more.extend(fresh.tolist())
    return np.array(start)


#: Cosines of pairs that a walk takes at once.
PAIRS = 1 << 14


def walk(x: np.ndarray, lists: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosines of queries with the nodes that a range-expanding greedy search reaches, -inf elsewhere.

    lists: neighbour positions, padded by -1.
    """
    sim = np.full((len(queries), len(x)), -np.inf)
    held = lists >= 0
    deg, flat = held.sum(axis=1), lists[held]
    ends = np.cumsum(deg)
    start = seeds(x, deg, flat)
    sim[:, start] = queries @ x[start].T
    unseen = np.full(len(queries), len(x) - len(start))
    todo = sim.copy()  # -inf once expanded
    live, expanded = np.arange(len(queries)), 0
    while len(live):
        best = todo[live].argmax(axis=1)
        top = todo[live, best]
        go = (top > -np.inf) & ((expanded < BEAM) | (top >= WIDE)) & (unseen[live] > 0)
        live, best = live[go], best[go]
        todo[live, best] = -np.inf
        n = deg[best]
        q = live.repeat(n)
        node = flat[np.arange(len(q)) + (ends[best] - np.cumsum(n)).repeat(n)]
        new = sim[q, node] == -np.inf
        q, node = q[new], node[new]
        for i in range(0, len(q), PAIRS):
            qi, ni = q[i : i + PAIRS], node[i : i + PAIRS]
            sim[qi, ni] = todo[qi, ni] = np.einsum("ij,ij->i", queries[qi], x[ni])
        unseen -= np.bincount(q, minlength=len(queries))
        expanded += 1
    return sim


def _vectors(c: pa.Array | pa.ChunkedArray) -> np.ndarray:
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1).astype("f8")


def links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all rows with their representative, (rep, n_links) of representatives with links, spanning edges (a, b))."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("v"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("vec_id").isNotNull())
    reps = rows.where("ok").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    reps = materialize(reps.withColumn("dim", F.size("v")), "vec-distinct")
    member = rows.join(reps.select("v", "rep"), "v", "left").select("vec_id", F.when(F.col("ok"), F.col("rep")).alias("rep"))
    none = (member, spark.createDataFrame([], "rep long, n_links long"), spark.createDataFrame([], "a long, b long"))
    dims = [r.dim for r in reps.groupBy("dim").count().collect()]  # one dimension as a rule
    if not dims:
        return none
    counts, edges = [], []
    for dim in dims:
        c, e = _links(reps.where(F.col("dim") == dim), threshold)
        counts.append(c)
        edges.append(e)
    for c, e in zip(counts[1:], edges[1:], strict=True):
        counts[0], edges[0] = counts[0].union(c), edges[0].union(e)
    return member, counts[0], edges[0]


def _links(reps: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    spark = reps.sparkSession
    n = reps.count()
    k = max(1, min(MOST_CENTRES, math.ceil(n / PER_SHARD)))
    sample = unit([r.v for r in reps.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").collect()])
    centres = spark.sparkContext.broadcast(centres_of(sample, min(k, len(sample))))  # MOST_CENTRES at most
    schema = "rep long, mult long, u array<double>, own array<int>, probe array<int>"

    def place(batches: Iterator[pa.RecordBatch]):
        c = centres.value
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(_vectors(b.column("v")))
            s = x @ c.T
            own = np.argsort(-s, axis=1, kind="stable")[:, :2]
            near = s >= s.max(axis=1, keepdims=True) - MARGIN
            np.put_along_axis(near, own, True, 1)
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("mult"), pa.array(list(x)), pa.array(np.sort(own, axis=1).astype("i4").tolist(), pa.list_(pa.int32())), pa.array([np.flatnonzero(r).astype("i4") for r in near], pa.list_(pa.int32()))], names=["rep", "mult", "u", "own", "probe"])

    placed = materialize(reps.select("rep", "mult", "v").repartition(partitions(spark), "rep").mapInArrow(place, schema), "vec-placed")
    held = placed.select("rep", "mult", "u", "own", F.explode("own").alias("shard"))
    sizes = held.groupBy("shard").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))  # a row per centre
    held = held.join(F.broadcast(sizes), "shard").withColumn("slice", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        ids, x = t.column("rep").to_numpy(), _vectors(t.column("u"))
        lists = [ids[a] for a in pruned(x)]
        return pa.table({"rep": ids, "near": pa.array(lists, pa.list_(pa.int64()))})

    lists = held.select("shard", "slice", "rep", "u").groupBy("shard", "slice").applyInArrow(build, "rep long, near array<long>")
    graph = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # two lists of a slice's length at most, 2 DEGREE on average
    graph = materialize(graph, "vec-graph")
    asked = placed.select("rep", "mult", "u", "probe", F.explode("probe").alias("shard")).join(F.broadcast(sizes), "shard")
    blocks = asked.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    asked = asked.join(F.broadcast(blocks), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("q"), "rep", "mult", "u", F.col("probe").alias("in_shards"), F.lit(None).cast("array<bigint>").alias("near"))
    nodes = held.join(graph, "rep").join(F.broadcast(blocks), "shard").select("shard", "slice", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("q"), "rep", "mult", "u", F.col("own").alias("in_shards"), "near")

    def search(t: pa.Table) -> pa.Table:
        shard, is_q = t.column("shard")[0].as_py(), np.array(t.column("q").to_pylist())
        a, b = t.filter(pa.array(~is_q)), t.filter(pa.array(is_q))
        names = ["rep", "n_links", "root"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        ids, x = a.column("rep").to_numpy(), _vectors(a.column("u"))
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        near = a.column("near").combine_chunks()
        ends = near.offsets.to_numpy()
        flat, owner = near.values.to_numpy(), np.repeat(np.arange(len(near)), np.diff(ends))
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        here = ids[at] == flat  # neighbours in other slices aren't loaded here
        place_of = np.empty(len(order), "i8")
        place_of[order] = np.arange(len(order))
        owner, at = place_of[owner[here]], at[here]
        by = np.argsort(owner, kind="stable")
        owner, at = owner[by], at[by]
        deg = np.bincount(owner, minlength=len(ids))
        lists = np.full((len(ids), max(1, int(deg.max(initial=0)))), -1, "i4")
        lists[owner, np.arange(len(owner)) - np.repeat(np.cumsum(deg) - deg, deg)] = at
        mult = a.column("mult").to_numpy()[order]
        first = np.array([min(o) for o in a.column("in_shards").to_pylist()])[order]
        qid, probes = b.column("rep").to_numpy(), b.column("in_shards").combine_chunks()
        looks = np.zeros((len(qid), int(max(first.max(), probes.values.to_numpy().max())) + 1), bool)
        looks[np.repeat(np.arange(len(qid)), np.diff(probes.offsets.to_numpy())), probes.flatten().to_numpy()] = True
        q, node = np.nonzero(walk(x, lists, _vectors(b.column("u"))) >= threshold)
        other = qid[q] != ids[node]
        q, node = q[other], node[other]
        # a pair counts in the first shard where the query looks and the node is
        ok = (first[node] == shard) | ~looks[q, first[node]]
        q, node = q[ok], node[ok]
        got = np.bincount(q, weights=mult[node], minlength=len(qid)).astype("i8")
        every = np.unique(np.concatenate([qid[q], ids[node]]))
        u, v = np.searchsorted(every, qid[q]), np.searchsorted(every, ids[node])
        root = np.arange(len(every))
        while len(u):
            low = np.minimum(root[u], root[v])
            before = root.copy()
            np.minimum.at(root, u, low)
            np.minimum.at(root, v, low)
            root = root[root]
            if (root == before).all():
                break
        some = np.flatnonzero(got)
        return pa.table([pa.array(np.concatenate([qid[some], every])), pa.array(np.concatenate([got[some], np.zeros(len(every), "i8")])), pa.array(np.concatenate([qid[some], every[root]]))], names=names)

    found = nodes.unionByName(asked).groupBy("shard", "slice", "block").applyInArrow(search, "rep long, n_links long, root long")
    found = materialize(found, "vec-found")
    return found.groupBy("rep").agg(F.sum("n_links").alias("n_links")), found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct()


def annotate(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of vectors.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id,
    link with nothing and are components of their own. Equal vectors are searched once and counted as
    often as they occur; vectors of different lengths never link. A row that repeats an id is a vector of
    its own; other columns are not read, so their names don't matter. An empty table gives an empty result.
    """
    member, counts, edges = links(vectors, id_col, vec_col, threshold)
    mult = member.where("rep is not null").groupBy("rep").agg(F.count("*").alias("mult"))
    comp = components(edges)
    per = mult.join(counts, "rep", "left").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    per = per.select("rep", (F.coalesce("n_links", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n"), F.coalesce("component", "rep").alias("component"))
    out = member.join(per, "rep", "left")
    comp_id = F.coalesce("component", "vec_id")
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), comp_id.alias("component_id"), F.col("vec_id").eqNullSafe(comp_id).alias("kept"))


def audit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, every: int = 100) -> float:
    """Recall of the index: links found of the vectors whose id is divisible by `every`, against brute force over all vectors."""
    spark = vectors.sparkSession
    fine = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("v"))
    asked = fine.where(F.col("vec_id") % every == 0)
    blocks, n_tiles = max(1, math.ceil(asked.count() / QUERIES)), max(1, math.ceil(fine.count() / (10 * SLICE)))
    asked = asked.select(F.col("vec_id").alias("q"), F.col("v").alias("w"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
    tiles = fine.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(n_tiles)))
    names = ["q", "n"]

    def exact(t: pa.Table) -> pa.Table:
        is_q = np.array(t.column("is_q").to_pylist())
        a, b = t.filter(pa.array(~is_q)), t.filter(pa.array(is_q))
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2, names=names)
        hit = unit(_vectors(b.column("v"))) @ unit(_vectors(a.column("v"))).T >= threshold
        hit &= b.column("id").to_numpy()[:, None] != a.column("id").to_numpy()[None, :]
        return pa.table([b.column("id"), pa.array(hit.sum(axis=1))], names=names)

    both = tiles.select("tile", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block"), F.lit(False).alias("is_q"), F.col("vec_id").alias("id"), "v").union(asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1)).cast("array<bigint>")).alias("tile"), "block", F.lit(True), "q", "w"))
    truth = both.groupBy("tile", "block").applyInArrow(exact, "q long, n long").groupBy("q").agg(F.sum("n").alias("n"))
    got = annotate(vectors, id_col, vec_col, threshold).select(F.col(id_col).alias("q"), "n_links")
    r = truth.join(got, "q").agg(F.sum(F.least("n_links", "n")).alias("found"), F.sum("n").alias("all")).first()
    return 1.0 if not r["all"] else r["found"] / r["all"]


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: links and components of all vectors."""
    return annotate(read(spark, sf_dir, "embeddings"))


#: DuckDB: all pairs and their closure.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS n, vec_id AS c FROM v UNION SELECT l.b, r.c FROM reach r JOIN l ON l.a = r.n),
comp AS (SELECT n, min(c) AS c FROM reach GROUP BY n),
links AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, c AS component_id, v.vec_id = c AS kept FROM v LEFT JOIN links ON a = v.vec_id JOIN comp ON n = v.vec_id
"""
