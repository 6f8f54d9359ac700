"""Paths: ways over the tree, its pruned form, cell traces, detailed lines and domain boundaries."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgework.functions import ids
from ridgework.functions.store import materialize
from ridgework.operators import blocks, forest

#: What follows the last node of a trace that leaves the data.
OFF = np.array([-1])


def ancestors(tree: DataFrame, starts: DataFrame, ways: blocks.Ways | None = None) -> DataFrame:
    """(up, start, pos, node): the way from each start to its root, pos 0 the start itself."""
    chains = chains_of(tree, starts, ways)
    return chains.select("up", "start", F.posexplode("chain").alias("pos", "node")).withColumn("pos", F.col("pos").cast("long"))


def chains_of(tree: DataFrame, starts: DataFrame, ways: blocks.Ways | None = None) -> DataFrame:
    """(start, up, chain): ancestors() as lists."""
    ways = ways or blocks.Ways(tree)
    legs = starts.select("up", F.col("start")).distinct().join(ways.rank.select("up", F.col("node").alias("start"), (F.col("depth") + 1).alias("n")), ["up", "start"]).withColumn("node", F.col("start"))
    return ways.lists(legs, ["start"], "chain")


def between(tree: DataFrame, tasks: DataFrame, ways: blocks.Ways | None = None) -> DataFrame:
    """(up, p, target, left, right): nodes of the way from p, and from target, to the first common one.

    tasks: (up, p, target). Both lists end with the node where they meet; without one, or without a
    target, each goes on to its root. Ways are followed block by block, so only nodes of the result are
    ever written.
    """
    ways = ways or blocks.Ways(tree)
    k = tasks.select("up", "p", "target").distinct()
    met = ways.meets(k.where("target is not null").select("up", F.col("p").alias("a"), F.col("target").alias("b")))
    met = materialize(met.select("up", F.col("a").alias("p"), F.col("b").alias("target"), "i", "j"), "way-meets")
    depth = lambda c: ways.rank.select("up", F.col("node").alias(c), (F.col("depth") + 1).alias(f"n_{c}"))
    x = k.join(met, ["up", "p", "target"], "left").join(depth("p"), ["up", "p"]).join(depth("target"), ["up", "target"], "left")
    sides = F.array(F.struct(F.lit("left").alias("side"), F.col("p").alias("node"), F.coalesce(F.col("i") + 1, F.col("n_p")).alias("n")), F.struct(F.lit("right").alias("side"), F.col("target").alias("node"), F.coalesce(F.col("j") + 1, F.col("n_target")).alias("n")))
    legs = x.select("up", "p", "target", F.explode(sides).alias("l")).select("up", "p", "target", "l.*").where("node is not null and n is not null")
    lists = ways.lists(legs, ["p", "target", "side"], "nodes")
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("nodes"))).alias(side)
    return lists.groupBy("up", "p", "target").agg(pick("left"), pick("right")).select("up", "p", "target", "left", "right").where("left is not null and (target is null or right is not null)")


def pruned(tree: DataFrame, keys: DataFrame) -> DataFrame:
    """(up, src, dst, interim): the tree cut down to key nodes, roots and the junctions between them.

    interim alternates saddle, node, saddle. Nodes in use are the keys and all that lies rootwards of
    them; every other node in use belongs to one leg, between the next kept nodes on either side.
    """
    used = materialize(keys.select("up", "node").distinct().join(tree.select("up", "node"), ["up", "node"], "left_semi"), "pruned-used")
    near, far = forest.jumps(tree)
    used = used.join(near, ["up", "node"]).select("up", F.explode("way").alias("node")).distinct()
    for t in far:
        used = materialize(used.union(used.join(t, ["up", "node"]).select("up", F.col("next").alias("node"))).distinct(), "pruned-used")
    way = tree.select("up", "node", "next", "s").join(used, ["up", "node"], "left_semi")
    joins = way.where("next is not null").groupBy("up", F.col("next").alias("node")).agg(F.count("*").alias("n")).where("n >= 2").select("up", "node")
    roots = way.where("next is null").select("up", "node")
    keep = joins.union(keys.select("up", "node")).union(roots).distinct().withColumn("kept", F.lit(True))
    way = materialize(way.join(keep, ["up", "node"], "left"), "pruned-way")
    # each node that isn't kept points rootwards; the last one before a kept node names the leg
    stops = way.select("up", F.col("node").alias("next"), F.col("kept").alias("stop"))
    ptr = way.where("next is not null").join(stops, ["up", "next"], "left").select("up", "node", "next", "s", "kept", F.when(F.col("stop").isNull(), F.col("next")).alias("on"))
    ptr = materialize(ptr, "pruned-ptr")
    leg = forest.ranked(ptr.select("up", "node", F.col("on").alias("next")))
    # a kept node begins its own leg, which ends at the leg of the node that it points to
    x = ptr.join(leg, ["up", "node"]).groupBy("up", "root").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("k"), "node", "s", "next"))).alias("l"))
    l0 = F.col("l")[0]
    return x.select("up", l0["node"].alias("src"), F.element_at("l", -1)["next"].alias("dst"), F.flatten(F.transform("l", lambda e: F.when(e["k"] == l0["k"], F.array(e["s"])).otherwise(F.array(e["node"], e["s"])))).alias("interim"))


def traces(split: DataFrame, ways: blocks.Ways, classified: DataFrame) -> DataFrame:
    """(x, y, seq, up, trace, cells): the cells from a saddle to where its lead ends.

    cells begins with the saddle; a last element without x says that the way leaves the data. Ways are
    those of network.cell_ways(), followed block by block; a cell of a result is written once.
    """
    gone = F.struct(F.lit(None).cast("int").alias("x"), F.lit(None).cast("int").alias("y"))
    off = classified.where("class = 'indeterminate'").select(ids.pack(0, "x", "y").alias("root"), F.lit(True).alias("off"))
    by = ["x", "y", "seq", "trace"]
    first = split.select(*by, "up", ids.pack(0, "bx", "by").alias("node")).join(ways.rank, ["up", "node"]).join(off, "root", "left")
    first = materialize(first.select(*by, "up", "node", (F.col("depth") + 1).alias("n"), "off"), "trace-first")
    out = first.select(*by, "up", "off").join(ways.lists(first, by, "way"), [*by, "up"])
    at = F.transform("way", lambda v: F.struct(ids.unpack(v)["x"].alias("x"), ids.unpack(v)["y"].alias("y")))
    whole = F.concat(F.array(F.struct("x", "y")), at, F.when(F.col("off"), F.array(gone)).otherwise(F.array().cast("array<struct<x:int,y:int>>")))
    return out.select("x", "y", "seq", "up", "trace", whole.alias("cells"))


def hops(edges: DataFrame, tr: DataFrame) -> DataFrame:
    """(up, s, src, dst, cells): the cells from one end of an edge over its saddle to the other."""
    t = tr.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "seq", "up", "trace", "cells")
    e = edges.join(t.withColumnsRenamed({"trace": "tag_a", "cells": "to_a"}), ["sx", "sy", "seq", "up", "tag_a"]).join(t.withColumnsRenamed({"trace": "tag_b", "cells": "to_b"}), ["sx", "sy", "seq", "up", "tag_b"])
    pid = lambda x, y: F.when(F.col(x).isNotNull(), ids.pack(0, x, y))
    s, a, b = ids.pack(0, "sx", "sy", "seq"), pid("ax", "ay"), pid("bx", "by")
    one = lambda p, q: F.concat(F.reverse(p), F.slice(q, 2, F.size(q)))
    both = F.array(F.struct(a.alias("src"), b.alias("dst"), one(F.col("to_a"), F.col("to_b")).alias("cells")), F.struct(b.alias("src"), a.alias("dst"), one(F.col("to_b"), F.col("to_a")).alias("cells")))
    return e.select("up", s.alias("s"), F.explode(both).alias("h")).select("up", "s", "h.*")


def detailed(ways: DataFrame, tree: DataFrame, hop: DataFrame) -> DataFrame:
    """(up, p, target, cells): every way of between() as cells from p to its target.

    The two lists become consecutive hops, target's side backwards; cells of hops are spliced in order.
    """
    right = F.coalesce("right", F.array().cast("array<bigint>"))
    nodes = F.concat("left", F.slice(F.reverse(right), 2, F.greatest(F.size(right), F.lit(1))))
    n = ways.select("up", "p", "target", nodes.alias("nodes"))
    legs = n.where("size(nodes) > 1").select("up", "p", "target", F.posexplode(F.zip_with(F.slice("nodes", 1, F.size("nodes") - 1), F.slice("nodes", 2, F.size("nodes") - 1), lambda u, v: F.struct(u.alias("src"), v.alias("dst")))).alias("i", "l")).select("up", "p", "target", "i", "l.*")
    arrows = tree.where("next is not null").select("up", "node", "next", "s")
    via = arrows.select("up", F.col("node").alias("src"), F.col("next").alias("dst"), "s").union(arrows.select("up", "next", "node", "s"))
    x = legs.join(via, ["up", "src", "dst"]).join(hop, ["up", "s", "src", "dst"])
    g = x.groupBy("up", "p", "target").agg(F.array_sort(F.collect_list(F.struct("i", "cells"))).alias("c"))
    cells = F.flatten(F.transform("c", lambda e: F.when(e["i"] == 0, e["cells"]).otherwise(F.slice(e["cells"], 2, F.size(e["cells"])))))
    return g.select("up", "p", "target", cells.alias("cells"))


def trim(z: Column, level: Column, up: Column) -> Column:
    """How far from its end a path of heights z crosses level for the last time; -1 if it doesn't.

    Counted in segments from the end, the part of the crossed segment included.
    """
    sign = F.when(up, 1.0).otherwise(-1.0)
    n = F.size(z)
    at = F.filter(F.sequence(F.lit(1), n - 1), lambda i: ((z[i] - level) * sign >= 0) & ((z[i - 1] - level) * sign < 0))
    i = F.element_at(at, -1)
    part = (z[i] - level) / (z[i] - z[i - 1])
    return F.when((n > 1) & (F.size(at) > 0), (n - 1 - i) + part).otherwise(F.lit(-1.0))


def trimmed(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """Lines (up, p, target, cells) cut where they last cross the height of their first cell.

    The points of the result are array<struct<x: double, y: double>>; its last one lies on the segment that
    crosses. A line that never comes back to that height, or ends off the data, stays whole.
    """
    at = lines.select("up", "p", "target", F.posexplode("cells").alias("pos", "c")).select("up", "p", "target", "pos", "c.x", "c.y")
    z = at.join(cells.select("x", "y", F.col("z").cast("double").alias("z")), ["x", "y"], "left")
    line = z.groupBy("up", "p", "target").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z"))).alias("l"))
    heights = F.transform("l", lambda e: e["z"])
    line = line.withColumn("t", F.when(F.exists("l", lambda e: e["x"].isNull()), F.lit(-1.0)).otherwise(trim(heights, heights[0], F.col("up"))))
    i = F.size("l") - 1 - F.floor("t").cast("int")  # the segment's far end
    part = F.col("t") - F.floor("t")
    a, b = F.get("l", i), F.get("l", i - 1)
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    whole = F.transform("l", lambda e: point(e["x"], e["y"]))
    end = F.array(point(a["x"] + part * (b["x"] - a["x"]), a["y"] + part * (b["y"] - a["y"])))
    return line.select("up", "p", "target", F.when(F.col("t") < 0, whole).otherwise(F.concat(F.slice(whole, F.lit(1), F.greatest(i, F.lit(1))), end)).alias("points"))


def settled(seeds: list[list]) -> list[list]:
    """Where each trace of a domain ends, as the part of it that is left.

    Traces (a saddle, then nodes of the tree towards its root, None last) run over one tree, so from the
    first common node on two are the same. At every node, those farthest from the root first, the traces
    that are still running and come together there close off in pairs, in order of their steps so far
    and then of the seeds; an odd one runs on. One that closes with no other leaves the data.
    """
    ways = [np.array(way[1:-1], np.int64) for way in seeds]
    return [way[:n] for way, n in zip(seeds, _stops(ways), strict=True)]


def _stops(ways: list[np.ndarray]) -> list[int]:
    """settled() for the nodes of each trace: how much of it is left, its saddle and its end included.

    Sorted from their roots on, traces that share a node stand side by side, so those that come together are
    found from the common beginnings of neighbours, the longest first.
    """
    stop = [len(w) + 2 for w in ways]
    if len(ways) < 2:
        return stop
    down = [w[::-1] for w in ways]
    order = sorted(range(len(ways)), key=lambda t: down[t].astype(">u8").tobytes())
    common = []
    for i in range(1, len(order)):
        p, q = down[order[i - 1]], down[order[i]]
        n = min(len(p), len(q))
        differ = np.flatnonzero(p[:n] != q[:n])
        common.append((int(differ[0]) if len(differ) else n, i))
    group, running = list(range(len(order))), [[t] for t in order]

    def home(i):
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    for shared, at in groupby(sorted((c for c in common if c[0]), reverse=True), key=lambda c: c[0]):
        met = set()
        for _, i in at:
            p, q = home(i - 1), home(i)
            group[q] = p
            running[p] += running[q]
            met.add(p)
        for i in {home(i) for i in met}:
            here = sorted((len(ways[t]) - shared + 1, t) for t in running[i])
            for step, t in here[: len(here) // 2 * 2]:
                stop[t] = step + 1
            running[i] = [t for _, t in here[len(here) // 2 * 2 :]]
    return stop


def domains(rel: DataFrame, edges: DataFrame, chains: DataFrame) -> DataFrame:
    """(up, p, lines): the boundary of each notable peak's domain, as lists of node ids.

    From p's key saddle and the saddles where p's neighbourhood ends by drop, both leads in the opposite
    direction follow the opposite tree until they meet each other or leave the data (a last -1). Order of
    seeds: by saddle and trace, so the result doesn't depend on arrival. chains: (up, start, chain) of that tree.
    """
    own = rel.where("notable").select("up", "p", "s")
    subs = rel.select("up", F.explode("subs").alias("x")).where("x.prom").select("up", F.col("x.p").alias("p"), F.col("x.s").alias("s"))
    seeds = own.unionByName(subs.join(own.select("up", "p"), ["up", "p"], "left_semi")).distinct()
    pid = lambda x, y: F.when(F.col(x).isNotNull(), ids.pack(0, x, y))
    anch = edges.select((~F.col("up")).alias("up"), ids.pack(0, "sx", "sy", "seq").alias("s"), F.explode(F.array(F.struct(F.col("tag_a").alias("t"), pid("ax", "ay").alias("q")), F.struct(F.col("tag_b").alias("t"), pid("bx", "by").alias("q")))).alias("h")).select("up", "s", "h.*").where("q is not null")
    x = seeds.join(anch, ["up", "s"]).join(chains.select((~F.col("up")).alias("up"), F.col("start").alias("q"), "chain"), ["up", "q"])

    tasks = x.groupBy("up", "p").agg(F.array_sort(F.collect_list(F.struct("s", "t", "chain"))).alias("seeds"))

    def run(batches):
        for b in batches:
            of = b.column("seeds")
            saddle, chain = of.values.field("s").to_numpy(), of.values.field("chain")
            first, at, nodes = of.offsets.to_numpy(), chain.offsets.to_numpy(), chain.values.to_numpy()
            lines, size = [], []
            for i in range(len(of)):
                ways = [nodes[at[k] : at[k + 1]] for k in range(first[i], first[i + 1])]
                for k, way, n in zip(range(first[i], first[i + 1]), ways, _stops(ways), strict=True):
                    lines += [saddle[k : k + 1], way[: n - 1], OFF[: n - 1 - len(way)]]
                    size.append(min(n, len(way) + 2))
            values = np.concatenate(lines) if lines else np.empty(0, np.int64)
            inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]), pa.int32()), pa.array(values, pa.int64()))
            out = pa.ListArray.from_arrays(pa.array(first - first[0], pa.int32()), inner)
            yield pa.RecordBatch.from_arrays([b.column("up"), b.column("p"), out], names=["up", "p", "lines"])

    return tasks.mapInArrow(run, "up boolean, p long, lines array<array<long>>")
