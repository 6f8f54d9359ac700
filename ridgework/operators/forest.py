"""Forests of pointers, followed by doubling: as many joins as the longest way has bits.

A forest is (up, node, next), next null at a root. Nodes may be of any type that can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgework.functions.store import materialize, materialize_counting


def ranked(ptr: DataFrame) -> DataFrame:
    """(up, node, root, depth): where each node's way ends, and after how many steps; a pointer with w counts as w steps."""
    one = F.col("w") if "w" in ptr.columns else F.lit(1)
    state = materialize(ptr.select("up", "node", F.coalesce("next", "node").alias("root"), F.when(F.col("next").isNull(), 0).otherwise(one).cast("long").alias("depth")), "forest-rank")
    while True:  # every round makes ways four times as long, so the rounds end by themselves
        step = state
        for i in range(3):
            on = state.select("up", F.col("node").alias("root"), F.col("root").alias("r2"), F.col("depth").alias("d2"))
            step = step.join(on, ["up", "root"], "left").select("up", "node", F.coalesce("r2", "root").alias("root"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.coalesce("d2", F.lit(0)).alias("d2"))
            step = step if i == 2 else step.drop("d2")
        state, moved = materialize_counting(step, "forest-rank", F.col("d2") > 0)
        state = state.drop("d2")
        if not moved:
            return state


#: Nodes of a way that are kept as a list beside each node, a power of two.
NEAR = 16


def jumps(ptr: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(near, far): near (up, node, way, next) with the first NEAR nodes of each node's way and what follows
    them; far: tables (up, node, next) of the ancestors NEAR, 2 NEAR, ... steps on, of the nodes that have them."""
    near = materialize(ptr.select("up", "node", F.array("node").alias("way"), "next"), "forest-near")
    for _ in range(NEAR.bit_length() - 1):
        on = near.select("up", F.col("node").alias("next"), F.col("way").alias("w2"), F.col("next").alias("n2"))
        near = materialize(near.join(on, ["up", "next"], "left").select("up", "node", F.when(F.col("w2").isNull(), F.col("way")).otherwise(F.concat("way", "w2")).alias("way"), F.col("n2").alias("next")), "forest-near")
    far, n = [], 1
    table = near.where("next is not null").select("up", "node", "next")
    while True:
        table, n = materialize_counting(table, "forest-jump", F.col("node").isNotNull())
        if not n:
            return near, far
        far.append(table)
        table = table.join(table.select("up", F.col("node").alias("next"), F.col("next").alias("n2")), ["up", "next"]).select("up", "node", F.col("n2").alias("next"))


def expanded(table: tuple[DataFrame, list[DataFrame]], legs: DataFrame, ids: list[str]) -> DataFrame:
    """(*ids, up, pos, node) of legs (*ids, up, node, n): the n nodes of each leg from its node on; ways are long enough.

    A leg is halved until its parts are lists beside a node, so no round has more rows than the result.
    """
    near, far = table
    rows = legs.select(*ids, "up", F.lit(0).cast("long").alias("pos"), "node", F.col("n").cast("long").alias("n"))
    part = lambda pos, node, n: F.struct(pos.alias("pos"), node.alias("node"), n.alias("n"))
    for k in reversed(range(len(far))):
        got = rows.join(far[k], ["up", "node"], "left")
        half = F.lit(NEAR << k).cast("long")
        two = F.array(part(F.col("pos"), F.col("node"), F.least("n", half)), F.when(F.col("n") > half, part(F.col("pos") + half, F.col("next"), F.col("n") - half)))
        rows = materialize(got.select(*ids, "up", F.explode(two).alias("leg")).where("leg is not null").select(*ids, "up", "leg.*"), "forest-legs")
    got = rows.join(near.select("up", "node", "way"), ["up", "node"])
    got = got.select(*ids, "up", F.col("pos").alias("from"), F.posexplode(F.slice("way", F.lit(1), F.col("n").cast("int"))).alias("at", "node"))
    return got.select(*ids, "up", (F.col("from") + F.col("at")).alias("pos"), "node")


def meets(table: tuple[DataFrame, list[DataFrame]], rank: DataFrame, pairs: DataFrame, before: bool = False) -> DataFrame:
    """(up, a, b, meet, i, j): the first common node of the ways from a and from b, i and j steps on; null if there is none.

    With `before` also (u, v), the nodes before it on the two ways, null if it is a or b itself.

    The longer way is shortened to the other's length by jumps; then both jump as long as they differ,
    and the lists beside the last two nodes hold the place where they meet.
    """
    near, far = table
    of = lambda c, d: rank.select("up", F.col("node").alias(c), F.col("depth").alias(d))
    both = pairs.select("up", "a", "b").distinct().join(of("a", "da"), ["up", "a"]).join(of("b", "db"), ["up", "b"])
    x = both.select("*", F.col("a").alias("u"), F.col("b").alias("v"), F.col("da").alias("du"), F.col("db").alias("dv"))
    to = lambda t, c, n: t.select("up", F.col("node").alias(c), F.col("next").alias(n))
    way = lambda c: near.select("up", F.col("node").alias(c), F.col("way").alias(f"w{c}"))
    ride = lambda c, m, n, d, by: {c: F.when(m, F.col(n)).otherwise(F.col(c)), d: F.when(m, F.col(d) - by).otherwise(F.col(d))}
    for k in reversed(range(len(far))):
        y = x.join(to(far[k], "u", "nu"), ["up", "u"], "left").join(to(far[k], "v", "nv"), ["up", "v"], "left")
        mu, mv = F.col("du") - F.col("dv") >= NEAR << k, F.col("dv") - F.col("du") >= NEAR << k
        x = materialize(y.withColumns(ride("u", mu, "nu", "du", NEAR << k) | ride("v", mv, "nv", "dv", NEAR << k)).drop("nu", "nv"), "forest-meet")
    y = x.join(way("u"), ["up", "u"]).join(way("v"), ["up", "v"])  # less than NEAR steps between their lengths now
    up_u, up_v = (F.greatest(F.col(p) - F.col(q), F.lit(0)).cast("int") for p, q in (("du", "dv"), ("dv", "du")))
    x = y.select("up", "a", "b", "da", "db", F.get("wu", up_u).alias("u"), F.get("wv", up_v).alias("v"), F.least("du", "dv").alias("d"))
    for k in reversed(range(len(far))):
        y = x.join(to(far[k], "u", "nu"), ["up", "u"], "left").join(to(far[k], "v", "nv"), ["up", "v"], "left")
        m = F.coalesce(F.col("nu") != F.col("nv"), F.lit(False))
        x = materialize(y.withColumns({"u": F.when(m, F.col("nu")).otherwise(F.col("u")), "v": F.when(m, F.col("nv")).otherwise(F.col("v")), "d": F.when(m, F.col("d") - (NEAR << k)).otherwise(F.col("d"))}).drop("nu", "nv"), "forest-meet")
    # they meet within the lists, or one node beyond these
    y = x.join(near.select("up", F.col("node").alias("u"), F.concat("way", F.when(F.col("next").isNotNull(), F.array("next")).otherwise(F.slice("way", 1, 0))).alias("wu")), ["up", "u"])
    y = y.join(near.select("up", F.col("node").alias("v"), F.concat("way", F.when(F.col("next").isNotNull(), F.array("next")).otherwise(F.slice("way", 1, 0))).alias("wv")), ["up", "v"])
    same = F.array_position(F.zip_with("wu", "wv", lambda p, q: p == q), True) - 1
    y = y.withColumn("k", F.when(same >= 0, same))
    steps = lambda d0: F.when(F.col("k").isNotNull(), F.col(d0) - F.col("d") + F.col("k"))
    last = [F.when(F.col("k") > 0, F.get(w, F.col("k").cast("int") - 1)).alias(c) for c, w in (("u", "wu"), ("v", "wv"))] if before else []
    return y.select("up", "a", "b", F.get("wu", F.col("k").cast("int")).alias("meet"), steps("da").alias("i"), steps("db").alias("j"), *last)


#: The top bit of an id.
TOP = -(1 << 63)


def rooted(edges: DataFrame, roots: DataFrame, rank=ranked) -> DataFrame:
    """(up, node, next, s): the trees of edges (up, s, m, n), s the edge's own id from 0 up, as arrows towards their roots (up, node).

    Each edge is two arcs; the tour of all arcs of a tree is a list, whose ranks say which of the two comes
    first: that one leaves the parent. Every tree has one root; no arrow begins at a root. An arc is the
    edge's id, with the top bit set for the one from the greater end.
    """
    arcs = edges.select("up", "s", "m", "n").union(edges.select("up", "s", F.col("n"), F.col("m")))
    arcs = materialize(arcs.join(roots.select("up", F.col("node").alias("m"), F.lit(True).alias("root")), ["up", "m"], "left"), "tour-arcs")
    arc = lambda start, end: F.when(F.col(start) > F.col(end), F.col("s").bitwiseXOR(F.lit(TOP))).otherwise(F.col("s"))
    w = Window.partitionBy("up", "m").orderBy("s")
    after = F.coalesce(F.lead("own").over(w), F.when(F.col("root").isNull(), F.first("own").over(w)))  # a tour ends in its root
    ptr = arcs.withColumn("own", arc("m", "n")).withColumn("next", after).select("up", arc("n", "m").alias("node"), "next")
    left = rank(ptr).select("up", F.col("node").bitwiseAND(F.lit(~TOP)).alias("s"), (F.col("node") < 0).alias("top"), "depth")  # arcs until the end
    ends = left.groupBy("up", "s").agg(F.max(F.when(~F.col("top"), F.col("depth"))).alias("low"), F.max(F.when(F.col("top"), F.col("depth"))).alias("high"))
    first = F.col("low") < F.col("high")
    x = edges.select("up", "s", F.least("m", "n").alias("l"), F.greatest("m", "n").alias("h")).join(ends, ["up", "s"])
    return x.select("up", F.when(first, F.col("l")).otherwise(F.col("h")).alias("node"), F.when(first, F.col("h")).otherwise(F.col("l")).alias("next"), "s")
