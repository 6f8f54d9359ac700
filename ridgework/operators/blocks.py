"""Forests of packed ids, followed block by block: pointers of places mostly stay near, so what lies inside a block of
places is followed in memory, and only the nodes where ways enter a block go through rounds of joins.

A forest is (up, node, next) as in forest.py, with ids as nodes. The result does not depend on where blocks end.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgework.functions import ids
from ridgework.functions.store import materialize, materialize_counting
from ridgework.operators import forest

#: Bits of a block's side in cells; what one task holds at once follows from it.
SIDE = 8


def block(node: str) -> Column:
    """The block that a node lies in."""
    p = ids.unpack(node)
    return F.struct(F.shiftright(p["x"], SIDE).alias("x"), F.shiftright(p["y"], SIDE).alias("y"))


def _pointers(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted, order, to): the nodes in order, their rows, and the row of each row's next node, its own if that is elsewhere."""
    node, has = t["node"].to_numpy(), t["next"].is_valid().to_numpy()
    nxt = t["next"].fill_null(0).to_numpy()
    order = np.argsort(node, kind="stable")
    found = node[order]
    at = np.searchsorted(found, nxt).clip(max=len(found) - 1)
    return found, order, np.where(has & (found[at] == nxt), order[at], np.arange(len(node)))


def _ends(to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, depth) of each row of _pointers()."""
    root, depth = to, (to != np.arange(len(to))).astype(np.int64)
    while (root[root] != root).any():
        root, depth = root[root], depth + depth[root]
    return root, depth


def _inside(t: pa.Table) -> pa.Table:
    to = _pointers(t)[2]
    root, depth = _ends(to)
    return pa.table({"up": t["up"], "node": t["node"], "root": t["node"].take(pa.array(root)), "depth": pa.array(depth), "out": t["next"].take(pa.array(root))})


def _walk(starts: pa.Table, t: pa.Table) -> pa.Table:
    """The n nodes from each start on, all inside the block."""
    node, n = starts["node"].to_numpy(), starts["n"].to_numpy()
    off = np.concatenate([[0], np.cumsum(n)])
    values = np.empty(off[-1], np.int64)
    if len(node):
        found, order, to = _pointers(t)
        every, live = t["node"].to_numpy(), np.arange(len(node))
        cur, step = order[np.searchsorted(found, node)], 0
        while len(live):
            values[off[live] + step] = every[cur]
            step += 1
            on = n[live] > step
            live, cur = live[on], to[cur[on]]
    return pa.table({"up": starts["up"], "node": starts["node"], "way": pa.LargeListArray.from_arrays(pa.array(off, pa.int64()), pa.array(values)).cast(pa.list_(pa.int64()))})


def _meet(pairs: pa.Table, t: pa.Table) -> pa.Table:
    """The first common node of the ways from u and from v, which have one end in the block."""
    meet = np.empty(len(pairs), np.int64)
    if len(pairs):
        found, order, to = _pointers(t)
        depth = _ends(to)[1]
        u, v = (order[np.searchsorted(found, pairs[c].to_numpy())] for c in ("u", "v"))
        far = [to]
        while (far[-1][far[-1]] != far[-1]).any():
            far.append(far[-1][far[-1]])
        for k in reversed(range(len(far))):
            mu, mv = depth[u] - depth[v] >= 1 << k, depth[v] - depth[u] >= 1 << k
            u, v = np.where(mu, far[k][u], u), np.where(mv, far[k][v], v)
        for jump in reversed(far):
            m = jump[u] != jump[v]
            u, v = np.where(m, jump[u], u), np.where(m, jump[v], v)
        meet = t["node"].to_numpy()[np.where(u == v, u, to[u])]
    return pairs.select(["up", "a", "b"]).append_column("meet", pa.array(meet, pa.int64()))


class Ways:
    """The ways of a forest, with what is found once for all questions about them."""

    def __init__(self, ptr: DataFrame):
        self.ptr = ptr.select("up", F.col("node").cast("long").alias("node"), F.col("next").cast("long").alias("next"), block("node").alias("block"))

    @cached_property
    def inner(self) -> DataFrame:
        """(up, node, root, depth, out): the last node of each node's way inside its block, the steps to it, and what follows it."""
        return materialize(self.ptr.groupBy("up", "block").applyInArrow(_inside, "up boolean, node long, root long, depth long, out long"), "blocks-inner")

    @cached_property
    def gates(self) -> DataFrame:
        """(up, node, next, w, root): the nodes where ways enter a block, the next such node, w steps on, and the last node before that."""
        enter = self.inner.where("out is not null").select("up", F.col("out").alias("node")).distinct()
        return materialize(self.inner.join(enter, ["up", "node"]).select("up", "node", F.col("out").alias("next"), (F.col("depth") + 1).alias("w"), "root"), "blocks-gates")

    @cached_property
    def rank(self) -> DataFrame:
        """(up, node, root, depth), as forest.ranked()."""
        last = forest.ranked(self.gates)
        ends = self.gates.where("next is null").select("up", F.col("node").alias("root"), F.col("root").alias("r2"), (F.col("w") - 1).alias("d2"))
        gate = last.join(ends, ["up", "root"]).select("up", F.col("node").alias("out"), F.col("r2").alias("r"), (F.col("depth") + F.col("d2") + 1).alias("d"))
        x = self.inner.join(gate, ["up", "out"], "left")
        return materialize(x.select("up", "node", F.coalesce("r", "root").alias("root"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth")), "blocks-rank")

    @cached_property
    def far(self) -> list[DataFrame]:
        """Tables (up, node, next, w) of the gates 1, 2, 4, ... gates on, w steps on."""
        far, table = [], self.gates.where("next is not null").select("up", "node", "next", "w")
        while True:
            table, n = materialize_counting(table, "blocks-jump", F.col("node").isNotNull())
            if not n:
                return far
            far.append(table)
            table = table.join(table.select("up", F.col("node").alias("next"), F.col("next").alias("n2"), F.col("w").alias("w2")), ["up", "next"]).select("up", "node", F.col("n2").alias("next"), (F.col("w") + F.col("w2")).alias("w"))

    def expanded(self, legs: DataFrame, by: list[str]) -> DataFrame:
        """(*by, up, pos, nodes) of legs (*by, up, node, n): the n nodes of each leg from its node on, in lists that begin at pos; ways are long enough."""
        part = lambda pos, node, n: F.struct(pos.alias("pos"), node.alias("node"), n.alias("n"))

        def split(rows, jumps):
            """Each row as its part before `next` and the rest."""
            got = rows.join(jumps, ["up", "node"], "left")
            two = F.array(part(F.col("pos"), F.col("node"), F.least("n", "w")), F.when(F.col("n") > F.col("w"), part(F.col("pos") + F.col("w"), F.col("next"), F.col("n") - F.col("w"))))
            return got.select(*by, "up", F.explode(two).alias("leg")).where("leg is not null").select(*by, "up", "leg.*")

        rows = legs.select(*by, "up", F.lit(0).cast("long").alias("pos"), "node", F.col("n").cast("long").alias("n"))
        rows = materialize(split(rows, self.inner.select("up", "node", F.col("out").alias("next"), (F.col("depth") + 1).alias("w"))), "blocks-legs")
        if self.far:
            first, rows = rows.where("pos = 0"), rows.where("pos > 0")
            for jumps in reversed(self.far):
                rows = materialize(split(rows, jumps), "blocks-legs")
            rows = first.union(rows)
        need = rows.groupBy("up", "node").agg(F.max("n").alias("n")).withColumn("block", block("node"))
        ways = need.groupBy("up", "block").cogroup(self.ptr.groupBy("up", "block")).applyInArrow(_walk, "up boolean, node long, way array<long>")
        return rows.join(ways, ["up", "node"]).select(*by, "up", "pos", F.slice("way", F.lit(1), F.col("n").cast("int")).alias("nodes"))

    def lists(self, legs: DataFrame, by: list[str], name: str) -> DataFrame:
        """(*by, up, name): the nodes of each leg of expanded() as one list."""
        parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "nodes"))), lambda e: e["nodes"])
        return self.expanded(legs, by).groupBy(*by, "up").agg(F.flatten(parts).alias(name))

    def meets(self, pairs: DataFrame) -> DataFrame:
        """(up, a, b, meet, i, j), as forest.meets(), of the pairs that meet.

        Ways that leave their blocks are compared as lists of gates; the place where two of them meet lies in
        the block before the first common gate, or is that gate.
        """
        of = lambda c, o, r: self.inner.select("up", F.col("node").alias(c), F.col("out").alias(o), F.col("root").alias(r))
        both = materialize(pairs.select("up", "a", "b").distinct().join(of("a", "oa", "ra"), ["up", "a"]).join(of("b", "ob", "rb"), ["up", "b"]), "blocks-pairs")
        near = both.where("ra = rb").select("up", "a", "b", F.col("a").alias("u"), F.col("b").alias("v"))
        apart = both.where("ra <> rb and (oa is not null or ob is not null)")
        # gates and the ends of such pairs; a way that ends in a block goes on to a mark of its root, no id of a place
        ends = apart.select("up", F.col("a").alias("node"), F.col("oa").alias("next"), F.col("ra").alias("root")).union(apart.select("up", "b", "ob", "rb"))
        nodes = ends.union(self.gates.select("up", "node", "next", "root")).distinct()
        mark = lambda r, side: F.struct(F.lit(side).alias("mark"), F.col(r).alias("id"))
        hops = nodes.select("up", mark("node", 0).alias("node"), F.when(F.col("next").isNotNull(), mark("next", 0)).otherwise(mark("root", 1)).alias("next"))
        tops = nodes.where("next is null").select("up", mark("root", 1).alias("node"), F.lit(None).cast(hops.schema["next"].dataType).alias("next")).distinct()
        hops = materialize(hops.union(tops), "blocks-hops")
        m = forest.meets(forest.jumps(hops), forest.ranked(hops), apart.select("up", mark("a", 0).alias("a"), mark("b", 0).alias("b")), before=True)
        m = m.where("meet is not null").select("up", F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("meet.id").alias("meet"), F.col("u.id").alias("u"), F.col("v.id").alias("v"))
        m = m.join(of("u", "ou", "ru"), ["up", "u"], "left").join(of("v", "ov", "rv"), ["up", "v"], "left")
        m = materialize(m.select("up", "a", "b", "u", "v", "meet", F.coalesce(F.col("ru") == F.col("rv"), F.lit(False)).alias("inside")), "blocks-meets")
        near = near.union(m.where("inside").select("up", "a", "b", "u", "v")).withColumn("block", block("u"))
        found = near.groupBy("up", "block").cogroup(self.ptr.groupBy("up", "block")).applyInArrow(_meet, "up boolean, a long, b long, meet long")
        found = found.union(m.where("not inside").select("up", "a", "b", "meet"))
        at = lambda c: self.rank.select("up", F.col("node").alias(c), F.col("depth").alias(f"d_{c}"))
        x = found.join(at("a"), ["up", "a"]).join(at("b"), ["up", "b"]).join(at("meet"), ["up", "meet"])
        return x.select("up", "a", "b", "meet", (F.col("d_a") - F.col("d_meet")).alias("i"), (F.col("d_b") - F.col("d_meet")).alias("j"))
