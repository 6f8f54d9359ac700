"""Key saddles, drops, parents, secondary saddles and the tree of a network.

Everything is said for the up direction; down is the same on negated keys. The drop of a peak is its
height over its key saddle; a peak is notable if its drop reaches the cutoff.

Networks are contracted by rounds of joins: every component merges over its highest saddle into the higher
component behind it, all at once, and only ids move. Each round merges something, so the rounds end; the
last LAST connections are merged in one task a direction, whatever the network's size was.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgework.functions import ids
from ridgework.functions.store import materialize, materialize_counting
from ridgework.operators import blocks, forest

#: Connections between components, of both directions, that are left to one task each at the end.
LAST = 20_000
KEY = "struct<z:double,iso:int,x:int,seq:int>"


def _key(z, x, y, seq, up) -> Column:
    sign = F.when(up, 1).otherwise(-1)
    return F.struct((z * sign).alias("z"), ((x - y) * sign).cast("int").alias("iso"), (x * sign).cast("int").alias("x"), (seq * sign).cast("int").alias("seq"))


def graph(e: DataFrame) -> DataFrame:
    """Edges by packed id, with sort keys that grow towards the direction's peaks; rings are left out (A4)."""
    c = F.col
    pid = lambda x, y: F.when(c(x).isNotNull(), ids.pack(0, x, y))
    g = e.select("up", pid("ax", "ay").alias("a"), pid("bx", "by").alias("b"), ids.pack(0, "sx", "sy", "seq").alias("s"), _key(c("az"), c("ax"), c("ay"), F.lit(0), c("up")).alias("ka"), _key(c("bz"), c("bx"), c("by"), F.lit(0), c("up")).alias("kb"), _key(c("sz"), c("sx"), c("sy"), c("seq"), c("up")).alias("ks"), "tag_a", "tag_b")
    return g.where("a is null or b is null or a <> b")


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """What facts() says of the last components: saddles from the highest down, the lower of two peaks ends there.

    A component that reaches the edge of the data, or a higher one that did, has no key saddle in the data.
    """
    key = lambda v: tuple(v[x] for x in ("z", "iso", "x", "seq"))
    number = lambda v: None if v is None or v != v else int(v)
    peak, into, rows, open_end = {}, {}, [], {}

    def home(c):
        while c in into:
            c = into[c]
        return c

    edges = []
    for r in pdf.to_dict("records"):
        sides = [(number(r[c]), number(r[at]), r[p]) for c, at, p in (("ca", "a", "pa"), ("cb", "b", "pb"))]
        peak.update({c: key(p) for c, _, p in sides if c is not None})
        edges.append((key(r["ks"]), int(r["s"]), sides))
    for _, s, sides in sorted(edges, key=lambda e: e[:2], reverse=True):
        ends = sorted(((peak[home(c)], home(c), at) for c, at, _ in sides if c is not None), key=lambda e: e[0])
        low = ends[0]
        if len(ends) == 1:
            open_end.setdefault(low[1], (s, low[2], None))
        elif low[1] == ends[1][1]:
            continue
        elif low[1] not in open_end:
            into[low[1]] = ends[1][1]
            rows.append((low[1], s, low[2], ends[1][2], False))
        else:
            open_end.setdefault(ends[1][1], (s, ends[1][2], low[2]))
    rows += [(c, *v, True) for c, v in open_end.items()]
    out = pd.DataFrame({n: pd.array(v, "Int64") for n, v in zip(("p", "s", "q_own", "q_far"), list(zip(*rows, strict=True))[:4] if rows else [[]] * 4, strict=True)})
    return out.assign(up=bool(pdf["up"].iloc[0]), min_bound=[r[4] for r in rows])[["up", "p", "s", "q_own", "q_far", "min_bound"]]


def _contracted(t: pa.Table) -> pa.Table:
    """What a block merges by itself: (up, c, root, top, s, own, far), by the rounds of facts(), until nothing more merges.

    Rows are ends (c, p, own) of connections that lead to o, far (null: off the data); the peak of o is
    known if o lies in the block too. A component whose highest connection leads elsewhere waits.
    """
    col = lambda c: t[c].fill_null(0).to_numpy()
    comp, first, c = np.unique(col("c"), return_index=True, return_inverse=True)
    found = np.searchsorted(comp, col("o")).clip(max=len(comp) - 1)
    o = np.where(t["o"].is_valid().to_numpy() & (comp[found] == col("o")), found, -1)
    places = lambda name: [t[name].combine_chunks().field(f).to_numpy() for f in ("seq", "x", "iso", "z")]
    row = np.lexsort([col("s"), *places("ks")])  # from the lowest connection up
    peak = np.empty(len(comp), np.int64)
    peak[np.lexsort([p[first] for p in places("p")])] = np.arange(len(comp))
    home, via, c, o = np.arange(len(comp)), np.full(len(comp), -1), c[row], o[row]
    while True:
        mine, theirs = home[c], np.where(o >= 0, home[o], -1)
        best = np.full(len(comp), -1)
        live = np.flatnonzero(mine != theirs)
        best[mine[live]] = live  # the last one is the highest
        low = np.flatnonzero(best >= 0)
        to = theirs[best[low]]
        go = (to >= 0) & (peak[to] > peak[low])
        low, to = low[go], to[go]
        if not len(low):
            break
        via[low] = row[best[low]]
        home[low] = to
        while (home[home] != home).any():
            home = home[home]
    gone = np.flatnonzero(via >= 0)
    at = lambda name: t[name].take(pa.array(via[gone]))
    top = t["p"].take(pa.array(first[home[gone]]))
    return pa.table({"up": pa.array(np.full(len(gone), t["up"][0].as_py())), "c": pa.array(comp[gone]), "root": pa.array(comp[home[gone]]), "top": top, "s": at("s"), "own": at("own"), "far": at("far")})


def facts(g: DataFrame, last: int = LAST) -> DataFrame:
    """(up, p, s, q_own, q_far, min_bound), the key saddle s of every peak p.

    q_own and q_far are the peaks next to s on p's side and beyond. min_bound marks peaks whose key
    saddle is unknown because the data end; s is then the highest saddle that may lead off. The highest
    peak of all has no row. Peaks of any cutoff are included.
    """
    found = []
    conn = g.select("up", "a", "b", "s", "ks", F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("ka").alias("pa"), F.col("kb").alias("pb"))
    conn = _best(conn)
    half = lambda c, p, own, o, po, far: F.struct(F.col(c).alias("c"), F.col(p).alias("p"), F.col(own).alias("own"), F.col(o).alias("o"), F.col(po).alias("po"), F.col(far).alias("far"))
    halves = lambda conn: conn.select("up", "s", "ks", F.explode(F.array(half("ca", "pa", "a", "cb", "pb", "b"), half("cb", "pb", "b", "ca", "pa", "a"))).alias("h")).select("up", "s", "ks", "h.*").where("c is not null")

    def moved(conn, to):
        """Connections between what components (up, c) have become."""
        for side, key in (("ca", "pa"), ("cb", "pb")):
            conn = conn.join(to.select("up", F.col("c").alias(side), F.col("root").alias("_t"), F.col("top").alias("_k")), ["up", side], "left").withColumns({side: F.coalesce("_t", side), key: F.coalesce("_k", key)}).drop("_t", "_k")
        return _best(conn.select("up", "a", "b", "s", "ks", "ca", "cb", "pa", "pb").where("ca is null or cb is null or ca <> cb"))

    # what lies inside blocks is merged there first; the rounds get what is left between them
    conn = materialize(conn, "contract")
    ends = halves(conn).drop("po").withColumn("block", blocks.block("c"))
    here = materialize(ends.groupBy("up", "block").applyInArrow(_contracted, f"up boolean, c long, root long, top {KEY}, s long, own long, far long"), "contract-blocks")
    found.append(here.select("up", F.col("c").alias("p"), "s", F.col("own").alias("q_own"), F.col("far").alias("q_far"), F.lit(False).alias("min_bound")))
    conn = moved(conn, here)
    while True:
        conn, left = materialize_counting(conn, "contract", F.col("s").isNotNull())
        if left <= last and found:
            found.append(conn.groupBy("up").applyInPandas(_merged, "up boolean, p long, s long, q_own long, q_far long, min_bound boolean"))
            return reduce(DataFrame.union, found)
        ends = halves(conn)
        first = ends.groupBy("up", "c").agg(F.max_by(F.struct("s", "p", "own", "o", "po", "far"), F.struct("ks", "s")).alias("f")).select("up", "c", "f.*")
        first, some = materialize_counting(first.withColumn("merges", F.coalesce(F.col("po") > F.col("p"), F.lit(False))), "contract-first", F.col("merges"))
        merge = first.where("merges")
        if not some:
            found.append(first.select("up", F.col("c").alias("p"), "s", F.col("own").alias("q_own"), F.col("far").alias("q_far"), F.lit(True).alias("min_bound")))
            return reduce(DataFrame.union, found)
        found.append(merge.select("up", F.col("c").alias("p"), "s", F.col("own").alias("q_own"), F.col("far").alias("q_far"), F.lit(False).alias("min_bound")))
        # where each merged component ends up, and the peak there
        steps = merge.select("up", F.col("c").alias("node"), F.col("o").alias("next"))
        ends_at = steps.select("up", F.col("next").alias("node")).join(steps.select("up", "node"), ["up", "node"], "left_anti").distinct()
        to = forest.ranked(steps.union(ends_at.select("up", "node", F.lit(None).cast("long"))))
        tops = merge.groupBy("up", F.col("o").alias("root")).agg(F.first("po").alias("top"))
        to = materialize(to.where("depth > 0").join(tops, ["up", "root"]).select("up", F.col("node").alias("c"), "root", "top"), "contract-arrows")
        conn = moved(conn, to)


def _best(conn: DataFrame) -> DataFrame:
    """Of all saddles between two components the highest, and of each component's saddles off the data."""
    low, high = F.least("ca", "cb"), F.when(F.col("ca").isNotNull() & F.col("cb").isNotNull(), F.greatest("ca", "cb"))
    g = conn.groupBy("up", low.alias("_l"), high.alias("_h")).agg(F.max_by(F.struct("a", "b", "s", "ks", "ca", "cb", "pa", "pb"), F.struct("ks", "s")).alias("e"))
    return g.select("up", "e.*")


def points(g: DataFrame) -> DataFrame:
    """(up, id, key) of the network's peaks and saddles."""
    rows = g.select("up", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("ka").alias("key")), F.struct(F.col("b").alias("id"), F.col("kb").alias("key")), F.struct(F.col("s").alias("id"), F.col("ks").alias("key")))).alias("r"))
    return rows.select("up", "r.id", "r.key").where("id is not null").groupBy("up", "id").agg(F.first("key").alias("key"))


def pair_key(kp: Column, ks: Column) -> Column:
    """F8: the order of peaks with key saddles; null saddle: the greatest."""
    d = lambda f: (kp[f] - ks[f])
    drop = F.coalesce(F.abs(kp["z"] - ks["z"]), F.lit(float("inf")))
    return F.struct(drop.alias("drop"), d("iso").alias("iso"), d("x").alias("dx"), d("seq").alias("dseq"), kp["x"].alias("px"), ks["x"].alias("sx"), ks["seq"].alias("sseq"), kp["iso"].alias("piso"))


def with_keys(f: DataFrame, pts: DataFrame) -> DataFrame:
    """Facts with kp, ks and drop."""
    out = f.join(pts.select("up", F.col("id").alias("p"), F.col("key").alias("kp")), ["up", "p"]).join(pts.select("up", F.col("id").alias("s"), F.col("key").alias("ks")), ["up", "s"])
    return out.withColumn("drop", F.abs(F.col("kp.z") - F.col("ks.z")))


def tops(g: DataFrame, f: DataFrame, pts: DataFrame) -> DataFrame:
    """Peaks without a fact, in the columns of with_keys()."""
    peaks = g.select("up", F.explode(F.array("a", "b")).alias("p")).where("p is not null").distinct()
    t = peaks.join(f.select("up", "p"), ["up", "p"], "left_anti").join(pts.select("up", F.col("id").alias("p"), F.col("key").alias("kp")), ["up", "p"])
    none = F.lit(None)
    return t.select("up", "p", none.cast("long").alias("s"), none.cast("long").alias("q_own"), none.cast("long").alias("q_far"), none.cast("boolean").alias("min_bound"), "kp", none.cast(KEY).alias("ks"))


def relations(g: DataFrame, cutoff: float, f: DataFrame | None = None, pts: DataFrame | None = None) -> DataFrame:
    """(up, p, s, drop, thresh, pthresh, parent, min_bound, notable, subs) of every peak with a key saddle.

    thresh: the first higher peak beyond the key saddle; pthresh: the first notable one from thresh on;
    parent: the first peak of a greater drop. Each follows the next-higher pointers from the saddle.
    subs: the saddles where this peak's neighbourhood ends for lower notable peaks.
    """
    pts = materialize(points(g), "points") if pts is None else pts
    f = materialize(facts(g), "facts") if f is None else f
    keyed = materialize(with_keys(f, pts), "facts-keyed")
    cols = ["up", "p", "s", "q_own", "q_far", "min_bound", "kp", "ks"]
    all_ = keyed.select(*cols).unionByName(tops(g, f, pts))
    return _chains(all_, cutoff).join(keyed.select("up", "p", "drop"), ["up", "p"])


def _chains(all_: DataFrame, cutoff: float) -> DataFrame:
    """What relations() says of peaks with keys, by rounds of joins: every open walk goes one pointer further in each, until none is open."""
    k = all_.withColumn("pair", pair_key(F.col("kp"), F.col("ks"))).withColumn("notable", F.when(F.col("s").isNull(), True).otherwise(F.abs(F.col("kp.z") - F.col("ks.z")) >= cutoff))
    k = materialize(k, "chain-peaks")
    at = k.select("up", F.col("p").alias("c"), F.col("kp").alias("kc"), F.col("pair").alias("pc"), F.col("notable").alias("nc"))
    # next-higher pointers: a walk over lower peaks takes over their cursors, whether they have arrived or not
    state = k.select("up", "p", "kp", F.when(~F.col("min_bound"), F.col("q_far")).alias("c"))
    state = materialize(state.join(at.select("up", "c", "kc"), ["up", "c"], "left"), "chain-next")
    low, more = F.col("kc") < F.col("kp"), 1
    while more:
        on = state.select("up", F.col("p").alias("c"), F.col("c").alias("c2"), F.col("kc").alias("k2"))
        step = state
        for _ in range(3):
            step = step.join(on, ["up", "c"], "left").select("up", "p", "kp", F.when(low, F.col("c2")).otherwise(F.col("c")).alias("c"), F.when(low, F.col("k2")).otherwise(F.col("kc")).alias("kc"))
        state, more = materialize_counting(step, "chain-next", low)
    nxt = state.select("up", "p", F.col("c").alias("thresh"))
    base = k.where("s is not null").join(nxt, ["up", "p"])
    live = F.col("notable") & ~F.col("min_bound")
    starts = [("own", F.col("q_own")), ("far", F.col("q_far")), ("parent", F.when(live, F.col("q_far"))), ("pthresh", F.when(live, F.col("thresh")))]
    walks = base.select("up", "p", "s", "kp", "pair", "min_bound", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), c.alias("c")) for kind, c in starts])).alias("w"))
    open_ = walks.select("up", "p", "s", "kp", "pair", "min_bound", "w.kind", "w.c", F.lit(None).cast(k.schema["pair"].dataType).alias("best")).where("c is not null")
    steps = []
    known = materialize(at.join(nxt.select("up", F.col("p").alias("c"), F.col("thresh").alias("nxt")), ["up", "c"]), "chain-known")
    while True:
        x = open_.join(known, ["up", "c"])
        side = F.col("kind").isin("own", "far")
        stop = F.when(side, F.col("kc") >= F.col("kp")).when(F.col("kind") == "parent", F.col("pc") > F.col("pair")).otherwise(F.col("nc"))
        counts = (F.col("kind") == "parent") | (F.col("kind") == "own") | ((F.col("kind") == "far") & F.col("min_bound"))
        fresh = F.col("nc") & ~F.col("stop") & (F.col("best").isNull() | (F.col("pc") > F.col("best")))
        x = x.withColumn("stop", stop).withColumn("prom", counts & fresh).withColumn("elev", side & F.col("nc") & ~F.col("stop"))
        x, more = materialize_counting(x, "chain-walk", ~F.col("stop") & F.col("nxt").isNotNull())
        steps.append(x)
        open_ = x.where("not stop and nxt is not null").select("up", "p", "s", "kp", "pair", "min_bound", "kind", F.col("nxt").alias("c"), F.when(F.col("prom"), F.col("pc")).otherwise(F.col("best")).alias("best"))
        if not more:
            break
    every = reduce(DataFrame.union, steps)
    e = every.where("stop and kind in ('parent', 'pthresh')").groupBy("up", "p").agg(F.max(F.when(F.col("kind") == "parent", F.col("c"))).alias("parent"), F.max(F.when(F.col("kind") == "pthresh", F.col("c"))).alias("pthresh"))
    sp = every.where("elev or prom").groupBy("up", "p", F.col("c").alias("sp"), F.col("s").alias("ss")).agg(F.max("elev").alias("elev"), F.max("prom").alias("prom"))
    sp = sp.groupBy("up", "p").agg(F.collect_list(F.struct(F.col("sp").alias("p"), F.col("ss").alias("s"), "elev", "prom")).alias("subs"))
    out = base.select("up", "p", "s", "thresh", "min_bound", "notable").join(e, ["up", "p"], "left").join(sp, ["up", "p"], "left")
    return out.select("up", "p", "s", "thresh", "pthresh", "parent", "min_bound", "notable", F.coalesce("subs", F.array().cast("array<struct<p:long,s:long,elev:boolean,prom:boolean>>")).alias("subs"))


def ranked(rel: DataFrame, pts: DataFrame) -> DataFrame:
    """A3: (up, p, rank) by falling drop and its tie-breaks, from 0, of notable peaks with a key saddle.

    Coarse ranges of the drop are counted first, so the row numbers are made range by range and no task
    sorts everything.
    """
    r = with_keys(rel.where("notable").select("up", "p", "s"), pts).withColumn("pair", pair_key(F.col("kp"), F.col("ks")))
    r = r.withColumn("band", F.floor(F.log2(F.col("drop") + 1e-9) * 8).cast("int"))
    counts = r.groupBy("up", "band").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("up").orderBy(F.desc("band"))) - F.col("n")).drop("n")  # a few hundred rows
    num = F.row_number().over(Window.partitionBy("up", "band").orderBy(F.desc("pair"))) - 1
    return r.withColumn("_i", num).join(F.broadcast(before), ["up", "band"]).select("up", "p", (F.col("before") + F.col("_i")).alias("rank"))


def tree(g: DataFrame, f: DataFrame) -> DataFrame:
    """(up, node, next, s, depth): each peak's arrow over a merge saddle towards its component's root.

    A component is rooted where it leaves the data: at the peak next to its min_bound saddle, whose
    arrow goes over that saddle; the component of the highest peak is rooted there. Depth counts the
    arrows inside the component.
    """
    merges = f.where("not min_bound").select("up", "s", F.col("q_own").alias("m"), F.col("q_far").alias("n"))
    exits = f.where("min_bound").select("up", F.col("q_own").alias("node"), F.col("q_far").alias("next"), "s")
    peaks = g.select("up", F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    none = F.lit(None).cast("long")
    free = peaks.join(f.select("up", F.col("p").alias("node")), ["up", "node"], "left_anti").select("up", "node", none.alias("next"), none.alias("s"))
    roots = materialize(exits.union(free), "tree-roots")
    arrows = materialize(forest.rooted(merges, roots.select("up", "node"), lambda ptr: blocks.Ways(ptr).rank), "tree-arrows")
    depth = blocks.Ways(arrows.select("up", "node", "next").union(roots.select("up", "node", none))).rank
    return arrows.union(roots).join(depth.select("up", "node", F.col("depth").cast("int").alias("depth")), ["up", "node"])
