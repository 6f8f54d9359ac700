"""The network: where ascents and descents end, and the edges from saddles to summits and pits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgework.functions import ids
from ridgework.functions.store import materialize, remove
from ridgework.operators import blocks, mesh

MOST_ROUNDS = 40


def chase(classified: DataFrame, lead: DataFrame) -> DataFrame:
    """M5: (x, y, up, ex, ey) for every cell and direction: where following M4 ends, null off the data.

    Each cell knows its next one; pointer doubling replaces next by next of next until all point to a
    summit (up), a pit (down) or an indeterminate cell, in as many rounds as the longest way has bits.
    Cells that have arrived leave the loop, so rounds shrink.
    """
    ends = classified.select("x", "y", F.explode(F.array(F.lit(True), F.lit(False))).alias("up"), "class").where((F.col("class") == "indeterminate") | ((F.col("class") == "summit") & F.col("up")) | ((F.col("class") == "pit") & ~F.col("up")))
    arrived = ends.select("x", "y", "up", F.when(F.col("class") != "indeterminate", F.col("x")).alias("ex"), F.when(F.col("class") != "indeterminate", F.col("y")).alias("ey"))
    done, parts = materialize(arrived, "chase-done"), []
    parts.append(done)
    open_, path = materialize(mesh.next_cells(lead), "chase-open", with_path=True)
    for _ in range(MOST_ROUNDS):
        if open_.isEmpty():
            break
        known = parts[0]
        for p in parts[1:]:
            known = known.union(p)
        at = known.select(F.col("x").alias("nx"), F.col("y").alias("ny"), "up", "ex", "ey", F.lit(True).alias("hit"))
        jump = open_.select(F.col("x").alias("nx"), F.col("y").alias("ny"), "up", F.col("nx").alias("mx"), F.col("ny").alias("my"))
        step = open_.join(at, ["nx", "ny", "up"], "left").join(jump, ["nx", "ny", "up"], "left")
        step, now = materialize(step.select("x", "y", "up", "hit", "ex", "ey", "mx", "my"), "chase-step", with_path=True)
        parts.append(step.where("hit").select("x", "y", "up", "ex", "ey"))
        open_ = step.where("hit is null").select("x", "y", "up", F.col("mx").alias("nx"), F.col("my").alias("ny"))
    else:
        raise RuntimeError(f"a way is longer than 2**{MOST_ROUNDS} cells")
    remove(open_.sparkSession, path)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def cell_ways(classified: DataFrame, lead: DataFrame) -> blocks.Ways:
    """M4: the ways of all cells in both directions, as a forest of packed places."""
    place = lambda x, y: ids.pack(0, x, y)
    steps = mesh.next_cells(lead).select("up", place("x", "y").alias("node"), place("nx", "ny").alias("next"))
    every = F.array(F.lit(True), F.lit(False))
    stays = (F.col("class") == "indeterminate") | F.when(F.col("up"), F.col("class") == "summit").otherwise(F.col("class") == "pit")
    ends = classified.select("x", "y", "class", F.explode(every).alias("up")).where(stays).select("up", place("x", "y").alias("node"), F.lit(None).cast("long").alias("next"))
    return blocks.Ways(materialize(steps.union(ends), "cell-ways"))


def arrivals(classified: DataFrame, ways: blocks.Ways) -> DataFrame:
    """chase() by the ways of all cells: (x, y, up, ex, ey)."""
    off = classified.where("class = 'indeterminate'").select(ids.pack(0, "x", "y").alias("root"), F.lit(True).alias("off"))
    n, r = ids.unpack("node"), ids.unpack("root")
    on = F.col("off").isNull()
    return ways.rank.join(off, "root", "left").select(n["x"].alias("x"), n["y"].alias("y"), "up", F.when(on, r["x"]).alias("ex"), F.when(on, r["y"]).alias("ey"))


def edges(cells: DataFrame, classes: DataFrame | None = None, leads: DataFrame | None = None, grid: mesh.Grid | None = None, ways: blocks.Ways | None = None) -> DataFrame:
    """M7, M8: (sx, sy, sz, seq, up, ax, ay, az, bx, by, bz, tag_a, tag_b), an edge per virtual saddle and direction.

    The ends are summits (up) or pits; an end off the data is null and an edge with both ends off the
    data is dropped (P25). Endpoint a has the lower tag. With the ways of cell_ways() nothing is chased.
    """
    c = materialize(mesh.classify(cells, grid), "mesh-classes") if classes is None else classes
    lead = materialize(mesh.leads(c, grid), "mesh-leads") if leads is None else leads
    end = chase(c.select("x", "y", "class"), lead) if ways is None else arrivals(c, ways)
    half = mesh.split_saddles(lead).join(end.select(F.col("x").alias("bx"), F.col("y").alias("by"), "up", "ex", "ey"), ["bx", "by", "up"], "left")
    tops = c.where(F.col("class").isin("summit", "pit")).select(F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("z").alias("ez"))
    half = half.join(tops, ["ex", "ey"], "left")
    # a saddle has two leads a direction; the first, of the lower tag, is known by its number, so plain numbers are grouped
    first = F.col("trace") == F.when(F.col("up"), -2 * F.col("seq")).otherwise(1 - 2 * F.col("seq"))
    end_of = lambda own, c, name: F.max(F.when(own, F.col(c))).alias(name)
    sides = [end_of(own, c, name) for own, names in ((first, ("ax", "ay", "az", "tag_a")), (~first, ("bx", "by", "bz", "tag_b"))) for c, name in zip(("ex", "ey", "ez", "trace"), names, strict=True)]
    g = half.groupBy("x", "y", "seq", "up").agg(F.max("z").alias("z"), *sides)
    e = g.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), "seq", "up", "ax", "ay", "az", "bx", "by", "bz", "tag_a", "tag_b")
    return e.where("ax is not null or bx is not null")


def half_edges(e: DataFrame) -> DataFrame:
    """P5: (px, py, pz, sx, sy, sz, seq, up, tag) per edge end that is not null."""
    ends = F.array(F.struct(F.col("ax").alias("px"), F.col("ay").alias("py"), F.col("az").alias("pz"), F.col("tag_a").alias("tag")), F.struct(F.col("bx").alias("px"), F.col("by").alias("py"), F.col("bz").alias("pz"), F.col("tag_b").alias("tag")))
    return e.select("sx", "sy", "sz", "seq", "up", F.explode(ends).alias("h")).select("h.*", "sx", "sy", "sz", "seq", "up").where("px is not null")


def ring_saddles(e: DataFrame) -> DataFrame:
    """A4: (px, py, sx, sy, seq, up) of saddles that meet one peak twice."""
    g = half_edges(e).groupBy("px", "py", "sx", "sy", "seq", "up").agg(F.count("*").alias("n"))
    return g.where("n = 2").drop("n")


def best_connectors(e: DataFrame) -> DataFrame:
    """Per pair of peaks and direction the highest (up) or lowest saddle: (up, lx, ly, hx, hy, sx, sy, seq)."""
    both = e.where("ax is not null and bx is not null and not (ax = bx and ay = by)")
    p, q = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    sign = F.when(F.col("up"), 1).otherwise(-1)
    key = F.struct((F.col("sz") * sign).alias("a"), ((F.col("sx") - F.col("sy")) * sign).alias("b"), (F.col("sx") * sign).alias("c"), (F.col("seq") * sign).alias("d"))
    g = both.select("up", F.least(p, q).alias("l"), F.greatest(p, q).alias("h"), key.alias("k"), "sx", "sy", "seq")
    g = g.groupBy("up", "l", "h").agg(F.max_by(F.struct("sx", "sy", "seq"), "k").alias("s"))
    return g.select("up", F.col("l.x").alias("lx"), F.col("l.y").alias("ly"), F.col("h.x").alias("hx"), F.col("h.y").alias("hy"), "s.sx", "s.sy", "s.seq")
