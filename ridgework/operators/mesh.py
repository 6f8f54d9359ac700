"""Local shape of a raster: neighbour rings, classes and leads, one shuffle for all of them.

Every point has the sort key (z, x - y, x), a total order on a planar grid. The lattice is triangulated:
cells with even x + y have eight neighbours, the others the four along the axes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgework.functions import ids


@dataclass(frozen=True)
class Grid:
    """A geographic grid: degrees per cell, and the even number of cells around it if x closes up."""

    spacing: float
    width: int | None = None
    grid_id: int = 0

    def __post_init__(self):
        if self.width is not None and self.width % 2:
            raise ValueError("a grid that closes up has an even number of cells around")

    def stretch(self) -> Column:
        """The length of a step in x, where a step in y is 1: the cosine of the latitude."""
        return F.cos(F.radians(F.col("y") * self.spacing))


#: Neighbour offsets clockwise from north.
RING = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
CLASSES = ["indeterminate", "summit", "pit", "saddle", "slope"]


def offsets() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(RING)])


def present(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("z").isNotNull() & ~F.isnan("z")).select("x", "y", F.col("z").cast("double").alias("z"))


def _around(x: Column, grid: Grid | None) -> Column:
    """X, or the same place of a grid that closes up."""
    return x if grid is None or grid.width is None else ids.wrapped_x(x, grid.width).cast("int")


def adjacency(cells: DataFrame, grid: Grid | None = None) -> DataFrame:
    """M1: (x, y, i, nx, ny) of every cell's neighbour places, present or not."""
    n = present(cells).select("x", "y", F.explode(offsets()).alias("o"))
    n = n.where((F.pmod(F.col("x") + F.col("y"), F.lit(2)) == 0) | (F.col("o.i") % 2 == 0))
    return n.select("x", "y", "o.i", _around(F.col("x") + F.col("o.dx"), grid).alias("nx"), (F.col("y") + F.col("o.dy")).alias("ny"))


def rings(cells: DataFrame, grid: Grid | None = None) -> DataFrame:
    """(x, y, z, ring) with ring = array<struct<i, nz, nx, ny, up>> in ring order; up: the neighbour is higher.

    Each cell sends its height to the places that count it as a neighbour, so one grouping by place
    builds every ring; nothing is joined. Cells are one a place, as overlaid() makes them; of several the
    highest counts.
    """
    p = present(cells)
    sent = p.select("x", "y", "z", F.explode(F.concat(offsets(), F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("dx"), F.lit(0).alias("dy"))))).alias("o"))
    # the receiver lies at (x - dx, y - dy) and sees the sender at offset i
    tx, ty = _around(F.col("x") - F.col("o.dx"), grid), F.col("y") - F.col("o.dy")
    sent = sent.where((F.col("o.i") % 2 != 1) | (F.pmod(tx + ty, F.lit(2)) == 0))
    sent = sent.select(tx.alias("x"), ty.alias("y"), "z", F.col("o.i").alias("i"))
    # nine numbers a place, which are combined before the shuffle; a list of structs would not be
    at = [F.max(F.when(F.col("i") == i, F.col("z"))) for i in range(len(RING))]
    g = sent.groupBy("x", "y").agg(F.max(F.when(F.col("i") == -1, F.col("z"))).alias("z"), *[h.alias(f"z{i}") for i, h in enumerate(at)])
    g = g.where("z is not null")
    key = lambda z, x, y: F.struct(z.alias("a"), (x - y).alias("b"), x.alias("c"))
    me = key(F.col("z"), F.col("x"), F.col("y"))
    places = [(F.col(f"z{i}"), _around(F.col("x") + dx, grid), F.col("y") + dy) for i, (dx, dy) in enumerate(RING)]
    near = F.array(*[F.struct(F.lit(i).alias("i"), z.alias("nz"), x.alias("nx"), y.alias("ny"), (key(z, x, y) > me).alias("up")) for i, (z, x, y) in enumerate(places)])
    ring = F.filter(near, lambda n: n["nz"].isNotNull())
    return g.select("x", "y", "z", ring.alias("ring"))


def complete() -> Column:
    return F.size("ring") == F.when(F.pmod(F.col("x") + F.col("y"), F.lit(2)) == 0, 8).otherwise(4)


def changes(ring: Column) -> Column:
    """Sign changes once around the ring."""
    n = F.size(ring)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(ring[i]["up"] != ring[F.pmod(i + 1, n)]["up"], 1).otherwise(0))


def classify(cells: DataFrame, grid: Grid | None = None) -> DataFrame:
    """M2: (x, y, z, ring, changes, class)."""
    r = rings(cells, grid).withColumn("changes", F.when(complete(), changes(F.col("ring"))))
    ups = F.exists("ring", lambda n: n["up"])
    c = F.when(F.col("changes").isNull(), "indeterminate").when((F.col("changes") == 0) & ~ups, "summit").when(F.col("changes") == 0, "pit").when(F.col("changes") > 2, "saddle").otherwise("slope")
    return r.withColumn("class", c)


def leads(classified: DataFrame, grid: Grid | None = None) -> DataFrame:
    """M3: (x, y, z, class, trace, up, bx, by), the best neighbour of every cohort of slopes and saddles.

    The ring splits into runs of higher and lower neighbours; runs of higher ones have even trace
    numbers, counted clockwise, and the run over the seam is one. In a run, scanned in ring order, a
    neighbour takes over when its rise over the best one's exceeds the ratio of their distances; a best
    one of equal height gives way to any higher and to no lower one. A step in x is 1 long, or the
    cosine of the latitude on a geographic grid.
    """
    s = grid.stretch() if grid is not None else F.lit(1.0)
    c = classified.where(F.col("class").isin("slope", "saddle")).withColumn("_s", s)
    ring = F.col("ring")
    n = F.size(ring)
    first_up = F.element_at(ring, 1)["up"]
    # runs in order of the ring's array, each an array; a change begins a new one
    runs = F.aggregate(ring, F.array(F.slice(ring, 1, 0)), lambda a, e: F.when((F.size(F.element_at(a, -1)) == 0) | (F.element_at(F.element_at(a, -1), -1)["up"] == e["up"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), F.array(e))))).otherwise(F.concat(a, F.array(F.array(e)))))
    c = c.withColumn("_runs", runs)
    # the first and the last run are one when both rise or both fall
    m = F.size("_runs")
    seam = F.element_at(F.col("_runs"), 1)[0]["up"] == F.element_at(F.col("_runs"), -1)[0]["up"]
    joined = F.when(seam & (m > 1), F.concat(F.array(F.concat(F.element_at(F.col("_runs"), 1), F.element_at(F.col("_runs"), -1))), F.slice("_runs", 2, m - 2))).otherwise(F.col("_runs"))
    c = c.withColumn("_runs", joined)

    def step(x, y):
        far = F.sqrt(F.col("_s") * F.col("_s") + 1.0)
        return F.when(x == F.col("x"), F.lit(1.0)).when(y == F.col("y"), F.col("_s")).otherwise(far)

    def better(p, b):
        dp, db = p["nz"] - F.col("z"), b["nz"] - F.col("z")
        ip, ib = ((v["nx"] - v["ny"]) - (F.col("x") - F.col("y")) for v in (p, b))
        lp, lb = step(p["nx"], p["ny"]), step(b["nx"], b["ny"])

        def exceeds(u, v):
            return F.when(v > 0, u * lb > lp * v).when(v < 0, u * lb < lp * v).otherwise(u > 0)

        return F.when((dp != 0) | (db != 0), exceeds(dp, db)).when((ip != 0) | (ib != 0), exceeds(ip, ib)).otherwise(lb > lp)

    best = F.transform("_runs", lambda run: F.aggregate(F.slice(run, 2, F.size(run)), F.element_at(run, 1), lambda b, p: F.when(better(p, b), p).otherwise(b)))
    out = c.select("x", "y", "z", "class", first_up.alias("_fu"), F.size("_runs").alias("_n"), F.posexplode(best).alias("_k", "b"))
    trace = F.pmod(F.col("_k") + F.when(F.col("_fu"), 0).otherwise(1), F.col("_n"))
    return out.select("x", "y", "z", "class", trace.cast("int").alias("trace"), F.col("b.up").alias("up"), F.col("b.nx").alias("bx"), F.col("b.ny").alias("by"))


def next_cells(lead: DataFrame) -> DataFrame:
    """M4: (x, y, up, nx, ny), the next cell of an ascent or descent: trace 0 or 1."""
    return lead.where("trace < 2").select("x", "y", "up", F.col("bx").alias("nx"), F.col("by").alias("ny"))


def split_saddles(lead: DataFrame) -> DataFrame:
    """M6: (x, y, z, seq, up, trace, bx, by), two leads per direction of every virtual saddle.

    A saddle of n rises is n - 1 saddles: number i joins rises 2i and 2i + 2, and falls 2i + 1 and 2n - 1.
    """
    s = lead.where(F.col("class") == "saddle")
    g = s.groupBy("x", "y").agg(F.max("z").alias("z"), F.array_sort(F.collect_list(F.struct("trace", "bx", "by"))).alias("l"))
    n = (F.size("l") / 2).cast("int")
    v = g.select("x", "y", "z", "l", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1 - 1)).alias("i"))
    pairs = F.array(*[F.struct(F.lit(up).alias("up"), t.cast("int").alias("t")) for up, t in ((True, 2 * F.col("i")), (True, 2 * F.col("i") + 2), (False, 2 * F.col("i") + 1), (False, 2 * F.col("n") - 1))])
    v = v.select("x", "y", "z", (-F.col("i")).alias("seq"), "l", F.explode(pairs).alias("p"))
    at = F.element_at(F.col("l"), F.col("p.t") + 1)
    return v.select("x", "y", "z", "seq", F.col("p.up").alias("up"), F.col("p.t").alias("trace"), at["bx"].alias("bx"), at["by"].alias("by"))
