"""Registered queries over the test rasters, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgework.functions import geocode, ids
from ridgework.operators import combine, mesh, network
from ridgework.plans import twins, viewer
from ridgework.plans.terrain import Terrain
from ridgework.sources import rasters

CUTOFF = 20000.0
#: Ids of cells with x from 64 to 79.
PREFIX = "00000004"
_TERRAINS: dict = {}


def terrain(spark: SparkSession, sf_dir: str) -> Terrain:
    """R2's results of this session; queries share the tables of earlier steps, as stages of one run do."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TERRAINS:
        _TERRAINS[key] = Terrain(rasters.r2(spark, sf_dir), CUTOFF)
    return _TERRAINS[key]


def forget() -> None:
    """Have the next query compute everything again."""
    _TERRAINS.clear()


def f1_point_index(spark, sf_dir):
    c = rasters.r1(spark, sf_dir).select((F.col("x") - 100).alias("x"), (F.col("y") - 7).alias("y"))
    i = c.select(ids.pack(3, "x", "y", F.pmod(F.col("x"), F.lit(3)) - 1).alias("ix"))
    p = ids.unpack("ix")
    return i.select("ix", *[p[k].alias(k) for k in ("grid", "x", "y", "seq")], ids.with_seq("ix", -2).alias("ix2"), ids.tile_id(3, p["x"], p["y"], 4).alias("tile"))


def f_scalars(spark, sf_dir):
    o = rasters.read(spark, sf_dir, "orders")
    v = F.col("o_totalprice")
    return o.select(
        "o_orderkey", ids.millimetres(v - 200000).alias("mm"), ids.feet_class(ids.feet(v * 10)).alias("cls"), ids.hex_id(F.col("o_orderkey") * 7919 - 5_000_000).alias("hex"),
        ids.hex_to_id(ids.hex_id(F.col("o_orderkey") * 7919 - 5_000_000)).alias("back"), ids.bit_reversed(F.col("o_orderkey") * 31 - 100).alias("rev"), ids.floor_mod(F.col("o_orderkey") - 500, 128).alias("m"), ids.wrapped_x("o_orderkey", 1000).alias("wx"), ids.lon_normal(v / 100).alias("lon"), ids.lon_epoch(v / 100).alias("epoch"),
    )


def p3_pages(spark, sf_dir):
    s = rasters.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 97 * 41 - 2000).cast("int").alias("x0"), (F.col("p_partkey") % 89 * 23 - 1000).cast("int").alias("y0"), "p_size")
    e = s.withColumns({"x1": F.col("x0") + F.col("p_size") * 20, "y1": F.col("y0") + F.col("p_size") * 7})
    return rasters.pages(e, 9).select("id", "tile_x", "tile_y")


def p4_chunks(spark, sf_dir):
    c = mesh.present(rasters.r2(spark, sf_dir))
    return c.groupBy(ids.chunk_tile("x", 0, 4).alias("tx"), ids.chunk_tile("y", 0, 4).alias("ty"), ids.chunk_tile("x", 1, 4).alias("tx1"), ids.chunk_tile("y", 1, 4).alias("ty1")).agg(F.count("*").alias("n"))


def t5_overlaid(spark, sf_dir):
    li = rasters.read(spark, sf_dir, "lineitem").select(F.lit(0).alias("grid_id"), (F.col("l_partkey") % 64).cast("int").alias("x"), (F.col("l_suppkey") % 64).cast("int").alias("y"), F.when(F.col("l_linenumber") < 6, F.col("l_quantity")).alias("z"), F.concat(F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.col("l_linenumber").cast("string")).alias("path"))
    return rasters.overlaid(li)


def m1_adjacency(spark, sf_dir):
    return mesh.adjacency(rasters.r2(spark, sf_dir))


def _classes(raster):
    return lambda spark, sf_dir: mesh.classify(raster(spark, sf_dir)).select("x", "y", "class", "changes")


#: A band around a small cylinder: half a degree per cell, 128 cells around.
GEO = mesh.Grid(0.5, 128)


def r4(spark, sf_dir):
    """The cells of R2, x from -64 on, on a grid that closes up."""
    return rasters.r2(spark, sf_dir).withColumn("x", ids.wrapped_x("x", 128).cast("int"))


def m1_seam(spark, sf_dir):
    return mesh.adjacency(r4(spark, sf_dir), GEO)


def m3_leads_geo(spark, sf_dir):
    """Classes and leads over the seam, with steps in x as short as their latitude makes them."""
    return mesh.leads(mesh.classify(r4(spark, sf_dir), GEO), GEO).select("x", "y", "class", "trace", "up", "bx", "by")


def f4_lat_lon(spark, sf_dir):
    c = r4(spark, sf_dir).withColumn("seq", -F.pmod("x", F.lit(3)).cast("int"))
    lat, lon = ids.lat_lon("x", "y", GEO.spacing, seq=F.col("seq"))
    return c.select("x", "y", "seq", geocode.wkt_point(lon, lat).alias("loc"))


def m2_class_counts(spark, sf_dir):
    return mesh.classify(rasters.r2(spark, sf_dir)).groupBy("class").agg(F.count("*").alias("n"))


def _leads(raster):
    return lambda spark, sf_dir: mesh.leads(mesh.classify(raster(spark, sf_dir))).select("x", "y", "trace", "up", "bx", "by")


def m4_next(spark, sf_dir):
    return mesh.next_cells(terrain(spark, sf_dir).leads)


def m5_chase(spark, sf_dir):
    t = terrain(spark, sf_dir)
    return network.chase(t.classes.select("x", "y", "class"), t.leads)


def m6_saddles(spark, sf_dir):
    return mesh.split_saddles(terrain(spark, sf_dir).leads).select("x", "y", "seq", "up", "trace", "bx", "by")


def m7_edges(spark, sf_dir):
    return terrain(spark, sf_dir).edges.drop("az", "bz", "sz")


def p5_half_edges(spark, sf_dir):
    return network.half_edges(terrain(spark, sf_dir).edges).drop("pz", "sz")


def a4_rings(spark, sf_dir):
    return network.ring_saddles(terrain(spark, sf_dir).edges)


def a7_connectors(spark, sf_dir):
    return network.best_connectors(terrain(spark, sf_dir).edges)


def j3_only_up(spark, sf_dir):
    """Saddles with an edge up and none down: left anti join."""
    e = terrain(spark, sf_dir).edges
    return e.where("up").select("sx", "sy", "seq").join(e.where("not up").select("sx", "sy", "seq"), ["sx", "sy", "seq"], "left_anti")


def j4_anchors(spark, sf_dir):
    """Edges down of the saddles that join two different peaks: left semi join, half-edges, nulls kept."""
    e = terrain(spark, sf_dir).edges
    keys = e.where("up and ax is not null and bx is not null and not (ax = bx and ay = by)").select("sx", "sy", "seq")
    d = e.where("not up").join(keys, ["sx", "sy", "seq"], "left_semi")
    return d.select("sx", "sy", "seq", F.explode(F.array(F.struct(F.col("tag_a").alias("tag"), F.col("ax").alias("qx"), F.col("ay").alias("qy")), F.struct(F.col("tag_b").alias("tag"), F.col("bx").alias("qx"), F.col("by").alias("qy")))).alias("h")).select("sx", "sy", "seq", "h.*")


def a15_saddles_per_tile(spark, sf_dir):
    """Distinct saddles and directions per tile."""
    s = mesh.split_saddles(terrain(spark, sf_dir).leads).select("x", "y", "seq", "up").distinct()
    return s.groupBy(ids.tile("x", 4).alias("tx"), ids.tile("y", 4).alias("ty"), "up").agg(F.count("*").alias("n"))


def _relations(up: bool, *cols: str):
    return lambda spark, sf_dir: terrain(spark, sf_dir).relations.where(F.col("up") == up).select(*cols)


def _subs(kind: str):
    return lambda spark, sf_dir: terrain(spark, sf_dir).relations.select("up", F.explode("subs").alias("x")).where(f"x.{kind}").select("up", F.col("x.p").alias("p"), F.col("x.s").alias("s")).distinct()


def m8_topology_counts(spark, sf_dir):
    return terrain(spark, sf_dir).edges.groupBy("up").agg(F.count("*").alias("edges"), F.countDistinct("sx", "sy").alias("saddles"))


def m18_bounds(spark, sf_dir):
    return terrain(spark, sf_dir).facts.groupBy("up", "min_bound").agg(F.count("*").alias("n"))


def m37_in_prefix(spark, sf_dir):
    t = terrain(spark, sf_dir)
    return viewer.peaks_in(t.point_table(), t.prom_facts(), PREFIX, True)


def s19_features(spark, sf_dir):
    """The peaks of an id range as GeoJSON features."""
    top = m37_in_prefix(spark, sf_dir)
    return top.select("point", viewer.feature(F.col("loc"), geo="geo", prom_mm="prom_mm", prom_class="prom_class").alias("feature"))


def s19_collection(spark, sf_dir):
    return viewer.collection(s19_features(spark, sf_dir), "point")


def _most(up: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = terrain(spark, sf_dir)
        return viewer.peaks_in(t.point_table(), t.prom_facts(), "", up)

    return query


def _busiest(t: Terrain) -> int:
    """The peak of the tables with the most secondary saddles."""
    first = t.subsaddle_table().join(t.prom_facts().select("point"), "point", "left_semi").groupBy("point").count().orderBy(F.desc("count"), "point").first()
    return first.point if first else ids.NULL_ID


def m36_view(spark, sf_dir):
    """A peak with everything around it."""
    t = terrain(spark, sf_dir)
    return viewer.around(t.point_table(), t.prom, t.subsaddle_table(), _busiest(t))


def j20_behind_saddles(spark, sf_dir):
    """The peaks behind the secondary saddles of a peak, by SQL; the view prom holds the columns without lines."""
    t = terrain(spark, sf_dir)
    viewer.register(t.point_table(), t.prom_facts(), t.subsaddle_table())
    return viewer.around_sql(spark, _busiest(t))


def _cells(c: str) -> Column:
    """Cells as text, a step off the data as an empty one."""
    return F.array_join(F.transform(c, lambda e: F.concat_ws(":", e["x"].cast("string"), e["y"].cast("string"))), ",")


def m31_traces(spark, sf_dir):
    return terrain(spark, sf_dir).traces.select("x", "y", "seq", "up", "trace", _cells("cells").alias("cells"))


def m32_lines(spark, sf_dir):
    return terrain(spark, sf_dir).lines.select("up", "p", "target", _cells("cells").alias("cells"))


def m28_domains(spark, sf_dir):
    lines = F.transform("lines", lambda ln: F.array_join(ln.cast("array<string>"), ","))
    return terrain(spark, sf_dir).domains.select("up", "p", F.array_join(lines, ";").alias("lines"))


def a1_consolidate(spark, sf_dir):
    """Partial rows per part: some have one column, some another, some a list."""
    li = rasters.read(spark, sf_dir, "lineitem")
    kind = F.col("l_linenumber") % 3
    parts = li.select("l_partkey", F.when(kind == 0, F.col("l_quantity")).alias("q"), F.when(kind == 1, F.col("l_shipdate")).alias("d"), F.when(kind == 2, F.array("l_suppkey")).otherwise(F.array().cast("array<bigint>")).alias("s"))
    return combine.consolidate(parts, ["l_partkey"]).withColumn("s", F.array_join(F.col("s").cast("array<string>"), ","))


def a2_latest(spark, sf_dir):
    li = rasters.read(spark, sf_dir, "lineitem")
    return combine.latest(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey"], "l_linenumber")


def a11_flags(spark, sf_dir):
    """Saddles of up and of down edges, once each, with two flags."""
    e = terrain(spark, sf_dir).edges
    return combine.union_with_flags(e.where("up"), e.where("not up"), ["sx", "sy", "seq"], "in_up", "in_down")


def j15_crossref(spark, sf_dir):
    """Edges with the traces of their saddles."""
    t = terrain(spark, sf_dir)
    key = lambda x, y: (F.col(x) * 65536 + F.col(y)).cast("long")
    tr = mesh.split_saddles(t.leads).where("seq = 0").select(key("x", "y").alias("s"), F.col("trace").alias("dir"), F.col("bx").alias("tx"), F.col("by").alias("ty"))
    users = t.edges.where("seq = 0").select(key("sx", "sy").alias("s"), F.when(F.col("tag_a") < 2, key("sx", "sy")).otherwise(F.lit(-1).cast("long")).alias("ix"), F.col("tag_a").alias("edge_dir"), "up")
    return combine.crossref(tr, users)


def w4_running_maxima(spark, sf_dir):
    o = rasters.read(spark, sf_dir, "orders")
    return combine.running_maxima(o.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey", "o_totalprice")


def w6_first_where(spark, sf_dir):
    o = rasters.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return combine.first_where(o, ["o_custkey"], "o_orderkey", F.col("o_totalprice") > 200000)


QUERIES = {
    "a1_consolidate": a1_consolidate,
    "a2_latest": a2_latest,
    "a11_flags": a11_flags,
    "j15_crossref": j15_crossref,
    "w4_running_maxima": w4_running_maxima,
    "w6_first_where": w6_first_where,
    "m2_class_counts": m2_class_counts,
    "f1_point_index": f1_point_index,
    "f_scalars": f_scalars,
    "p3_pages": p3_pages,
    "p4_chunks": p4_chunks,
    "t5_overlaid": t5_overlaid,
    "m1_adjacency": m1_adjacency,
    "m2_classify": _classes(rasters.r2),
    "m2_classify_rough": _classes(rasters.r1),
    "m2_classify_ties": _classes(rasters.r1q),
    "m2_classify_smooth": _classes(rasters.r3),
    "m3_leads": _leads(rasters.r2),
    "m3_leads_ties": _leads(rasters.r1q),
    "m1_seam": m1_seam,
    "m3_leads_geo": m3_leads_geo,
    "f4_lat_lon": f4_lat_lon,
    "m4_next": m4_next,
    "m5_chase": m5_chase,
    "m6_saddles": m6_saddles,
    "m7_edges": m7_edges,
    "m8_topology_counts": m8_topology_counts,
    "p5_half_edges": p5_half_edges,
    "a4_rings": a4_rings,
    "a7_connectors": a7_connectors,
    "a15_saddles_per_tile": a15_saddles_per_tile,
    "j3_only_up": j3_only_up,
    "j4_anchors": j4_anchors,
    "m12_drop_up": _relations(True, "p", "s", "drop", "min_bound", "notable"),
    "m12_drop_down": _relations(False, "p", "s", "drop", "min_bound", "notable"),
    "m13_thresh": lambda spark, sf_dir: terrain(spark, sf_dir).relations.select("up", "p", "thresh"),
    "m14_pthresh": lambda spark, sf_dir: terrain(spark, sf_dir).relations.where("notable").select("up", "p", "pthresh"),
    "m15_parent": lambda spark, sf_dir: terrain(spark, sf_dir).relations.where("notable").select("up", "p", "parent"),
    "m16_elev_subsaddles": _subs("elev"),
    "m17_drop_subsaddles": _subs("prom"),
    "m18_bounds": m18_bounds,
    "a3_rank": lambda spark, sf_dir: terrain(spark, sf_dir).ranks,
    "m19_tree": lambda spark, sf_dir: terrain(spark, sf_dir).tree,
    "m24_ways": lambda spark, sf_dir: terrain(spark, sf_dir).between.select("up", "p", "target", F.concat_ws(",", F.transform("left", lambda v: v.cast("string"))).alias("left"), F.concat_ws(",", F.transform("right", lambda v: v.cast("string"))).alias("right")),
    "m29_pruned": lambda spark, sf_dir: terrain(spark, sf_dir).pruned.select("up", "src", "dst", F.concat_ws(",", F.transform("interim", lambda v: v.cast("string"))).alias("interim")),
    "m31_traces": m31_traces,
    "m32_lines": m32_lines,
    "m28_domains": m28_domains,
    "db_points": lambda spark, sf_dir: terrain(spark, sf_dir).point_table(),
    "db_prom": lambda spark, sf_dir: terrain(spark, sf_dir).prom_table(),
    "db_subsaddles": lambda spark, sf_dir: terrain(spark, sf_dir).subsaddle_table(),
    "m37_summits": _most(True),
    "m37_sinks": _most(False),
    "m37_in_prefix": m37_in_prefix,
    "s19_features": s19_features,
    "s19_collection": s19_collection,
    "m36_view": m36_view,
    "j20_behind_saddles": j20_behind_saddles,
}

# --- DuckDB -----------------------------------------------------------------------------------------

R2 = "SELECT CAST(o_orderkey % 128 AS INT) AS x, CAST(o_orderkey // 128 AS INT) AS y, o_totalprice AS z FROM orders"
R1 = "SELECT CAST(vec_id AS INT) AS x, CAST(unnest(range(0, 64)) AS INT) AS y, CAST(unnest(embedding) AS DOUBLE) AS z FROM embeddings"
R1Q = f"SELECT x, y, CAST(CAST(round(z * 20) AS INT) AS DOUBLE) AS z FROM ({R1})"
R3 = "SELECT CAST(p_partkey % 32 AS INT) AS x, CAST(p_partkey // 32 AS INT) AS y, p_retailprice AS z FROM part"


R4 = "SELECT CAST((o_orderkey % 128 + 64) % 128 - 64 AS INT) AS x, CAST(o_orderkey // 128 AS INT) AS y, o_totalprice AS z FROM orders"
NX = "(c.x + o.dx + 192) % 128 - 64"


def _ring(raster: str, nx: str = "c.x + o.dx") -> str:
    values = ", ".join(f"({i}, {dx}, {dy})" for i, (dx, dy) in enumerate(mesh.RING))
    return f"""
cells AS ({raster}),
off(i, dx, dy) AS (VALUES {values}),
ring AS (SELECT c.x, c.y, c.z, o.i, n.z AS nz, n.x AS nx, n.y AS ny, row(n.z, n.x - n.y, n.x) > row(c.z, c.x - c.y, c.x) AS up
         FROM cells c JOIN off o ON (c.x + c.y) % 2 = 0 OR o.i % 2 = 0 JOIN cells n ON n.x = {nx} AND n.y = c.y + o.dy),
turn AS (SELECT *, coalesce(lag(up) OVER (PARTITION BY x, y ORDER BY i), last_value(up) OVER (PARTITION BY x, y ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS before FROM ring),
summed AS (SELECT x, y, count(*) AS n, sum(CASE WHEN up <> before THEN 1 ELSE 0 END) AS changes, bool_or(up) AS any_up FROM turn GROUP BY x, y),
cls AS (SELECT c.x, c.y, c.z, CASE WHEN f THEN CAST(changes AS INT) END AS changes,
        CASE WHEN NOT f THEN 'indeterminate' WHEN changes = 0 AND NOT any_up THEN 'summit' WHEN changes = 0 THEN 'pit' WHEN changes > 2 THEN 'saddle' ELSE 'slope' END AS class
        FROM (SELECT c.x, c.y, c.z, s.changes, s.any_up, coalesce(s.n, 0) = CASE WHEN (c.x + c.y) % 2 = 0 THEN 8 ELSE 4 END AS f FROM cells c LEFT JOIN summed s USING (x, y)) c)"""


_LEADS = """,
runs AS (SELECT r.*, sum(CASE WHEN r.up <> r.prev THEN 1 ELSE 0 END) OVER (PARTITION BY x, y ORDER BY i) AS k, first_value(r.up) OVER (PARTITION BY x, y ORDER BY i) AS starts_up
         FROM (SELECT *, coalesce(lag(up) OVER (PARTITION BY x, y ORDER BY i), up) AS prev FROM ring) r JOIN cls USING (x, y) WHERE class IN ('slope', 'saddle')),
cohorts AS (SELECT *, (max(k) OVER (PARTITION BY x, y) + 1) // 2 * 2 AS n FROM runs),
best AS (SELECT x, y, CAST((k + CASE WHEN starts_up THEN 0 ELSE 1 END) % n AS INT) AS trace, any_value(up) AS up,
         list_reduce(list({'dp': nz - z, 'ip': (nx - ny) - (x - y), 'len': CASE WHEN nx = x OR ny = y THEN 1.0::DOUBLE ELSE sqrt(2.0::DOUBLE) END, 'nx': nx, 'ny': ny} ORDER BY i),
           lambda b, p: CASE WHEN CASE
             WHEN p.dp <> 0 OR b.dp <> 0 THEN CASE WHEN b.dp > 0 THEN p.dp * b.len > p.len * b.dp WHEN b.dp < 0 THEN p.dp * b.len < p.len * b.dp ELSE p.dp > 0 END
             WHEN p.ip <> 0 OR b.ip <> 0 THEN CASE WHEN b.ip > 0 THEN p.ip * b.len > p.len * b.ip WHEN b.ip < 0 THEN p.ip * b.len < p.len * b.ip ELSE p.ip > 0 END
             ELSE b.len > p.len END THEN p ELSE b END) AS b
         FROM cohorts GROUP BY x, y, (k + CASE WHEN starts_up THEN 0 ELSE 1 END) % n),
leads AS (SELECT x, y, trace, up, b.nx AS bx, b.ny AS "by" FROM best)"""

_CHASE = """,
nxt AS (SELECT x, y, up, bx AS nx, "by" AS ny FROM leads WHERE trace < 2),
walk AS (SELECT x, y, d.up, x AS cx, y AS cy FROM cls, (VALUES (true), (false)) d(up)
         WHERE class IN ('slope', 'saddle', 'indeterminate') OR (class = 'summit' AND d.up) OR (class = 'pit' AND NOT d.up)
         UNION ALL SELECT w.x, w.y, w.up, n.nx, n.ny FROM walk w JOIN nxt n ON n.x = w.cx AND n.y = w.cy AND n.up = w.up),
chase AS (SELECT w.x, w.y, w.up, CASE WHEN c.class <> 'indeterminate' THEN c.x END AS ex, CASE WHEN c.class <> 'indeterminate' THEN c.y END AS ey
          FROM walk w JOIN cls c ON c.x = w.cx AND c.y = w.cy WHERE c.class IN ('summit', 'pit', 'indeterminate'))"""

_SADDLES = """,
counted AS (SELECT x, y, CAST(count(*) // 2 AS INT) AS n FROM leads JOIN cls USING (x, y) WHERE class = 'saddle' GROUP BY x, y),
virtual AS (SELECT x, y, n, CAST(unnest(range(0, n - 1)) AS INT) AS i FROM counted),
split AS (SELECT v.x, v.y, -v.i AS seq, l.up, l.trace, l.bx, l."by" FROM virtual v JOIN leads l USING (x, y)
          WHERE l.trace IN (2 * v.i, 2 * v.i + 2, 2 * v.i + 1, 2 * v.n - 1))"""

_EDGES = """,
half AS (SELECT s.*, c.ex, c.ey FROM split s LEFT JOIN chase c ON c.x = s.bx AND c.y = s."by" AND c.up = s.up),
paired AS (SELECT x AS sx, y AS sy, seq, up, list({'t': trace, 'x': ex, 'y': ey} ORDER BY trace) AS h FROM half GROUP BY x, y, seq, up),
edges AS (SELECT sx, sy, seq, up, h[1].x AS ax, h[1].y AS ay, h[2].x AS bx, h[2].y AS "by", h[1].t AS tag_a, h[2].t AS tag_b FROM paired WHERE h[1].x IS NOT NULL OR h[2].x IS NOT NULL),
halves AS (SELECT sx, sy, seq, up, tag_a AS tag, ax AS px, ay AS py FROM edges UNION ALL SELECT sx, sy, seq, up, tag_b, bx, "by" FROM edges)"""


def _sql(raster: str, select: str, *more: str) -> str:
    return "WITH RECURSIVE" + _ring(raster) + "".join(more) + "\n" + select


_ALL = (_LEADS, _CHASE, _SADDLES, _EDGES)
_CLS = "SELECT x, y, class, changes FROM cls"
_KEYS = '(SELECT sx, sy, seq FROM edges WHERE up AND ax IS NOT NULL AND bx IS NOT NULL AND NOT (ax = bx AND ay = "by"))'

ORACLES = {
    "a1_consolidate": """
SELECT l_partkey, max(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity END) AS q, max(CASE WHEN l_linenumber % 3 = 1 THEN l_shipdate END) AS d,
       coalesce(array_to_string(list_sort(list(DISTINCT l_suppkey) FILTER (WHERE l_linenumber % 3 = 2)), ','), '') AS s
FROM lineitem GROUP BY l_partkey""",
    "a2_latest": """
SELECT l_orderkey, r.a AS l_linenumber, r.b AS l_partkey, r.c AS l_suppkey, r.d AS l_quantity
FROM (SELECT l_orderkey, max({'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'd': l_quantity}) AS r FROM lineitem GROUP BY l_orderkey)""",
    "a11_flags": _sql(R2, "SELECT sx, sy, seq, max(CASE WHEN up THEN 1 ELSE 0 END) AS in_up, max(CASE WHEN up THEN 0 ELSE 1 END) AS in_down FROM edges GROUP BY sx, sy, seq", *_ALL),
    "j15_crossref": _sql(
        R2,
        """SELECT e.s, e.ix, e.edge_dir, e.up, t.trace AS dir, t.bx AS tx, t."by" AS ty
FROM (SELECT CAST(sx * 65536 + sy AS BIGINT) AS s, CASE WHEN tag_a < 2 THEN CAST(sx * 65536 + sy AS BIGINT) ELSE -1 END AS ix, tag_a AS edge_dir, up FROM edges WHERE seq = 0) e
JOIN split t ON t.seq = 0 AND e.s = t.x * 65536 + t.y WHERE (e.ix <> e.s OR e.edge_dir = t.trace) AND e.up = (t.trace % 2 = 0)""",
        *_ALL,
    ),
    "w4_running_maxima": """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM orders)
WHERE m IS NULL OR o_totalprice > m""",
    "w6_first_where": "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey",
    "m2_class_counts": _sql(R2, "SELECT class, count(*) AS n FROM cls GROUP BY class"),
    "f1_point_index": f"""
WITH c AS (SELECT x - 100 AS x, y - 7 AS y, CAST(((x - 100) % 3 + 3) % 3 - 1 AS INT) AS seq FROM ({R1})),
u AS (SELECT *, (CAST(3 AS BIGINT) << 52) | ((CAST(x AS BIGINT) & 16777215) << 28) | ((CAST(y AS BIGINT) & 16777215) << 4) AS cell FROM c)
SELECT cell | (CAST(seq AS BIGINT) & 15) AS ix, CAST(3 AS INT) AS grid, x, y, seq, cell | 14 AS ix2,
       (CAST(3 AS BIGINT) << 52) | ((CAST(CAST(floor(x / 16.0) AS INT) * 16 AS BIGINT) & 16777215) << 28) | ((CAST(CAST(floor(y / 16.0) AS INT) * 16 AS BIGINT) & 16777215) << 4) AS tile FROM u""",
    "f_scalars": """
WITH v AS (SELECT o_orderkey, o_totalprice AS v, o_orderkey * 7919 - 5000000 AS h, o_orderkey * 31 - 100 AS r FROM orders)
SELECT o_orderkey, CAST(trunc((v - 200000) * 1000.0) AS INT) AS mm,
       CAST((v * 10 / 1000.0 / 0.3048 > 500)::INT + (v * 10 / 1000.0 / 0.3048 > 1000)::INT + (v * 10 / 1000.0 / 0.3048 > 1500)::INT + (v * 10 / 1000.0 / 0.3048 > 2000)::INT
         + (v * 10 / 1000.0 / 0.3048 > 3000)::INT + (v * 10 / 1000.0 / 0.3048 > 4000)::INT + (v * 10 / 1000.0 / 0.3048 > 6000)::INT + (v * 10 / 1000.0 / 0.3048 > 9000)::INT AS INT) AS cls,
       printf('%016x', h) AS hex, h AS back,
       CAST(CASE WHEN substr(b, 1, 1) = '1' THEN CAST(substr(b, 2)::BIT::BIGINT AS HUGEINT) - 9223372036854775808 ELSE CAST(substr(b, 2)::BIT::BIGINT AS HUGEINT) END AS BIGINT) AS rev,
       ((o_orderkey - 500) % 128 + 128) % 128 AS m, (o_orderkey + 500) % 1000 - 500 AS wx,
       fmod(v / 100 + 180.0, 360.0) - 180.0 AS lon, CAST(floor((v / 100 + 180.0) / 360.0) AS INT) AS epoch
FROM (SELECT *, reverse(CAST(r::BIT AS VARCHAR)) AS b FROM v)""",
    "p3_pages": """
WITH s AS (SELECT p_partkey AS id, CAST(p_partkey % 97 * 41 - 2000 AS INT) AS x0, CAST(p_partkey % 89 * 23 - 1000 AS INT) AS y0, p_size FROM part),
x AS (SELECT id, y0, p_size, CAST(unnest(range(CAST(floor(x0 / 512.0) AS BIGINT), CAST(floor((x0 + p_size * 20) / 512.0) AS BIGINT) + 1)) AS INT) AS tile_x FROM s)
SELECT DISTINCT id, tile_x, CAST(unnest(range(CAST(floor(y0 / 512.0) AS BIGINT), CAST(floor((y0 + p_size * 7) / 512.0) AS BIGINT) + 1)) AS INT) AS tile_y FROM x""",
    "p4_chunks": f"""
SELECT CAST(floor(x / 16.0) AS INT) AS tx, CAST(floor(y / 16.0) AS INT) AS ty, CAST(floor((x - 8) / 64.0) AS INT) AS tx1, CAST(floor((y - 8) / 64.0) AS INT) AS ty1, count(*) AS n FROM ({R2}) GROUP BY ALL""",
    "t5_overlaid": """
SELECT 0 AS grid_id, CAST(l_partkey % 64 AS INT) AS x, CAST(l_suppkey % 64 AS INT) AS y, arg_max(l_quantity, row(concat(lpad(CAST(l_orderkey AS VARCHAR), 9, '0'), CAST(l_linenumber AS VARCHAR)), l_quantity)) AS z
FROM lineitem WHERE l_linenumber < 6 GROUP BY ALL""",
    "m1_adjacency": _sql(R2, "SELECT c.x, c.y, o.i, c.x + o.dx AS nx, c.y + o.dy AS ny FROM cells c JOIN off o ON (c.x + c.y) % 2 = 0 OR o.i % 2 = 0"),
    "m2_classify": _sql(R2, _CLS),
    "m2_classify_rough": _sql(R1, _CLS),
    "m2_classify_ties": _sql(R1Q, _CLS),
    "m2_classify_smooth": _sql(R3, _CLS),
    "m3_leads": _sql(R2, "SELECT * FROM leads", _LEADS),
    "m3_leads_ties": _sql(R1Q, "SELECT * FROM leads", _LEADS),
    "m4_next": _sql(R2, "SELECT * FROM nxt", _LEADS, _CHASE),
    "m5_chase": _sql(R2, "SELECT * FROM chase", _LEADS, _CHASE),
    "m6_saddles": _sql(R2, "SELECT * FROM split", _LEADS, _SADDLES),
    "m7_edges": _sql(R2, "SELECT * FROM edges", *_ALL),
    "m8_topology_counts": _sql(R2, "SELECT up, count(*) AS edges, count(DISTINCT row(sx, sy)) AS saddles FROM edges GROUP BY up", *_ALL),
    "p5_half_edges": _sql(R2, "SELECT px, py, tag, sx, sy, seq, up FROM halves WHERE px IS NOT NULL", *_ALL),
    "a4_rings": _sql(R2, "SELECT px, py, sx, sy, seq, up FROM halves WHERE px IS NOT NULL GROUP BY ALL HAVING count(*) = 2", *_ALL),
    "a7_connectors": _sql(
        R2,
        """SELECT up, lx, ly, hx, hy, s.sx AS sx, s.sy AS sy, s.seq AS seq FROM (
SELECT up, least(row(ax, ay), row(bx, "by")) AS l, greatest(row(ax, ay), row(bx, "by")) AS h, l[1] AS lx, l[2] AS ly, h[1] AS hx, h[2] AS hy,
       CASE WHEN up THEN arg_max({'sx': sx, 'sy': sy, 'seq': seq}, row(z, sx - sy, sx, seq)) ELSE arg_min({'sx': sx, 'sy': sy, 'seq': seq}, row(z, sx - sy, sx, seq)) END AS s
FROM edges JOIN cells ON cells.x = sx AND cells.y = sy WHERE ax IS NOT NULL AND bx IS NOT NULL AND NOT (ax = bx AND ay = "by") GROUP BY up, l, h)""",
        *_ALL,
    ),
    "a15_saddles_per_tile": _sql(R2, "SELECT x >> 4 AS tx, y >> 4 AS ty, up, count(*) AS n FROM (SELECT DISTINCT x, y, seq, up FROM split) GROUP BY ALL", _LEADS, _SADDLES),
    "j3_only_up": _sql(R2, "SELECT sx, sy, seq FROM edges WHERE up AND (sx, sy, seq) NOT IN (SELECT (sx, sy, seq) FROM edges WHERE NOT up)", *_ALL),
    "j4_anchors": _sql(R2, f"SELECT sx, sy, seq, tag, px AS qx, py AS qy FROM halves WHERE NOT up AND (sx, sy, seq) IN (SELECT (sx, sy, seq) FROM {_KEYS})", *_ALL),
}

_NET = (*_ALL, twins.GRAPH, twins.FACTS, twins.CHAINS.replace("{cutoff}", str(CUTOFF)))
_TREE = (*_NET, twins.TREE)
_LINED = (*_TREE, twins.WAYS, twins.TRACES, twins.LINES)
_TABLES = (*_LINED, twins.DOMAINS, twins.TABLES)
_IN_PREFIX = twins.MOST.format(type=1, low=ids.hex_limit(PREFIX, False), high=ids.hex_limit(PREFIX, True))
_FEATURES = f"""SELECT point, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || replace(regexp_extract(loc, '\\((.*)\\)', 1), ' ', ',') || ']}},"properties":{{"geo":"' || geo || '","prom_mm":' || prom_mm || ',"prom_class":' || prom_class || '}}}}' AS feature FROM ({_IN_PREFIX})"""
_TWINS = {
    "m12_drop_up": ('SELECT p, s, "drop", min_bound, notable FROM rel WHERE up', _NET),
    "m12_drop_down": ('SELECT p, s, "drop", min_bound, notable FROM rel WHERE NOT up', _NET),
    "m13_thresh": ("SELECT up, p, thresh FROM rel", _NET),
    "m14_pthresh": ("SELECT up, p, pthresh FROM rel WHERE notable", _NET),
    "m15_parent": ("SELECT up, p, parent FROM rel WHERE notable", _NET),
    "m16_elev_subsaddles": ("SELECT up, p, s FROM subs WHERE elev", _NET),
    "m17_drop_subsaddles": ("SELECT up, p, s FROM subs WHERE prom", _NET),
    "m18_bounds": ("SELECT up, min_bound, count(*) AS n FROM facts GROUP BY up, min_bound", _NET),
    "a3_rank": ("SELECT up, p, rank FROM ranks", _NET),
    "m19_tree": ("SELECT up, node, next, s, depth FROM arrow", _TREE),
    "m24_ways": ("SELECT up, p, target, array_to_string(lft, ',') AS \"left\", coalesce(array_to_string(rgt, ','), '') AS \"right\" FROM sides", (*_TREE, twins.WAYS)),
    "m29_pruned": ("SELECT up, src, arg_max(next, pos) AS dst, string_agg(CASE WHEN pos = 0 THEN CAST(s AS VARCHAR) ELSE node || ',' || s END, ',' ORDER BY pos) AS interim FROM leg GROUP BY up, src", (*_TREE, twins.WAYS, twins.PRUNED)),
    "m31_traces": ("SELECT x, y, seq, up, trace, replace(array_to_string(cells, ','), 'off', '') AS cells FROM traced", (*_TREE, twins.TRACES)),
    "m32_lines": ("SELECT up, p, target, replace(array_to_string(cells, ','), 'off', '') AS cells FROM lines", _LINED),
    "m28_domains": ("SELECT up, p, string_agg(array_to_string(nodes, ','), ';' ORDER BY s, t) AS lines FROM bounds GROUP BY up, p", (*_TREE, twins.DOMAINS)),
    "db_points": ("SELECT * FROM point_table", _TABLES),
    "db_prom": ("SELECT * FROM prom_table", _TABLES),
    "db_subsaddles": ("SELECT * FROM subsaddle_table", _TABLES),
    "m37_summits": (twins.MOST.format(type=1, low=-(2**63), high=2**63 - 1), _TABLES),
    "m37_sinks": (twins.MOST.format(type=-1, low=-(2**63), high=2**63 - 1), _TABLES),
    "m37_in_prefix": (_IN_PREFIX, _TABLES),
    "s19_features": (_FEATURES, _TABLES),
    "s19_collection": (f"SELECT '{{\"type\":\"FeatureCollection\",\"features\":[' || coalesce(string_agg(feature, ',' ORDER BY point), '') || ']}}' AS document FROM ({_FEATURES})", _TABLES),
    "m36_view": ("SELECT * FROM shown", (*_TABLES, twins.VIEW)),
    "j20_behind_saddles": ("SELECT point, saddle, prom_mm FROM prom_table WHERE saddle IN (SELECT saddle FROM mine)", (*_TABLES, twins.VIEW)),
}
_SLANTED = _LEADS.replace("CASE WHEN nx = x OR ny = y THEN 1.0::DOUBLE ELSE sqrt(2.0::DOUBLE) END", "CASE WHEN nx = x THEN 1.0::DOUBLE WHEN ny = y THEN cos(radians(y * 0.5)) ELSE sqrt(cos(radians(y * 0.5)) * cos(radians(y * 0.5)) + 1.0) END")
ORACLES |= {
    "m1_seam": f"WITH RECURSIVE {_ring(R4, NX)} SELECT c.x, c.y, o.i, {NX} AS nx, c.y + o.dy AS ny FROM cells c JOIN off o ON (c.x + c.y) % 2 = 0 OR o.i % 2 = 0",
    "m3_leads_geo": f"WITH RECURSIVE {_ring(R4, NX)}{_SLANTED} SELECT x, y, class, trace, up, bx, \"by\" FROM leads JOIN cls USING (x, y)",
    "f4_lat_lon": f"SELECT x, y, seq, 'POINT (' || regexp_replace(CAST(CAST(x * 0.5 AS DECIMAL(18,6)) AS VARCHAR), '\\.?0+$', '') || ' ' || regexp_replace(CAST(CAST(y * 0.5 + seq * 3e-6 AS DECIMAL(18,6)) AS VARCHAR), '\\.?0+$', '') || ')' AS loc FROM (SELECT *, CAST(-((x % 3 + 3) % 3) AS INT) AS seq FROM ({R4}))",
}
ORACLES |= {name: twins.packed(_sql(R2, select, *more)) for name, (select, more) in _TWINS.items()}
