"""The whole computation, from cells to the published tables, with each step's table kept for the next."""

from __future__ import annotations

import sqlite3
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgework.functions import geocode, ids
from ridgework.functions.store import materialize
from ridgework.operators import blocks, mesh, network, paths, peaks


@dataclass
class Terrain:
    """Results over one raster; each is computed when first asked for and then read from its table."""

    cells: DataFrame
    cutoff: float
    grid: mesh.Grid | None = None  # of a geographic raster: neighbours over its seam, true steepness, degrees in the tables

    @cached_property
    def classes(self) -> DataFrame:
        return materialize(mesh.classify(self.cells, self.grid), "t-classes")

    @cached_property
    def leads(self) -> DataFrame:
        return materialize(mesh.leads(self.classes, self.grid), "t-leads")

    @cached_property
    def cell_ways(self) -> blocks.Ways:
        """The ways of all cells, followed once for edges and traces."""
        return network.cell_ways(self.classes, self.leads)

    @cached_property
    def edges(self) -> DataFrame:
        return materialize(network.edges(self.cells, self.classes, self.leads, ways=self.cell_ways), "t-edges")

    @cached_property
    def graph(self) -> DataFrame:
        return materialize(peaks.graph(self.edges), "t-graph")

    @cached_property
    def facts(self) -> DataFrame:
        return materialize(peaks.facts(self.graph), "t-facts")

    @cached_property
    def points(self) -> DataFrame:
        return materialize(peaks.points(self.graph), "t-points")

    @cached_property
    def relations(self) -> DataFrame:
        return materialize(peaks.relations(self.graph, self.cutoff, self.facts, self.points), "t-relations")

    @cached_property
    def ranks(self) -> DataFrame:
        return materialize(peaks.ranked(self.relations, self.points), "t-ranks")

    @cached_property
    def tree(self) -> DataFrame:
        return materialize(peaks.tree(self.graph, self.facts), "t-tree")

    @cached_property
    def ways(self) -> blocks.Ways:
        """The ways of the tree, followed once for all that asks."""
        return blocks.Ways(self.tree)

    @cached_property
    def tasks(self) -> DataFrame:
        """(up, p, kind, target) of notable peaks."""
        both = F.array(F.struct(F.lit("thresh").alias("kind"), F.col("thresh").alias("target")), F.struct(F.lit("parent").alias("kind"), F.col("parent").alias("target")))
        return self.relations.where("notable").select("up", "p", F.explode(both).alias("t")).select("up", "p", "t.*")

    @cached_property
    def ways_up(self) -> DataFrame:
        """Ways to the root of what domains start from."""
        pid = lambda x, y: F.when(F.col(x).isNotNull(), ids.pack(0, x, y))
        used = self.relations.where("notable").select((~F.col("up")).alias("up"), "s").union(self.relations.select((~F.col("up")).alias("up"), F.explode("subs").alias("x")).where("x.prom").select("up", "x.s")).distinct()
        anch = self.edges.select("up", ids.pack(0, "sx", "sy", "seq").alias("s"), F.explode(F.array(pid("ax", "ay"), pid("bx", "by"))).alias("start")).where("start is not null").join(used, ["up", "s"], "left_semi").select("up", "start")
        return materialize(paths.chains_of(self.tree, anch, self.ways), "t-ways")

    @cached_property
    def between(self) -> DataFrame:
        return materialize(paths.between(self.tree, self.tasks, self.ways), "t-between")

    @cached_property
    def pruned(self) -> DataFrame:
        keys = self.tasks.select("up", F.explode(F.array("p", "target")).alias("node")).where("node is not null").distinct()
        return materialize(paths.pruned(self.tree, keys), "t-pruned")

    @cached_property
    def traces(self) -> DataFrame:
        used = self.tree.where("s is not null").select(*[c.alias(n) for n, c in ids.unpack("s").items() if n != "grid"], "up").distinct()
        split = mesh.split_saddles(self.leads).join(used, ["x", "y", "seq", "up"], "left_semi")
        return materialize(paths.traces(split, self.cell_ways, self.classes), "t-traces")

    @cached_property
    def lines(self) -> DataFrame:
        return materialize(paths.detailed(self.between, self.tree, paths.hops(self.edges, self.traces)), "t-lines")

    @cached_property
    def thresh_lines(self) -> DataFrame:
        """The lines to the next higher peak, up to where they reach this peak's height."""
        of = self.tasks.where("kind = 'thresh'").select("up", "p", "target")
        return materialize(paths.trimmed(self.lines.join(of, ["up", "p", "target"], "left_semi"), mesh.present(self.cells)), "t-thresh-lines")

    def _line(self, points: Column) -> Column:
        """Points of the grid as text, in degrees on a geographic one."""
        if self.grid is not None:
            points = F.transform(points, lambda e: F.when(e["x"].isNotNull(), F.struct((e["x"] * self.grid.spacing).alias("x"), (e["y"] * self.grid.spacing).alias("y"))))
        return geocode.wkt_line(points)

    @cached_property
    def domains(self) -> DataFrame:
        return materialize(paths.domains(self.relations, self.edges, self.ways_up), "t-domains")

    def point_table(self) -> DataFrame:
        """points(geocode, type, elev_mm, isodist_cm, elev_rank, loc)."""
        r = self.relations.where("notable")
        used = r.select("up", F.col("p").alias("id"), F.lit(1).alias("t")).union(r.select("up", "s", F.lit(0)))
        for c in ("thresh", "pthresh", "parent"):
            used = used.union(r.where(F.col(c).isNotNull()).select("up", F.col(c), F.lit(1)))
        used = used.groupBy("up", "id").agg(F.max("t").alias("t"))
        k = used.join(self.points, ["up", "id"])
        sign = F.when(F.col("up"), 1).otherwise(-1)
        xy = ids.unpack("id")
        iso = (F.col("key.iso") * sign).cast("long")
        cm = F.when(iso == 0, 0).when(iso > 0, iso - 2147483647).otherwise(iso + 2147483647 + 1).cast("int")
        where = geocode.wkt_point(xy["x"], xy["y"])
        if self.grid is not None:
            lat, lon = ids.lat_lon(xy["x"], xy["y"], self.grid.spacing, seq=xy["seq"])
            where = geocode.wkt_point(lon, lat)
        out = k.select(F.col("id").alias("geocode"), (F.col("t") * sign).cast("int").alias("type"), ids.millimetres(F.col("key.z") * sign).alias("elev_mm"), cm.alias("isodist_cm"), F.lit(-1).alias("elev_rank"), where.alias("loc"))
        return out.distinct()  # a saddle of both directions is one row

    def prom_facts(self) -> DataFrame:
        """prom's columns that need no tree and no lines: (point, saddle, prom_mm, min_bound, prom_parent, line_parent)."""
        r = self.relations.where("notable")
        return r.select(F.col("p").alias("point"), F.col("s").alias("saddle"), ids.millimetres("drop").alias("prom_mm"), F.col("min_bound").cast("int").alias("min_bound"), F.col("parent").alias("prom_parent"), F.col("pthresh").alias("line_parent"))

    def prom_table(self) -> DataFrame:
        """prom(point, saddle, prom_mm, prom_rank, min_bound, prom_parent, line_parent, thresh_path, parent_path, domain)."""
        r = self.relations.where("notable").join(self.ranks, ["up", "p"])
        parent = self.lines.join(self.tasks.where("kind = 'parent'").select("up", "p", "target"), ["up", "p", "target"], "left_semi").select("up", "p", self._line(F.col("cells")).alias("parent_path"))
        thresh = self.thresh_lines.select("up", "p", self._line(F.col("points")).alias("thresh_path"))
        node = lambda v: F.struct(*[ids.unpack(v)[k].alias(k) for k in ("x", "y")])
        domain = self.domains.select("up", "p", F.transform("lines", lambda ln: self._line(F.transform(F.filter(ln, lambda v: v != -1), node))).alias("domain"))
        out = r.join(thresh, ["up", "p"], "left").join(parent, ["up", "p"], "left").join(domain, ["up", "p"], "left")
        return out.select(F.col("p").alias("point"), F.col("s").alias("saddle"), ids.millimetres("drop").alias("prom_mm"), F.col("rank").cast("int").alias("prom_rank"), F.col("min_bound").cast("int").alias("min_bound"), F.col("parent").alias("prom_parent"), F.col("pthresh").alias("line_parent"), "thresh_path", "parent_path", F.array_join("domain", "; ").alias("domain"))

    @cached_property
    def prom(self) -> DataFrame:
        """prom_table(), kept for queries that read it more than once."""
        return materialize(self.prom_table(), "t-prom")

    def subsaddle_table(self) -> DataFrame:
        """subsaddles(point, saddle, is_elev, is_prom)."""
        x = self.relations.select(F.explode("subs").alias("x")).select("x.*")
        return x.groupBy(F.col("p").alias("point"), F.col("s").alias("saddle")).agg(F.max(F.col("elev").cast("int")).alias("is_elev"), F.max(F.col("prom").cast("int")).alias("is_prom"))

    def publish(self, out: str) -> None:
        """The three tables as Parquet, sorted for lookups by id and by height."""
        self.point_table().repartitionByRange("geocode").sortWithinPartitions("geocode").write.mode("overwrite").parquet(f"{out}/points")
        self.prom_table().repartitionByRange("point").sortWithinPartitions("point").write.mode("overwrite").parquet(f"{out}/prom")
        self.subsaddle_table().repartitionByRange("point").sortWithinPartitions("point", "saddle").write.mode("overwrite").parquet(f"{out}/subsaddles")


    def debug(self, out: str) -> None:
        """The tree's hops and the points of each step as text geometries, per direction."""
        xy = lambda c: tuple(ids.unpack(c)[k] for k in ("x", "y"))
        ends = lambda df, a, b: df.where(f"{b} is not null").select("up", geocode.wkt_line(F.array(*[F.struct(xy(c)[0].alias("x"), xy(c)[1].alias("y")) for c in (a, b)])).alias("geometry"))
        at = lambda df, c: df.where(f"{c} is not null").select("up", geocode.wkt_point(*xy(c)).alias("geometry"))
        dumps = {"fullmst": ends(self.tree, "node", "next"), "pmst": ends(self.pruned, "src", "dst"), "keypoints": at(self.tasks.select("up", F.explode(F.array("p", "target")).alias("id")).distinct(), "id"), "saddles": at(self.relations.where("notable").select("up", "s"), "s")}
        for name, df in dumps.items():
            df.write.mode("overwrite").partitionBy("up").parquet(f"{out}/{name}")


INDEXES = [("points", "geocode"), ("points", "elev_mm"), ("prom", "point"), ("prom", "saddle"), ("prom", "prom_mm"), ("prom", "prom_parent"), ("prom", "line_parent"), ("subsaddles", "point"), ("subsaddles", "saddle")]


def export_sqlite(tables: dict[str, DataFrame], path: str, batch: int = 5000) -> None:
    """A SQLite file on the driver from published tables, in batches, one commit, indexes last."""
    con = sqlite3.connect(path)
    try:
        for name, df in tables.items():
            con.execute(f"create table {name} ({', '.join(df.columns)})")
            rows = []
            for r in df.toLocalIterator():
                rows.append(tuple(r))
                if len(rows) == batch:
                    con.executemany(f"insert into {name} values ({', '.join('?' * len(df.columns))})", rows)
                    rows = []
            con.executemany(f"insert into {name} values ({', '.join('?' * len(df.columns))})", rows)
        con.commit()
        for t, c in INDEXES:
            if t in tables:
                con.execute(f"create index {t}_{c} on {t}({c})")
        con.commit()
    finally:
        con.close()
