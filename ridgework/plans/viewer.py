"""Queries of the published tables: one peak with all around it, and the greatest peaks of a region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgework.functions import ids

#: Fixed value: rows of the list of peaks unless the caller says otherwise.
MOST = 5000


def register(points: DataFrame, prom: DataFrame, subsaddles: DataFrame) -> None:
    """The tables as views, for SQL."""
    points.createOrReplaceTempView("points")
    prom.createOrReplaceTempView("prom")
    subsaddles.createOrReplaceTempView("subsaddles")


def geometry(wkt: Column) -> Column:
    """A point or line as GeoJSON text; null without one."""
    inside = F.regexp_extract(wkt, r"\((.*)\)", 1)
    pairs = F.regexp_replace(F.regexp_replace(inside, ", ", "],["), " ", ",")
    return F.when(wkt.startswith("POINT"), F.concat(F.lit('{"type":"Point","coordinates":['), pairs, F.lit("]}"))).when(wkt.startswith("LINESTRING"), F.concat(F.lit('{"type":"LineString","coordinates":[['), pairs, F.lit("]]}")))


def feature(wkt: Column, **properties: Column | str) -> Column:
    """One GeoJSON feature as text, with its geometry and properties."""
    props = F.to_json(F.struct(*[(v if isinstance(v, Column) else F.col(v)).alias(k) for k, v in properties.items()]))
    return F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(geometry(wkt), F.lit("null")), F.lit(',"properties":'), props, F.lit("}"))


def collection(features: DataFrame, order: str, feature_col: str = "feature") -> DataFrame:
    """The features of a view, MOST of them unless its caller asked for more, as one GeoJSON document."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, feature_col))), lambda x: x[feature_col])
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(listed, ","), F.lit("]}")).alias("document"))


def peaks_in(points: DataFrame, prom: DataFrame, prefix: str = "", up: bool = True, most: int = MOST) -> DataFrame:
    """The greatest peaks whose id begins with the hex prefix."""
    p = prom.join(points.where(F.col("type") == (1 if up else -1)), F.col("point") == F.col("geocode"))
    p = p.where(F.col("point").between(ids.hex_limit(prefix, False), ids.hex_limit(prefix, True)))
    top = p.orderBy(F.desc("prom_mm"), "point").limit(most)
    return top.select("point", ids.hex_id("point").alias("geo"), "loc", "elev_mm", "prom_mm", "min_bound", ids.feet_class(ids.feet("prom_mm")).alias("prom_class"))


def around(points: DataFrame, prom: DataFrame, subsaddles: DataFrame, point: int) -> DataFrame:
    """(kind, ix, point, saddle, prom_mm, path) of a peak, its parents, children and secondary saddles.

    A missing peak gives no rows, and missing paths are null.
    """
    me = prom.where(F.col("point") == point)
    cols = ["point", "saddle", "prom_mm", "thresh_path", "parent_path", "domain"]
    row = lambda df, kind, path, ix=None: df.select(F.lit(kind).alias("kind"), (ix if ix is not None else F.lit(0)).cast("int").alias("ix"), "point", "saddle", "prom_mm", F.col(path).alias("path"))
    from pyspark.sql import Window

    kids = prom.where(F.col("prom_parent") == point)
    out = row(me, "peak", "thresh_path").union(row(me, "domain", "domain"))
    for kind, c in (("parent", "prom_parent"), ("pthresh", "line_parent")):
        who = me.where(F.col(c).isNotNull()).select(F.col(c).alias("_w"))
        out = out.union(row(prom.join(F.broadcast(who), F.col("point") == F.col("_w"), "left_semi"), kind, "parent_path"))  # one row
    out = out.union(row(kids.select(*cols, F.row_number().over(Window.orderBy("prom_rank")).alias("_i")), "child", "parent_path", F.col("_i")))
    ss = subsaddles.where(F.col("point") == point)
    behind = prom.join(ss.select("saddle"), "saddle", "left_semi")
    out = out.union(row(behind, "subsaddle peak", "thresh_path"))
    sub = ss.select(F.explode(F.array(F.when(F.col("is_elev") == 1, "elev"), F.when(F.col("is_prom") == 1, "prom"))).alias("k"), "point", "saddle").where("k is not null")
    return out.union(sub.select(F.concat(F.lit("subsaddle "), "k"), F.lit(0), "point", "saddle", F.lit(None).cast("int"), F.lit(None).cast("string")))


def around_sql(spark: SparkSession, point: int) -> DataFrame:
    """The peaks behind a peak's secondary saddles, in SQL over the registered views."""
    return spark.sql("SELECT point, saddle, prom_mm FROM prom WHERE saddle IN (SELECT saddle FROM subsaddles WHERE point = :p) ORDER BY prom_mm DESC, point", args={"p": point})
