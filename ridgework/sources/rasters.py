"""Rasters as rows: cells(x, y, z), from tables, from files of samples, and the catalog of raster files."""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgework.functions import ids

#: Test rasters, as SQL that Spark and DuckDB share but for the table's name.
R2_SQL = "SELECT CAST(o_orderkey % 128 AS INT) AS x, CAST({div} AS INT) AS y, o_totalprice AS z FROM {orders}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rough surface: one column of 64 cells per vector."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("x"), F.posexplode("embedding").alias("y", "v"))
    return e.select("x", F.col("y").cast("int").alias("y"), F.col("v").cast("double").alias("z"))


def r1q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 in about twenty levels, full of ties."""
    return r1(spark, sf_dir).withColumn("z", F.round(F.col("z") * 20).cast("int").cast("double"))


def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main surface; it grows with the scale factor."""
    o = read(spark, sf_dir, "orders")
    return o.select((F.col("o_orderkey") % 128).cast("int").alias("x"), F.expr("cast(o_orderkey div 128 as int)").alias("y"), F.col("o_totalprice").alias("z"))


def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smooth ramp with few peaks."""
    p = read(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") % 32).cast("int").alias("x"), F.expr("cast(p_partkey div 32 as int)").alias("y"), F.col("p_retailprice").alias("z"))


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_INT, _DBL, _STR, _BOOL = T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()
GRID = _struct(id=_INT, srs=_STR, spacing=_DBL, x_stretch=_DBL, subpx_offset=T.ArrayType(_DBL), origin_offset=T.ArrayType(_INT))
DEM = _struct(path=_STR, sidecars=T.ArrayType(_STR), grid_id=_INT, width=_INT, height=_INT, origin=T.ArrayType(_INT), flip_xy=_BOOL, inv_x=_BOOL, inv_y=_BOOL, bound=_STR, nodata=_DBL, z_unit=_DBL)
CATALOG = _struct(grids=T.ArrayType(GRID), dems=T.ArrayType(DEM))


def load_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(grids, dems) of a catalog file, with defaults filled in."""
    both = spark.read.schema(CATALOG).json(path, multiLine=True)
    grids = both.select(F.inline("grids")).withColumns({"x_stretch": F.coalesce("x_stretch", F.lit(1.0)), "origin_offset": F.coalesce("origin_offset", F.array(F.lit(0), F.lit(0)))})
    dems = both.select(F.inline("dems")).withColumns({"nodata": F.coalesce("nodata", F.lit(float("nan"))), "z_unit": F.coalesce("z_unit", F.lit(1.0)), **{c: F.coalesce(c, F.lit(False)) for c in ("flip_xy", "inv_x", "inv_y")}})
    return grids, dems


def describe(path: str, transform: tuple[float, ...], width: int, height: int, srs: str, bound: str | None = None, nodata: float | None = None, unit: str = "m", x_stretch: float = 1.0) -> dict:
    """A catalog entry from an affine pixel transform (x0, xx, xy, y0, yx, yy).

    The transform may be turned by a quarter and mirrored; spacing is the pixel's size along y.
    """
    x0, xx, xy, y0, yx, yy = transform
    flip = abs(xx) < abs(xy)
    dx, dy = (xy, yx) if flip else (xx, yy)
    spacing = abs(dy)
    cx, cy = (width, height) if not flip else (height, width)
    low_x, low_y = x0 if dx > 0 else x0 + dx * cx, y0 if dy > 0 else y0 + dy * cy
    gx, gy = low_x / (spacing * x_stretch) + 0.5, low_y / spacing + 0.5  # of the centre of the lowest pixel
    ox, oy = math.floor(gx + 1e-6), math.floor(gy + 1e-6)
    return {
        "path": path, "grid": {"srs": srs, "spacing": spacing, "x_stretch": x_stretch, "subpx_offset": [round(gx - ox, 6), round(gy - oy, 6)]}, "width": width, "height": height, "origin": [ox, oy],
        "flip_xy": flip, "inv_x": dx < 0, "inv_y": dy > 0, "bound": bound, "nodata": math.nan if nodata is None else nodata, "z_unit": {"m": 1.0, "ft": 0.3048}[unit],
    }


def index_catalog(spark: SparkSession, entries: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Number the distinct grids of described files and refer to them by id."""
    grids: dict[str, int] = {}
    rows = [{**{k: v for k, v in e.items() if k != "grid"}, "sidecars": e.get("sidecars", []), "grid_id": grids.setdefault(json.dumps(e["grid"], sort_keys=True), len(grids))} for e in sorted(entries, key=lambda e: e["path"])]
    g = [{**json.loads(k), "id": i, "origin_offset": [0, 0]} for k, i in grids.items()]
    return spark.createDataFrame(g, GRID), spark.createDataFrame(rows, DEM)


def files_of(spark: SparkSession, root: str, series: dict[str, str]) -> DataFrame:
    """S3: (series, path) of raster files by glob, in path order."""
    out = None
    for name, glob in sorted(series.items()):
        part = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root).select(F.lit(name).alias("series"), "path")
        out = part if out is None else out.union(part)
    return out.orderBy("series", "path")



#: Named regions.
REGIONS = {
    "global": "box:-180,180,-90,90",
    "northeast-us": "43.78696,-77.60742 45.33670,-75.25635 46.98025,-72.55371 48.06340,-70.18066 49.33944,-67.43408 49.53947,-65.14893 48.93693,-63.67676 47.78363,-61.10596 47.24941,-59.85352 46.10371,-59.15039 45.04248,-60.73242 43.27721,-65.45654 41.02964,-69.74121 40.22922,-73.23486 38.66836,-74.72900 38.73695,-75.47607 40.22922,-77.25586",
    "africa": "38.06539,11.51367 36.77409,-5.88867 27.21556,-15.24902 21.90228,-18.32520 11.43696,-17.70996 2.94304,-7.51465 -37.43997,18.45703 -34.74161,30.05859 -26.74561,48.69141 -13.41099,52.55859 13.75272,53.26172 16.46769,41.04492 32.62087,35.50781",
    "western-us": "48.90806,-123.35449 48.89362,-112.93945 45.84411,-108.30322 44.22946,-102.98584 40.81381,-101.16211 37.94420,-101.66748 34.37971,-101.95313 30.69461,-104.52393 31.54109,-108.85254 31.18461,-113.79639 31.24099,-117.39990 37.38762,-123.13477 43.22920,-125.39795",
    "satest": "-33.39476,17.64954 -34.60156,18.20984 -35.12440,19.91272 -34.37064,23.74695 -34.18909,26.12000 -32.99024,28.29529 -31.01057,30.58594 -29.95018,31.18469 -27.82450,30.21240 -26.98083,26.98242 -30.72295,20.86304 -29.89781,19.11621 -30.43447,17.10571",
}


def region_polygon(spec: str) -> list[tuple[float, float]] | None:
    """Corners (lon, lat) of a region given as box:x0,x1,y0,y1 or as lat,lon pairs; None for :global and the like."""
    spec = REGIONS.get(spec, spec)
    if spec.startswith(":"):
        return None
    if m := re.fullmatch(r"box:([^,]+),([^,]+),([^,]+),([^,]+)", spec):
        x0, x1, y0, y1 = map(float, m.groups())
        return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    pairs = [tuple(map(float, p.split(","))) for p in spec.split()]
    return [(lon, lat) for lat, lon in pairs]


def wkt_polygon(corners: list[tuple[float, float]]) -> str:
    ring = [*corners, corners[0]]
    return "POLYGON ((" + ", ".join(f"{x:g} {y:g}" for x, y in ring) + "))"


def wkt_corners(wkt: Column) -> Column:
    """array<struct<x, y>> of a polygon's outer ring."""
    return F.transform(F.split(F.regexp_extract(wkt, r"\(\(([^)]*)\)", 1), r",\s*"), lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y")))


def _crosses(a: tuple, b: tuple, p: Column, q: Column) -> Column:
    """Whether segment a-b, of numbers, meets segment p-q, of columns."""

    def side(ox, oy, px, py, qx, qy):
        return F.signum((px - ox) * (qy - oy) - (py - oy) * (qx - ox))

    ax, ay, bx, by = map(F.lit, (*a, *b))
    s1, s2 = side(ax, ay, bx, by, p["x"], p["y"]), side(ax, ay, bx, by, q["x"], q["y"])
    s3, s4 = side(p["x"], p["y"], q["x"], q["y"], ax, ay), side(p["x"], p["y"], q["x"], q["y"], bx, by)
    inside = (F.greatest(p["x"], q["x"]) >= F.least(ax, bx)) & (F.least(p["x"], q["x"]) <= F.greatest(ax, bx)) & (F.greatest(p["y"], q["y"]) >= F.least(ay, by)) & (F.least(p["y"], q["y"]) <= F.greatest(ay, by))
    return (s1 * s2 <= 0) & (s3 * s4 <= 0) & inside


def _side(a: tuple, b: tuple):
    return lambda s: _crosses(a, b, s["p"], s["q"])


def overlaps(bound: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a polygon (WKT) and a region meet: an edge crosses, or one holds a corner of the other."""
    ring = wkt_corners(bound)
    segs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    sides = list(zip(corners, [*corners[1:], corners[0]], strict=True))
    cross = F.lit(False)
    for a, b in sides:
        cross = cross | F.exists(segs, _side(a, b))

    def ray(x, y, p, q):
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], F.lit(1.0)).otherwise(q["y"] - p["y"]) + p["x"])

    holds = F.aggregate(segs, F.lit(False), lambda a, s: a != ray(F.lit(corners[0][0]), F.lit(corners[0][1]), s["p"], s["q"]))
    first, held = F.element_at(ring, 1), F.lit(False)
    for (px, py), (qx, qy) in sides:
        p, q = ({"x": F.lit(px), "y": F.lit(py)}, {"x": F.lit(qx), "y": F.lit(qy)})
        held = held != ray(first["x"], first["y"], p, q)
    return cross | holds | held


def select_dems(dems: DataFrame, region: str, series: str) -> DataFrame:
    """The files of a series whose bound meets the region; a region that begins with : is everywhere."""
    some, corners = dems.where(F.col("path").startswith(series + "/")), region_polygon(region)
    if corners is None:
        return some
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    ring = wkt_corners(F.col("bound"))
    near = (F.array_max(F.transform(ring, lambda p: p["x"])) >= min(xs)) & (F.array_min(F.transform(ring, lambda p: p["x"])) <= max(xs)) & (F.array_max(F.transform(ring, lambda p: p["y"])) >= min(ys)) & (F.array_min(F.transform(ring, lambda p: p["y"])) <= max(ys))
    return some.where(near).where(overlaps(F.col("bound"), corners))


def extent(dems: DataFrame) -> DataFrame:
    """dems with x0, x1, y0, y1, the grid cells that each file covers, ends included."""
    w, h = F.when(F.col("flip_xy"), F.col("height")).otherwise(F.col("width")), F.when(F.col("flip_xy"), F.col("width")).otherwise(F.col("height"))
    return dems.withColumns({"x0": F.col("origin")[0], "y0": F.col("origin")[1]}).withColumns({"x1": F.col("x0") + w - 1, "y1": F.col("y0") + h - 1})


def pages(extents: DataFrame, res: int, width: int | None = None) -> DataFrame:
    """A row (tile_x, tile_y) per tile that each extent overlaps; on a cylindrical grid of that width x wraps."""
    spans = F.array(F.struct(F.col("x0").alias("a"), F.col("x1").alias("b")))
    if width:
        low = ids.wrapped_x("x0", width)
        high = low + F.col("x1") - F.col("x0")
        edge = -(width // 2) + width - 1
        spans = F.when(high <= edge, F.array(F.struct(low.alias("a"), high.alias("b")))).otherwise(F.array(F.struct(low.alias("a"), F.lit(edge).alias("b")), F.struct(F.lit(-(width // 2)).alias("a"), (high - width).alias("b"))))
    rows = extents.withColumn("_s", F.explode(spans))
    rows = rows.withColumn("tile_x", F.explode(F.sequence(ids.tile(F.col("_s.a"), res), ids.tile(F.col("_s.b"), res)))).drop("_s")
    return rows.withColumn("tile_y", F.explode(F.sequence(ids.tile("y0", res), ids.tile("y1", res)))).distinct()


def read_raw(dems: DataFrame, root: str, glob: str = "*") -> DataFrame:
    """Raster rows (path, row, values) of headerless little-endian float32 files under root.

    A file that matches glob and is not in the catalog, a file of another size than its entry says, and
    an entry without a file are errors, so that no part of a raster is missing unnoticed.
    """
    files = dems.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    name = F.element_at(F.split("path", "/" + re.escape(root.rstrip("/").rsplit("/", 1)[-1]) + "/"), -1)
    absent = dems.select("path").join(files.select(name.alias("path")), "path", "left_anti").first()
    if absent is not None:
        raise FileNotFoundError(f"{absent.path} is in the catalog but not under {root}")
    held = files.select(name.alias("path"), "content").join(dems.select("path", "width", "height"), "path", "left")

    def rows(batches):
        for b in batches:
            for path, content, w, h in zip(*(b.column(c).to_pylist() for c in ("path", "content", "width", "height")), strict=True):
                if w is None or len(content) != 4 * w * h:
                    raise ValueError(f"{path}: {len(content)} bytes, not what the catalog says")
                v = np.frombuffer(content, "<f4").reshape(h, w)
                yield pa.RecordBatch.from_arrays([pa.array([path] * h), pa.array(np.arange(h), pa.int32()), pa.array(list(v), pa.list_(pa.float32()))], names=["path", "row", "values"])

    return held.mapInArrow(rows, "path string, row int, values array<float>")


def samples(rasters: DataFrame, dems: DataFrame, ocean: bool = True) -> DataFrame:
    """(grid_id, x, y, z, path) from raster rows (path, row, values array<float>) and their catalog.

    Row 0 is the northern edge unless the file is inverted; no-data becomes null or, as ocean, 0 m.
    """
    d = rasters.join(dems, "path")
    cell = d.select("*", F.posexplode("values").alias("col", "v"))
    px, py = F.col("col"), F.col("row")
    across = F.when(F.col("flip_xy"), py).otherwise(px)
    down = F.when(F.col("flip_xy"), px).otherwise(py)
    w = F.when(F.col("flip_xy"), F.col("height")).otherwise(F.col("width"))
    h = F.when(F.col("flip_xy"), F.col("width")).otherwise(F.col("height"))
    x = F.when(F.col("inv_x"), w - 1 - across).otherwise(across)
    y = F.when(F.col("inv_y"), down).otherwise(h - 1 - down)
    v = F.col("v").cast("float")
    z = F.when(F.isnan(v) | (v.cast("double") == F.col("nodata")), None).otherwise((v * F.col("z_unit")).cast("float"))
    return cell.select("grid_id", (F.col("origin")[0] + x).alias("x"), (F.col("origin")[1] + y).alias("y"), (F.coalesce(z, F.lit(0.0).cast("float")) if ocean else z).alias("z"), "path")


def overlaid(cells: DataFrame) -> DataFrame:
    """T5: one height per cell; of overlapping files the last path with data there wins, of one path the highest."""
    return cells.where("z is not null").groupBy("grid_id", "x", "y").agg(F.max_by("z", F.struct("path", "z")).alias("z"))
