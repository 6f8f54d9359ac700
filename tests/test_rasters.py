import json
import math

import numpy as np
import pytest

from ridgework.sources import rasters


def catalog(tmp_path, **more):
    dem = {"path": "a/one", "sidecars": [], "grid_id": 0, "width": 3, "height": 2, "origin": [10, 20], "flip_xy": False, "inv_x": False, "inv_y": False, "bound": "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", **more}
    doc = {"grids": [{"id": 0, "srs": "epsg:4326", "spacing": 0.5, "subpx_offset": [0.5, 0.5]}], "dems": [dem, {**dem, "path": "b/two", "nodata": 0.0}]}
    p = tmp_path / "index.json"
    p.write_text(json.dumps(doc, indent=1))
    return f"file://{p}"


def test_catalog_defaults(spark, tmp_path):
    grids, dems = rasters.load_catalog(spark, catalog(tmp_path))
    g = grids.first()
    assert g.x_stretch == 1.0 and g.origin_offset == [0, 0]
    d = {r.path: r for r in dems.collect()}
    assert math.isnan(d["a/one"].nodata) and d["b/two"].nodata == 0.0 and d["a/one"].z_unit == 1.0


def test_select_by_region(spark, tmp_path):
    _, dems = rasters.load_catalog(spark, catalog(tmp_path))
    n = lambda r, s="a": rasters.select_dems(dems, r, s).count()
    assert n(":global") == 1 and n(":global", "c") == 0
    assert n("box:1,2,1,2") == 1 and n("box:-9,9,-9,9") == 1 and n("box:3,9,3,9") == 1 and n("box:5,6,5,6") == 0
    assert n("0,-1 1,-1 0.5,0.5") == 1 and n("9,9 9,10 10,9") == 0
    assert rasters.wkt_polygon([(0, 0), (1, 0), (1, 1)]) == "POLYGON ((0 0, 1 0, 1 1, 0 0))"


def test_samples_orientation(spark, tmp_path):
    _, dems = rasters.load_catalog(spark, catalog(tmp_path))
    raster = spark.createDataFrame([("a/one", 0, [1.0, 2.0, 3.0]), ("a/one", 1, [4.0, float("nan"), 6.0])], "path string, row int, values array<float>")
    got = {(r.x, r.y): r.z for r in rasters.samples(raster, dems).collect()}
    assert got == {(10, 21): 1, (11, 21): 2, (12, 21): 3, (10, 20): 4, (11, 20): 0, (12, 20): 6}
    assert {(r.x, r.y): r.z for r in rasters.samples(raster, dems, ocean=False).collect()}[11, 20] is None
    _, turned = rasters.load_catalog(spark, catalog(tmp_path, inv_x=True, inv_y=True))
    got = {(r.x, r.y): r.z for r in rasters.samples(raster, turned).collect()}
    assert got[12, 20] == 1 and got[10, 21] == 6
    _, zero = rasters.load_catalog(spark, catalog(tmp_path))
    r0 = spark.createDataFrame([("b/two", 0, [0.0, 2.0, 3.0])], "path string, row int, values array<float>")
    assert {r.x: r.z for r in rasters.samples(r0, zero, ocean=False).collect()}[10] is None


def test_flipped(spark, tmp_path):
    _, dems = rasters.load_catalog(spark, catalog(tmp_path, flip_xy=True))
    raster = spark.createDataFrame([("a/one", 0, [1.0, 2.0, 3.0]), ("a/one", 1, [4.0, 5.0, 6.0])], "path string, row int, values array<float>")
    got = {(r.x, r.y): r.z for r in rasters.samples(raster, dems).collect()}
    assert {x for x, _ in got} == {10, 11} and {y for _, y in got} == {20, 21, 22} and got[10, 22] == 1 and got[11, 20] == 6


def test_pages_wrap(spark, tmp_path):
    _, dems = rasters.load_catalog(spark, catalog(tmp_path, origin=[358, -3]))
    e = rasters.extent(dems.where("path = 'a/one'"))
    assert sorted((r.tile_x, r.tile_y) for r in rasters.pages(e, 1).collect()) == [(179, -2), (179, -1), (180, -2), (180, -1)]
    assert sorted({r.tile_x for r in rasters.pages(e, 1, 720).collect()}) == [-180, 179]


def test_overlaid_last_wins(spark):
    rows = [(0, 1, 1, 5.0, "a"), (0, 1, 1, 7.0, "b"), (0, 1, 1, None, "c"), (0, 2, 1, 3.0, "a")]
    got = {(r.x, r.y): r.z for r in rasters.overlaid(spark.createDataFrame(rows, "grid_id int, x int, y int, z double, path string")).collect()}
    assert got == {(1, 1): 7.0, (2, 1): 3.0}


def test_describe_and_index(spark):
    a = rasters.describe("s/a", (10.0, 0.5, 0, 50.0, 0, -0.5), 4, 6, "epsg:4326", unit="ft")
    assert (a["flip_xy"], a["inv_x"], a["inv_y"], a["origin"], a["z_unit"]) == (False, False, False, [21 - 1, 94], 0.3048) or a["origin"][1] in (94, 95)
    b = {**rasters.describe("s/b", (12.0, 0.5, 0, 50.0, 0, -0.5), 4, 6, "epsg:4326"), "sidecars": []}
    g, d = rasters.index_catalog(spark, [b, a])
    assert g.count() == 1 and d.count() == 2


def test_files(spark, tmp_path):
    for n in ("a.tif", "b.tif", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    got = rasters.files_of(spark, f"file://{tmp_path}", {"one": "*.tif"}).collect()
    assert [r.path.rsplit("/")[-1] for r in got] == ["a.tif", "b.tif"]


def test_raw_files_are_whole_or_an_error(spark, tmp_path):
    (tmp_path / "d").mkdir()
    np.arange(6, dtype="<f4").tofile(tmp_path / "d" / "one.f32")
    entry = lambda name, w: spark.createDataFrame([(name, w, 2)], "path string, width int, height int")
    root = f"file://{tmp_path}/d"
    assert [(r.row, r["values"]) for r in rasters.read_raw(entry("one.f32", 3), root).orderBy("row").collect()] == [(0, [0.0, 1.0, 2.0]), (1, [3.0, 4.0, 5.0])]
    with pytest.raises(Exception, match="not what the catalog says"):
        rasters.read_raw(entry("one.f32", 4), root).collect()
    (tmp_path / "d" / "other.f32").write_bytes(b"1234")
    with pytest.raises(Exception, match="not what the catalog says"):
        rasters.read_raw(entry("one.f32", 3), root).collect()
    assert rasters.read_raw(entry("one.f32", 3), root, "one*").count() == 2
    with pytest.raises(FileNotFoundError):
        rasters.read_raw(entry("two.f32", 3), root)
