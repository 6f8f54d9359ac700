import struct

import pytest

from ridgework import cli
from ridgework.functions import bounds
from ridgework.sources import rasters


def test_stages(spark, tmp_path):
    out = f"file://{tmp_path}"
    z = [(x, y, float((x * 7 + y * 13 + x * y * 5) % 23)) for x in range(14) for y in range(14)]
    spark.createDataFrame(z, "x int, y int, z double").write.parquet(f"{out}/cells")
    cli.main([f"{out}/cells", f"{out}/full", "--cutoff", "2", "--debug"])
    for stage in ("topo", "prom", "path", "db"):
        cli.main([f"{out}/cells", f"{out}/steps", "--cutoff", "2", "--stage", stage])
    for t in ("points", "prom", "subsaddles", "edges", "relations"):
        a, b = (sorted(map(str, spark.read.parquet(f"{out}/{k}/{t}").collect())) for k in ("full", "steps"))
        assert a == b and a
    assert spark.read.parquet(f"{out}/full/debug/fullmst").count() > 0


def test_grids_do_not_fall_on_one_another(spark, tmp_path, monkeypatch):
    dems = spark.createDataFrame([("a", 0), ("b", 1)], "path string, grid_id int")
    monkeypatch.setattr(rasters, "load_catalog", lambda *a: (None, dems))
    monkeypatch.setattr(rasters, "select_dems", lambda d, *a: d)
    with pytest.raises(SystemExit, match="choose one"):
        cli.main(["nowhere", f"file://{tmp_path}", "--index", "i"])


def test_raw_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one").write_bytes(struct.pack("<6f", 1, 2, 3, 4, 5, 6))
    (tmp_path / "a" / "bad").write_bytes(b"12")
    e = [{**rasters.describe(f"a/{n}", (0.0, 1.0, 0, 2.0, 0, -1.0), 3, 2, "epsg:4326"), "sidecars": []} for n in ("one", "bad")]
    _, dems = rasters.index_catalog(spark, e)
    with pytest.raises(Exception, match="not what the catalog says"):
        rasters.read_raw(dems, f"file://{tmp_path}").collect()
    (tmp_path / "a" / "bad").unlink()
    rows = rasters.read_raw(dems.where("path = 'a/one'"), f"file://{tmp_path}")
    assert {(r.path, r.row): list(r["values"]) for r in rows.collect()} == {("a/one", 0): [1, 2, 3], ("a/one", 1): [4, 5, 6]}
    assert rasters.samples(rows, dems).count() == 6


def test_outline():
    east = lambda q: (q[0] % 360, q[1])
    square = [(170.0, 0.0), (190.0, 0.0), (190.0, 10.0), (170.0, 10.0)]
    assert bounds.outline(square, lambda p: ((p[0] + 180) % 360 - 180, p[1]), east, 1e-6) == bounds.unwrapped(square)
    assert bounds.lon_near(-179.0, 179.0) == 181.0
    import math

    polar = lambda p: (math.degrees(math.atan2(p[1], p[0])), 90 - math.hypot(*p))
    back = lambda q: ((90 - q[1]) * math.cos(math.radians(q[0])), (90 - q[1]) * math.sin(math.radians(q[0])))
    ring = bounds.outline([(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0)], polar, back, 0.01)
    assert max(lat for _, lat in ring) == 90.0 and max(x for x, _ in ring) - min(x for x, _ in ring) == pytest.approx(360)
