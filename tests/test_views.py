import pytest
from test_terrain import raster, rough

from ridgework.operators import mesh
from ridgework.plans import catalogue
from ridgework.plans.terrain import Terrain

#: What only paths and boundaries need; a view without them computes none of it.
LINES = {"tree", "ways_up", "between", "traces", "lines", "thresh_lines", "domains"}


@pytest.fixture(scope="module")
def terrain(spark):
    return Terrain(raster(spark, rough(16, 9)), 0.3)


@pytest.mark.parametrize("name", ["j20_behind_saddles", "m37_sinks", "m37_summits", "m37_in_prefix", "s19_features", "s19_collection"])
def test_no_lines_for_numbers(spark, terrain, monkeypatch, name):
    for made in LINES & set(vars(terrain)):
        delattr(terrain, made)
    monkeypatch.setattr(catalogue, "terrain", lambda spark, sf_dir: terrain)
    catalogue.QUERIES[name](spark, "").collect()
    assert not LINES & set(vars(terrain))


def test_a_place_given_twice_counts_once(spark):
    z = rough(5, 3)
    cells = raster(spark, z)
    twice = cells.union(cells.where("x = 2 and y = 2").selectExpr("x", "y", "z - 1"))
    rows = [sorted(map(tuple, mesh.classify(c).select("x", "y", "z", "class").collect())) for c in (cells, twice)]
    assert rows[0] == rows[1]


def test_view_makes_prom_once(spark, terrain, monkeypatch):
    made, make = [], Terrain.prom_table
    monkeypatch.setattr(Terrain, "prom_table", lambda self: made.append(1) or make(self))
    monkeypatch.setattr(catalogue, "terrain", lambda spark, sf_dir: terrain)
    paths = catalogue.m36_view(spark, "").inputFiles()
    assert len(made) == 1 and any("/t-prom-" in p for p in paths)
