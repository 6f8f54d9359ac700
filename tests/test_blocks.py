import random

import pytest
from test_terrain import raster, rough

from ridgework.operators import blocks, network
from ridgework.plans.terrain import Terrain

pack = lambda x, y: x << 28 | y << 4


@pytest.mark.parametrize("side", [1, 8])
def test_ways_over_blocks(spark, monkeypatch, side):
    """Ranks, ways and meeting points of a long way, bushy trees and lone nodes, however many blocks they cross."""
    monkeypatch.setattr(blocks, "SIDE", side)
    r = random.Random(7)
    place = [pack(i % 20, i // 20) for i in range(300)]
    up = {i: i - 1 for i in range(1, 100)} | {i: r.choice([r.randrange(100, i), max(100, i - r.randrange(1, 4))]) for i in range(101, 290)}
    way = lambda i: [i, *way(up[i])] if i in up else [i]
    ptr = spark.createDataFrame([(True, place[i], place[up[i]] if i in up else None) for i in range(300)], "up boolean, node long, next long")
    ways = blocks.Ways(ptr)
    assert {(x.node, x.root, x.depth) for x in ways.rank.collect()} == {(place[i], place[way(i)[-1]], len(way(i)) - 1) for i in range(300)}
    legs = [(True, i, place[i], r.randrange(1, len(way(i)) + 1)) for i in range(300)]
    got = ways.lists(spark.createDataFrame(legs, "up boolean, id long, node long, n long"), ["id"], "nodes")
    assert {x.id: x.nodes for x in got.collect()} == {i: [place[v] for v in way(i)[:n]] for _, i, _, n in legs}
    pairs = {(r.randrange(300), r.randrange(300)) for _ in range(900)} | {(5, 5), (99, 0), (0, 99), (295, 296), (295, 295)}
    want = {}
    for a, b in pairs:
        at = next((v for v in way(a) if v in way(b)), None)
        if at is not None:
            want[place[a], place[b]] = (place[at], way(a).index(at), way(b).index(at))
    got = ways.meets(spark.createDataFrame([(True, place[a], place[b]) for a, b in pairs], "up boolean, a long, b long"))
    assert {(x.a, x.b): (x.meet, x.i, x.j) for x in got.collect()} == want


@pytest.mark.parametrize("levels", [None, 3])
def test_result_does_not_depend_on_blocks(spark, monkeypatch, levels):
    cells, seen = raster(spark, rough(15, 5, levels)), []
    for side in (8, 1):
        monkeypatch.setattr(blocks, "SIDE", side)
        t = Terrain(cells, 0.1)
        seen.append([sorted(map(str, df.collect())) for df in (t.edges, t.facts, t.traces, t.prom_table())])
    assert seen[0] == seen[1]
    chased = network.edges(cells, t.classes, t.leads)  # by rounds
    assert sorted(map(str, chased.select(*t.edges.columns).collect())) == seen[0][0]


def test_prom_chases_no_cell_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(network, "chase", None)
    seen, rank = [], blocks.forest.ranked
    monkeypatch.setattr(blocks.forest, "ranked", lambda ptr: seen.append(ptr.count()) or rank(ptr))
    t = Terrain(raster(spark, rough(12, 8)), 0.1)
    assert t.prom_table().count()
    nodes = t.graph.selectExpr("explode(array(a, b)) as v").where("v is not null").distinct().count()
    assert t.cell_ways.gates.count() == 0 and max(seen) < 4 * nodes  # all else lies in one block
