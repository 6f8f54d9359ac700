import random

import pytest
from pyspark.sql import functions as F
from reference_model import classify, edges, leads, search

from ridgework.functions import ids
from ridgework.operators import forest, mesh, network, paths, peaks
from ridgework.plans.terrain import Terrain


def raster(spark, z):
    return spark.createDataFrame([(x, y, float(v)) for (x, y), v in z.items()], "x int, y int, z double")


def cones():
    return {(x, y): float(max(100 - 10 * (abs(x - 1) + abs(y - 3)), 80 - 10 * (abs(x - 5) + abs(y - 3)))) for x in range(7) for y in range(7)}


def rough(n, seed, levels=None):
    r = random.Random(seed)
    return {(x, y): float(r.randrange(levels) if levels else r.random()) for x in range(n) for y in range(n)}


def monkey():
    return {(x, y): 0.0 if (x, y) == (2, 2) else (1.0 if (x - 2) * (y - 2) == 0 else -1.0) for x in range(1, 4) for y in range(1, 4)}


@pytest.mark.parametrize("z", [cones(), monkey(), rough(14, 1), rough(14, 2, 4), rough(12, 3, 2), {(0, 0): 1.0}], ids=["cones", "monkey", "rough", "ties", "flat", "one"])
def test_classes_leads_edges(spark, z):
    cells = raster(spark, z)
    c = mesh.classify(cells)
    assert {(r.x, r.y): r["class"] for r in c.collect()} == {k: classify(k, z) for k in z}
    got = {(r.x, r.y, r.trace): (r.up, (r.bx, r.by)) for r in mesh.leads(c).collect()}
    want = {(*k, t): (u, b) for k in z if classify(k, z) in ("slope", "saddle") for t, u, b in leads(k, z)}
    assert got == want
    pt = lambda x, y: None if x is None else (x, y)
    e = {((r.sx, r.sy), r.seq, r.up): (pt(r.ax, r.ay), r.tag_a, pt(r.bx, r.by), r.tag_b) for r in network.edges(cells).collect()}
    assert e == edges(z)


def test_seam(spark):
    """A cylinder that is turned by an even number of cells has the same classes and leads, turned; no class is missing at the seam."""
    r, width = random.Random(3), 16
    z = {(x - 8, y): r.random() for x in range(width) for y in range(9)}
    turn = lambda x, k: (x + 8 + k) % width - 8
    grid, got = mesh.Grid(2.0, width), []
    for k in (0, 6):
        cells = raster(spark, {(turn(x, k), y): v for (x, y), v in z.items()})
        c = mesh.classify(cells, grid)
        rows = {(turn(r.x, -k), r.y): r["class"] for r in c.collect()}
        ways = {(turn(r.x, -k), r.y, r.trace, r.up, turn(r.bx, -k), r.by) for r in mesh.leads(c, grid).collect()}
        assert all((v == "indeterminate") == (y in (0, 8)) for (x, y), v in rows.items())
        got.append((rows, ways))
    assert got[0] == got[1]
    with pytest.raises(ValueError):
        mesh.Grid(1.0, 7)


def test_steps_shrink_with_latitude(spark):
    """At 60 degrees a step in x is half as long, so a lower neighbour there can be the steeper one."""
    z = {(x, y): 0.0 for x in range(2, 5) for y in range(59, 62)} | {(3, 60): 10.0, (4, 60): 16.0, (3, 61): 19.0}  # a cell with four neighbours
    flat, steep = ({r.trace: (r.bx, r.by) for r in mesh.leads(mesh.classify(raster(spark, z)), g).where("x = 3 and y = 60").collect()} for g in (None, mesh.Grid(1.0)))
    assert flat[0] == (3, 61) and steep[0] == (4, 60)


def test_thresh_lines_end_at_the_height_they_began(small):
    t = small
    z, whole, cut = rough(16, 9), {(r.up, r.p, r.target): r.cells for r in t.lines.collect()}, 0
    for r in t.thresh_lines.collect():
        cells = [(c.x, c.y) for c in whole[r.up, r.p, r.target]]
        got = [(c.x, c.y) for c in r.points]
        if (None, None) in cells:
            assert got == cells
            continue
        sign = 1 if r.up else -1
        k = [z[c] * sign for c in cells]
        i = max((i for i in range(1, len(k)) if k[i] >= k[0] > k[i - 1]), default=None)
        if i is None:
            assert got == cells
            continue
        cut += 1
        f = (k[0] - k[i - 1]) / (k[i] - k[i - 1])
        end = tuple(a + f * (b - a) for a, b in zip(cells[i - 1], cells[i], strict=True))
        assert got[:-1] == cells[:i] and got[-1] == pytest.approx(end)
    assert cut


def test_missing_and_null_heights(spark):
    z = cones()
    holes = raster(spark, {k: v for k, v in z.items() if k != (3, 3)}).union(spark.createDataFrame([(3, 3, None)], "x int, y int, z double"))
    got = {(r.x, r.y): r["class"] for r in mesh.classify(holes).collect()}
    assert (3, 3) not in got and got[4, 3] == "indeterminate"


def test_empty(spark):
    none = spark.createDataFrame([], "x int, y int, z double")
    assert mesh.classify(none).count() == 0 and network.edges(none).count() == 0


def facts_of(spark, z, cutoff, last=peaks.LAST):
    g = peaks.graph(network.edges(raster(spark, z))).cache()
    return g, {(r.up, r.p): r for r in peaks.relations(g, cutoff, peaks.facts(g, last)).collect()}


@pytest.mark.parametrize("last", [peaks.LAST, 0], ids=["last in one task", "rounds alone"])
def test_key_saddles_by_search(spark, last):
    z = rough(16, 5)
    g, rel = facts_of(spark, z, 0.3, last)
    for up in (True, False):
        graph, kp, ks = {}, {}, {}
        for r in g.where(F.col("up") == up).collect():
            ks[r.s] = tuple(r.ks)
            for p, k, o in ((r.a, r.ka, r.b), (r.b, r.kb, r.a)):
                if p is not None:
                    graph.setdefault(p, []).append((r.s, o))
                    kp[p] = tuple(k)
        seen = 0
        for p in kp:
            s, thresh, bound = search(p, graph, kp, ks)
            r = rel.get((up, p))
            if s is None:
                assert r is None
                continue
            seen += 1
            assert r.min_bound == (thresh is None)
            if thresh is not None:
                assert (r.s, r.thresh) == (s, thresh)
                assert r.drop == pytest.approx(abs(kp[p][0] - ks[s][0]))
        assert seen


def test_relations_agree_and_hold(spark):
    z = rough(18, 7)
    _, a = facts_of(spark, z, 0.25)
    _, b = facts_of(spark, z, 0.25, 0)
    norm = lambda r: (r.s, r.thresh, r.pthresh, r.parent, r.min_bound, r.notable, sorted(tuple(x) for x in r.subs))
    assert {k: norm(v) for k, v in a.items()} == {k: norm(v) for k, v in b.items()}
    for (up, p), r in a.items():
        if r.parent is not None and (up, r.parent) in a and not a[up, r.parent].min_bound:
            assert a[up, r.parent].drop >= r.drop
        assert r.parent is None if r.min_bound or not r.notable else r.thresh is not None


def test_up_is_down_of_the_negative(spark):
    z = rough(13, 11)
    pick = lambda rel, up: sorted((ids_xy(r.p), ids_xy(r.s), round(r.drop, 9), r.min_bound) for (u, _), r in rel.items() if u == up)
    ids_xy = lambda v: (v >> 28 & 0xFFFFFF, v >> 4 & 0xFFFFFF)
    _, a = facts_of(spark, z, 0.2)
    _, b = facts_of(spark, {k: -v for k, v in z.items()}, 0.2)
    assert [x[0] for x in pick(a, True)] == [x[0] for x in pick(b, False)]


def test_cones(spark):
    _, rel = facts_of(spark, cones(), 10.0)
    pid = lambda x, y: x << 28 | y << 4
    assert set(rel) == {(True, pid(5, 3))}
    r = rel[True, pid(5, 3)]
    assert (r.s, r.drop, r.thresh, r.pthresh, r.parent, r.min_bound) == (pid(4, 3), 10.0, pid(1, 3), pid(1, 3), pid(1, 3), False)


@pytest.fixture(scope="module")
def small(spark):
    return Terrain(raster(spark, rough(16, 9)), 0.3)


def test_tree_ways_and_lines(small):
    t = small
    tree = {(r.up, r.node): (r.next, r.s) for r in t.tree.collect()}
    g = t.graph.collect()
    assert {k for k in tree} == {(r.up, p) for r in g for p in (r.a, r.b) if p is not None}
    exits = {(r.up, r.q_own): (r.q_far, r.s) for r in t.facts.where("min_bound").collect()}
    merges = {(r.up, r.s): {r.q_own, r.q_far} for r in t.facts.where("not min_bound").collect()}
    for (up, n), (o, s) in tree.items():
        assert exits.get((up, n), (None, None)) == (o, s) if (up, n) in exits or s is None else merges[up, s] == {n, o}

    def way(up, n):
        out = []
        while n is not None and (up, n) in tree:
            out.append(n)
            n = tree[up, n][0]
        return out

    starts = t.tasks.select("up", F.col("p").alias("start"))
    a = sorted(map(tuple, paths.ancestors(t.tree, starts).select("up", "start", "pos", "node").collect()))
    assert a == sorted({(r.up, r.p, i, n) for r in t.tasks.collect() for i, n in enumerate(way(r.up, r.p))})
    for r in t.between.where("target is not null and right is not null").collect():
        left, right = way(r.up, r.p), way(r.up, r.target)
        meet = next((n for n in left if n in right), None)
        if meet is not None:
            assert r.left == left[: left.index(meet) + 1] and r.right == right[: right.index(meet) + 1]
    xy = lambda v: (v >> 28 & 0xFFFFFF, v >> 4 & 0xFFFFFF)
    n = 0
    for r in t.lines.where("target is not null").collect():
        cells = [(c.x, c.y) for c in r.cells if c.x is not None]
        if r.cells[-1].x is None or any(c.x is None for c in r.cells):
            continue
        assert cells[0] == xy(r.p) and cells[-1] == xy(r.target)
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 1 for a, b in zip(cells, cells[1:], strict=False))
        n += 1
    assert n
    for r in t.pruned.collect():
        chain = way(r.up, r.src)
        at = chain.index(r.dst) if r.dst in chain else len(chain)
        assert [x for x in r.interim[1::2]] == chain[1:at]


def test_ranks(spark):
    t = Terrain(raster(spark, rough(16, 10)), 0.2)
    drop = {(r.up, r.p): r.drop for r in t.relations.collect()}
    for up in (True, False):
        rows = sorted((r.rank, r.p) for r in t.ranks.collect() if r.up == up)
        assert [r[0] for r in rows] == list(range(len(rows)))
        d = [drop[up, p] for _, p in rows]
        assert d == sorted(d, reverse=True)


def test_settled():
    go = paths.settled
    assert go([[1, 5, 6, 7, None], [2, 6, 7, None]]) == [[1, 5, 6], [2, 6]]
    assert go([[1, 5, None]]) == [[1, 5, None]]
    assert go([[1, 5, None], [2, 6, None]]) == [[1, 5, None], [2, 6, None]]
    assert go([[1, 9, 8, None], [2, 9, 8, None], [3, 9, 8, None]]) == [[1, 9], [2, 9], [3, 9, 8, None]]
    # the third of 9 meets the one that comes from 4 at 8
    assert go([[1, 9, 8, None], [2, 9, 8, None], [3, 9, 8, None], [4, 8, None]]) == [[1, 9], [2, 9], [3, 9, 8], [4, 8]]
    assert go([[1, 5, 9, None], [1, 9, None], [2, 5, 9, None]]) == [[1, 5], [1, 9, None], [2, 5]]


def test_settled_is_what_nodes_see():
    """Rootwards over every node: traces that are still running there pair off, an odd one goes on."""
    r = random.Random(4)
    for _ in range(200):
        n = r.randrange(2, 25)
        up = {i: r.randrange(i) for i in range(1, n)}
        seeds = []
        for t in range(r.randrange(1, 9)):
            way, i = [], r.randrange(n)
            while i is not None:
                way.append(i)
                i = up.get(i)
            seeds.append([100 + t, *way, None])
        here = {node: [] for node in range(n)}
        ends = {}

        def arrive(node, running):
            running.sort()
            for _, t in running[: len(running) // 2 * 2]:
                ends[t] = node
            return running[len(running) // 2 * 2 :]

        for node in reversed(range(n)):  # children have larger numbers
            running = here[node] + [(1, t) for t, s in enumerate(seeds) if s[1] == node]
            for step, t in arrive(node, running):
                if node:
                    here[up[node]].append((step + 1, t))
        want = [s[: s.index(ends[t]) + 1] if t in ends else s for t, s in enumerate(seeds)]
        assert paths.settled(seeds) == want


def test_forests(spark):
    """A way of 3,000 nodes and bushy trees: ranks, ways, meeting points and arrows from edges without direction."""
    r = random.Random(6)
    up = {i: i - 1 for i in range(1, 3000)} | {i: r.choice([r.randrange(3000, i), r.randrange(max(3000, i - 3), i)]) for i in range(3001, 3400)}
    nodes = range(3400)
    ptr = spark.createDataFrame([(True, i, up.get(i)) for i in nodes], "up boolean, node long, next long").cache()

    def way(i):
        out = [i]
        while out[-1] in up:
            out.append(up[out[-1]])
        return out

    rank = forest.ranked(ptr)
    assert {(x.node, x.root, x.depth) for x in rank.collect()} == {(i, way(i)[-1], len(way(i)) - 1) for i in nodes}
    table = forest.jumps(ptr)
    starts = r.sample(nodes, 40) + [2999]
    legs = [(True, i, i, r.randrange(1, len(way(i)) + 1)) for i in starts]
    got = forest.expanded(table, spark.createDataFrame(legs, "up boolean, id long, node long, n long"), ["id"])
    assert sorted((x.id, x.pos, x.node) for x in got.collect()) == sorted((i, k, v) for _, i, _, n in legs for k, v in enumerate(way(i)[:n]))
    pairs = {(r.choice(nodes), r.choice(nodes)) for _ in range(300)} | {(r.randrange(3000, 3400), r.randrange(3000, 3400)) for _ in range(300)} | {(5, 5), (2999, 0), (0, 2999), (1, 17), (16, 32)}
    for x in forest.meets(table, rank, spark.createDataFrame([(True, *p) for p in pairs], "up boolean, a long, b long")).collect():
        a, b = way(x.a), way(x.b)
        at = next((n for n in a if n in set(b)), None)
        assert (x.meet, x.i, x.j) == ((at, a.index(at), b.index(at)) if at is not None else (None, None, None)), x
    edges = [(True, i + 10_000, *r.sample([i, o], 2)) for i, o in up.items()]
    roots = spark.createDataFrame([(True, 0), (True, 3000)], "up boolean, node long")
    arrows = forest.rooted(spark.createDataFrame(edges, "up boolean, s long, m long, n long"), roots).collect()
    assert {(x.node, x.next, x.s) for x in arrows} == {(i, o, i + 10_000) for i, o in up.items()}


def test_trim(spark):
    df = spark.createDataFrame([([1.0, 0.0, 2.0, 4.0], 1.0, True), ([1.0, 0.0], 5.0, True), ([3.0], 1.0, True)], "z array<double>, l double, up boolean")
    assert [r[0] for r in df.select(paths.trim(F.col("z"), F.col("l"), F.col("up"))).collect()] == [1.5, -1.0, -1.0]


def test_publish_and_export(spark, tmp_path):
    import sqlite3

    from ridgework.plans import terrain, viewer

    t = Terrain(raster(spark, rough(16, 12)), 0.3)
    t.publish(f"file://{tmp_path}/out")
    tables = {n: spark.read.parquet(f"file://{tmp_path}/out/{n}") for n in ("points", "prom", "subsaddles")}
    terrain.export_sqlite(tables, str(tmp_path / "t.db"), batch=7)
    con = sqlite3.connect(tmp_path / "t.db")
    for n, df in tables.items():
        assert con.execute(f"select count(*) from {n}").fetchone()[0] == df.count()
    top = viewer.peaks_in(tables["points"], tables["prom"], "", True, 3).collect()
    assert [r.prom_mm for r in top] == sorted((r.prom_mm for r in top), reverse=True) and len(top) == 3
    assert viewer.peaks_in(tables["points"], tables["prom"], "f", True).count() == 0
    me = top[0].point
    rows = viewer.around(tables["points"], tables["prom"], tables["subsaddles"], me).collect()
    assert [r.point for r in rows if r.kind == "peak"] == [me]
    assert viewer.around(tables["points"], tables["prom"], tables["subsaddles"], 12345).count() == 0
    viewer.register(tables["points"], tables["prom"], tables["subsaddles"])
    assert viewer.around_sql(spark, me).columns == ["point", "saddle", "prom_mm"]
    assert ids.NULL_ID == -1
