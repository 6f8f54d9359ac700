import math

import numpy as np

from ridgework.llm import embedding_dedup as emb


def brute(rows):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ok = {i: v / np.abs(v).max() for i, v in ok.items()}
    unit = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    ids = sorted(unit)
    near = {i: [j for j in ids if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= emb.THRESHOLD] for i in ids}
    out = {}
    for i in [r[0] for r in rows]:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(near.get(i, [])), min(seen) if i is not None else None)
    return out


def check(df):
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    got = {r.vec_id: (r.n_links, r.component_id) for r in emb.annotate(df).collect()}
    assert got == want
    return got


def test_table(spark, data):
    check(spark.read.parquet(f"{data}/embeddings.parquet"))


def test_groups(spark):
    rng = np.random.default_rng(2)
    rows = []
    for size in (60, 25, 2, 1):
        c = rng.normal(size=16)
        rows += [(c + rng.normal(size=16) * 0.12).tolist() for _ in range(size)]
    rows += [rows[0]] * 5 + [rng.normal(size=16).tolist() for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = check(df)
    assert got[0][0] > 10
    assert emb.audit(df, every=3) >= 0.99


def test_hub(spark):
    rng = np.random.default_rng(4)
    hub = emb.unit(rng.normal(size=(1, 256)))[0]
    noise = rng.normal(size=(1950, 256))
    noise = emb.unit(noise - np.outer(noise @ hub, hub))
    rows = [hub, *(0.98 * hub + math.sqrt(1 - 0.98**2) * noise), *rng.normal(size=(300, 256))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in emb.annotate(df).collect()}
    assert got[0].n_links == 1950 and all(got[i].component_id == 0 for i in range(1951))
    assert emb.audit(df, every=3) >= 0.999


def test_seeds_reach_every_vector():
    rng = np.random.default_rng(5)
    x = emb.unit(np.repeat(rng.normal(size=(15, 32)), 100, axis=0) + 0.1 * rng.normal(size=(1500, 32)))
    lists = emb.pruned(x)
    padded = np.full((len(x), max(map(len, lists))), -1)
    for i, a in enumerate(lists):
        padded[i, : len(a)] = a
    found = emb.walk(x, padded, x) >= emb.THRESHOLD
    assert (found == (x @ x.T >= emb.THRESHOLD)).mean() == 1.0


def test_odd_rows(spark):
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0]), (7, [1.0, 0.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1e300, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(df)
    none = emb.annotate(df.limit(0))
    assert none.count() == 0 and none.columns == ["vec_id", "n_links", "component_id", "kept"]
    extra = df.selectExpr("*", "vec_id as rep", "1 as mult", "2 as shard").union(spark.createDataFrame([(None, [1.0, 0.0], 1, 1, 1)], "vec_id long, embedding array<double>, rep long, mult int, shard int"))
    assert emb.annotate(extra).where("vec_id is null").first().n_links == 0
