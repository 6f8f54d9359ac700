import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ridgework.llm import near_dedup as near


def brute(rows):
    """doc_id -> class by comparing all pairs of different texts that share a shingle."""
    df, sets, first = np.zeros(near.SLOTS, "i8"), {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        h, c = near.shingles(t or "")
        df[np.unique(near.slot(h))] += 1
        if (t or "") not in first and i is not None:
            first[t or ""] = i
            sets[i] = (h, c)
    w = near.damped_idf(df, len(rows))
    inv, up = defaultdict(list), {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (h, _) in sets.items():
        for j in Counter(j for x in h.tolist() for j in inv[x]):
            if near.similarity(sets[i], sets[j], w) >= near.THRESHOLD:
                a, b = sorted((root(i), root(j)))
                up[b] = a
        for x in h.tolist():
            inv[x].append(i)
    return {i: root(first[t or ""]) for i, t in rows if i is not None}


def varied(n, seed, words=120, change=4):
    """A base text and variants of it, each with a few other words, between texts of their own."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        v = list(base)
        for _ in range(r.randrange(change)):
            v[r.randrange(words)] = f"x{r.randrange(10**6)}"
        out.append(" ".join(v))
    return out + [" ".join(f"w{r.randrange(5000)}" for _ in range(words)) for _ in range(n // 2)]


def test_classes(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: r.class_id for r in near.classes(docs).collect()} == brute(rows)


def test_hot_group_by_pivot_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "SMALL", 4)
    monkeypatch.setattr(near, "BLOCK", 16)
    rows = list(enumerate(varied(90, 3) + varied(20, 4)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near.classes(df).collect()}
    assert got == brute(rows)
    assert max(Counter(got.values()).values()) > 50


def test_samples_estimate_similarity():
    a, b = varied(1, 9, 400, 60)[:2]
    sets = [near.shingles(t) for t in (a, b)]
    w = np.ones(near.SLOTS, "f4")
    h, c = (np.concatenate([s[k] for s in sets]) for k in (0, 1))
    est = []
    for seed in range(40):
        x, y = near.Sampler(seed).samples(h, c * w[near.slot(h)], np.array([0, len(sets[0][0])]))
        est.append((x == y).mean())
    assert abs(np.mean(est) - near.similarity(*sets, w)) < 0.05


def test_exact_document_frequencies(spark, docs):
    some = docs.limit(60).union(docs.limit(5))
    rows = [r.text or "" for r in some.collect()]
    want = Counter(x for t in rows for x in near.shingles(t)[0].tolist())
    got = near.signatures(some, len(rows)).join(some.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) == len(rows)
    for r in got:
        h = near.shingles(r.text or "")[0].tolist()
        assert np.frombuffer(r.df or b"", "<u4").tolist() == [want[x] for x in h]


def test_weights_are_of_shingles_not_slots(spark, monkeypatch):
    monkeypatch.setattr(near, "slot", lambda h: np.zeros(len(h), "i8"))  # as crowded as the slots of a large corpus
    tail = " ".join(f"t{i}" for i in range(29))
    base = [" ".join(f"u{i}" for i in range(104)), " ".join(f"f{i}" for i in range(29))]
    rows = [(0, " ".join(base)), (1, f"{base[0]} {tail}")]
    rows += [(2 + i, f"{t} {' '.join(f'r{i}x{j}' for j in range(200))}") for i in range(300) for t in [f"{base[1]} {tail}"]]
    h = [near.shingles(t) for _, t in rows]
    df = Counter(x for s, _ in h for x in s.tolist())
    w = tuple(near.damped_idf(np.array([df[x] for x in s.tolist()]), len(rows)) for s, _ in h[:2])
    assert near.similarity(*h[:2], (np.ones(len(w[0])), np.ones(len(w[1])))) < near.similarity(*h[:2], w)
    got = {r.doc_id: (r.sig, np.frombuffer(r.df, "<u4")) for r in near.signatures(spark.createDataFrame(rows, "doc_id long, text string"), len(rows)).collect()}
    assert all(np.array_equal(near.damped_idf(got[i][1], len(rows)), w[i]) for i in (0, 1))


def test_odd_rows(odd, none):
    got = near.classes(odd)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute(rows)
    assert all(r.class_id == want[r.doc_id] for r in got.collect() if r.doc_id is not None)
    assert got.count() == len(rows) and got.where("doc_id is null and kept").count() == 0
    assert near.classes(none).count() == 0
    out = near.deduplicate(odd)
    assert out.columns == odd.columns and out.select("doc_id").distinct().count() == len(set(want.values()))
    assert got.where(F.col("kept")).select("class_id").distinct().count() == len(set(want.values()))
