import hashlib
import random
from itertools import pairwise

import numpy as np
import pytest

from ridgework.llm import induced, passages


def brute(rows):
    first, out = {}, []
    big = 2**63 - 1
    rows = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in rows:
        for p in range(len(b) - passages.LENGTH + 1):
            s = b[p : p + passages.LENGTH]
            first[s] = min(first.get(s, big), i)
    for i, b in rows:
        c = bytearray(len(b))
        for p in range(len(b) - passages.LENGTH + 1):
            if first[b[p : p + passages.LENGTH]] < i:
                c[p : p + passages.LENGTH] = b"\1" * passages.LENGTH
        kept = bytes(x for x, y in zip(b, c, strict=True) if not y)
        spans = sum(1 for k, x in enumerate(c) if x and (k == 0 or not c[k - 1]))
        out.append((None if i == big else i, len(b), sum(c), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def check(df):
    got = sorted(repr(tuple(r)) for r in passages.removals(df).collect())
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])


def test_table(docs):
    check(docs)


@pytest.mark.parametrize("blob", [300, 1 << 19])
def test_shared_passages(spark, monkeypatch, blob):
    monkeypatch.setattr(passages, "BLOB", blob)
    monkeypatch.setattr(passages, "SHARD", 2000)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9)))
    parts = [" ".join(word() for _ in range(r.randrange(3, 30))) for _ in range(12)] + ["ab" * 60, "-" * 90]
    rows = [(i, " ".join(r.choice(parts) if r.random() < 0.5 else word() for _ in range(r.randrange(8)))) for i in range(120)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_odd_rows(spark, odd, none):
    check(odd)
    assert passages.removals(none).count() == 0


def test_lengths(spark):
    t = "".join(chr(97 + (i * i) % 26) for i in range(120))
    check(spark.createDataFrame([(5, t[:49]), (1, t[:49]), (2, t[:50]), (3, t[:50]), (4, t), (4, t), (0, None)], "doc_id long, text string"))
    kept = {r.doc_id: bytes(r.kept) for r in passages.removals(spark.createDataFrame([(1, t), (2, "x" + t + "y")], "doc_id long, text string"), with_kept=True).collect()}
    assert kept == {1: t.encode(), 2: b"xy"}


def shares(a, b, depth):
    return next((k for k in range(min(len(a), len(b), depth)) if a[k] != b[k]), min(len(a), len(b), depth))


@pytest.mark.parametrize(("batch", "step"), [(8, 7), (64, 100), (1 << 14, 1 << 21)])
def test_suffix_order(monkeypatch, tmp_path, batch, step):
    monkeypatch.setattr(induced, "BATCH", batch)
    monkeypatch.setattr(induced, "STEP", step)
    rng = np.random.default_rng(3)
    for trial in range(200):
        size, n = int(rng.integers(1, 8)), int(rng.integers(0, 110))
        t = rng.integers(0, size, n)
        if trial % 4 == 0:
            t = np.repeat(t, rng.integers(1, 9, n))[:150]
        elif trial % 4 == 1:
            t = np.tile(t[: n // 5], 6)
        depth, s, n = [200, 50, 6, 3][trial % 3], t.tolist(), len(t)
        order, common = induced.suffix_order(t.astype("u2"), size + 1, depth, induced.Store([1 << 30, 200][trial % 2], str(tmp_path)))
        assert sorted(order.tolist()) == list(range(n))
        assert [s[i : i + depth] for i in order] == sorted(s[i : i + depth] for i in range(n))
        assert common[1:].tolist() == [shares(s[i:], s[j:], depth) for i, j in pairwise(order.tolist())]


def test_far_beyond_memory(tmp_path):
    """A text of 400,000 characters within 64 KB of arrays in memory: the rest is in files."""
    rng = np.random.default_rng(7)
    words = [rng.integers(1, 256, int(rng.integers(2, 9))) for _ in range(900)]
    t = np.concatenate([words[i] for i in rng.zipf(1.3, 80_000) % 900])[:400_000].astype("u2")
    store = induced.Store(1 << 16, str(tmp_path))
    order, common = induced.suffix_order(t, 257, 50, store)
    assert store.spilled > 200 * store.memory and store.held <= store.memory
    assert not list(tmp_path.iterdir())  # the files have no names
    view = np.lib.stride_tricks.sliding_window_view(np.append(t, np.zeros(50, "u2")), 50)
    a, b = view[order[:-1]], view[order[1:]]
    differs = a != b
    at = np.where(differs.any(axis=1), differs.argmax(axis=1), 50)
    low = np.arange(len(at))
    assert ((at == 50) | (a[low, at % 50] < b[low, at % 50])).all()
    n = len(t) - np.maximum(order[:-1], order[1:])
    assert (common[1:] == np.minimum(at, n)).all()
    with pytest.raises(MemoryError):
        induced.suffix_order(t, 257, 50, induced.Store(1 << 16))


def collision():
    """Two texts without a common string of 50 bytes whose parts agree in any polynomial hash modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(1 << 11)]
    block = ["a", "n"]
    x = "".join(block[b] for b in bits)
    y = "".join(block[1 - b] for b in bits)
    return x, y


def test_hash_collisions_are_not_equal(spark):
    x, y = collision()
    raw = np.frombuffer((x + y).encode(), "u1")
    half = len(x)
    p, q = passages._powers(len(raw) + 1)
    total = np.append(np.zeros(1, "u8"), np.cumsum(passages._TABLE[raw] * p[: len(raw)]))
    assert (total[half] - total[0]) * q[0] == (total[2 * half] - total[half]) * q[half]  # the hashes are equal, the texts aren't
    strings = np.array([half - passages.LENGTH + 1] * 2)
    truth = {x[i : i + 50] for i in range(half - 49)}
    want = [False] * int(strings[0]) + [y[i : i + 50] in truth for i in range(half - 49)]
    assert passages.earlier(strings, np.array([1, 2]), raw).tolist() == want
    pad = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(60))
    check(spark.createDataFrame([(1, pad + x + pad), (2, pad + y + pad)], "doc_id long, text string"))
