import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from ridgework.llm import exact_dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_groups(spark, odd, docs):
    for df in (odd, docs):
        rows = df.collect()
        groups = {}
        for r in rows:
            groups.setdefault(norm(r.text), []).append(r.doc_id)
        want = []
        for r in rows:
            g = groups[norm(r.text)]
            keep = min((i for i in g if i is not None), default=None)
            want.append((r.doc_id, keep, len(g), r.doc_id == keep, hashlib.sha256(norm(r.text).encode()).hexdigest()))
        got = [tuple(r) for r in exact_dedup.annotate(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_empty(none):
    assert exact_dedup.annotate(none).count() == 0 and exact_dedup.deduplicate(none).columns == none.columns


def test_deduplicate_keeps_columns(odd):
    out = exact_dedup.deduplicate(odd)
    assert out.columns == odd.columns
    texts = [norm(r.text) for r in out.dropDuplicates(["doc_id"]).collect()]
    assert len(texts) == len(set(texts)) == len({norm(r.text) for r in odd.collect()})


def test_directory_splits(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    i, bucket = exact_dedup.build_index(df, capacity=50)
    rows = i.withColumn("again", bucket(F.col("fp"))).collect()
    assert len(rows) == 3000 and all(r.bucket == r.again for r in rows)
    sizes = Counter(r.bucket for r in rows)
    assert max(sizes.values()) <= 50 and len(sizes) >= 60
    where, deep = exact_dedup.directory(i.select("fp"), 50)
    held = Counter((r.fp % 2**64) >> (64 - deep) for r in rows)
    depth = {r.prefix: r.depth for r in where.collect()}
    buddies = {(d, p >> (deep - d + 1)) for p, d in depth.items()}
    for d, parent in buddies:  # a bucket was split because its parent was too full
        assert sum(n for p, n in held.items() if p >> (deep - d + 1) == parent) > 50
    assert len({d for d in depth.values()}) > 1
    one, _ = exact_dedup.build_index(df, capacity=50, max_depth=2)
    assert one.select("bucket").distinct().count() == 4


def test_chains_of_one_fingerprint(spark, monkeypatch):
    """All texts share one key: bytes tell them apart, and each finds its own place in the chain."""
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda norm: F.when(norm.isNotNull(), F.lit(7).cast("long")))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "doc_id long, text string")
    got = exact_dedup.annotate(df, capacity=1).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(1, 1, 2), (3, 1, 2), (2, 2, 1), (4, 4, 1)}
    assert sorted({(r.text_sha256, r.chain) for r in got})[0][1] == 0 and {r.chain for r in got} == {0, 1, 2}


def test_null_ids_by_text(spark):
    from ridgework.llm import near_dedup

    df = spark.createDataFrame([(1, "a b"), (None, "a b"), (None, "c d"), (None, None)], "doc_id long, text string")
    for op in (exact_dedup.deduplicate, near_dedup.deduplicate):
        assert sorted(map(repr, map(tuple, op(df).collect()))) == sorted(map(repr, [(1, "a b"), (None, "c d"), (None, None)]))
