import zlib

import numpy as np
from pyspark.sql import functions as F

from ridgework.llm import quality


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    got = quality.op8_quality(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out and quality is not null").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) >= 0.95


def test_against_plain_algebra(spark, docs, data):
    """The same fit by least squares over one matrix, and the isotonic steps by their max-min formula."""
    x = {r.doc_id: np.array(r.stats) for r in quality.describe(docs).collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.quality is not None and r.doc_id in x}
    ids = sorted(x)
    every = np.array([x[i] for i in ids])
    rng = np.random.default_rng(quality.SEED)
    w = rng.normal(0, np.sqrt(2 * quality.GAMMA), (every.shape[1], quality.FEATURES))
    b = rng.uniform(0, 2 * np.pi, quality.FEATURES)
    sd = every.std(axis=0)
    z = np.clip((every - every.mean(axis=0)) / np.where(sd > 1e-9, sd, 1), -8, 8)
    z = np.c_[np.sqrt(2 / quality.FEATURES) * np.cos(z @ w + b), np.ones(len(z))]
    fold = np.array([zlib.crc32(str(i).encode()) % 4 for i in ids])
    y = np.array([label.get(i, np.nan) for i in ids], float)
    fit = ~np.isnan(y) & (fold != quality.HELD_OUT) & (fold != quality.CALIBRATE)
    coef = np.linalg.lstsq(np.r_[z[fit], np.sqrt(fit.sum() * quality.RIDGE) * np.eye(z.shape[1])], np.r_[y[fit], np.zeros(z.shape[1])], rcond=None)[0]
    raw = z @ coef
    held = ~np.isnan(y) & (fold == quality.CALIBRATE)
    cell = np.floor(np.clip(raw, -0.5, 1.5) * (quality.BINS / 2))
    bins = [(raw[held & (cell == c)].mean(), y[held & (cell == c)].sum(), (held & (cell == c)).sum()) for c in sorted(set(cell[held]))]
    mean = lambda j, k: sum(v[1] for v in bins[j : k + 1]) / sum(v[2] for v in bins[j : k + 1])
    steps = [max(min(mean(j, k) for k in range(i, len(bins))) for j in range(i + 1)) for i in range(len(bins))]
    knots = {}
    for (at, _, n), v in zip(bins, steps, strict=True):
        knots.setdefault(round(v, 9), []).append((at, n))
    kx = [np.average([a for a, _ in k], weights=[n for _, n in k]) for k in knots.values()]
    want = np.clip(0.98 * np.interp(raw, kx, list(knots)) + 0.02 * np.clip(raw, 0, 1), 0, 1)
    got = {r.doc_id: r.score for r in quality.scored(docs, spark.read.parquet(f"{data}/labels.parquet")).collect()}
    assert len(label) > 40 and np.allclose([got[i] for i in ids], want, atol=1e-6)


def test_no_leak(spark, docs, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    held = quality.remainder() == quality.HELD_OUT
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = sorted(map(tuple, quality.scored(docs, labels).collect()))
    b = sorted(map(tuple, quality.scored(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")), flipped).collect()))
    assert np.allclose([r[1] for r in a], [r[1] for r in b])


def test_odd_rows(spark, odd, none, data):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (3, None), (3, 1)], "doc_id long, quality int")
    s = quality.scored(odd, labels).collect()
    assert len(s) == odd.count() and all(0 <= r.score <= 1 for r in s)
    assert quality.scored(none, labels).count() == 0
    assert all(r.score > 0.4 for r in quality.scored(odd, labels.limit(0)).collect())
    kept = quality.accepted(odd, labels, least=0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_without_labels_every_row_stays(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    for none in (labels.limit(0), labels.where(quality.remainder() == quality.HELD_OUT)):
        assert {r.score for r in quality.scored(odd, none).collect()} == {0.5}
        assert quality.accepted(odd, none).count() == odd.count()


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 3, 1, 2, 5.0]), np.array([5, 5, 5, 5, 5.0]))
    assert (np.diff(y) > 0).all() and len(y) == 3
