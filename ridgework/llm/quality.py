"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _slices
from .common import materialize, partitions, read, small_batches, trimmed

#: Byte classes whose shares are statistics. Bytes from 128 on are the last class.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "|", "!", "?", "*#$%&@", "<>{}[]()", "'\"`", ":;", "=+~^_/\\-"]
NAMES = ["log_bytes", "log_words", "word_mean", "word_sd", "distinct_words", "top_word", "log_lines", "line_mean", "distinct_lines", "long_words", "symbol_ends", "capital_words", *(f"class_{i}" for i in range(len(CLASSES) + 1))]
FEATURES, GAMMA, RIDGE, SEED, BINS = 384, 0.04, 1e-3, 20240, 1024
#: Score below which the filter rejects a document: label 0 is likelier.
REJECT = 0.5
#: The split of the labels: a remainder of crc32(id as text) by 4.
HELD_OUT, CALIBRATE = 2, 3


def _class_table() -> np.ndarray:
    t = np.full(256, len(CLASSES), "u1")
    for b in range(128):
        t[b] = next((i for i, c in enumerate(CLASSES) if chr(b) in c), len(CLASSES) - 1)
    return t


def statistics(text: str, table: np.ndarray) -> list[float]:
    """The statistics of one whole text; an empty one has zeros."""
    if not text:
        return [0.0] * len(NAMES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1")
    shares = np.bincount(table[raw], minlength=len(CLASSES) + 1) / len(raw)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    edge = np.concatenate([[True], raw <= 32, [True]])
    ends = np.flatnonzero(edge[2:] & ~edge[1:-1])
    starts = np.flatnonzero(edge[:-2] & ~edge[1:-1])
    size = (ends - starts + 1).astype(float) if len(ends) else np.zeros(1)
    last = table[raw[ends]] if len(ends) else np.zeros(1, "u1")
    first = table[raw[starts]] if len(starts) else np.zeros(1, "u1")
    return [
        math.log1p(len(raw)), math.log1p(len(words)), float(size.mean()), float(size.std()), len(counts) / n, max(counts.values(), default=0) / n,
        math.log1p(len(lines)), math.log1p(len(raw) / len(lines)), len(set(lines)) / len(lines), float((size > 15).mean()), float((last >= 7).mean() - (last == len(CLASSES)).mean()), float((first == 1).mean()), *shares.tolist(),
    ]


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats), a row per row of docs, from whole texts; null counts as empty."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        table = _class_table()
        for b in _slices(batches, "text", 8 << 20):
            stats = [statistics(t, table) for t in b.column("text").fill_null("").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "doc_id long, stats array<double>")


def remainder(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4


class Model:
    """Scores from statistics: standardise, random Fourier features, linear, isotonic steps."""

    def __init__(self, mean, sd, features: int = FEATURES, gamma: float = GAMMA, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = np.asarray(mean, float), np.where(np.asarray(sd, float) > 1e-9, sd, 1.0)
        self.w = rng.normal(0, math.sqrt(2 * gamma), (len(self.mean), features))
        self.b = rng.uniform(0, 2 * math.pi, features)
        self.coef = np.zeros(features + 1)
        self.knots_x, self.knots_y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        self.fitted = False

    def lift(self, x: np.ndarray) -> np.ndarray:
        """The features whose inner products approximate a Gaussian kernel, and a constant."""
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        z = math.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.coef

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, with a small share of the raw order left inside flat steps; 0.5 exactly if unfitted."""
        if not self.fitted:
            return np.full(len(x), 0.5)
        r = self.raw(x)
        return np.clip(0.98 * np.interp(r, self.knots_x, self.knots_y) + 0.02 * np.clip(r, 0, 1), 0, 1)


def isotonic(x: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins; knots at the pooled blocks' mean x."""
    blocks: list[list[float]] = []
    for xi, t, c in zip(x, total, count, strict=True):
        blocks.append([xi * c, t, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    c = b.column("stats")
    return c.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Model:
    """Model from described documents and labels (doc_id, quality).

    Learns from rows whose remainder is not HELD_OUT: those of CALIBRATE fit the isotonic map, the others
    the ridge weights. Each task sums its part of the normal equations, row by row of the matrix, and the
    sums are added up in streams; the driver gets FEATURES + 1 rows and BINS bins, whatever the input.
    Null labels count for nothing; without labels every score is the neutral 0.5.
    """
    spark = stats.sparkSession
    k = len(NAMES)
    agg = stats.agg(*[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(k)], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(k)]).first()
    model = Model([agg[f"m{i}"] or 0.0 for i in range(k)], [agg[f"s{i}"] or 0.0 for i in range(k)])
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
    rows = stats.join(known.where(remainder() != HELD_OUT), "doc_id").withColumn("fold", remainder())
    names = ["i", "v"]

    def part(batches):
        total = None
        for b in batches:
            z = model.lift(_matrix(b))
            y = b.column("y").to_numpy(zero_copy_only=False)
            s = z.T @ np.hstack([z, y[:, None]])
            total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=names)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column("i").to_pylist(), b.column("v").to_pylist(), strict=True):
                x = np.frombuffer(v)
                sums[i] = sums[i] + x if i in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=names)

    parts = rows.where(F.col("fold") != CALIBRATE).select("stats", "y").mapInArrow(part, "i int, v binary")
    got = parts.repartition(min(16, partitions(spark)), "i").mapInArrow(add, "i int, v binary").collect()
    if not got:
        return model
    model.fitted = True
    m = np.array([np.frombuffer(r.v) for r in sorted(got, key=lambda r: r.i)])
    n = m[-1, -2]
    model.coef = np.linalg.solve(m[:, :-1] / n + RIDGE * np.eye(len(m)), m[:, -1] / n)

    def raws(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(b))), b.column("y")], names=["r", "y"])

    held = rows.where(F.col("fold") == CALIBRATE).select("stats", "y").mapInArrow(raws, "r double, y double")
    bins = held.groupBy(F.floor(F.least(F.greatest(F.col("r"), F.lit(-0.5)), F.lit(1.5)) * (BINS / 2)).alias("b")).agg(F.avg("r").alias("x"), F.sum("y").alias("t"), F.count("*").alias("c")).orderBy("b").collect()
    if bins:
        model.knots_x, model.knots_y = isotonic(*(np.array([float(r[c]) for r in bins]) for c in ("x", "t", "c")))
    return model


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, score), a row per row of docs; fits on labels first.

    Texts are read once: their statistics, a few hundred bytes a document, are kept in the shared folder.
    Repeated ids and ids without labels are scored like any other, equal texts alike; null texts count as
    empty. Other columns are not read, so their names don't matter; an empty table gives an empty result.
    """
    stats = materialize(describe(docs, id_col, text_col), "quality-stats")
    model = fit(stats, labels, label_col)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(_matrix(b)))], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = REJECT) -> DataFrame:
    """The rows of docs whose score is `least` or more, with docs' own columns.

    Fits like scored(); then each text's statistics are taken again where the row is read, so that no
    text is shuffled. Nulls, repeats and empty tables as there.
    """
    model = fit(materialize(describe(docs, id_col, text_col), "quality-stats"), labels, label_col)
    names, schema = docs.columns, docs.schema

    def run(batches):
        table = _class_table()
        for b in _slices(batches, text_col, 8 << 20):
            stats = np.array([statistics(t, table) for t in b.column(text_col).fill_null("").to_pylist()])
            yield pa.RecordBatch.from_arrays(b.columns, names=names).filter(pa.array(model.score(stats) >= least))

    return docs.mapInArrow(trimmed(run), schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: a score for every document, learned from rows that are not held out."""
    s = scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return s.select("doc_id", (remainder() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
