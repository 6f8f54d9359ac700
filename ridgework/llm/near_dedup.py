"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Shingles are five words; a text of fewer words is one shingle. A shingle weighs its count in the text
times 1 + ln(1 + N / df) / ln(1 + N), where df counts the documents that hold the shingle (its 64-bit
hash), over the whole corpus: blocks of documents send their shingles to ranges of hashes, which count
them and send the frequencies back. The weights of a rare and a frequent shingle differ by a factor of
two at most, so that samples also find pairs that are alike by counts. Two texts are linked if their
weighted Jaccard similarity is at least THRESHOLD, by these weights or by counts alone: the second keeps
near copies together whose few differing shingles are rare. Classes are the connected components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialize, partitions, read, small_batches, text_or_empty, trimmed

WORDS, THRESHOLD = 5, 0.8
#: Slots of a weight table for similarity() of texts whose shingles have no weights of their own.
SLOTS = 1 << 20
#: Blocks of documents per shuffle partition.
BLOCKS = 4
#: Samples per text and per band: 12 bands of 2 let 0.0005 % of pairs of similarity 0.8 slip by, 0.5 % at 0.6.
SAMPLES, ROWS = 24, 2
BANDS = SAMPLES // ROWS
#: Equal samples that a pair needs before it is verified; 0.8 similar texts have fewer once in 1e5.
LEAST_EQUAL = 9
#: Members of a bucket up to which they are compared with one another at once; a larger one goes by pivot, then blocks.
SMALL = 48
BLOCK = 512
_DRAWS = 1 << 15


class Words(dict):
    """64-bit hashes of words, in a bounded cache."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_WORDS = Words()


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a whole text, and how often each occurs."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    w = np.fromiter(map(_WORDS.__getitem__, words), "u8", n)
    k = min(n, WORDS)
    h = np.full(n - k + 1, k, "u8")
    for i in range(k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w[i : n - k + 1 + i]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(29)), return_counts=True)


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype("i8")


class Sampler:
    """Improved consistent weighted sampling (Ioffe 2010) with its draws taken from tables by shingle hash."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.shift = np.uint64(64 - _DRAWS.bit_length() + 1)
        self.odd = rng.integers(1, 1 << 62, SAMPLES, dtype="u8") * np.uint64(2) + np.uint64(1)
        self.r = rng.gamma(2, 1, (SAMPLES, _DRAWS)).astype("f4")
        self.ln_c = np.log(rng.gamma(2, 1, (SAMPLES, _DRAWS))).astype("f4")
        self.b = rng.uniform(0, 1, (SAMPLES, _DRAWS)).astype("f4")

    def samples(self, h: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """SAMPLES 32-bit samples per text; two texts agree on each with the probability of their weighted Jaccard similarity.

        h and weight hold the shingles of many texts, one after the other; text i begins at starts[i].
        """
        ln_w = np.log(weight).astype("f4")
        out = np.empty((len(starts), SAMPLES), "<u4")
        size = np.diff(np.append(starts, len(h)))
        text = np.repeat(np.arange(len(starts)), size)
        for k in range(SAMPLES):
            at = ((h * self.odd[k]) >> self.shift).astype("i8")
            r, b = self.r[k].take(at), self.b[k].take(at)
            t = np.floor(ln_w / r + b)
            ln_a = self.ln_c[k].take(at) - r * (t - b + np.float32(1))
            low = np.minimum.reduceat(ln_a, starts)
            hit = np.flatnonzero(ln_a == low.repeat(size))
            first = hit[np.searchsorted(text[hit], np.arange(len(starts)))]  # of ties the smallest hash
            mixed = h[first] * np.uint64(0x9E3779B97F4A7C15) + (t[first].astype("i8") + 1000003).astype("u8") * np.uint64(0xC2B2AE3D27D4EB4F)
            out[:, k] = mixed >> np.uint64(32)
        return out


_SAMPLER: list[Sampler] = []


def sampler() -> Sampler:
    if not _SAMPLER:
        _SAMPLER.append(Sampler())
    return _SAMPLER[0]


def _packed(h: np.ndarray) -> bytes:
    """Sorted hashes as the bytes of their differences, the highest bytes of all first, which compress."""
    return np.diff(h, prepend=np.uint64(0)).astype(">u8").view("u1").reshape(-1, 8).T.tobytes()


def _unpacked(v: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(v, "u1").reshape(8, -1).T).view(">u8").ravel().astype("u8"), dtype="u8")


def in_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, doc_id, text): documents dealt by id and text, so that copies under different ids are spread."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return src.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(BLOCKS * partitions(docs.sparkSession))).cast("int").alias("block"), "doc_id", "text")


def document_frequencies(blocks: DataFrame) -> DataFrame:
    """(block, r, df): for the distinct shingles of a block in range r, by hash, the documents of the corpus that hold each."""
    bits = max(1, (partitions(blocks.sparkSession) - 1).bit_length())
    names = ["block", "r", "h", "n"]

    def send(t: pa.Table) -> pa.Table:
        h, n = np.unique(np.concatenate([shingles(x)[0] for x in t.column("text").to_pylist()]), return_counts=True)
        ends = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
        rows = [(r, _packed(h[i:j]), n[i:j].astype("<u4").tobytes()) for r, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if j > i]
        r, hs, ns = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.Table.from_arrays([pa.array([t.column("block")[0].as_py()] * len(r), pa.int32()), pa.array(r, pa.int32()), pa.array(hs, pa.binary()), pa.array(ns, pa.binary())], names=names)

    def answer(t: pa.Table) -> pa.Table:
        parts = [_unpacked(v) for v in t.column("h").to_pylist()]
        n = np.concatenate([np.frombuffer(v, "<u4") for v in t.column("n").to_pylist()]).astype("i8")
        h = np.concatenate(parts)
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]) != 0)
        df = np.empty(len(h), "<u4")
        df[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(h))))
        got = [x.tobytes() for x in np.split(df, np.cumsum([len(x) for x in parts])[:-1])]
        return pa.Table.from_arrays([t.column("block").combine_chunks(), t.column("r").combine_chunks(), pa.array(got, pa.binary())], names=["block", "r", "df"])

    sent = blocks.groupBy("block").applyInArrow(send, "block int, r int, h binary, n binary")
    return sent.groupBy("r").applyInArrow(answer, "block int, r int, df binary")


def damped_idf(df: np.ndarray, n: int) -> np.ndarray:
    """1 + ln(1 + N / df) / ln(1 + N)."""
    n = max(1, n)
    return (1 + np.log1p(n / np.maximum(df, 1)) / np.log1p(n)).astype("f4")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weights: np.ndarray | tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity, the larger of that by TF-IDF and that by counts.

    weights: those of a's and of b's shingles, or one table by slot.
    """
    (ha, ca), (hb, cb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    wa, wb = weights if isinstance(weights, tuple) else (weights[slot(ha)], weights[slot(hb)])
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    same = hb[at] == ha
    low = np.minimum(ca[same], cb[at[same]])
    best = 0.0
    for part, whole in ((float(low.sum()), float(ca.sum() + cb.sum())), (float((low * wa[same]).sum()), float((ca * wa).sum() + (cb * wb).sum()))):
        best = max(best, part / (whole - part))
    return best


def signatures(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, sig, df): digest of the exact text, the samples and its shingles' frequencies; sig and df are null for a text without words. n counts the documents."""
    blocks = in_blocks(docs, id_col, text_col)

    def run(answers: pa.Table, t: pa.Table) -> pa.Table:
        import hashlib

        s, texts = sampler(), t.column("text").to_pylist()
        sets = [shingles(x) for x in texts]
        every = np.unique(np.concatenate([x[0] for x in sets])) if sets else np.zeros(0, "u8")
        by_range = sorted(zip(answers.column("r").to_pylist(), answers.column("df").to_pylist(), strict=True))
        df_of = np.frombuffer(b"".join(v for _, v in by_range), "<u4")
        if len(df_of) != len(every):
            raise RuntimeError("a block's frequencies are not those of its shingles")
        sigs, dfs = [None] * len(texts), [None] * len(texts)
        some = [i for i, x in enumerate(sets) if len(x[0])]
        while some:
            part, size = [], 0
            while some and size < 1 << 17:
                part.append(some.pop())
                size += len(sets[part[-1]][0])
            h, c = (np.concatenate([sets[i][j] for i in part]) for j in (0, 1))
            ends = np.cumsum([len(sets[i][0]) for i in part])
            df = df_of[np.searchsorted(every, h)]
            starts = np.concatenate([[0], ends[:-1]])
            for i, row, x in zip(part, s.samples(h, c * damped_idf(df, n), starts), np.split(df, ends[:-1]), strict=True):
                sigs[i], dfs[i] = row.tobytes(), x.tobytes()
        digests = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest() for x in texts]
        return pa.Table.from_arrays([t.column("doc_id").combine_chunks(), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(dfs, pa.binary())], names=["doc_id", "th", "sig", "df"])

    return document_frequencies(blocks).groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(run, "doc_id long, th binary, sig binary, df binary")


def _weighed(text: str, df: bytes | None, n: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """A text's shingles and counts, and the shingles' weights."""
    return shingles(text), damped_idf(np.frombuffer(df or b"", "<u4"), n)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, SAMPLES)


def _first_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first band on which rows agree, BANDS if none."""
    eq = (x == y).reshape(-1, BANDS, ROWS).all(axis=2)
    return np.where(eq.any(axis=1), eq.argmax(axis=1), BANDS)


def banded(reps: DataFrame) -> DataFrame:
    """(band, key, doc_id), BANDS rows per text; a key is a hash of the band's samples."""
    width = 4 * ROWS
    return reps.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.substring("sig", i * width + 1, F.lit(width))))).alias("band", "key"), "doc_id")


def candidates(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b): pairs with enough equal samples, from each small bucket all, from each large one those with its pivot.

    The pivot of a large bucket is its member whose buckets are the largest in sum, which is the one that
    most others resemble.
    """
    popular = members.groupBy("doc_id").agg(F.sum("size").alias("popular"))
    known = members.join(sigs, "doc_id")
    large = known.where(F.col("size") > SMALL)
    pivots = large.join(popular, "doc_id").groupBy("band", "key").agg(F.max(F.struct("popular", (-F.col("doc_id")).alias("neg"), "sig")).alias("p")).select("band", "key", (-F.col("p.neg")).alias("pivot"), F.col("p.sig").alias("psig"))
    pivots = materialize(pivots, "near-pivots")  # a side of its own, so that the join can split a hot bucket
    star = large.join(pivots, ["band", "key"]).where("doc_id <> pivot").select("band", F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b"), "sig", "psig")

    def close(batches):
        for b in batches:
            if b.num_rows:
                x, y = _matrix(b.column("sig")), _matrix(b.column("psig"))
                yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= LEAST_EQUAL))

    def within(batches):
        for b in batches:
            left, right = [], []
            for band, members in zip(b.column("band").to_pylist(), b.column("members"), strict=True):
                ids = members.values.field("doc_id").to_numpy()
                sig = _matrix(members.values.field("sig"))
                i, j = np.triu_indices(len(ids), 1)
                ok = ((sig[i] == sig[j]).sum(axis=1) >= LEAST_EQUAL) & (_first_common(sig[i], sig[j]) == band)
                left.append(np.minimum(ids[i[ok]], ids[j[ok]]))
                right.append(np.maximum(ids[i[ok]], ids[j[ok]]))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    small = known.where(F.col("size") <= SMALL).groupBy("band", "key").agg(F.collect_list(F.struct("doc_id", "sig")).alias("members"))
    return star.mapInArrow(trimmed(close), "a long, b long").union(small.select("band", "members").mapInArrow(trimmed(within), "a long, b long")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar enough.

    Each a meets its partners in blocks of about BLOCK: a's text goes once to each block, ahead of theirs,
    so neither a pivot of any number of partners nor its text is gathered or repeated per pair.
    """
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), "b")
    left = dealt.select("a", "block").distinct().join(texts.select(F.col("doc_id").alias("a"), "text", "df"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "text", "df")
    right = dealt.join(texts.select(F.col("doc_id").alias("b"), "text", "df"), "b").select("a", "block", "b", "text", "df")

    def run(batches):
        at, mine = None, None
        for b in batches:
            keep = []
            for a, x, text, df in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("text"), b.column("df"), strict=True):
                made = _weighed(text.as_py(), df.as_py(), n)
                if x is None:
                    at, mine = a, made
                keep.append(x is not None and at == a and similarity(mine[0], made[0], (mine[1], made[1])) >= THRESHOLD)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = left.union(right).repartition(partitions(pairs.sparkSession), "a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return both.mapInArrow(trimmed(run), "a long, b long")


def remaining(members: DataFrame, sigs: DataFrame, labels: DataFrame, texts: DataFrame, n_docs: int) -> DataFrame:
    """Links of large buckets that the pivots have not shown.

    Inside a bucket only a link between two components matters, and one of its ends lies outside the
    bucket's largest component. So the members outside it are compared with all members, in blocks of
    BLOCK by BLOCK, each pair in the first bucket that it shares, until the components meet.
    """
    large = members.where(F.col("size") > SMALL).join(sigs, "doc_id").join(labels.select(F.col("node").alias("doc_id"), F.col("component").alias("c")), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    per = large.groupBy("band", "key", "c").agg(F.count("*").alias("n"))
    main = per.groupBy("band", "key").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("all")).select("band", "key", F.col("m.c").alias("main"), (F.col("all") - F.col("m.n")).alias("rest")).where("rest > 0")
    rows = large.join(main, ["band", "key"]).withColumn("out", F.col("c") != F.col("main"))
    rows = rows.join(texts, "doc_id").withColumn("t_blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("q_blocks", F.ceil(F.col("rest") / BLOCK).cast("int"))
    mine = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    cols = ["band", "key", "doc_id", "c", "sig", "text", "df", "out"]
    target = rows.select(*cols, F.lit(False).alias("q"), mine(F.col("t_blocks")).alias("tb"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("qb"))
    query = rows.where("out").select(*cols, F.lit(True).alias("q"), F.explode(F.sequence(F.lit(0), F.col("t_blocks") - 1)).alias("tb"), mine(F.col("q_blocks")).alias("qb"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        band = table.column("band")[0].as_py()
        q = np.array(table.column("q").to_pylist())
        ids, comp, out = (table.column(x).to_numpy() for x in ("doc_id", "c", "out"))
        sig, text = _matrix(table.column("sig").combine_chunks()), table.column("text")
        df = table.column("df")
        t_at, got, made = np.flatnonzero(~q), [], {}
        met: dict[int, int] = {}

        def top(c):
            while c in met:
                c = met[c]
            return c

        def of(i):
            if i not in made:
                made[i] = _weighed(text[i].as_py() or "", df[i].as_py(), n_docs)
            return made[i]

        for i in np.flatnonzero(q):
            equal = (sig[t_at] == sig[i]).sum(axis=1)
            ok = (equal >= LEAST_EQUAL) & (comp[t_at] != comp[i]) & (_first_common(sig[t_at], np.broadcast_to(sig[i], (len(t_at), SAMPLES))) == band) & ~(out[t_at] & (ids[t_at] < ids[i]))
            for k in np.flatnonzero(ok)[np.argsort(-equal[ok], kind="stable")]:
                j = t_at[k]
                x, y = top(int(comp[i])), top(int(comp[j]))
                mine, other = of(int(i)), of(int(j))
                if x != y and similarity(mine[0], other[0], (mine[1], other[1])) >= THRESHOLD:
                    met[x] = y
                    got.append((int(ids[i]), int(ids[j])))
        return pa.table([pa.array([min(g) for g in got], pa.int64()), pa.array([max(g) for g in got], pa.int64())], schema=schema)

    return target.unionByName(query).groupBy("band", "key", "tb", "qb").applyInArrow(compare, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_digest: bool = False) -> DataFrame:
    """(doc_id, class_id, kept[, digest]), a row per row of docs.

    class_id is the smallest id of the document's class, the texts reachable by links; equal texts are
    always one class, and kept marks the one that stays. Null and empty texts, and texts without words,
    link only with texts equal to them. Rows with a null id take the class of their text and never stay
    when another row has the text; alone they have a null class. Rows that repeat an id and text share
    their row's class. Other columns of docs are not read, so their names don't matter, and an empty table
    gives an empty result. Copies are collapsed before anything is
    compared, hot buckets go by pivot and blocks, and joins on hot keys are left to the skew join.
    """
    small_batches(docs.sparkSession)
    n = docs.count()
    sigs = materialize(signatures(docs, n, id_col, text_col), "near-signatures")
    reps = materialize(sigs.where("doc_id is not null").groupBy("th").agg(F.min("doc_id").alias("doc_id"), F.min("sig").alias("sig")), "near-texts")
    bands = banded(reps.where("sig is not null"))
    sizes = materialize(bands.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1"), "near-buckets")
    members = materialize(bands.join(sizes, ["band", "key"]), "near-members")  # (band, key, doc_id, size) of buckets that are shared
    sig_of = reps.select("doc_id", "sig")
    pairs = materialize(candidates(members, sig_of), "near-pairs")
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(members.where(F.col("size") > SMALL).select("doc_id")).distinct()
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # of rows that repeat an id only the one whose text is compared counts
    wanted = ends.join(reps.select("doc_id", "th"), "doc_id")
    df_of = sigs.where("df is not null").join(wanted.select("th"), "th", "left_semi").groupBy("th").agg(F.first("df").alias("df"))  # equal for equal texts
    texts = materialize(whole.join(wanted, "doc_id").where(F.sha2("text", 256) == F.lower(F.hex("th"))).select("doc_id", "text", "th").dropDuplicates(["doc_id"]).join(df_of, "th").select("doc_id", "text", "df"), "near-candidates")
    links = materialize(verified(pairs, texts, n), "near-links")
    labels = components(links)
    more = materialize(remaining(members, sig_of, labels, texts, n), "near-more")
    if not more.isEmpty():
        labels = components(links.union(more))
    by_text = reps.select("th", "doc_id").join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("th", F.coalesce("component", "doc_id").alias("class_id"))
    out = sigs.select("doc_id", "th").join(by_text, "th", "left")
    return out.select(F.col("doc_id").alias(id_col), "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), *([F.col("th").alias("digest")] if with_digest else []))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one text of each class, with docs' own columns.

    Rows with a null id are told apart by their text, so one of them may stay where another goes.
    """
    kept = classes(docs, id_col, text_col, with_digest=True).where("kept").select(F.col(id_col).alias("_kept_id"), F.when(F.col(id_col).isNull(), F.lower(F.hex("digest"))).alias("_kept_sha")).distinct()
    sha = F.when(docs[id_col].isNull(), F.sha2(text_or_empty(docs[text_col]), 256))
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["_kept_id"]) & sha.eqNullSafe(kept["_kept_sha"]), "left_semi")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies."""
    return classes(read(spark, sf_dir, "documents"))
