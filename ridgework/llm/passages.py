"""Suffix-array dedup of passages: bytes covered by a string that also starts in an earlier document go.

A string of LENGTH bytes is filed under the smallest of the hashed grams in it, its anchor, so equal
strings always meet in one key range. A first exchange finds the anchors that two documents share; only
stretches around shared ones are then sent to the range of their anchor, where a shard of stretches is
suffix-sorted by external induced sorting, and neighbours in that order whose common prefix has LENGTH
bytes hold the same string. Hashes only choose candidates: stretches of one hash are compared byte by byte.

Texts are packed into blobs once, in a table bucketed by blob. What goes back from the ranges are bits
per blob, so texts never move again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions, read, small_batches, table_path, trimmed
from .induced import Store, suffix_order

LENGTH, GRAM = 50, 24
WINDOW = LENGTH - GRAM + 1
#: Bytes of a blob, more only if one document has more.
BLOB = 1 << 19
#: Bytes hashed at once, few enough for a processor's cache.
CHUNK = 1 << 14
#: Parts of a key range, and bytes of stretches that are sorted at once: neighbouring parts up to about that many.
PARTS, SHARD = 64, 2 << 20
#: Bytes of documents per key range, so that what a task holds at once doesn't follow the corpus.
RANGE_BYTES = 32 << 20
_B = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(50).integers(0, 1 << 64, 256, dtype="u8")
_POWER: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64."""
    if "p" not in _POWER or len(_POWER["p"]) < n:
        n = max(n, 2 * BLOB)
        inverse = np.uint64(pow(int(_B), -1, 1 << 64))
        for k, b in (("p", _B), ("q", inverse)):
            a = np.full(n, b, "u8")
            a[0] = 1
            _POWER[k] = np.cumprod(a)
    return _POWER["p"], _POWER["q"]


def _least(raw: np.ndarray) -> np.ndarray:
    """The smallest hashed gram in the LENGTH bytes from each byte on, 48 bits each."""
    h, m = _TABLE[raw], 1
    while m < 16:
        if m == 8:
            eight = h
        g = h[:-m] * np.uint64(pow(int(_B), m, 1 << 64))
        g += h[m:]
        h, m = g, 2 * m
    h = h[: len(h) - 8]
    h *= np.uint64(pow(int(_B), 8, 1 << 64))
    h += eight[16:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h >>= np.uint64(16)
    k = 1
    while 2 * k <= WINDOW:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.minimum(h[: len(h) - (WINDOW - k)], h[WINDOW - k :])


def anchors(raw: np.ndarray, ends: np.ndarray, skip: np.ndarray):
    """(start, count, value, document) of runs of strings with one anchor value, of documents not in skip.

    A run is `count` strings of LENGTH that begin one byte after the other in one document.
    """
    empty = np.zeros(0, "i8")
    n = len(raw) - LENGTH + 1
    if n < 1:
        return empty, empty, empty.astype("u8"), empty
    low = np.concatenate([_least(raw[i : i + CHUNK + LENGTH - 1]) for i in range(0, n, CHUNK)])
    starts = np.append(0, ends[:-1])
    count = np.where(skip, 0, np.maximum(0, ends - starts - LENGTH + 1))
    change = np.zeros(n + 1, "i1")
    some = count > 0
    change[starts[some]] += 1
    change[starts[some] + count[some]] -= 1
    valid = np.cumsum(change[:-1]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    at = np.flatnonzero(new)
    stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
    # least values crowd together at the low end: spread them, one to one, so that ranges are alike
    value = (low[at] * _B) & np.uint64((1 << 48) - 1)
    return at, stop - at, value, np.searchsorted(ends, at, side="right")


def _planes(v: np.ndarray) -> bytes:
    """Sorted 48-bit values, byte by byte, which the exchange's codec shrinks well."""
    return np.ascontiguousarray(v.astype("<u8").view("u1").reshape(-1, 8)[:, :6].T).tobytes()


def _unplaned(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), "u1")
    out[:, :6] = np.frombuffer(b, "u1").reshape(6, -1).T
    return out.view("<u8").ravel()


def _distinct(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and whether two documents have each."""
    order = np.argsort(value, kind="stable")
    v, d = value[order], doc[order]
    first = np.append(True, v[1:] != v[:-1])[: len(v)]
    at = np.flatnonzero(first)
    if not len(at):
        return v, np.zeros(0, bool)
    return v[at], np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)


def _range_of(v: np.ndarray, n: int) -> np.ndarray:
    return ((v >> np.uint64(16)) * np.uint64(n) >> np.uint64(32)).astype("i8")


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blobs as a bucketed table: (blob, ids, ends, digests, raw); a null id is the largest number."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]):
        part, seq = TaskContext.get().partitionId(), 0
        ids, raws, size = [], [], 0

        def row():
            nonlocal ids, raws, size, seq
            ends = np.cumsum([len(r) for r in raws])
            digests = [hashlib.sha256(r).digest() for r in raws]
            out = pa.RecordBatch.from_arrays([pa.array([part << 32 | seq]), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([digests], pa.list_(pa.binary())), pa.array([b"".join(raws)], pa.binary())], names=["blob", "ids", "ends", "digests", "raw"])
            ids, raws, size, seq = [], [], 0, seq + 1
            return out

        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                if raws and size + len(raw) > BLOB:
                    yield row()
                ids.append(2**63 - 1 if i is None else i)
                raws.append(raw)
                size += len(raw)
        if raws:
            yield row()

    blobs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "blob long, ids array<long>, ends array<long>, digests array<binary>, raw binary")
    name = f"passages_{uuid.uuid4().hex}"
    blobs.write.bucketBy(partitions(spark), "blob").option("path", table_path(spark, name)).format("parquet").saveAsTable(name)
    return spark.table(name)


def copies(blobs: DataFrame) -> DataFrame:
    """(blob, skip): positions in each blob of documents that equal one with a smaller id."""
    d = blobs.select("blob", F.posexplode(F.arrays_zip("ids", "digests")).alias("k", "d")).select("blob", "k", F.col("d.ids").alias("id"), F.col("d.digests").alias("digest"))
    first = d.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialize(first, "passages-copies")  # a side of its own, so that the join can split a hot text
    return d.join(first, "digest").where("id > first").groupBy("blob").agg(F.collect_list("k").alias("skip"))


def _skips(ends: np.ndarray, skip) -> np.ndarray:
    out = np.zeros(len(ends), bool)
    if skip is not None and len(skip):
        out[np.asarray(skip)] = True
    return out


def _rows(batches: Iterator[pa.RecordBatch], *more: str):
    """Blob by blob: id, document ids, ends, skip and the raw bytes, then further columns as Python values."""
    for b in batches:
        for i in range(b.num_rows):
            ends = b.column("ends")[i].values.to_numpy()
            raw = np.frombuffer(b.column("raw")[i].as_buffer(), "u1")
            ids = b.column("ids")[i].values.to_numpy() if "ids" in b.schema.names else None
            yield b.column("blob")[i].as_py(), ids, ends, _skips(ends, b.column("skip")[i].as_py()), raw, *(b.column(c)[i].as_py() for c in more)


def _alike(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether raw[a : a + size] equals raw[b : b + size], pair by pair, all bytes compared; size is 8 at least."""
    words = np.ndarray((max(0, len(raw) - 7),), "<u8", np.ascontiguousarray(raw), strides=(1,))
    out = np.ones(len(a), bool)
    n = (size + 7) // 8
    ends = np.cumsum(n)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK)))
        m = n[i:j]
        pair = np.repeat(np.arange(i, j), m)
        at = np.minimum(8 * (np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m)), size[pair] - 8)
        out[pair[words[a[pair] + at] != words[b[pair] + at]]] = False
        i = j
    return out


def _distinct_stretches(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, content: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which places of an order by size and hash begin a new stretch: one of other bytes than the one before."""
    new = np.append(True, (size[order][1:] != size[order][:-1]) | (content[order][1:] != content[order][:-1]))[: len(order)]
    k = np.flatnonzero(~new)
    new[k] = ~_alike(raw, begin[order[k]], begin[order[k - 1]], size[order[k]])
    return new


def stretches(ids, ends, skip, raw, masks):
    """The stretches of a blob around shared anchors.

    masks: [(range, bits)] over the blob's distinct anchor values in order. Returns runs (start, count,
    doc, stretch number) and per distinct stretch: value, an occurrence of the smallest id, its count.
    """
    start, count, value, doc = anchors(raw, ends, skip)
    uniq, _ = _distinct(value, doc)
    bits = np.concatenate([np.unpackbits(np.frombuffer(m["mask"], "u1"), count=m["n"]) for m in sorted(masks, key=lambda m: m["r"])]).astype(bool) if masks else np.zeros(len(uniq), bool)
    shared = uniq[bits]
    if not len(shared):
        none = np.zeros(0, "i8")
        return (none,) * 4, (none.astype("u8"), none, none)
    at = np.minimum(np.searchsorted(shared, value), len(shared) - 1)
    keep = shared[at] == value
    start, count, value, doc = start[keep], count[keep], value[keep], doc[keep]
    p, q = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, "u8")
    np.cumsum(_TABLE[raw] * p[: len(raw)], out=total[1:])
    content = (total[start + count + LENGTH - 1] - total[start]) * q[start]
    order = np.lexsort((ids[doc], content, count, value))
    v = value[order]
    first = _distinct_stretches(raw, start, count + LENGTH - 1, content, order) | np.append(True, v[1:] != v[:-1])
    number = np.empty(len(order), "i8")
    number[order] = np.cumsum(first) - 1
    heads = order[first]
    return (start, count, doc, number), (value[heads], heads, count[heads])


def earlier(lengths: np.ndarray, docs: np.ndarray, raw: np.ndarray, store: Store | None = None) -> np.ndarray:
    """Per string of every stretch: whether it occurs in a stretch of a smaller document id.

    Stretch i holds lengths[i] strings of document docs[i]; raw has the stretches one after the other.
    Equal stretches are one in the sorted text, with their smallest id.
    """
    size = lengths + LENGTH - 1
    ends = np.cumsum(size)
    begins = ends - size
    p, q = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, "u8")
    np.cumsum(_TABLE[raw] * p[: len(raw)], out=total[1:])
    content = (total[ends] - total[begins]) * q[begins]
    order = np.lexsort((docs, content, lengths))
    new = _distinct_stretches(raw, begins, size, content, order)
    number = np.empty(len(order), "i8")
    number[order] = np.cumsum(new) - 1
    heads = order[new]
    # the distinct stretches with a smallest character between them
    hs = size[heads]
    ends2 = np.cumsum(hs + 1)
    begins2 = ends2 - hs - 1
    text = np.zeros(int(ends2[-1]), "u2")
    step = np.arange(int(hs.sum()), dtype="i4")
    source = raw[np.repeat((begins[heads] - (np.cumsum(hs) - hs)).astype("i4"), hs) + step]
    text[np.repeat((begins2 - (np.cumsum(hs) - hs)).astype("i4"), hs) + step] = source.astype("u2") + 1
    del step, source, total
    sa, common = suffix_order(text, 257, LENGTH, store)
    group = np.cumsum(common < LENGTH, dtype="i4")
    owner = np.repeat(np.arange(len(heads), dtype="i4"), hs + 1)[sa]
    whole = ends2[owner] - 1 - sa >= LENGTH
    sa, owner, group = sa[whole], owner[whole], group[whole]  # a suffix of fewer bytes is alone in its group
    first = np.append(True, group[1:] != group[:-1])
    least = np.minimum.reduceat(docs[heads][owner], np.flatnonzero(first))[np.cumsum(first) - 1]
    of = np.empty(int(ends2[-1]), "i8")
    of[sa] = least
    # back to every stretch: string j of stretch i is string j of its distinct one
    base = np.repeat(begins2[number] - (np.cumsum(lengths) - lengths), lengths)
    return of[base + np.arange(int(lengths.sum()))] < np.repeat(docs, lengths)


def scratch(spark: SparkSession) -> str | None:
    """A folder in the shared one for the files of sorts beyond their memory bound, if that is a mounted path."""
    place = urlparse(table_path(spark, "passages-sort"))
    return place.path if place.scheme in ("", "file") else None


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), a row per row of docs.

    A byte goes if a string of LENGTH bytes of its text covers it that also starts in a document with a
    smaller id, in the input; matches stay inside documents and overlaps count. Null texts are empty.
    A null id is larger than any other; rows that repeat an id are no earlier than one another. An empty
    table gives an empty result. Any string may be in any number of documents: a blob sends each stretch
    once, and ranges hold hashed anchors, so no key gathers rows. Columns of docs other than the two are
    not read, so their names don't matter; ties among equal texts go by id alone.
    """
    spark = small_batches(docs.sparkSession)
    blobs = pack(docs, id_col, text_col)
    held = blobs.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    n_ranges = max(2 * partitions(spark), -(-held // RANGE_BYTES))
    folder = scratch(spark)
    skip = copies(blobs)
    with_skip = blobs.join(skip, "blob", "left")

    def ask(batches):
        for blob, _, ends, skips, raw in _rows(batches):
            _, _, value, doc = anchors(raw, ends, skips)
            uniq, several = _distinct(value, doc)
            r = _range_of(uniq, n_ranges)
            cuts = [0, *(np.flatnonzero(np.diff(r)) + 1).tolist(), len(r)]
            out = [(int(r[i]), blob, j - i, _planes(uniq[i:j]), np.packbits(several[i:j]).tobytes()) for i, j in zip(cuts, cuts[1:], strict=False) if j > i]
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary()), pa.array(c[4], pa.binary())], names=["r", "blob", "n", "vals", "several"])

    def share(t: pa.Table) -> pa.Table:
        vals = [_unplaned(v) for v in t.column("vals").to_pylist()]
        n = t.column("n").to_pylist()
        several = np.concatenate([np.unpackbits(np.frombuffer(s, "u1"), count=m) for s, m in zip(t.column("several").to_pylist(), n, strict=True)]).astype(bool)
        v = np.concatenate(vals)
        order = np.argsort(v, kind="stable")
        s = v[order]
        eq = s[1:] == s[:-1]
        hit = np.append(eq, False) | np.append(False, eq)
        shared = several.copy()
        shared[order] |= hit
        # blobs that hold a value in one document see it shared if another blob has it in several
        masks, at = [], 0
        for m in n:
            masks.append(np.packbits(shared[at : at + m]).tobytes())
            at += m
        return pa.table({"blob": t.column("blob"), "m": pa.array([{"r": r, "n": k, "mask": x} for r, k, x in zip(t.column("r").to_pylist(), n, masks, strict=True)], pa.struct([("r", pa.int32()), ("n", pa.int32()), ("mask", pa.binary())]))})

    asked = with_skip.select("blob", "ends", "skip", "raw").mapInArrow(trimmed(ask), "r int, blob long, n int, vals binary, several binary")
    masks = asked.groupBy("r").applyInArrow(share, "blob long, m struct<r:int,n:int,mask:binary>").groupBy("blob").agg(F.collect_list("m").alias("masks"))
    masks = materialize(masks, "passages-masks")
    marked = with_skip.join(masks, "blob", "left")

    def send(batches):
        for blob, ids, ends, skips, raw, ms in _rows(batches, "masks"):
            (start, count, doc, _), (value, heads, n) = stretches(ids, ends, skips, raw, ms)
            part = _range_of(value, n_ranges * PARTS)
            r = part // PARTS
            cuts = [0, *(np.flatnonzero(np.diff(r)) + 1).tolist(), len(r)]
            out = []
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j > i:
                    b, c = start[heads[i:j]], n[i:j]
                    size = c + LENGTH - 1
                    at = np.repeat(b - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    parts = np.bincount(part[i:j] % PARTS, minlength=PARTS)
                    out.append((int(r[i]), blob, c.astype("<u4").tobytes(), ids[doc[heads[i:j]]].astype("<i8").tobytes(), parts.astype("<u4").tobytes(), raw[at].tobytes()))
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), *(pa.array(x, pa.binary()) for x in c[2:])], names=["r", "blob", "counts", "docs", "parts", "raw"])

    def sort(t: pa.Table) -> pa.Table:
        counts = [np.frombuffer(x, "<u4").astype("i8") for x in t.column("counts").to_pylist()]
        docs_ = [np.frombuffer(x, "<i8") for x in t.column("docs").to_pylist()]
        raws = [x.as_buffer() for x in t.column("raw")]
        first = np.array([np.append(0, np.cumsum(np.frombuffer(x, "<u4").astype("i8"))) for x in t.column("parts").to_pylist()])  # stretch by row and part
        begin = [np.append(0, np.cumsum(c + LENGTH - 1)) for c in counts]  # byte by stretch
        size = sum(b[f] for b, f in zip(begin, first, strict=True))  # bytes before each part
        out: list[list[np.ndarray]] = [[] for _ in counts]
        p = 0
        while p < PARTS:
            e = p + 1
            while e < PARTS and size[e + 1] - size[p] <= SHARD:
                e += 1
            rows = [i for i in range(len(counts)) if first[i, e] > first[i, p]]
            if rows:
                cs = [counts[i][first[i, p] : first[i, e]] for i in rows]
                raw = np.concatenate([np.frombuffer(raws[i], "u1")[begin[i][first[i, p]] : begin[i][first[i, e]]] for i in rows])
                flags = earlier(np.concatenate(cs), np.concatenate([docs_[i][first[i, p] : first[i, e]] for i in rows]), raw, Store(folder=folder))
                at = 0
                for i, c in zip(rows, cs, strict=True):
                    m = int(c.sum())
                    out[i].append(flags[at : at + m])
                    at += m
            p = e
        done = [np.concatenate(x) for x in out]
        return pa.table({"blob": t.column("blob"), "f": pa.array([{"r": r, "n": len(x), "flags": np.packbits(x).tobytes()} for r, x in zip(t.column("r").to_pylist(), done, strict=True)], pa.struct([("r", pa.int32()), ("n", pa.int64()), ("flags", pa.binary())]))})

    sent = marked.select("blob", "ids", "ends", "skip", "raw", "masks").mapInArrow(trimmed(send), "r int, blob long, counts binary, docs binary, parts binary, raw binary")
    sent = sent.repartition(n_ranges, "r")  # as many tasks as ranges, since sorting costs far more than reading
    flags = sent.groupBy("r").applyInArrow(sort, "blob long, f struct<r:int,n:long,flags:binary>").groupBy("blob").agg(F.collect_list("f").alias("flags"))
    flags = materialize(flags, "passages-flags")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept

    def cut(batches):
        for _, ids, ends, skips, raw, ms, fs in _rows(batches, "masks", "flags"):
            (start, count, doc, number), (_, heads, n) = stretches(ids, ends, skips, raw, ms)
            gone = np.zeros(len(raw) + 1, "i4")
            if len(start):
                bits = np.concatenate([np.unpackbits(np.frombuffer(f["flags"], "u1"), count=f["n"]) for f in sorted(fs, key=lambda f: f["r"])]).astype(bool)
                base = np.cumsum(n) - n
                mine = np.repeat(base[number] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                later = ids[doc] > ids[doc[heads]][number]  # the stretch is in an earlier document of this blob
                on = bits[mine] | np.repeat(later, count)
                where = (np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum())))[on]
                np.add.at(gone, where, 1)
                np.add.at(gone, where + LENGTH, -1)
            cover = np.cumsum(gone[:-1]) > 0
            rows, at = [], 0
            for k, end in enumerate(ends.tolist()):
                c = cover[at:end]
                if skips[k]:
                    c = np.full(end - at, end - at >= LENGTH)
                kept = raw[at:end][~c].tobytes()
                spans = int(c[0]) + int((c[1:] & ~c[:-1]).sum()) if end > at else 0
                i = int(ids[k])
                rows.append((None if i == 2**63 - 1 else i, end - at, int(c.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
                at = end
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4]), *([pa.array(c[5], pa.binary())] if with_kept else [])], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    out = marked.join(flags, "blob", "left").select("blob", "ids", "ends", "skip", "raw", "masks", "flags").mapInArrow(trimmed(cut), schema)
    return out.withColumnRenamed("doc_id", id_col)


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: what goes and what stays of every document."""
    return removals(read(spark, sf_dir, "documents"))


#: DuckDB: every string of 50 bytes with the smallest document that has it.
ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS e, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, e[p + 1 : p + 50] AS s FROM (SELECT doc_id, e, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
bad AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE m < doc_id),
bytes AS (SELECT doc_id, p, hex(e[p + 1 : p + 1]) AS x FROM (SELECT doc_id, e, unnest(range(0, n)) AS p FROM d)),
seen AS (SELECT b.doc_id, b.p, x, max(bad.p) OVER (PARTITION BY b.doc_id ORDER BY b.p) AS last FROM bytes b LEFT JOIN bad ON bad.doc_id = b.doc_id AND bad.p = b.p),
cut AS (SELECT doc_id, p, x, coalesce(last >= p - 49, false) AS gone FROM seen),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM cut)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed, CAST(count(*) FILTER (WHERE opens) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(string_agg(x, '' ORDER BY p) FILTER (WHERE NOT gone), ''))) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id, n
"""
