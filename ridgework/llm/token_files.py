"""Token-ID files of directly addressable codes.

A segment holds the ids of a run of documents. Each id is cut into chunks of 8 bits, lowest first; level
k stores chunk k of the ids that need it, a bitmap that says which of them go on to level k + 1, and a
rank directory of the bitmap, so id i of the segment is found by one rank query per level.

Segment layout, little-endian: b"DAC1", u32 documents, u64 ids, u32 levels; i64 document ids; u64
document starts (documents + 1 of them, within the segment); per level: u64 chunks, the chunk bytes,
the bitmap (bit i of byte i // 8), u32 ranks before each block of 512 bits.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _slices
from .common import partitions, read, small_batches, table_path, trimmed
from .segments import merged

TOKENIZER, END_ID, BLOCK = "byte_bpe_50k.json", 2, 512
#: Ids of one segment at most, unless one document has more.
SEGMENT_IDS = 2_000_000
#: Key ranges of a corpus at most; their bounds and offsets are all that the driver sees.
MOST_RANGES = 10_000


def pack(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment."""
    levels, rest = [], ids.astype("<u4")
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(bits) // (BLOCK // 8)) * (BLOCK // 8), "u1")
        padded[: len(bits)] = bits
        counts = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype="u8")
        ranks = np.concatenate([[0], np.cumsum(counts)])[: len(counts)].astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype("u1").tobytes() + padded.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    head = struct.pack("<4sIQI", b"DAC1", len(doc_ids), len(ids), len(levels))
    return head + doc_ids.astype("<i8").tobytes() + starts.astype("<u8").tobytes() + b"".join(levels)


class Segment:
    """Reader of one segment; nothing is decoded until asked for."""

    def __init__(self, payload: bytes):
        magic, n, self.n_ids, levels = struct.unpack_from("<4sIQI", payload, 0)
        if magic != b"DAC1":
            raise ValueError("not a segment")
        at = 20
        self.doc_ids = np.frombuffer(payload, "<i8", n, at)
        self.starts = np.frombuffer(payload, "<u8", n + 1, at + 8 * n).astype("i8")
        at += 16 * n + 8
        self.levels = []
        for _ in range(levels):
            (m,) = struct.unpack_from("<Q", payload, at)
            blocks = -(-m // BLOCK)
            chunks = np.frombuffer(payload, "u1", m, at + 8)
            bits = np.frombuffer(payload, "u1", blocks * BLOCK // 8, at + 8 + m)
            ranks = np.frombuffer(payload, "<u4", blocks, at + 8 + m + blocks * BLOCK // 8)
            self.levels.append((chunks, bits, ranks))
            at += 8 + m + blocks * (BLOCK // 8 + 4)

    def __getitem__(self, i: int) -> int:
        """Id i of the segment, by one rank query per level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = bits[block * (BLOCK // 8) : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
            shift += 8
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, reading only their own chunks on each level."""
        out = np.zeros(stop - start, "<u4")
        where, lo, hi = np.arange(stop - start), start, stop
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out[where] |= chunks[lo:hi].astype("<u4") << np.uint32(8 * k)
            more = np.unpackbits(bits[lo >> 3 : (hi + 7) >> 3], bitorder="little")[lo & 7 :][: hi - lo].astype(bool)
            where = where[more]
            if not len(where):
                break
            block = lo // BLOCK
            before = bits[block * (BLOCK // 8) : lo >> 3]
            lo = int(ranks[block]) + int(np.bitwise_count(before).sum()) + ((int(bits[lo >> 3]) & ((1 << (lo & 7)) - 1)).bit_count() if lo & 7 else 0)
            hi = lo + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


_ALNUM, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_SPACE[[*range(9, 14), *range(28, 33)]] = True
#: How byte-level vocabularies write bytes: 33 to 126, 161 to 172 and 174 to 255 as themselves, the others from 256 on. Zero stands for a line end, and line ends stay.
_VISIBLE = dict(zip((b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)), range(256, 512), strict=False))
_VISIBLE |= {0: _VISIBLE[10], 10: 10}
#: First bytes in UTF-8 of all white space beyond ASCII.
_WIDE = np.array([0xC2, 0xE1, 0xE2, 0xE3], "u1")


class Coder:
    """A library tokenizer that encodes the new pieces of a batch of texts in one call.

    Texts are cut at spaces, before a full stop or comma after a Latin letter or digit, and around a line
    end between two characters that are not white space: a pre-token ends at each of these. The ids of LIMIT
    pieces at most are kept, in arrays. A text in which one of these places is no such border is cut at
    lone spaces only.
    """

    #: Marks of pieces without a space before them and of a text's end, and the ids of that end and of a piece that can't stand alone.
    GLUED, LINE, END, STOP, BAD = "\1", "\2", "\3", 0xFFFFFFFE, 0xFFFFFFFF
    #: A white-space run that is one token and stands between words in one call.
    GAP = "\n\n"
    LIMIT = 1_000_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.t = Tokenizer.from_file(path)
        self.special = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.gap, self.line = (np.frombuffer(self.one(x), "<u4") for x in (self.GAP, "\n"))
        self.bad = np.array([self.BAD], "<u4").tobytes()
        # the library's model alone, for pieces of letters: one pre-token each, so that its pattern needn't run
        self.model = Tokenizer(self.t.model)
        self.model.pre_tokenizer = CharDelimiterSplit("\n")
        probe = ["Probe", "\u00e9t\u00e9", "\u0101", "x"]
        if self.t.normalizer is not None or self.letters(probe, " ") != self.joined(probe, " ", self.GAP, self.gap) or self.letters(probe, "") != self.joined(probe, "", "\n", self.line):
            self.model = None
        self.forget()

    def forget(self, keep: np.ndarray | None = None) -> None:
        """Keep only some of the known pieces: their names, ids one after the other, where these begin, how many, and whether they were met since the last time."""
        if keep is None:
            self.names, self.flat = pa.array([], pa.large_string()), np.zeros(0, "<u4")
            self.start, self.size, self.met = np.zeros(0, "i8"), np.zeros(0, "i4"), np.zeros(0, bool)
            return
        size = self.size[keep]
        begin = np.cumsum(size, dtype="i8") - size
        self.flat = self.flat[np.repeat(self.start[keep] - begin, size) + np.arange(int(size.sum()))]
        self.names, self.start, self.size, self.met = self.names.take(pa.array(keep)), begin, size, np.zeros(len(keep), bool)

    def one(self, text: str) -> bytes:
        return np.array(self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def joined(self, names: list[str], lead: str, between: str, gap: np.ndarray) -> list[bytes]:
        """The ids of each of lead + name, by one call with `between` between names."""
        if not names:
            return []
        raw = self.one(lead + (between + lead).join(names))
        gaps = np.flatnonzero(np.frombuffer(raw, "<u4") == gap[0])
        if len(gap) != 1 or len(gaps) != len(names) - 1:  # a name holds the gap itself
            return [self.one(lead + w) for w in names]
        starts, ends = [0, *(4 * gaps + 4).tolist()], [*(4 * gaps).tolist(), len(raw)]
        return [raw[i:j] for i, j in zip(starts, ends, strict=True)]

    def letters(self, names: list[str], lead: str) -> list[bytes]:
        """joined() of names that hold Latin letters only."""
        if not names:
            return []
        text = (lead + f"\n\0\n{lead}".join(names)).encode().decode("latin-1").translate(_VISIBLE)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        raw, gaps = ids.tobytes(), np.flatnonzero(ids == self.line[0])
        starts, ends = [0, *(4 * gaps + 4).tolist()], [*(4 * gaps).tolist(), len(raw)]
        return [raw[i:j] for i, j in zip(starts, ends, strict=True)]

    def all_of(self, names: list[str], lead: str, between: str, gap: np.ndarray):
        """(name, ids of lead + name) of all names."""
        if self.model is None:
            return zip(names, self.joined(names, lead, between, gap), strict=True)
        plain = [w for w in names if w.isalpha() and max(w) < "\u0250"]
        rest = list(set(names).difference(plain))
        return chain(zip(plain, self.letters(plain, lead), strict=True), zip(rest, self.joined(rest, lead, between, gap), strict=True))

    def learn(self, names: pa.Array) -> None:
        """Make pieces known that aren't."""
        new = names.to_pylist()
        words = [w for w in new if w and w.strip() == w and w[0] > self.END]
        lines = [w[1:] for w in new if w[:1] == self.LINE and w[1:].strip() == w[1:] != ""]
        known = dict.fromkeys(new, self.bad)
        known.update(self.all_of(words, " ", self.GAP, self.gap))
        known.update((self.LINE + w, code) for w, code in self.all_of(lines, "", "\n", self.line))
        known.update((w, self.one(w[1:])) for w in new if w[:1] == self.GLUED and (w[1:].strip() == w[1:] or w[1:] == "\n"))
        known |= {self.END: np.array([self.STOP], "<u4").tobytes(), self.LINE: b""}
        codes = [known[w] for w in new]
        size = np.fromiter(map(len, codes), "i4", len(codes)) // 4
        self.start = np.append(self.start, len(self.flat) + np.cumsum(size, dtype="i8") - size)
        self.size, self.met = np.append(self.size, size), np.append(self.met, np.ones(len(new), bool))
        self.flat = np.append(self.flat, np.frombuffer(b"".join(codes), "<u4"))
        self.names = pa.concat_arrays([self.names, names])

    def places(self, names: pa.Array) -> np.ndarray:
        """Where distinct pieces are among the known ones, new ones included."""
        if len(self.names) + len(names) > self.LIMIT:
            met = np.flatnonzero(self.met)
            self.forget(met if len(met) + len(names) < self.LIMIT // 2 else met[len(met) - self.LIMIT // 4 :])
        at = pc.index_in(names, value_set=self.names)
        fresh = names.filter(at.is_null())
        old = at.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        self.met[old[old >= 0]] = True
        if len(fresh):
            old[old < 0] = len(self.names) + np.arange(len(fresh))
            self.learn(fresh)
        return old

    @staticmethod
    def unsafe(raw: np.ndarray) -> np.ndarray:
        """Places of a full stop, comma or line end, in UTF-8, that may be no border; zero bytes stand around texts."""
        raw = np.concatenate([np.zeros(3, "u1"), raw, np.zeros(1, "u1")])
        stops, ends = np.flatnonzero((raw == 46) | (raw == 44)), np.flatnonzero(raw == 10)
        b, lead = raw[stops - 1], raw[stops - 2]
        latin = (b >= 128) & (lead >= 0xC3) & (lead <= 0xC8) & ~((lead == 0xC3) & ((b == 0x97) | (b == 0xB7)))
        plain = _ALNUM[b] | latin
        b, nxt = raw[ends - 1], raw[ends + 1]
        space = _SPACE[b] | _SPACE[nxt] | np.isin(nxt, _WIDE) | ((b >= 128) & (np.isin(raw[ends - 2], _WIDE) | np.isin(raw[ends - 3], _WIDE)))
        marks = np.flatnonzero((raw > 0) & (raw < 4))
        return np.concatenate([stops[~plain], ends[space], marks]) - 3

    def slow(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that are cut at lone spaces only, or not at all if a special token is in them."""
        out = []
        for t in texts:
            if any(x in t for x in self.special):
                out.append(self.one(t))
                continue
            parts = merged(t.split(" "))
            new = list(set(parts))
            ids = dict(zip(new, (np.array(e.ids, "<u4").tobytes() for e in self.t.encode_batch_fast(new, add_special_tokens=False)), strict=True))
            out.append(b"".join(map(ids.__getitem__, parts)))
        return out

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts."""
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        begin = np.cumsum([0, *(len(r) + 1 for r in raws)])
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(begin, self.unsafe(np.frombuffer(b"\0".join(raws), "u1")), side="right") - 1] = True
        del raws
        for x in self.special:
            odd |= np.array([x in t for t in texts], bool)
        clear = np.flatnonzero(~odd).tolist()
        marked = "".join(f"{self.LINE}{texts[i]} {self.END} " for i in clear)
        marked = marked.replace(".", f" {self.GLUED}.").replace(",", f" {self.GLUED},").replace("\n", f" {self.GLUED}\n {self.LINE}")
        pieces = pc.split_pattern(pa.array([marked[:-1]], pa.large_string()), " ").values.dictionary_encode()
        del marked
        where = self.places(pieces.dictionary)[pieces.indices.to_numpy()] if clear else np.zeros(0, "i4")
        size = self.size[where]
        at = np.repeat((self.start[where] - (np.cumsum(size, dtype="i8") - size)).astype("i4"), size)
        at += np.arange(len(at), dtype="i4")
        ids = self.flat[at]
        del pieces, where, size, at
        ends = np.flatnonzero(ids == self.STOP)
        odd[np.array(clear, "i8")[np.searchsorted(ends, np.flatnonzero(ids == self.BAD))]] = True
        out, at = [None] * len(texts), 0
        for i, e in zip(clear, ends.tolist(), strict=True):
            out[i], at = ids[at:e], e + 1
        rest = np.flatnonzero(odd).tolist()
        for i, code in zip(rest, self.slow([texts[i] for i in rest]), strict=True):
            out[i] = np.frombuffer(code, "<u4")
        return out


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One coder per worker process and file."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def encoded(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, cuts: list[int]) -> DataFrame:
    """(key_range, doc_id, ids) with ids as the bytes of unsigned 16-bit or, where one needs it, 32-bit integers after a width byte."""

    def run(batches: Iterator[pa.RecordBatch]):
        c, bounds = coder(path), np.array(cuts, "i8")
        ends = {t: np.array([end_id], t).tobytes() for t in ("<u2", "<u4") if end_id < 65536 or t == "<u4"}
        for b in _slices(batches, "text", 8 << 20):
            codes = c.batch(b.column("text").fill_null("").to_pylist())
            kind, mark = ("<u2", b"\2") if end_id < 65536 and max((int(x.max(initial=0)) for x in codes), default=0) < 65536 else ("<u4", b"\4")
            out = [mark + x.astype(kind).tobytes() + ends[kind] for x in codes]
            doc = b.column("doc_id")
            at = np.searchsorted(bounds, doc.fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), doc, pa.array(out, pa.binary())], names=["key_range", "doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "key_range int, doc_id long, ids binary")


def ids_of(code: bytes) -> np.ndarray:
    return np.frombuffer(code, "<u2" if code[0] == 2 else "<u4", offset=1)


def write(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> None:
    """Write the ids of all documents as segments in ascending id order.

    out gets a table whose rows are (key_range, segment, before, n_ids, payload): payload is a segment as
    described above, before the ids of its range that precede it; null texts are empty and null ids come first. Ranges of ids, cut at quantiles so
    that each is about one shuffle partition, make the order: texts are encoded where they are read and
    only ids are shuffled. A heavily repeated id makes its range larger; a range is written segment by
    segment, so memory does not follow it. Rows that repeat an id are written each, in any order among
    themselves; other columns are not read, so their names don't matter; an empty table gives no segments.
    """
    spark = small_batches(docs.sparkSession)
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    n = min(MOST_RANGES, ranges or 2 * partitions(spark))
    cuts = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [i / n for i in range(1, n)] or [0.5], 100_000).alias("q")).first().q
    cuts = sorted(set(cuts or []))

    def segments(batches: Iterator[pa.RecordBatch]):
        key, number, before, docs_, codes, held = None, 0, 0, [], [], 0

        def flush():
            nonlocal number, before, docs_, codes, held
            starts = np.cumsum([0, *((len(x) - 1) // x[0] for x in codes)])
            narrow = all(x[0] == 2 for x in codes)
            ids = np.frombuffer(b"".join([x[1:] for x in codes]), "<u2") if narrow else np.concatenate([ids_of(x) for x in codes])
            row = pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([number], pa.int64()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([pack(np.array(docs_, "i8"), starts, ids)], pa.binary())], names=["key_range", "segment", "before", "n_ids", "payload"])
            number, before, docs_, codes, held = number + 1, before + held, [], [], 0
            return row

        for b in batches:
            for k, d, code in zip(b.column("key_range").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                m = (len(code) - 1) // code[0]
                if codes and (k != key or held + m > SEGMENT_IDS):
                    yield flush()
                if k != key:
                    key, number, before = k, 0, 0
                docs_.append(-(2**63) if d is None else d)
                codes.append(code)
                held += m
        if codes:
            yield flush()

    dealt = encoded(docs, path, end_id, id_col, text_col, cuts).repartition(max(1, min(n, partitions(spark))), "key_range").sortWithinPartitions("key_range", "doc_id")
    dealt.mapInArrow(trimmed(segments), "key_range int, segment long, before long, n_ids long, payload binary").write.option("compression", "none").parquet(out)


def offsets(files: DataFrame) -> DataFrame:
    """(key_range, start): ids before each range, from the sizes stored beside the segments; MOST_RANGES rows at most."""
    per = files.groupBy("key_range").agg(F.sum("n_ids").alias("n"))
    return per.select("key_range", (F.sum("n").over(Window.orderBy("key_range")) - F.col("n")).alias("start"))


def documents_of(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    files = spark.read.parquet(out)
    rows = files.join(F.broadcast(offsets(files)), "key_range").select("payload", (F.col("start") + F.col("before")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for payload, base in zip(b.column("payload"), b.column("base").to_pylist(), strict=True):
                s = Segment(payload.as_py())
                raw, at = memoryview(s.slice(0, s.n_ids).tobytes()), (4 * s.starts).tolist()
                crc = [zlib.crc32(raw[i:j]) for i, j in zip(at, at[1:], strict=False)]
                ids = pa.array(s.doc_ids, mask=s.doc_ids == -(2**63))
                yield pa.RecordBatch.from_arrays([ids, pa.array(base + s.starts[:-1]), pa.array(np.diff(s.starts)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(spark: SparkSession, out: str, i: int) -> int:
    """Id i of the whole corpus: the sizes beside the segments say which one holds it, and only that one is read."""
    files = spark.read.parquet(out)
    starts = files.select("key_range", "segment", "before", "n_ids").join(F.broadcast(offsets(files)), "key_range")
    base = F.col("start") + F.col("before")
    at = starts.where((base <= i) & (F.lit(i) < base + F.col("n_ids"))).select("key_range", "segment", (F.lit(i) - base).alias("k")).first()
    if at is None:
        raise IndexError(i)
    row = files.where((F.col("key_range") == at.key_range) & (F.col("segment") == at.segment)).select("payload").first()
    return Segment(row.payload)[at.k]


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: write every document's ids, read the files back."""
    out = table_path(spark, "token-files")
    write(read(spark, sf_dir, "documents"), out)
    return documents_of(spark, out)
