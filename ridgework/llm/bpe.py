"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string the last token of its BPE encoding is unique, and it is the one
vocabulary token that ends there and is compatible with the last token of the rest. So the encoding of
all prefixes is one table of last tokens: appending bytes extends it exactly, and an edit only
recomputes the entries after it.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, trimmed
from .segments import Generations, SegmentCache

RANKS = "byte_bpe_multi_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file in tiktoken's format."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Ranks, with the merge that forms each token, and the compatibility test for neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.merge: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.longest = max(map(len, ranks))
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                continue
            parts = self._parts(token, rank)
            if len(parts) == 2:  # else no merge ever forms it
                self.merge[parts[0], parts[1]] = rank
                self.halves[rank] = (parts[0], parts[1])
        self.tokens = ahocorasick.Automaton(ahocorasick.STORE_INTS)  # a string of code points below 256 stands for bytes
        for token, rank in ranks.items():
            if len(token) == 1 or rank in self.halves:
                self.tokens.add_word(token.decode("latin-1"), rank)
        self.tokens.make_automaton()
        self.compatible: dict[int, bool] = {}  # by left << 20 | right

    def _parts(self, token: bytes, below: int) -> list[int]:
        ids = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(ids) > 2:
            found = [(m, i) for i in range(len(ids) - 1) if (m := self.merge.get((ids[i], ids[i + 1]), below)) < below]
            if not found:
                break
            m, i = min(found)
            ids[i : i + 2] = [m]
        return ids

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between two neighbouring tokens uncrossed.

        Undoes the two tokens' merges from the latest backwards; the pair is incompatible if at some
        point a merge over the border would have been made earlier than the merge that hides it.
        """
        key = left << 20 | right
        if (known := self.compatible.get(key)) is None:
            if len(self.compatible) > 400_000:
                self.compatible.clear()
            known = self.compatible[key] = self._fits(left, right)
        return known

    def _fits(self, a: int, b: int) -> bool:
        bound = None  # merges over the border of this rank or more come too late
        while True:
            over = self.merge.get((a, b))
            if over is not None and (bound is None or over < bound):
                return False
            ha, hb = self.halves.get(a), self.halves.get(b)
            if ha is None and hb is None:
                return True
            # at equal ranks the left one merges first, so the right one is undone first
            if hb is None or (ha is not None and a > b):
                bound, a = a, ha[1]
            else:
                bound, b = b + 1, hb[0]


def extend(v: Vocabulary, text: str, skip: int, last: list[int]) -> None:
    """Add to last, the last tokens of all prefixes so far, those of the prefixes that end in text.

    text (bytes as code points below 256) begins at byte `skip` of the whole, early enough for every
    token that ends beyond the prefixes so far.
    """
    known, fits, size, push = v.compatible.get, v.fits, v.size, last.append
    done = len(last) - skip
    for end, token in v.tokens.iter(text):  # of tokens with one end the longest comes first
        if end < done:
            continue  # the one that fits has been found already, or the prefix is older
        start = end + 1 - size[token]
        if start + skip:
            left = last[start + skip - 1]
            fit = known(left << 20 | token)
            if fit is None:
                fit = fits(left, token)
            if not fit:
                continue
        push(token)
        done += 1
    if done < len(text):
        raise ValueError("the vocabulary lacks single bytes")


def tokens_of(last: list[int], size: dict[int, int]) -> list[int]:
    """The encoding, read backwards through the table of last tokens."""
    out, end = [], len(last)
    while end:
        token = last[end - 1]
        out.append(token)
        end -= size[token]
    out.reverse()
    return out


class PrefixTable:
    """Last token of every prefix of one piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.v, self.piece, self.last = vocabulary, bytearray(), []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Extend the piece; entries so far stay as they are."""
        skip = max(0, len(self.piece) + 1 - self.v.longest)  # tokens that end later start after it
        self.piece += more
        extend(self.v, self.piece[skip:].decode("latin-1"), skip, self.last)

    def cut(self, n: int) -> None:
        """Keep the first n bytes only."""
        del self.piece[n:], self.last[n:]

    def replace(self, start: int, stop: int, by: bytes) -> None:
        """Replace piece[start:stop]; what lies before start is not computed again."""
        tail = bytes(self.piece[stop:])
        self.cut(start)
        self.append(by + tail)

    def ids(self) -> list[int]:
        """The encoding; a piece that is a token itself stands for that token."""
        if (whole := self.v.ranks.get(bytes(self.piece))) is not None:
            return [whole]
        return tokens_of(self.last, self.v.size)


class Encoder:
    """Whole texts: each match of the pattern separately, no special tokens."""

    #: Characters after a match on which it may depend: the rest of a white-space run, or of a contraction.
    AHEAD = 3

    def __init__(self, vocabulary: Vocabulary, pattern: str = public_tokenizers.PATTERN):
        self.v, self.pattern = vocabulary, regex.compile(pattern)
        self.pieces = Generations(50_000)
        self.cache = SegmentCache(self._segment, 200_000)

    def forget(self) -> None:
        """Empty the caches."""
        self.pieces = Generations(self.pieces.limit)
        self.cache = SegmentCache(self._segment, 200_000)
        self.v.compatible.clear()

    def _piece(self, piece: str) -> bytes:
        """A new piece's ids, as bytes; a piece that is a token itself stands for that token."""
        raw, last = piece.encode(), []
        if (whole := self.v.ranks.get(raw)) is not None:
            return array("i", (whole,)).tobytes()
        extend(self.v, raw.decode("latin-1"), 0, last)
        return array("i", tokens_of(last, self.v.size)).tobytes()

    def _segment(self, text: str) -> bytes:
        if text[0] == " " and text[1:].isalpha():  # one match; the caller keeps it
            return self._piece(text)
        out, pieces, words = [], self.pieces, self.cache
        for piece in self.pattern.findall(text):
            word = piece[1:] if piece[0] == " " and piece[1:].isalpha() else ""
            code = (dict.get(words, word) or words.old.get(word)) if word else pieces.find(piece)
            if code is None:
                code = self._piece(piece)
                if len(piece) < 200:
                    words.keep(word, code) if word else pieces.put(piece, code)
            out.append(code)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.cache.text(text), "<i4")

    def encode_bytes(self, text: str) -> bytes:
        return self.cache.text(text)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, ids))


class EditableText:
    """A text with its encoding kept up to date under appends and edits.

    Holds a PrefixTable per pattern match. An edit re-cuts only from the first match it can reach until
    matches fall on old borders again; the match it changes reuses the table of its unchanged prefix.
    """

    def __init__(self, encoder: Encoder, text: str = ""):
        self.e, self.text, self.starts, self.tables = encoder, "", [], []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, by: str) -> None:
        """text[start:stop] = by."""
        old, starts, tables = self.text, self.starts, self.tables
        new = old[:start] + by + old[stop:]
        ends = starts[1:] + [len(old)] if starts else []
        keep = 0
        while keep < len(starts) and ends[keep] + self.e.AHEAD <= start:
            keep += 1
        at = starts[keep] if keep < len(starts) else (ends[-1] if ends else 0)
        shift = len(new) - len(old)
        later = {s + shift: i for i, s in enumerate(starts) if s >= stop}
        fresh_starts, fresh_tables, tail = [], [], len(starts)
        for m in self.e.pattern.finditer(new, at):
            if m.start() >= start + len(by) and m.start() in later:
                tail = later[m.start()]
                break
            piece = m.group().encode()
            had = keep + len(fresh_starts)
            if had < len(tables) and m.start() == starts[had] < stop:  # such a table is in no tail
                table = tables[had]
                same = 0
                for same, (x, y) in enumerate(zip(table.piece, piece, strict=False)):  # noqa: B007
                    if x != y:
                        break
                else:
                    same = min(len(table.piece), len(piece))
                table.cut(same)
                table.append(piece[same:])
            else:
                table = PrefixTable(self.e.v, piece)
            fresh_starts.append(m.start())
            fresh_tables.append(table)
        self.starts = starts[:keep] + fresh_starts + [s + shift for s in starts[tail:]]
        self.tables = tables[:keep] + fresh_tables + tables[tail:]
        self.text = new

    def ids(self) -> list[int]:
        return [i for t in self.tables for i in t.ids()]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary(load_ranks(path)))
    return _ENCODERS[path]


def _slices(batches: Iterator[pa.RecordBatch], column: str | int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that column holds about `most` bytes, long rows alone."""
    for b in batches:
        c = b.columns[column] if isinstance(column, int) else b.column(column)
        if not b.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False), "int64")
        group = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                yield b.slice(i, j - i)


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", ids_col: str = "ids", keep_cache: bool = True) -> DataFrame:
    """docs without text_col, with its ids as array<int>; null and empty texts give an empty array.

    A map without a shuffle: rows and their other columns stay where they are, whatever their names; a
    column named ids_col is replaced. Without keep_cache a worker forgets its words at the end of a task.
    """
    small_batches(docs.sparkSession)
    path = path or public_tokenizers.path(RANKS)
    rest = [c for c in docs.columns if c not in (text_col, ids_col)]
    schema = docs.select(*rest).withColumn(ids_col, F.array(F.lit(0))).schema

    def run(batches):
        enc = encoder(path)
        for b in _slices(batches, -1, 4 << 20):  # the text is the last column; names may clash
            codes = [enc.encode_bytes(t) for t in (b.column(b.num_columns - 1).fill_null("")).to_pylist()]
            ends = np.cumsum([0, *(len(c) // 4 for c in codes)], dtype="int64")
            ids = pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(np.frombuffer(b"".join(codes), "<i4")))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), ids], names=[*rest, ids_col])
        if not keep_cache:
            enc.forget()

    text = next(c for c in map("text{}".format, ["", *range(len(rest))]) if c.lower() not in {x.lower() for x in rest})
    return docs.select(*rest, F.col(text_col).alias(text)).mapInArrow(trimmed(run), schema)


def decode(docs: DataFrame, path: str | None = None, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """docs with the bytes that its ids stand for; null ids give empty bytes. A map without a shuffle.

    Rows and their other columns stay, repeated ones too; a column named bytes_col is replaced, and an
    empty table gives an empty result.
    """
    path = path or public_tokenizers.path(RANKS)
    docs = docs.drop(bytes_col)
    schema, names = docs.withColumn(bytes_col, F.lit(b"")).schema, [*docs.columns, bytes_col]

    def run(batches):
        enc = encoder(path)
        for b in batches:
            for part in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
                c = part.column(ids_col).fill_null([])
                ends, flat = np.cumsum([0, *pc.list_value_length(c).to_pylist()]), c.flatten().to_numpy(zero_copy_only=False)
                out = [enc.decode(flat[i:j].tolist()) for i, j in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=names)

    return docs.mapInArrow(run, schema)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: ids of every whole document, and the bytes decoded from them."""
    both = decode(encode(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
