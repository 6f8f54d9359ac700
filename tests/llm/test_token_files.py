import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ridgework.llm import token_files
from ridgework.llm.common import table_path

LIBRARY = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))


def test_segment_access():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 300, 3000), rng.integers(0, 70_000, 3000), rng.integers(0, 1 << 32, 100, dtype="u8")]).astype("u4")
    starts = np.array([0, 0, 10, 4000, len(ids)])
    s = token_files.Segment(token_files.pack(np.arange(4), starts, ids))
    assert [s[i] for i in range(0, len(ids), 7)] == ids[::7].tolist()
    for k in range(4):
        assert s.document(k).tolist() == ids[starts[k] : starts[k + 1]].tolist()
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert s.slice(a, b).tolist() == ids[a:b].tolist()


PARTS = [*"ab 's\n\té,.1!?_\x00\x01\x02\x03\x1c\x85\u2028²×", "  re", "日本", ".\n", "\n\n", ", ", "ab", "end.\nNext", "<|endoftext|>", " <|endoftext|> "]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), max_size=5))
def test_coder_is_the_library(texts):
    c = token_files.coder(public_tokenizers.path(token_files.TOKENIZER))
    assert [x.tolist() for x in c.batch(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_tokens_are_the_library_s():
    c = token_files.coder(public_tokenizers.path(token_files.TOKENIZER))
    assert [x.tolist() for x in c.batch(["a <|endoftext|> b", ""])] == [[64, 220, 50256, 275], []]


def test_cache_is_bounded(monkeypatch, docs):
    monkeypatch.setattr(token_files.Coder, "LIMIT", 300)
    c = token_files.Coder(public_tokenizers.path(token_files.TOKENIZER))
    texts = [r.text or "" for r in docs.limit(60).collect()]
    for i in range(0, 60, 7):
        assert [x.tolist() for x in c.batch(texts[i : i + 7])] == [e.ids for e in LIBRARY.encode_batch(texts[i : i + 7], add_special_tokens=False)]
        assert len(c.names) <= max(300, len(set("".join(texts[i : i + 7]).split(" "))) * 2)


def check(spark, docs, **more):
    out = table_path(spark, "files")
    token_files.write(docs, out, **more)
    got = token_files.documents_of(spark, out).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()), key=lambda r: r[:2])
    at, want = 0, []
    for known, i, t in rows:
        ids = LIBRARY.encode(t, add_special_tokens=False).ids + [token_files.END_ID]
        want.append((i if known else None, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=key) == sorted(want, key=key)
    spans = sorted((r.start, r.n_tokens, r.doc_id is not None, r.doc_id or 0) for r in got)
    assert [s[0] for s in spans] == np.cumsum([0, *(s[1] for s in spans)])[:-1].tolist()
    assert [s[2:] for s in spans] == sorted(s[2:] for s in spans)


def test_files(spark, docs):
    check(spark, docs)


def test_odd_rows(spark, odd, none):
    check(spark, odd, ranges=3)
    check(spark, none)


def test_small_segments(spark, docs, monkeypatch):
    check(spark, docs.limit(40), ranges=1)


def test_token_at(spark, docs):
    out, few = table_path(spark, "files"), docs.limit(30)
    token_files.write(few, out, ranges=3)
    want = [i for r in few.orderBy("doc_id").collect() for i in [*LIBRARY.encode(r.text or "", add_special_tokens=False).ids, token_files.END_ID]]
    for i in [0, 1, len(want) // 3, len(want) // 2, len(want) - 1]:
        assert token_files.token_at(spark, out, i) == want[i]
    with pytest.raises(IndexError):
        token_files.token_at(spark, out, len(want))
