import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgework.llm import bpe

VOCABULARY = bpe.Vocabulary(bpe.load_ranks(public_tokenizers.path(bpe.RANKS)))
ENCODER = bpe.Encoder(VOCABULARY)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
TEXT = st.text(alphabet=st.one_of(st.sampled_from(list("abcdes 's.,\n\t1é日!? re")), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_as_the_library(text):
    ids = ENCODER.encode(text).tolist()
    assert ids == LIBRARY.encode_ordinary(text)
    assert ENCODER.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 80), st.integers(0, 5), TEXT), max_size=4))
def test_edits(text, edits):
    e = bpe.EditableText(ENCODER, text)
    for at, n, by in edits:
        at = min(at, len(e.text))
        e.replace(at, min(len(e.text), at + n), by)
        assert e.ids() == LIBRARY.encode_ordinary(e.text)
    e.append(" more")
    assert e.ids() == LIBRARY.encode_ordinary(e.text)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=40), st.binary(max_size=10))
def test_appends_are_exact(a, b):
    grown = bpe.PrefixTable(VOCABULARY, a)
    grown.append(b)
    assert grown.last == bpe.PrefixTable(VOCABULARY, a + b).last


def test_long_pieces():
    for piece in ("a" * 5000, "ab" * 3000, "=" * 4000, "日本" * 2000):
        assert ENCODER.encode(piece).tolist() == LIBRARY.encode_ordinary(piece)


def test_odd_rows(odd, none):
    got = bpe.decode(bpe.encode(odd, keep_cache=False).drop("text"))
    assert got.columns == [*[c for c in odd.columns if c not in ("text", "ids")], "ids", "decoded"]
    want = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "").encode()) for r in odd.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.decoded)) for r in got.collect()) == want
    rest = [c for c in odd.columns if c not in ("text", "ids")]
    assert sorted(map(repr, got.select(*rest).collect())) == sorted(map(repr, odd.select(*rest).collect()))
    assert bpe.encode(none).count() == 0 and bpe.decode(bpe.encode(none)).count() == 0


def test_query(spark, data, docs):
    got = {r.doc_id: r for r in bpe.op2_byte_bpe(spark, data).collect()}
    for r in docs.collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        x = got[r.doc_id]
        assert x.n_tokens == len(ids) and x.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_missing_bytes():
    with pytest.raises(ValueError, match="single bytes"):
        bpe.PrefixTable(bpe.Vocabulary({b"a": 0}), b"b")
