import pytest

import corpus_pipeline
from ridgework.llm import bpe, exact_dedup, mixing, near_dedup


@pytest.fixture(scope="module")
def stages(spark, data):
    docs, out = corpus_pipeline.common.read(spark, data, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        new = corpus_pipeline.common.materialize(f(spark, docs, data), "test")
        out.append((name, docs, new))
        docs = new
    return out


def test_shape(stages):
    assert [s[0] for s in stages] == ["quality", "exact_dedup", "near_dedup", "mix", "bpe"]
    for _, before, after in stages[:-1]:
        assert set(before.columns) <= set(after.columns)
        assert after.count() <= before.count() and after.count() > 0


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_each_stage_on_its_input(spark, data, stages):
    s = {name: (a, b) for name, a, b in stages}
    a, b = s["quality"]
    labels = {r.doc_id: r.quality for r in corpus_pipeline.common.read(spark, data, "labels").collect()}
    good = {i for i in ids(a) if labels.get(i) == 1}
    assert len(good & ids(b)) >= 0.97 * len(good)
    assert len({i for i in ids(b) if labels.get(i) == 0}) <= 0.1 * sum(v == 0 for v in labels.values())
    a, b = s["exact_dedup"]
    first = {}
    for r in a.collect():
        k = __import__("re").sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        first[k] = min(r.doc_id, first.get(k, r.doc_id))
    assert ids(b) == set(first.values())
    a, b = s["near_dedup"]
    assert ids(b) == {r.class_id for r in near_dedup.classes(a).collect()}
    a, b = s["mix"]
    assert ids(b) == ids(a) and sorted(r.mix_pos for r in b.collect()) == list(range(a.count()))
    a, b = s["bpe"]
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(b).collect()}
    assert back == {r.doc_id: (r.text or "").encode() for r in a.collect()}
    assert exact_dedup and mixing


def test_run(spark, data, stages):
    out = corpus_pipeline.run(spark, data)
    assert ids(out) == ids(stages[-1][2]) and out.columns == ["doc_id", "lang", "source", "n_chars", "mix_pos", "ids"]


def test_odd_rows(spark, odd, none, data):
    for rows in (odd, none):
        docs = rows
        for _, f in corpus_pipeline.STAGES:
            docs = corpus_pipeline.common.materialize(f(spark, docs, data), "odd")
