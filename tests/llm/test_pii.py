import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ridgework.llm import pii

#: The contract's patterns.
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.split("."))) or (kind == "card" and 14 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 10 <= len(d) <= 15)


def brute(t):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(BASE) for m in re.finditer(BASE[kind], t or "") if valid(kind, m.group()))


def digest(spans):
    return hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def spans_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r.i: [(x.s, x.k, x.e) for x in r.b] for r in df.select("i", pii.base_spans(pii.text_or_empty("text")).alias("b")).collect()}


HARD = ["a@b.com_x@y.org", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.004", "4111 1111-1111 1111 4111", "+1 (234) 567-8901 x +44 20 7946 0958)", "a..b@c-.d.e@f.g", "é😀 a@b.co 😀 10.0.0.1", "4111111111111111" * 3, "x@y", "+12 3", "1-2-3 4111 1111 1111 1111-", "%@a.b+c@d.e", "00000000000000", "9" * 40 + ".1.1.1"]


def test_hard_cases(spark):
    got = spans_of(spark, HARD)
    assert {i: got[i] for i in got} == {i: brute(t) for i, t in enumerate(HARD)}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet=list("a1._@-+ ()9.04é😀"), max_size=60), min_size=200, max_size=200))
def test_random(spark, texts):
    got = spans_of(spark, texts)
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_query(spark, data, docs):
    got = {r.doc_id: r for r in pii.op5_pii(spark, data).collect()}
    for r in docs.collect():
        x, want = got[r.doc_id], brute(r.text)
        assert x.base_sha256 == digest(want)
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s[1] == k for s in want) for k in range(4)]
        assert {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want} <= set(x.spans.split(","))


def test_disclosing_terms(spark):
    rows = [(i, f"Mail of  jane@x.org , colleague Zyxwvut wrote the note number {i}.") for i in range(3)]
    rows += [(i, f"The note of someone else, number {i}, wrote of the mail again.") for i in range(3, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a = pii.annotate(df)
    text = dict(rows)
    hits = {r.doc_id: {text[r.doc_id][t.s : t.e] for t in r.terms} for r in a.collect()}
    assert all("Zyxwvut" in hits[i] and "wrote" not in hits[i] for i in range(3)) and not any(hits[i] for i in range(3, 40))
    out = {r.doc_id: r.t for r in a.join(df, "doc_id").select("doc_id", pii.sanitised(pii.F.col("text"), pii.F.col("base"), pii.F.col("terms")).alias("t")).collect()}
    assert "[EMAIL]" in out[0] and "jane" not in out[0] and "Zyxwvut" not in out[0] and out[5] == text[5]


def test_terms_of_whole_documents(spark):
    far = " and so on with words that everybody writes" * 9
    rows = [(i, f"Zyxwvut{far}, number {i}, jane@x.org" if i < 2 else f"jane@x.org{far}. \u201cZyxwvut\u201d wrote{far} to (zyxwvut)") for i in range(10)]
    rows += [(10, f"No mail here{far}, but Qqrst."), *((i, f"Somebody else wrote to us{far} at the number {i}") for i in range(11, 400))]
    rows += [(400 + i, f"Qqrst at tom@y.org{far}") for i in range(30)]
    df, text = spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)
    hits = {r.doc_id: [(text[r.doc_id][t.s : t.e], t.action) for t in r.terms] for r in pii.annotate(df).collect()}
    assert all(hits[i] == [("Zyxwvut", "removed")] for i in range(2))  # the first word, far from the mail
    assert all(hits[i] == [("Zyxwvut", "removed"), ("zyxwvut", "removed")] for i in range(2, 10))
    assert hits[10] == [("Qqrst", "removed")] and not any(hits[i] for i in range(11, 400))  # a document without the mail


def test_odd_rows(odd, none):
    got = pii.annotate(odd)
    assert got.count() == odd.count()
    want = sorted((r.doc_id is None, r.doc_id or 0, str(brute(r.text))) for r in odd.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, str([(x.s, x.k, x.e) for x in r.base])) for r in got.collect()) == want
    assert pii.annotate(none).count() == 0
