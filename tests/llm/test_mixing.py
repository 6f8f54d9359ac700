from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from ridgework.llm import mixing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_windows_and_deviation(parts):
    named = {f"s{i}": n for i, n in enumerate(parts)}
    total, done = sum(parts), Counter()
    for t, s in enumerate(mixing.period(named)):
        k, n = done[s], named[s]
        assert k * total // n <= t < -(-(k + 1) * total // n)
        done[s] += 1
        assert all(abs(done[x] - named[x] * (t + 1) / total) < 1 for x in named)
    assert done == Counter(named)


def test_mix(spark, docs):
    weights = {"src0": 3, "src1": 2, "src2": 1}
    rows = mixing.mix(docs, weights, block_rows=4).collect()
    assert len(rows) == docs.count() and sorted(r.mix_pos for r in rows) == list(range(len(rows)))
    sizes = Counter(r.mix_stream for r in rows)
    rows.sort(key=lambda r: r.mix_pos)
    parts = {"(other)": 1} | weights
    short = min(sizes[s] / n for s, n in parts.items()) * sum(parts.values())
    seen = Counter()
    for i, r in enumerate(rows, 1):
        seen[r.mix_stream] += 1
        if i < short * 0.9:
            assert all(abs(seen[s] - i * n / sum(parts.values())) < 2 * 4 for s, n in parts.items())
    slots = {}
    for r in rows:
        slots.setdefault(r.mix_slot, set()).add(r.mix_stream)
    assert all(len(s) == 1 for s in slots.values()) and max(Counter(r.mix_slot for r in rows).values()) <= 4


def test_odd_rows(odd, none):
    out = mixing.mix(odd, {"src0": 2}, block_rows=2)
    assert sorted(r.mix_pos for r in out.collect()) == list(range(odd.count()))
    rest = [c for c in odd.columns if c != "mix_pos"]
    assert out.columns == [*rest, "mix_stream", "mix_slot", "mix_pos"]
    assert sorted(map(repr, out.select(*rest).collect())) == sorted(map(repr, odd.select(*rest).collect()))  # clashing names keep their values
    assert mixing.mix(none).count() == 0
