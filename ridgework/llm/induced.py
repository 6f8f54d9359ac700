"""External induced sorting of suffixes, which carries the common prefixes of neighbours along.

The text is a sequence of runs of one character. Local minima among the runs (the leftmost S suffixes)
are sorted first: the strings from each one to the end of the next are named in order, and the string of
names is sorted by the same function, one level down, until names are unique or stand for `depth`
characters. From them a pass upwards induces all suffixes that are larger than their next one, and from
those a pass downwards, over complemented characters, all others.

A pass is a priority queue of tuples (character, repetitions, rank of what follows the run, run). Its keys
only grow, so it is kept as a bucket of tuples per range of characters: a bucket is read when its turn
comes, and a tuple that is taken puts that of the run before it into a later bucket. Each suffix comes out
with what it has in common with the one before it: the repetitions, and the least common prefix between
the two ranks, which a table of range minima of all earlier ones answers. One level down, symbols weigh
what they stand for, and different ones share what their names have in common.

Arrays of a sort (text, runs, buckets, ranks, minima) are in memory up to a bound and in mapped files
beyond it; batches are all else that memory holds.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Bytes of arrays that one sort keeps in memory, tuples taken at once, and cells worked on at once.
MEMORY, BATCH, STEP = 256 << 20, 1 << 14, 1 << 21


class Store:
    """Arrays of one sort: in memory up to a bound, in unnamed files of a folder beyond it."""

    def __init__(self, memory: int = MEMORY, folder: str | None = None):
        self.memory, self.folder, self.held, self.spilled = memory, folder, 0, 0

    def array(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if self.held + size <= self.memory or not n:
            self.held += size
            return np.empty(n, dtype)
        if self.folder is None:
            raise MemoryError("a sort beyond its memory bound needs a folder for its files")
        self.spilled += size
        os.makedirs(self.folder, exist_ok=True)
        with tempfile.TemporaryFile(dir=self.folder) as f:
            return np.memmap(f, dtype, "w+", shape=(n,))

    def free(self, *arrays: np.ndarray) -> None:
        for a in arrays:
            if not isinstance(a, np.memmap):
                self.held -= a.nbytes

    def kept(self, a: np.ndarray) -> np.ndarray:
        out = self.array(len(a), a.dtype)
        out[:] = a
        return out


class Minima:
    """Range minima of at most n bytes that arrive in order."""

    def __init__(self, n: int, store: Store):
        self.n, self.store = n, store
        self.flat = store.array(n * max(1, n.bit_length()), "u1")
        self.t = self.flat.reshape(-1, n) if n else self.flat.reshape(1, 0)

    def put(self, at: int, v: np.ndarray) -> None:
        """Values from place `at` on, which may replace the last ones."""
        end, t = at + len(v), self.t
        t[0, at:end] = v
        for j in range(1, len(t)):
            h = 1 << (j - 1)
            lo, hi = max(0, at - 2 * h + 1), end - 2 * h + 1
            if hi <= 0:
                break
            np.minimum(t[j - 1, lo:hi], t[j - 1, lo + h : hi + h], out=t[j, lo:hi])

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least value of places a to b, b excluded and larger than a."""
        k = np.frexp((b - a).astype("f8"))[1].astype("i8") - 1
        return np.minimum(self.flat[k * self.n + a], self.flat[k * self.n + b - (1 << k)])

    def mirrored(self) -> Minima:
        """Of neighbours x - 1 and x, for the complemented order."""
        out = Minima(self.n, self.store)
        out.put(0, np.append(np.zeros(1, "u1"), self.t[0, 1:][::-1]))
        return out

    def close(self) -> None:
        self.store.free(self.flat)


class Pass:
    """One induction over runs: char of each run, starts (one more than runs), in the order of the pass."""

    def __init__(self, char, starts, size: int, to_end: bool, weight, apart: Minima | None, depth: int, store: Store):
        self.c, self.s, self.size, self.weight, self.apart, self.depth, self.store = char, starts, size, weight, apart, depth, store
        self.to_end = to_end

    def shared(self, x, y):
        """What different symbols x < y have in common."""
        return 0 if self.apart is None else self.apart.least(x.astype("i8") + 1, y.astype("i8") + 1).astype("i8")

    def next_char(self, run):
        """The character after a run, -1 at the end of the text."""
        return np.where(run + 1 < len(self.c), self.c[np.minimum(run + 1, len(self.c) - 1)].astype("i8"), -1)

    def between(self, x, y):
        """What x and y, different symbols in either order or -1 for the end, have in common."""
        if self.apart is None:
            return np.zeros(len(x), "i8")
        some = (x >= 0) & (y >= 0) & (x != y)
        out = np.zeros(len(x), "i8")
        out[some] = self.shared(np.minimum(x, y)[some], np.maximum(x, y)[some])
        return out

    def common(self, c, run, a, r, seed, given):
        """Common prefixes of tuples with the one before each: one fewer than tuples."""
        depth = self.depth
        cx, cy, ax, ay, sx, sy = c[:-1], c[1:], a[:-1], a[1:], seed[:-1], seed[1:]
        out = np.zeros(len(cx), "i8")
        same = cx == cy
        if self.apart is not None:
            k = np.flatnonzero(~same)
            out[k] = self.shared(cx[k], cy[k])
        i = np.flatnonzero(same & ~sx)
        low = np.minimum(np.minimum(ax[i], ay[i]), depth)
        if self.weight is not None:
            low = np.minimum(low * self.weight[cy[i]], depth)
        out[i] = low
        part = low < depth
        i, low = i[part], low[part]
        level = ~sy[i] & (ax[i] == ay[i])
        k = i[level]
        out[k] += self.table.least(r[:-1][k] + 1, r[1:][k] + 1)
        if self.apart is not None:  # one of the two runs ends first, or both end and go on in different ways
            k = i[~level]
            nx, ny = (np.where(p <= q, self.next_char(v), cy[k]) for p, q, v in ((ax[k], ay[k], run[:-1][k]), (ay[k], ax[k], run[1:][k])))
            out[k] += self.between(nx, ny)
        if given is not None:
            k = np.flatnonzero(same & sx & sy)
            out[k] = given[1:][k]
        return np.minimum(out, depth).astype("u1")

    def first_common(self, c, run, a, r, seed, given):
        """The same of the last tuple taken and a first one."""
        if self.last is None:
            return np.zeros(1, "u1")
        two = [np.array([x, y]) for x, y in zip(self.last, (c, run, a, r, seed), strict=True)]
        return self.common(*two, np.array([0, given]))

    def take(self, c, run, a, r, seed, given, com, longs, below: int) -> None:
        """Tuples in order: note them, and put the runs before them, from character `below` on, into their buckets."""
        at, n = self.n, len(run)
        self.run[at : at + n], self.a[at : at + n], self.seed[at : at + n] = run, a, seed
        self.last = tuple(int(np.asarray(x).reshape(-1)[-1]) for x in (c, run, a, r)) + (bool(np.asarray(seed).reshape(-1)[-1]),)
        self.n += n
        if com is not None:
            self.table.put(at, com)
        k = np.flatnonzero((a == longs) & (run > 0))
        p = run[k] - 1
        to = self.c[p]
        k2 = np.flatnonzero((to > (c if np.isscalar(c) else c[k])) & (to >= below))
        self.put(p[k2], (at + k[k2]).astype("i4"), to[k2])

    def put(self, run, rank, char) -> None:
        if not len(run):
            return
        to = self.range_of[char]
        order = np.argsort(to, kind="stable")
        to, run, rank = to[order], run[order], rank[order]
        cuts = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist(), len(to)]
        for i, j, b in zip(cuts, cuts[1:], to[cuts[:-1]].tolist(), strict=False):
            at = self.fill[b]
            self.rows[at : at + j - i], self.ranks[at : at + j - i] = run[i:j], rank[i:j]
            self.fill[b] = at + j - i

    def one_char(self, c: int, rows: slice, seeds: slice) -> None:
        """A bucket of one character: tuples are in the order of their ranks already, repetitions come one after the other."""
        longer, weigh = [], 1 if self.weight is None else int(self.weight[c])
        for i in range(rows.start, rows.stop, BATCH):
            run, r = (np.asarray(v[i : min(rows.stop, i + BATCH)]) for v in (self.rows, self.ranks))
            longs = self.long[run]
            com = np.empty(len(run), "u1")
            com[1:] = np.minimum(self.table.least(r[:-1] + 1, r[1:] + 1).astype("i4") + weigh, self.depth)
            com[:1] = self.first_common(c, run[0], 1, r[0], False, 0)
            self.take(c, run, 1, r, False, None, com, longs, c)
            k = np.flatnonzero(longs > 1)
            longer.append((run[k], r[k]))
        run, r = (np.concatenate(x) for x in zip(*longer, strict=True)) if longer else (np.zeros(0, "i4"), np.zeros(0, "i4"))
        a = 2
        while len(run):
            wide = max(1, BATCH // len(run))
            size = np.minimum(self.long[run] - a + 1, wide).astype("i8")
            k = np.repeat(np.arange(len(run)), size)
            many = a + np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
            order = np.argsort(many, kind="stable")
            for i in range(0, len(k), BATCH):
                o = order[i : i + BATCH]
                self.general(np.full(len(o), c), run[k[o]], many[o], r[k[o]], np.zeros(len(o), bool), None, 0, c)
            a += wide
            on = self.long[run] >= a
            run, r = run[on], r[on]
        for i in range(seeds.start, seeds.stop, BATCH):
            j = slice(i, min(seeds.stop, i + BATCH))
            run, a, com = np.asarray(self.seeds[j]), np.asarray(self.seeds_a[j]), np.array(self.given[j])
            com[:1] = self.first_common(c, run[0], a[0], i, True, com[0])
            self.take(c, run, a, j.stop - 1, True, None, com, self.long[run], c)

    def general(self, c, run, a, r, seed, given, rounds: int, below: int) -> None:
        """Take tuples of any kind; rounds: how far ranks inside these tuples lead to one another."""
        com, at = np.empty(len(run), "u1"), self.n
        for _ in range(rounds + 1):  # until what the ranks inside share is known
            com[:1] = self.first_common(c[0], run[0], a[0], r[0], seed[0], 0 if given is None else given[0])
            com[1:] = self.common(c, run, a, r, seed, given)
            self.table.put(at, com)
        self.take(c, run, a, r, seed, given, None, self.long[run], below)

    def expanded(self, run, r):
        """All repetitions of runs."""
        size = self.long[run]
        if not len(size) or size.max() == 1:
            return run, np.ones(len(run), "i8"), r
        k = np.repeat(np.arange(len(run)), size)
        return run[k], 1 + np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size), r[k]

    def several(self, low: int, high: int, rows: slice, seeds: slice) -> None:
        """A bucket of several characters, whose tuples may lead to others of the same bucket."""
        run, a, r = self.expanded(np.asarray(self.rows[rows]), np.asarray(self.ranks[rows]).astype("i8"))
        k = np.arange(seeds.start, seeds.stop)
        run, a = np.append(run, self.seeds[seeds]), np.append(a, self.seeds_a[seeds].astype("i8"))
        r, seed = np.append(r, k), np.append(np.zeros(len(r), bool), np.ones(len(k), bool))
        base, depth, begin = np.full(len(run), -1), 0, 0  # the tuple of this bucket that led to each
        while True:
            new = begin + np.flatnonzero((a[begin:] == self.long[run[begin:]]) & (run[begin:] > 0))
            c = self.c[run[new] - 1]
            new = new[(c > self.c[run[new]]) & (c < high)]
            if not len(new):
                break
            begin, depth = len(run), depth + 1
            more, many, of = self.expanded(run[new] - 1, new)
            run, a, base = np.append(run, more), np.append(a, many), np.append(base, of)
            r, seed = np.append(r, np.zeros(len(of), "i8")), np.append(seed, np.zeros(len(of), bool))
        if not len(run):
            return
        key = ((self.c[run].astype("u8") - np.uint64(low)) << np.uint64(41)) | (seed.astype("u8") << np.uint64(40)) | (np.where(seed, 0, np.minimum(a, self.depth + 1)).astype("u8") << np.uint64(32))
        inside = np.flatnonzero(base >= 0)
        for _ in range(depth + 1):
            order = np.argsort(key | (r + 1).astype("u8"))
            if depth:
                place = np.empty(len(order), "i8")
                place[order] = np.arange(len(order))
                r[inside] = self.n + place[base[inside]]
        given = np.zeros(len(run), "i8")
        mine = seed[order]
        given[mine] = self.given[r[order][mine]]
        c = (key[order] >> np.uint64(41)).astype("i8") + low
        self.general(c, run[order], a[order], r[order], mine, given, depth, high)

    def induce(self, seeds, seeds_a, given):
        """(run, repetitions, seed or not, table of common prefixes) of all seeds and induced suffixes in order.

        seeds: runs, each with its repetitions, in order; given: what each shares with the one before it.
        """
        c, s, store = self.c, self.s, self.store
        self.long = store.array(len(c), "i4")
        for i in range(0, len(c), STEP):
            j = min(len(c), i + STEP)
            self.long[i:j] = s[i + 1 : j + 1] - s[i:j]
        self.seeds, self.seeds_a, self.given = seeds, seeds_a, given
        rows_of, size_of, seeds_of = np.zeros(self.size, "i8"), np.zeros(self.size, "i8"), np.zeros(self.size, "i8")
        for i in range(0, len(c), STEP):
            j = min(len(c), i + STEP)
            nxt = np.append(c[i + 1 : j + 1].astype("i8"), [] if j < len(c) else [-1 if self.to_end else self.size])
            k = np.flatnonzero(nxt < c[i:j])
            ck, n = c[i:j][k], (s[i + 1 : j + 1] - s[i:j])[k]
            rows_of += np.bincount(ck, minlength=self.size)
            size_of += np.bincount(ck, n, self.size).astype("i8")
        for i in range(0, len(seeds), STEP):
            seeds_of += np.bincount(c[seeds[i : i + STEP]], minlength=self.size)
        cost = size_of + seeds_of
        large = cost > BATCH // 4
        window = (np.cumsum(cost) - cost) // BATCH
        cut = np.append(True, (window[1:] != window[:-1]) | large[1:] | large[:-1]) | (np.arange(self.size) % (1 << 22) == 0)
        first = np.flatnonzero(cut)
        number = np.cumsum(cut) - 1
        self.range_of = number.astype("u2" if len(first) <= 1 << 16 else "i4")
        row_ends = np.cumsum(rows_of)
        seed_ends = np.cumsum(seeds_of)
        stops = np.append(first[1:], self.size)
        row_begin, seed_begin = np.append(0, row_ends[stops - 1])[:-1].tolist(), np.append(0, seed_ends[stops - 1]).tolist()
        self.fill = list(row_begin)
        self.rows, self.ranks = store.array(int(row_ends[-1]), "i4"), store.array(int(row_ends[-1]), "i4")
        total = int(cost.sum())
        self.run, self.a, self.seed, self.table = store.array(total, "i4"), store.array(total, "i4"), store.array(total, "?"), Minima(total, store)
        self.n, self.last = 0, None
        if self.to_end:
            self.put(np.array([len(c) - 1], "i4"), np.array([-1], "i4"), c[len(c) - 1 :])
        for b, (low, high) in enumerate(zip(first.tolist(), stops.tolist(), strict=True)):
            rows, of = slice(row_begin[b], self.fill[b]), slice(seed_begin[b], seed_begin[b + 1])
            if high - low == 1:
                self.one_char(low, rows, of)
            else:
                self.several(low, high, rows, of)
        if self.n != total:
            raise RuntimeError("an induction lost suffixes")
        store.free(self.rows, self.ranks, self.long)
        return self.run, self.a, self.seed, self.table


def _named(t, begin, stop, size: int, weight, apart: Minima | None, depth: int):
    """Strings t[begin:stop] in order: (order, new, common, long).

    new marks the first of each distinct string, common is what that shares with the one before it, long
    marks strings that reach depth and are compared no further. A stop beyond the text is its end, the smallest symbol.
    """
    bits = int(size).bit_length()
    q, m, n = max(1, 64 // bits), len(begin), len(t)

    def chunk(which, skip):
        key = np.zeros(len(which), "u8")
        p, e = begin[which] + skip, np.minimum(stop[which], n)
        for _ in range(q):
            key <<= np.uint64(bits)
            key |= np.where(p < e, t[np.minimum(p, n - 1)].astype("u8") + np.uint64(1), np.uint64(0))
            p = p + 1
        return key

    def shared(x, y):
        """Weight of the symbols that two different keys have in common, and of all of x's."""
        out, on, every = np.zeros(len(x), "i8"), np.ones(len(x), bool), np.zeros(len(x), "i8")
        for j in range(q - 1, -1, -1):
            u, v = ((k >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1) for k in (x, y))
            u, v = u.astype("i8"), v.astype("i8")
            w = np.ones(len(u), "i8") if weight is None else weight[np.maximum(u - 1, 0)].astype("i8")
            w = np.where(u > 0, w, 0)
            every += w
            out += np.where(on & (u == v), w, 0)
            if apart is not None:
                k = np.flatnonzero(on & (u != v) & (u > 0) & (v > 0))
                out[k] += apart.least(np.minimum(u, v)[k], np.maximum(u, v)[k])
            on &= u == v
        return out, every

    order = np.arange(m)
    new, common, far = np.zeros(m, bool), np.zeros(m, "i8"), np.zeros(m, bool)
    new[0] = True
    open_, group, sofar, skip = np.arange(m), np.zeros(m, "i8"), np.zeros(m, "i8"), 0
    while len(open_):
        which = order[open_]
        key = chunk(which, skip)
        by = np.lexsort((key, group)) if skip else np.argsort(key, kind="stable")
        which, key = which[by], key[by]
        order[open_] = which
        inner = np.append(False, group[1:] == group[:-1])  # groups keep their places
        differs = inner & np.append(False, key[1:] != key[:-1])
        k = np.flatnonzero(differs)
        part, _ = shared(key[k], key[k - 1])
        new[open_[k]] = True
        common[open_[k]] = sofar[k] + part
        starts = ~inner | differs
        number = np.cumsum(starts) - 1
        of = np.flatnonzero(starts)
        _, every = shared(key[of], key[of])
        sofar = (sofar[of] + every)[number]
        skip += q
        alone = np.bincount(number)[number] == 1
        deep = sofar >= depth
        far[which[deep]] = True
        on = ~alone & ~deep & (stop[which] - begin[which] > skip)
        open_, group, sofar = open_[on], number[on], sofar[on]
    return order, new, np.minimum(common, depth), far


def _sorted(t, size: int, weight, apart: Minima | None, depth: int, store: Store):
    """(order, common): places of t in suffix order, and what each shares with the one before it, cut at depth."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype="i4"), np.zeros(n, "u1")
    count = 1 + sum(int((t[i + 1 : min(n, i + STEP + 1)] != t[i : min(n, i + STEP + 1) - 1]).sum()) for i in range(0, n, STEP))
    c, s = store.array(count, t.dtype), store.array(count + 1, "i4")
    s[0], c[0], s[count], at = 0, t[0], n, 1
    for i in range(0, n, STEP):
        j = min(n, i + STEP + 1)
        k = np.flatnonzero(t[i + 1 : j] != t[i : j - 1]) + i + 1
        s[at : at + len(k)], c[at : at + len(k)] = k, t[k]
        at += len(k)
    low = [i + 1 + np.flatnonzero((c[i + 1 : j - 1] < c[i : j - 2]) & (c[i + 1 : j - 1] < c[i + 2 : j])) for i, j in ((i, min(count, i + STEP + 2)) for i in range(0, max(0, count - 2), STEP))]
    low = np.concatenate([np.zeros(0, "i8"), *low]).astype("i4")
    given = np.zeros(len(low), "u1")
    if len(low) > 1:
        begin = s[low].astype("i8")
        stop = np.append(s[low[1:] + 1].astype("i8") + 1, n + 1)  # the next minimum and the character after it
        order, new, common, far = _named(t, begin, stop, size, weight, apart, depth)
        names = np.empty(len(low), "i4")
        names[order] = np.cumsum(new) - 1
        heads = order[new]
        if weight is None:
            all_ = np.append(begin[1:], n) - begin
        else:
            total = np.append(0, np.cumsum(weight[t].astype("i8")))
            all_ = total[np.append(begin[1:], n)] - total[begin]
        standing = np.where(far[heads], depth, np.minimum(all_[heads], depth)).astype("u1")
        tied = np.bincount(names) > 1
        if (standing[tied] < depth).any():
            minima = Minima(len(heads), store)
            minima.put(0, common[new].astype("u1"))
            names = store.kept(names)
            order, given = _sorted(names, len(heads), standing, minima, depth, store)
            minima.close()
            store.free(names)
        else:
            given = np.where(new, common, depth).astype("u1")
        low = low[order]
    up = Pass(c, s, size, True, weight, apart, depth, store)
    run, a, seed, table = up.induce(low, s[low + 1] - s[low], given)
    larger = np.flatnonzero(~np.asarray(seed))[::-1]
    seeds, seeds_a = store.kept(run[larger]), store.kept(a[larger])
    # neighbours among the larger ones of one character are neighbours in the pass
    given = store.kept(np.append(np.zeros(1, "u1"), table.t[0][larger[:-1]]))
    del larger
    table.close()
    store.free(run, a, seed)
    back = store.array(count, c.dtype)
    for i in range(0, count, STEP):
        back[i : i + STEP] = c.dtype.type(size - 1) - c[i : i + STEP]
    other = None if apart is None else apart.mirrored()
    down = Pass(back, s, size, False, None if weight is None else weight[::-1], other, depth, store)
    run, a, seed, table = down.induce(seeds, seeds_a, given)
    if other is not None:
        other.close()
    order, common = store.array(n, "i4"), store.array(n, "u1")
    for i in range(0, n, STEP):
        j = min(n, i + STEP)
        order[n - j : n - i] = (s[run[i:j] + 1] - a[i:j])[::-1]
    common[0] = 0
    common[1:] = table.t[0][1:][::-1]
    table.close()
    store.free(run, a, seed, seeds, seeds_a, given, back, c, s)
    return order, common


def suffix_order(t: np.ndarray, size: int, depth: int, store: Store | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of t, below 2**31 characters that are below size each: places in suffix order, exact for
    the first `depth` characters (at most 255), and how many of those each suffix shares with the one before it."""
    return _sorted(t, size, None, None, depth, store or Store(1 << 62))
