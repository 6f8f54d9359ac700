"""A plain-Python model of the terrain operators, straight from their definitions."""

from itertools import groupby

RING = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def key(c, z):
    return (z[c], c[0] - c[1], c[0])


def around(c):
    return [(c[0] + dx, c[1] + dy) for i, (dx, dy) in enumerate(RING) if (c[0] + c[1]) % 2 == 0 or i % 2 == 0]


def classify(c, z):
    ns = around(c)
    if any(n not in z for n in ns):
        return "indeterminate"
    up = [key(n, z) > key(c, z) for n in ns]
    turns = sum(a != b for a, b in zip(up, up[1:] + up[:1], strict=True))
    if turns == 0:
        return "pit" if up[0] else "summit"
    return "saddle" if turns > 2 else "slope"


def steeper(p, q, c, z):
    """Whether the way from c to p is steeper than that to q; heights and, where both are c's own, x - y count."""
    length = {n: 1.0 if n[0] == c[0] or n[1] == c[1] else 2**0.5 for n in (p, q)}
    rise = {n: z[n] - z[c] for n in (p, q)}
    if not any(rise.values()):
        rise = {n: (n[0] - n[1]) - (c[0] - c[1]) for n in (p, q)}
    if not any(rise.values()):
        return length[q] > length[p]
    if rise[q] == 0:
        return rise[p] > 0
    return rise[p] / rise[q] > length[p] / length[q]


def leads(c, z):
    """[(trace, up, best)]: the ring begins at the first place where it turns, and falls into runs there."""
    ns = around(c)
    up = {n: key(n, z) > key(c, z) for n in ns}
    turn = next((i for i in range(1, len(ns)) if up[ns[i]] != up[ns[i - 1]]), 0)
    # the run that holds the ring's first neighbour is scanned from there on, then from the seam's other side
    runs = [list(r) for _, r in groupby(ns[turn:] + ns[:turn], key=up.get)]
    first = sorted(runs.pop(), key=ns.index)
    runs.insert(0, first)
    if not up[first[0]]:  # runs of higher neighbours have even numbers
        runs.insert(0, runs.pop())
    out = []
    for t, run in enumerate(runs):
        best = run[0]
        for p in run[1:]:
            if steeper(p, best, c, z):
                best = p
        out.append((t, up[best], best))
    return out


def edges(z):
    """{(saddle, seq, up): (end a, tag a, end b, tag b)}; ends None off the data."""
    cls = {c: classify(c, z) for c in z}
    lead = {c: leads(c, z) for c in z if cls[c] in ("slope", "saddle")}

    def end(c, up):
        while True:
            if cls[c] == ("summit" if up else "pit"):
                return c
            if cls[c] == "indeterminate":
                return None
            c = lead[c][0 if up else 1][2]

    out = {}
    for c in z:
        if cls[c] != "saddle":
            continue
        by = {t: b for t, _, b in lead[c]}
        n = len(by) // 2
        for i in range(n - 1):
            for up, s, t in ((True, 2 * i, 2 * i + 2), (False, 2 * i + 1, 2 * n - 1)):
                a, b = end(by[s], up), end(by[t], up)
                if a or b:
                    out[c, -i, up] = (a, s, b, t) if s < t else (b, t, a, s)
    return out


def search(p, graph, kp, ks):
    """Best-first from p over the highest saddles: (key saddle, first higher peak) or a saddle off the data."""
    seen, todo = {p}, [(ks[s], s, o) for s, o in graph[p]]
    low = None
    while todo:
        todo.sort()
        k, s, o = todo.pop()
        if low is None or k < low[0]:
            low = (k, s)
        if o is None:
            return low[1], None, True
        if o in seen:
            continue
        if kp[o] > kp[p]:
            return low[1], o, False
        seen.add(o)
        todo += [(ks[s2], s2, o2) for s2, o2 in graph[o] if o2 not in seen]
    return None, None, False
