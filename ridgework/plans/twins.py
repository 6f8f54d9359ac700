"""DuckDB SQL for what follows from the network: key saddles, chains, tree, ways, domains, tables and views.

Each constant is a group of common table expressions; names of one are used in the next. They say what
is computed one step at a time: saddles are merged from the highest down, walks go node by node.
"""

from __future__ import annotations

#: Ids of cells, the network by ids, peaks numbered from the lowest, saddles from the highest.
GRAPH = """,
heights AS MATERIALIZED (SELECT x, y, z FROM cells),
ided AS MATERIALIZED (
  SELECT e.up, pid(ax, ay, 0) AS a, pid(bx, "by", 0) AS b, pid(sx, sy, seq) AS s, CASE WHEN e.up THEN 1 ELSE -1 END AS sign, sx, sy, seq, tag_a, tag_b, ax, ay, bx, "by", h.z AS sz
  FROM edges e JOIN heights h ON h.x = sx AND h.y = sy),
net AS MATERIALIZED (SELECT * FROM ided WHERE a IS NULL OR b IS NULL OR a <> b),
ends AS (SELECT DISTINCT up, sign, a AS id, ax AS x, ay AS y FROM net WHERE a IS NOT NULL UNION SELECT up, sign, b, bx, "by" FROM net WHERE b IS NOT NULL),
pk AS MATERIALIZED (
  SELECT up, sign, id, x, y, z * sign AS kz, (x - y) * sign AS kiso, x * sign AS kx, CAST(row_number() OVER (PARTITION BY up ORDER BY z * sign, (x - y) * sign, x * sign) AS INT) AS n
  FROM ends JOIN heights USING (x, y)),
sd AS MATERIALIZED (SELECT up, s, sign, sz * sign AS kz, (sx - sy) * sign AS kiso, sx * sign AS kx, seq * sign AS kseq, sx, sy FROM net),
steps AS MATERIALIZED (
  SELECT net.up, s, p.n AS na, q.n AS nb, CAST(row_number() OVER (PARTITION BY net.up ORDER BY sz * net.sign DESC, (sx - sy) * net.sign DESC, sx * net.sign DESC, seq * net.sign DESC, s DESC) AS INT) AS i
  FROM net LEFT JOIN pk p ON p.up = net.up AND p.id = a LEFT JOIN pk q ON q.up = net.up AND q.id = b)"""

#: One saddle a step: root holds each peak's component, by the number of its highest peak; shut marks components that reached the end of the data.
FACTS = """,
merging(up, i, root, shut, p, s, own, far, bound) AS (
  SELECT up, 0, list_transform(range(1, max(n) + 1), lambda v: CAST(v AS INT)), list_transform(range(1, max(n) + 1), lambda v: false), CAST(NULL AS INT), CAST(NULL AS BIGINT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS BOOLEAN) FROM pk GROUP BY up
  UNION ALL
  SELECT up, i, CASE WHEN kind = 'merge' THEN list_transform(root, lambda v: CASE WHEN v = lo THEN hi ELSE v END) ELSE root END,
         CASE WHEN kind IN ('edge', 'stop') THEN shut[1:who - 1] || [true] || shut[who + 1:] ELSE shut END,
         who, CASE WHEN who IS NOT NULL THEN s END, CASE WHEN who = ra THEN na WHEN who = rb THEN nb END,
         CASE WHEN who = ra THEN nb WHEN who = rb THEN na END, CASE WHEN who IS NOT NULL THEN kind <> 'merge' END
  FROM (SELECT *, CASE kind WHEN 'merge' THEN lo WHEN 'edge' THEN lo WHEN 'stop' THEN hi END AS who
        FROM (SELECT *, CASE WHEN na IS NULL OR nb IS NULL THEN CASE WHEN NOT shut[lo] THEN 'edge' END WHEN lo = hi THEN NULL WHEN NOT shut[lo] THEN 'merge' WHEN NOT shut[hi] THEN 'stop' END AS kind
              FROM (SELECT m.up, t.i, t.s, t.na, t.nb, m.root, m.shut, m.root[t.na] AS ra, m.root[t.nb] AS rb, least(m.root[t.na], m.root[t.nb]) AS lo, greatest(m.root[t.na], m.root[t.nb]) AS hi
                    FROM merging m JOIN steps t ON t.up = m.up AND t.i = m.i + 1)))),
facts AS MATERIALIZED (
  SELECT m.up, p.id AS p, m.s, o.id AS q_own, f.id AS q_far, m.bound AS min_bound, m.p AS n, m.own AS no, m.far AS nf, p.kz AS pz, abs(p.kz - sd.kz) AS "drop",
         p.kiso - sd.kiso AS diso, p.kx - sd.kx AS dx, -sd.kseq AS dseq, p.kx AS px, sd.kx AS sx, sd.kseq AS sseq, p.kiso AS piso
  FROM merging m JOIN pk p ON p.up = m.up AND p.n = m.p JOIN sd ON sd.up = m.up AND sd.s = m.s LEFT JOIN pk o ON o.up = m.up AND o.n = m.own LEFT JOIN pk f ON f.up = m.up AND f.n = m.far
  WHERE m.p IS NOT NULL)"""

#: Peaks with the rank of their drops (the highest peaks, which have none, come last), then walks over the next higher peaks.
CHAINS = """,
peaks AS MATERIALIZED (
  SELECT pk.up, pk.id, pk.n, f.s, f.min_bound, f.no, f.nf, f."drop", coalesce(f."drop" >= {cutoff}, true) AS notable, f.s IS NULL AS top,
         rank() OVER (PARTITION BY pk.up ORDER BY coalesce(f."drop", 'infinity'::DOUBLE), f.diso, f.dx, f.dseq, f.px, f.sx, f.sseq, f.piso) AS pr
  FROM pk LEFT JOIN facts f ON f.up = pk.up AND f.n = pk.n),
wander(up, n, c) AS (
  SELECT up, n, nf FROM peaks WHERE NOT min_bound
  UNION ALL SELECT w.up, w.n, p.nf FROM wander w JOIN peaks p ON p.up = w.up AND p.n = w.c WHERE w.c < w.n AND NOT p.min_bound),
higher AS MATERIALIZED (SELECT p.up, p.n, w.c AS thresh FROM peaks p LEFT JOIN wander w ON w.up = p.up AND w.n = p.n AND w.c > p.n),
chain(up, n, kind, step, c) AS (
  SELECT up, n, kind, 0, c FROM (
    SELECT up, n, 'own' AS kind, no AS c FROM peaks WHERE NOT top UNION ALL SELECT up, n, 'far', nf FROM peaks WHERE NOT top
    UNION ALL SELECT up, n, 'parent', nf FROM peaks WHERE notable AND NOT min_bound
    UNION ALL SELECT up, n, 'pthresh', thresh FROM peaks JOIN higher USING (up, n) WHERE notable AND NOT min_bound) WHERE c IS NOT NULL
  UNION ALL
  SELECT ch.up, ch.n, kind, step + 1, h.thresh FROM chain ch JOIN higher h ON h.up = ch.up AND h.n = ch.c JOIN peaks p ON p.up = ch.up AND p.n = ch.n JOIN peaks c ON c.up = ch.up AND c.n = ch.c
  WHERE h.thresh IS NOT NULL AND CASE kind WHEN 'parent' THEN c.pr <= p.pr WHEN 'pthresh' THEN NOT c.notable ELSE ch.c < ch.n END),
seen AS MATERIALIZED (
  SELECT ch.*, c.notable, c.pr, p.pr AS own_pr, p.min_bound, p.s, CASE kind WHEN 'parent' THEN c.pr <= p.pr WHEN 'pthresh' THEN NOT c.notable ELSE ch.c < ch.n END AS on_way,
         max(CASE WHEN c.notable THEN c.pr END) OVER (PARTITION BY ch.up, ch.n, kind ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM chain ch JOIN peaks c ON c.up = ch.up AND c.n = ch.c JOIN peaks p ON p.up = ch.up AND p.n = ch.n),
rel AS MATERIALIZED (
  SELECT p.up, p.id AS p, p.s, p."drop", p.min_bound, p.notable, p.pr, p.n, t.id AS thresh,
         (SELECT any_value(q.id) FROM seen v JOIN peaks q ON q.up = v.up AND q.n = v.c WHERE v.up = p.up AND v.n = p.n AND v.kind = 'pthresh' AND NOT v.on_way) AS pthresh,
         (SELECT any_value(q.id) FROM seen v JOIN peaks q ON q.up = v.up AND q.n = v.c WHERE v.up = p.up AND v.n = p.n AND v.kind = 'parent' AND NOT v.on_way) AS parent
  FROM peaks p JOIN higher h ON h.up = p.up AND h.n = p.n LEFT JOIN peaks t ON t.up = p.up AND t.n = h.thresh WHERE NOT p.top),
subs AS MATERIALIZED (
  SELECT v.up, q.id AS p, v.s, bool_or(kind IN ('own', 'far')) AS elev, bool_or((kind <> 'far' OR v.min_bound) AND (before IS NULL OR v.pr > before)) AS prom
  FROM seen v JOIN peaks q ON q.up = v.up AND q.n = v.c WHERE kind <> 'pthresh' AND on_way AND v.notable GROUP BY ALL),
ranks AS MATERIALIZED (SELECT up, p, row_number() OVER (PARTITION BY up ORDER BY pr DESC) - 1 AS rank FROM rel WHERE notable)"""

#: Arrows from the roots outwards, the ways of all peaks that lead somewhere, and their first common nodes.
TREE = """,
hop AS MATERIALIZED (SELECT up, s, q_own AS m, q_far AS n FROM facts WHERE NOT min_bound UNION ALL SELECT up, s, q_far, q_own FROM facts WHERE NOT min_bound),
tree(up, node, next, s, depth) AS (
  SELECT up, q_own, q_far, s, 0 FROM facts WHERE min_bound
  UNION ALL SELECT up, id, NULL, NULL, 0 FROM peaks WHERE top
  UNION ALL SELECT t.up, h.n, h.m, h.s, t.depth + 1 FROM tree t JOIN hop h ON h.up = t.up AND h.m = t.node WHERE h.s IS DISTINCT FROM t.s),
arrow AS MATERIALIZED (SELECT * FROM tree)"""

WAYS = """,
tasks AS MATERIALIZED (SELECT up, p, 'thresh' AS kind, thresh AS target FROM rel WHERE notable UNION ALL SELECT up, p, 'parent', parent FROM rel WHERE notable),
way(up, start, pos, node) AS (
  SELECT up, start, 0, start FROM (SELECT up, p AS start FROM tasks UNION SELECT up, target FROM tasks WHERE target IS NOT NULL)
  UNION ALL SELECT w.up, w.start, w.pos + 1, a.next FROM way w JOIN arrow a ON a.up = w.up AND a.node = w.node WHERE a.next IS NOT NULL),
ways AS MATERIALIZED (SELECT * FROM way),
met AS (SELECT t.up, t.p, t.target, min(a.pos) AS i, min(b.pos) AS j FROM (SELECT DISTINCT up, p, target FROM tasks) t JOIN ways a ON a.up = t.up AND a.start = t.p JOIN ways b ON b.up = t.up AND b.start = t.target AND b.node = a.node GROUP BY ALL),
sides AS MATERIALIZED (
  SELECT t.up, t.p, t.target, (SELECT list(node ORDER BY pos) FROM ways w WHERE w.up = t.up AND w.start = t.p AND w.pos <= coalesce(m.i, w.pos)) AS lft, (SELECT list(node ORDER BY pos) FROM ways w WHERE w.up = t.up AND w.start = t.target AND w.pos <= coalesce(m.j, w.pos)) AS rgt
  FROM (SELECT DISTINCT up, p, target FROM tasks) t LEFT JOIN met m ON m.up = t.up AND m.p = t.p AND m.target = t.target)"""

PRUNED = """,
keynode AS (SELECT up, p AS node FROM tasks UNION SELECT up, target FROM tasks WHERE target IS NOT NULL),
used AS MATERIALIZED (SELECT DISTINCT a.* FROM ways w JOIN arrow a ON a.up = w.up AND a.node = w.node),
kept AS MATERIALIZED (SELECT up, node FROM keynode UNION SELECT up, next FROM used WHERE next IS NOT NULL GROUP BY up, next HAVING count(*) > 1 UNION SELECT up, node FROM used WHERE next IS NULL),
leg(up, src, pos, node, next, s) AS (
  SELECT u.up, u.node, 0, u.node, u.next, u.s FROM used u JOIN kept k ON k.up = u.up AND k.node = u.node WHERE u.next IS NOT NULL
  UNION ALL SELECT l.up, l.src, l.pos + 1, u.node, u.next, u.s FROM leg l JOIN used u ON u.up = l.up AND u.node = l.next WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.up = l.up AND k.node = l.next))"""

#: The cells of every lead of a saddle that the tree uses; -1 for a step off the data.
TRACES = """,
offshoot AS MATERIALIZED (SELECT s.x, s.y, s.seq, s.up, s.trace, s.bx, s."by" FROM split s WHERE EXISTS (SELECT 1 FROM arrow a WHERE a.up = s.up AND a.s = pid(s.x, s.y, s.seq))),
stepping AS MATERIALIZED (SELECT * FROM nxt),
run(x, y, seq, up, trace, pos, cx, cy) AS (
  SELECT x, y, seq, up, trace, 0, x, y FROM offshoot UNION ALL SELECT x, y, seq, up, trace, 1, bx, "by" FROM offshoot
  UNION ALL SELECT r.x, r.y, r.seq, r.up, r.trace, r.pos + 1, n.nx, n.ny FROM run r JOIN stepping n ON n.x = r.cx AND n.y = r.cy AND n.up = r.up WHERE r.pos > 0),
traced AS MATERIALIZED (
  SELECT r.x, r.y, seq, up, trace, list(r.cx || ':' || r.cy ORDER BY pos) || CASE WHEN bool_or(pos > 0 AND c.class = 'indeterminate') THEN ['off'] ELSE [] END AS cells
  FROM run r JOIN cls c ON c.x = r.cx AND c.y = r.cy GROUP BY ALL)"""

LINES = """,
spliced AS MATERIALIZED (
  SELECT DISTINCT e.up, e.s, unnest([{'src': e.a, 'dst': e.b, 'cells': list_reverse(p.cells) || q.cells[2:]}, {'src': e.b, 'dst': e.a, 'cells': list_reverse(q.cells) || p.cells[2:]}], recursive := true)
  FROM ided e JOIN traced p ON p.up = e.up AND p.x = e.sx AND p.y = e.sy AND p.seq = e.seq AND p.trace = e.tag_a JOIN traced q ON q.up = e.up AND q.x = e.sx AND q.y = e.sy AND q.seq = e.seq AND q.trace = e.tag_b),
route AS (SELECT up, p, target, lft || list_reverse(coalesce(rgt, []))[2:] AS nodes FROM sides),
legs AS (SELECT up, p, target, unnest(range(1, len(nodes))) AS i, nodes FROM route),
via AS (SELECT up, node AS src, next AS dst, s FROM arrow WHERE next IS NOT NULL UNION ALL SELECT up, next, node, s FROM arrow WHERE next IS NOT NULL),
lines AS MATERIALIZED (
  SELECT l.up, l.p, l.target, flatten(list(CASE WHEN i = 1 THEN h.cells ELSE h.cells[2:] END ORDER BY i)) AS cells
  FROM legs l JOIN via v ON v.up = l.up AND v.src = l.nodes[l.i] AND v.dst = l.nodes[l.i + 1] JOIN spliced h ON h.up = v.up AND h.s = v.s AND h.src = v.src AND h.dst = v.dst GROUP BY l.up, l.p, l.target)"""

#: Traces of a domain run rootwards over the opposite tree, node by node from those farthest from the root; where they come together they pair off.
DOMAINS = """,
seeds AS (SELECT up, p, s FROM rel WHERE notable UNION SELECT u.up, u.p, u.s FROM subs u JOIN rel r ON r.up = u.up AND r.p = u.p AND r.notable WHERE u.prom),
anchors AS (SELECT NOT up AS up, s, tag_a AS t, a AS q FROM ided WHERE a IS NOT NULL UNION ALL SELECT NOT up, s, tag_b, b FROM ided WHERE b IS NOT NULL),
far_from(up, node, rem) AS (SELECT up, node, 0 FROM arrow WHERE next IS NULL UNION ALL SELECT a.up, a.node, f.rem + 1 FROM far_from f JOIN arrow a ON a.up = f.up AND a.next = f.node),
remains AS MATERIALIZED (SELECT * FROM far_from),
running(r, up, p, s, t, node, step, rem, shut) AS (
  SELECT (SELECT max(rem) FROM remains), d.up, d.p, d.s, a.t, a.q, 1, f.rem, false FROM seeds d JOIN anchors a ON a.up = d.up AND a.s = d.s JOIN remains f ON f.up <> d.up AND f.node = a.q
  UNION ALL
  SELECT r - 1, w.up, w.p, w.s, w.t, CASE WHEN here AND NOT pairs AND a.next IS NOT NULL THEN a.next ELSE w.node END, step + CASE WHEN here AND NOT pairs THEN 1 ELSE 0 END, rem - CASE WHEN here AND NOT pairs THEN 1 ELSE 0 END, here AND pairs
  FROM (SELECT *, rem = r AS here, row_number() OVER (PARTITION BY up, p, node, rem = r ORDER BY step, s, t) <= count(*) OVER (PARTITION BY up, p, node, rem = r) // 2 * 2 AS pairs FROM running WHERE NOT shut) w
  JOIN arrow a ON a.up <> w.up AND a.node = w.node WHERE r >= 0 AND rem >= 0),
closed AS MATERIALIZED (SELECT up, p, s, t, bool_or(shut) AS shut, max(step) AS step FROM running GROUP BY ALL),
path(up, p, s, t, pos, node) AS (
  SELECT c.up, c.p, c.s, c.t, 1, a.q FROM closed c JOIN anchors a ON a.up = c.up AND a.s = c.s AND a.t = c.t
  UNION ALL SELECT h.up, h.p, h.s, h.t, h.pos + 1, a.next FROM path h JOIN arrow a ON a.up <> h.up AND a.node = h.node JOIN closed c ON c.up = h.up AND c.p = h.p AND c.s = h.s AND c.t = h.t WHERE a.next IS NOT NULL AND (NOT c.shut OR h.pos < c.step)),
bounds AS MATERIALIZED (SELECT up, p, s, t, [s] || list(node ORDER BY pos) || CASE WHEN shut THEN [] ELSE [CAST(-1 AS BIGINT)] END AS nodes FROM path JOIN closed USING (up, p, s, t) GROUP BY up, p, s, t, shut)"""

#: The published tables and the lines in them.
TABLES = """,
noted AS (SELECT * FROM rel WHERE notable),
used_points AS (
  SELECT up, id, max(t) AS t FROM (SELECT up, p AS id, 1 AS t FROM noted UNION ALL SELECT up, s, 0 FROM noted UNION ALL SELECT up, thresh, 1 FROM noted UNION ALL SELECT up, pthresh, 1 FROM noted UNION ALL SELECT up, parent, 1 FROM noted) WHERE id IS NOT NULL GROUP BY up, id),
places AS (SELECT up, id, x, y, kz * sign AS z FROM pk UNION SELECT up, s, sx, sy, kz * sign FROM sd),
point_table AS (
  SELECT DISTINCT id AS geocode, CASE WHEN up THEN t ELSE -t END AS type, CAST(trunc(z * 1000.0) AS INT) AS elev_mm, CAST(CASE WHEN x = y THEN 0 WHEN x > y THEN x - y - 2147483647 ELSE x - y + 2147483648 END AS INT) AS isodist_cm,
         -1 AS elev_rank, 'POINT (' || x || ' ' || y || ')' AS loc
  FROM used_points JOIN places USING (up, id)),
drawn AS (SELECT up, p, target, 'LINESTRING (' || array_to_string(list_transform(CASE WHEN len(k) = 1 THEN k || k ELSE k END, lambda c: replace(c, ':', ' ')), ', ') || ')' AS path FROM (SELECT *, list_filter(cells, lambda c: c <> 'off') AS k FROM lines) WHERE len(k) > 0),
uphill AS (
  SELECT l.up, l.p, l.target, g.i, g.c, CAST(split_part(g.c, ':', 1) AS INT) AS x, CAST(split_part(g.c, ':', 2) AS INT) AS y FROM lines l JOIN noted n ON n.up = l.up AND n.p = l.p AND n.thresh = l.target, unnest(l.cells) WITH ORDINALITY AS g(c, i) WHERE NOT list_contains(l.cells, 'off')),
profile AS MATERIALIZED (SELECT u.*, h.z * CASE WHEN u.up THEN 1 ELSE -1 END AS k, first_value(k) OVER w AS level, lag(k) OVER w AS k0, lag(u.x) OVER w AS x0, lag(u.y) OVER w AS y0 FROM uphill u JOIN heights h ON h.x = u.x AND h.y = u.y WINDOW w AS (PARTITION BY u.up, u.p ORDER BY i)),
crossed AS (SELECT up, p, max(i) AS i FROM profile WHERE k >= level AND k0 < level GROUP BY up, p),
cut_points AS (
  SELECT f.up, f.p, f.i, CASE WHEN f.i = c.i THEN f.x + (f.k - f.level) / (f.k - f.k0) * (f.x0 - f.x) ELSE f.x END AS x, CASE WHEN f.i = c.i THEN f.y + (f.k - f.level) / (f.k - f.k0) * (f.y0 - f.y) ELSE f.y END AS y
  FROM profile f LEFT JOIN crossed c ON c.up = f.up AND c.p = f.p WHERE f.i <= coalesce(c.i, f.i)),
cut_lines AS (SELECT up, p, 'LINESTRING (' || string_agg(regexp_replace(CAST(CAST(x AS DECIMAL(18,6)) AS VARCHAR), '\\.?0+$', '') || ' ' || regexp_replace(CAST(CAST(y AS DECIMAL(18,6)) AS VARCHAR), '\\.?0+$', ''), ', ' ORDER BY i) || ')' AS path FROM cut_points GROUP BY up, p),
xy AS (SELECT nodes, up, p, s, t, list_transform(list_filter(nodes, lambda v: v <> -1), lambda v: (v >> 28 & 16777215) || ' ' || (v >> 4 & 16777215)) AS k FROM bounds),
domain_table AS (SELECT up, p, string_agg('LINESTRING (' || array_to_string(CASE WHEN len(k) = 1 THEN k || k ELSE k END, ', ') || ')', '; ' ORDER BY s, t) AS domain FROM xy GROUP BY up, p),
prom_table AS MATERIALIZED (
  SELECT n.p AS point, n.s AS saddle, CAST(trunc("drop" * 1000.0) AS INT) AS prom_mm, CAST(rank AS INT) AS prom_rank, CAST(n.min_bound AS INT) AS min_bound, n.parent AS prom_parent, n.pthresh AS line_parent, coalesce(c1.path, d1.path) AS thresh_path, d2.path AS parent_path, m.domain
  FROM noted n JOIN ranks USING (up, p) LEFT JOIN cut_lines c1 ON c1.up = n.up AND c1.p = n.p LEFT JOIN drawn d1 ON d1.up = n.up AND d1.p = n.p AND d1.target = n.thresh LEFT JOIN drawn d2 ON d2.up = n.up AND d2.p = n.p AND d2.target = n.parent LEFT JOIN domain_table m ON m.up = n.up AND m.p = n.p),
subsaddle_table AS MATERIALIZED (SELECT p AS point, s AS saddle, max(CAST(elev AS INT)) AS is_elev, max(CAST(prom AS INT)) AS is_prom FROM subs WHERE elev OR prom GROUP BY ALL),
busiest AS (SELECT arg_max(point, row(k, -point)) AS point FROM (SELECT point, count(*) AS k FROM subsaddle_table SEMI JOIN prom_table USING (point) GROUP BY point))"""


#: The greatest peaks of a direction and id range, with their classes; fixed values are the class limits.
MOST = """SELECT point, printf('%016x', point) AS geo, loc, elev_mm, prom_mm, min_bound, CAST(len(list_filter([500, 1000, 1500, 2000, 3000, 4000, 6000, 9000], lambda v: prom_mm / 1000.0 / 0.3048 > v)) AS INT) AS prom_class
FROM prom_table JOIN point_table ON geocode = point AND type = {type} WHERE point BETWEEN {low} AND {high} ORDER BY prom_mm DESC, point LIMIT 5000"""

#: Everything around the peak with the most secondary saddles.
VIEW = """,
me AS (SELECT * FROM prom_table WHERE point = (SELECT point FROM busiest)),
mine AS (SELECT * FROM subsaddle_table WHERE point = (SELECT point FROM busiest)),
shown AS (
  SELECT 'peak' AS kind, 0 AS ix, point, saddle, prom_mm, thresh_path AS path FROM me UNION ALL SELECT 'domain', 0, point, saddle, prom_mm, domain FROM me
  UNION ALL SELECT 'parent', 0, point, saddle, prom_mm, parent_path FROM prom_table WHERE point IN (SELECT prom_parent FROM me) UNION ALL SELECT 'pthresh', 0, point, saddle, prom_mm, parent_path FROM prom_table WHERE point IN (SELECT line_parent FROM me)
  UNION ALL SELECT 'child', CAST(row_number() OVER (ORDER BY prom_rank) AS INT), point, saddle, prom_mm, parent_path FROM prom_table WHERE prom_parent IN (SELECT point FROM me)
  UNION ALL SELECT 'subsaddle peak', 0, point, saddle, prom_mm, thresh_path FROM prom_table WHERE saddle IN (SELECT saddle FROM mine)
  UNION ALL SELECT 'subsaddle elev', 0, point, saddle, NULL, NULL FROM mine WHERE is_elev = 1 UNION ALL SELECT 'subsaddle prom', 0, point, saddle, NULL, NULL FROM mine WHERE is_prom = 1)"""


def packed(sql: str) -> str:
    """sql with pid(x, y, seq) written out: the 64-bit id of a place, null without x."""
    out, at = "", 0
    while (i := sql.find("pid(", at)) >= 0:
        j = sql.index(")", i)
        x, y, seq = sql[i + 4 : j].split(", ")
        out += sql[at:i] + f"(((CAST({x} AS BIGINT) & 16777215) << 28) | ((CAST({y} AS BIGINT) & 16777215) << 4) | (CAST({seq} AS BIGINT) & 15))"
        at = j + 1
    return out + sql[at:]
