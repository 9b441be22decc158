"""SQL for DuckDB that gives the rows of each query that SQL can express."""

from __future__ import annotations

CO_PARTS = """items AS MATERIALIZED (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
co AS MATERIALIZED (SELECT x.p AS a, y.p AS b, count(*) AS w FROM items x JOIN items y ON x.o = y.o AND x.p < y.p GROUP BY x.p, y.p)"""
SYMMETRIC = f"{CO_PARTS}, adj AS (SELECT a AS i, b AS j, CAST(1 AS BIGINT) AS v FROM co UNION ALL SELECT b, a, CAST(1 AS BIGINT) FROM co)"
TRIANGLES = f"{CO_PARTS}, wedges AS MATERIALIZED (SELECT x.a AS a, x.b AS b, y.b AS c FROM co x JOIN co y ON x.a = y.a AND x.b < y.b), tri AS MATERIALIZED (SELECT w.a, w.b, w.c FROM wedges w JOIN co z ON z.a = w.b AND z.b = w.c)"
SALES = """sales AS (SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst, CAST(count(*) AS BIGINT) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
nodes AS (SELECT c_custkey * 2 AS node, CAST(c_nationkey AS BIGINT) AS block FROM customer UNION ALL SELECT s_suppkey * 2 + 1, CAST(s_nationkey AS BIGINT) FROM supplier)"""
MATRIX = f"{SALES}, m AS (SELECT x.block AS r, y.block AS c, CAST(sum(weight) AS BIGINT) AS m FROM sales JOIN nodes x ON x.node = src JOIN nodes y ON y.node = dst GROUP BY 1, 2)"
DEGREES = f"{MATRIX}, deg AS (SELECT block, CAST(sum(o) AS BIGINT) AS d_out, CAST(sum(i) AS BIGINT) AS d_in, CAST(sum(o + i) AS BIGINT) AS d FROM (SELECT r AS block, m AS o, 0 AS i FROM m UNION ALL SELECT c, 0, m FROM m) GROUP BY block)"
X = "(CASE WHEN {0} > 0 THEN ({0}) * ln({0}) ELSE 0 END)"
ENTROPY = f"{DEGREES}, data AS (SELECT (SELECT sum({X.format('d_out')} + {X.format('d_in')}) FROM deg) - (SELECT sum({X.format('m')}) FROM m) AS entropy)"


def gain(a: str, b: str) -> str:
    return f"({X.format(f'({a} + {b})')} - {X.format(a)} - {X.format(b)})"


MERGES = f"""{DEGREES}, pairs AS (SELECT DISTINCT least(r, c) AS r, greatest(r, c) AS s FROM m WHERE r <> c),
gains AS (
  SELECT p.r, p.s, -{gain('x.m', 'y.m')} AS delta FROM pairs p JOIN m x ON x.r = p.r AND x.c NOT IN (p.r, p.s) JOIN m y ON y.r = p.s AND y.c = x.c
  UNION ALL SELECT p.r, p.s, -{gain('x.m', 'y.m')} FROM pairs p JOIN m x ON x.c = p.r AND x.r NOT IN (p.r, p.s) JOIN m y ON y.c = p.s AND y.r = x.r
  UNION ALL SELECT p.r, p.s, sum({X.format('x.m')}) - {X.format('sum(x.m)')} FROM pairs p JOIN m x ON x.r IN (p.r, p.s) AND x.c IN (p.r, p.s) GROUP BY p.r, p.s
  UNION ALL SELECT p.r, p.s, {gain('x.d_out', 'y.d_out')} + {gain('x.d_in', 'y.d_in')} FROM pairs p JOIN deg x ON x.block = p.r JOIN deg y ON y.block = p.s
), deltas AS (SELECT r, s, sum(delta) AS delta FROM gains GROUP BY r, s)"""

MOVES = f"""{DEGREES}, proposed AS (SELECT s_suppkey * 2 + 1 AS node, CAST(s_nationkey AS BIGINT) AS r, (CAST(s_nationkey AS BIGINT) + 1) % 25 AS s FROM supplier),
around AS (SELECT src AS node, y.block AS t, sum(weight) AS k_out, 0 AS k_in FROM sales JOIN nodes y ON y.node = dst GROUP BY 1, 2
  UNION ALL SELECT dst, x.block, 0, sum(weight) FROM sales JOIN nodes x ON x.node = src GROUP BY 1, 2),
k AS (SELECT node, t, CAST(sum(k_out) AS BIGINT) AS k_out, CAST(sum(k_in) AS BIGINT) AS k_in FROM around GROUP BY 1, 2)"""

CHANGES = f"""{MOVES}, parts AS (
  SELECT p.node, r AS x, t AS y, -k_out AS chg FROM proposed p JOIN k USING (node) UNION ALL SELECT p.node, s, t, k_out FROM proposed p JOIN k USING (node)
  UNION ALL SELECT p.node, t, r, -k_in FROM proposed p JOIN k USING (node) UNION ALL SELECT p.node, t, s, k_in FROM proposed p JOIN k USING (node)
), changes AS (SELECT node, x, y, sum(chg) AS chg FROM parts GROUP BY 1, 2, 3 HAVING sum(chg) <> 0)"""

CONTINGENCY = """cont AS (SELECT CAST(c_nationkey AS VARCHAR) AS truth, c_mktsegment AS found, count(*) AS n FROM customer GROUP BY 1, 2),
ra AS (SELECT sum(n) AS n FROM cont GROUP BY truth), rb AS (SELECT sum(n) AS n FROM cont GROUP BY found)"""

WEIGHTS = """w AS (SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS layer, l_partkey % 64 AS i, l_suppkey % 64 AS j, round(avg(l_discount - 0.05) * 20, 6) AS w FROM lineitem GROUP BY 1, 2, 3),
y0 AS (SELECT vec_id AS "row", CAST(unnest(range(len(embedding))) AS BIGINT) AS neuron, CAST(unnest(embedding) AS DOUBLE) AS val FROM embeddings)"""


def layers(n: int) -> str:
    steps = [WEIGHTS]
    for k in range(1, n + 1):
        steps.append(f"""z{k} AS (SELECT "row", j AS neuron, sum(val * w) - 0.01 AS val, sum(val * w) AS z FROM y{k - 1} JOIN w ON i = neuron AND layer = {k} WHERE val <> 0 GROUP BY 1, 2),
y{k} AS (SELECT "row", neuron, least(val, 32.0) AS val FROM z{k} WHERE z <> 0 AND val > 0)""")
    return ", ".join(steps)


def star(m: int, kind: int) -> str:
    loop = {0: "", 1: " UNION ALL SELECT 0, 0", 2: f" UNION ALL SELECT {m}, {m}"}[kind]
    return f"(SELECT CAST(0 AS BIGINT) AS i, CAST(x AS BIGINT) AS j FROM range(1, {m + 1}) t(x) UNION ALL SELECT x, 0 FROM range(1, {m + 1}) t(x){loop})"


def stars(sizes: list[int], kind: int, loop: int) -> str:
    product = star(sizes[0], kind)
    for m in sizes[1:]:
        product = f"(SELECT a.i * {m + 1} + b.i AS i, a.j * {m + 1} + b.j AS j FROM {product} a CROSS JOIN {star(m, kind)} b)"
    return f"kr AS (SELECT i, j, CAST(1 AS BIGINT) AS v FROM {product} WHERE NOT (i = {loop} AND j = {loop}))"


def truss(k: int, rounds: int) -> str:
    """The k-truss, if it takes no more rounds than given: triangles go with any side that is in too few of what is left."""
    steps = [f"{TRIANGLES}, t0 AS MATERIALIZED (SELECT a, b, c FROM tri)"]
    for r in range(rounds):
        sides = f"SELECT a, b FROM t{r} UNION ALL SELECT a, c FROM t{r} UNION ALL SELECT b, c FROM t{r}"
        steps.append(f"e{r} AS MATERIALIZED (SELECT a, b FROM ({sides}) GROUP BY a, b HAVING count(*) >= {k - 2})")
        steps.append(f"t{r + 1} AS MATERIALIZED (SELECT t.* FROM t{r} t JOIN e{r} x ON x.a = t.a AND x.b = t.b JOIN e{r} y ON y.a = t.a AND y.b = t.c JOIN e{r} z ON z.a = t.b AND z.b = t.c)")
    return f"WITH {', '.join(steps)} SELECT a, b FROM e{rounds - 1}"


#: Degrees of a star with a loop at a leaf, and how many vertices have each.
LOOPED = "(SELECT CAST(unnest([{0}, 2, 1]) AS BIGINT) AS d, CAST(unnest([1, 1, {0} - 1]) AS BIGINT) AS n)"
BFS = """top AS (SELECT i FROM adj GROUP BY i ORDER BY count(*) DESC, i LIMIT 1),
bfs(node, depth) USING KEY (node) AS (SELECT i, 0 FROM top UNION SELECT a.j, min(b.depth) + 1 FROM bfs b JOIN adj a ON a.i = b.node WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs r WHERE r.node = a.j) GROUP BY a.j)"""

ORACLE_SQL = {
    "edge_list": f"WITH {SALES} SELECT * FROM sales",
    "symmetrize": f"WITH {MATRIX} SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM (SELECT r AS i, c AS j, m AS v FROM m UNION ALL SELECT c, r, m FROM m) GROUP BY i, j HAVING sum(v) <> 0",
    "transpose": f"WITH {SALES} SELECT dst AS i, src AS j, weight AS v FROM sales",
    "lower_triangle": f"WITH {MATRIX} SELECT r AS i, c AS j, m AS v FROM m WHERE r > c",
    "upper_triangle": f"WITH {MATRIX} SELECT r AS i, c AS j, m AS v FROM m WHERE r < c",
    "drop_diagonal": f"WITH {MATRIX} SELECT r AS i, c AS j, m AS v FROM m WHERE r <> c",
    "binarise": f"WITH {SALES} SELECT src AS i, dst AS j, CAST(1 AS BIGINT) AS v FROM sales",
    "degree": f"WITH {SYMMETRIC} SELECT i, CAST(sum(v) AS BIGINT) AS v FROM adj GROUP BY i",
    "column_sums": f"WITH {SALES} SELECT dst AS j, CAST(sum(weight) AS BIGINT) AS v FROM sales GROUP BY dst",
    "degree_distribution": f"WITH {SYMMETRIC} SELECT degree, count(*) AS n FROM (SELECT i, CAST(sum(v) AS BIGINT) AS degree FROM adj GROUP BY i) GROUP BY degree",
    "matrix_totals": f"WITH {SALES} SELECT CAST(sum(weight) AS BIGINT) AS total, count(*) AS nnz FROM sales",
    "spgemm": f"WITH {SALES} SELECT x.dst AS i, y.dst AS j, CAST(sum(x.weight * y.weight) AS BIGINT) AS v FROM sales x JOIN sales y ON x.src = y.src GROUP BY 1, 2",
    "hadamard": f"WITH {MATRIX} SELECT x.r AS i, x.c AS j, x.m * y.m AS v FROM m x JOIN m y ON x.r = y.c AND x.c = y.r",
    "sparse_add": f"WITH {MATRIX} SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM (SELECT r AS i, c AS j, m AS v FROM m UNION ALL SELECT c, r, -m FROM m) GROUP BY i, j HAVING sum(v) <> 0",
    "matrix_unequal": f'WITH {MATRIX} SELECT coalesce(x.r, y.c) AS i, coalesce(x.c, y.r) AS j, x.m AS "left", y.m AS "right" FROM m x FULL JOIN m y ON x.r = y.c AND x.c = y.r WHERE x.m IS DISTINCT FROM y.m',
    "kron_product": "WITH f AS (SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(n_regionkey AS BIGINT) AS j FROM nation) SELECT a.i * 25 + b.i AS i, a.j * 5 + b.j AS j, CAST(1 AS BIGINT) AS v FROM f a CROSS JOIN f b",
    "kron_generate": f"WITH {stars([3, 4, 5], 2, 119)} SELECT * FROM kr",
    "kron_degree_distribution": f"WITH {stars([3, 4, 5], 1, 0)} SELECT degree, count(*) AS n FROM (SELECT i, CAST(sum(v) AS BIGINT) AS degree FROM kr GROUP BY i) GROUP BY degree",
    "decimate": f"WITH {CO_PARTS} SELECT a // 4 AS src, b // 4 AS dst, w AS weight FROM co WHERE a % 4 = 1 AND b % 4 = 1",
    "triangle_count": f"WITH {TRIANGLES} SELECT count(*) AS triangles FROM tri",
    "triangle_count_algebra": f"WITH {TRIANGLES} SELECT count(*) AS triangles FROM tri",
    "triangle_count_lower": f"WITH {TRIANGLES} SELECT count(*) AS triangles FROM tri",
    "triangle_enumerate": f"WITH {TRIANGLES} SELECT a, b, c FROM tri",
    "triangle_vertex_degree": f"WITH {TRIANGLES} SELECT vertex, count(*) AS triangles FROM (SELECT a AS vertex FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY vertex",
    "triangle_edge_degree": f"WITH {TRIANGLES} SELECT a, b, count(*) AS triangles FROM (SELECT a, b FROM tri UNION ALL SELECT a, c FROM tri UNION ALL SELECT b, c FROM tri) GROUP BY a, b",
    "edge_support": f"WITH {TRIANGLES}, s AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM tri UNION ALL SELECT a, c FROM tri UNION ALL SELECT b, c FROM tri) GROUP BY a, b) SELECT co.a, co.b, coalesce(n, 0) AS support FROM co LEFT JOIN s ON s.a = co.a AND s.b = co.b",
    "k_counts": f"""WITH {TRIANGLES}, v AS (SELECT x, count(*) AS n FROM (SELECT a AS x FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY x),
e AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM tri UNION ALL SELECT a, c FROM tri UNION ALL SELECT b, c FROM tri) GROUP BY a, b)
SELECT k, count(*) AS triangles FROM (SELECT CAST(least(floor((3 + sqrt(1 + 8 * least(va.n, vb.n, vc.n))) / 2), least(ab.n, ac.n, bc.n) + 2) AS BIGINT) AS k
FROM tri t JOIN v va ON va.x = t.a JOIN v vb ON vb.x = t.b JOIN v vc ON vc.x = t.c JOIN e ab ON ab.a = t.a AND ab.b = t.b JOIN e ac ON ac.a = t.a AND ac.b = t.c JOIN e bc ON bc.a = t.b AND bc.b = t.c) GROUP BY k""",
    # an edge that is in a triangle keeps it, so one round is all
    "ktruss_3": f"WITH {TRIANGLES} SELECT a, b FROM (SELECT a, b FROM tri UNION SELECT a, c FROM tri UNION SELECT b, c FROM tri)",
    "dnn_layer": f'WITH {layers(1)} SELECT "row", neuron, round(val, 6) AS val FROM y1',
    "dnn_infer_3": f'WITH {layers(3)} SELECT "row", neuron, round(val, 5) AS val FROM y3',
    "dnn_categories": f'WITH {layers(3)} SELECT "row" FROM y3 GROUP BY "row" HAVING sum(val) <> 0',
    "block_edge_counts": f"WITH {MATRIX} SELECT r, c, m FROM m",
    "block_degrees": f"WITH {DEGREES} SELECT * FROM deg",
    "data_entropy": f"WITH {ENTROPY} SELECT round(entropy, 4) AS entropy FROM data",
    "row_entropy": f"WITH {DEGREES} SELECT r, round(sum(-m * ln(m / (x.d_out * y.d_in))), 4) AS entropy FROM m JOIN deg x ON x.block = r JOIN deg y ON y.block = c GROUP BY r",
    "overall_entropy": f"""WITH {ENTROPY}, n AS (SELECT (SELECT sum(m) FROM m) AS e, (SELECT count(*) FROM deg) AS b, (SELECT count(*) FROM nodes) AS n),
model AS (SELECT e * ({X.format('(1 + b * b / e)')} - {X.format('(b * b / e)')}) + n * ln(b) AS model FROM n) SELECT round(model, 4) AS model, round(entropy, 4) AS data, round(model + entropy, 4) AS overall FROM model, data""",
    "merge_delta_entropy": f"WITH {MERGES} SELECT r, s, round(delta, 4) AS delta FROM deltas",
    "best_merge": f"""WITH {MERGES}, both_ways AS (SELECT r AS block, s AS partner, delta FROM deltas UNION ALL SELECT s, r, delta FROM deltas)
SELECT block, partner, round(delta, 4) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY delta, partner) AS k FROM both_ways) WHERE k = 1""",
    "move_delta_entropy": f"""WITH {CHANGES}, cells AS (SELECT node, sum({X.format('coalesce(m, 0)')} - {X.format('(coalesce(m, 0) + chg)')}) AS cells FROM changes LEFT JOIN m ON m.r = x AND m.c = y GROUP BY node),
kk AS (SELECT node, sum(k_out) AS o, sum(k_in) AS i FROM k GROUP BY node)
SELECT p.node, p.r, p.s, round({X.format('(a.d_out - o)')} - {X.format('a.d_out')} + {X.format('(b.d_out + o)')} - {X.format('b.d_out')} + {X.format('(a.d_in - i)')} - {X.format('a.d_in')} + {X.format('(b.d_in + i)')} - {X.format('b.d_in')} + coalesce(cells, 0), 4) AS delta
FROM proposed p JOIN kk USING (node) JOIN deg a ON a.block = p.r JOIN deg b ON b.block = p.s LEFT JOIN cells USING (node)""",
    "hastings_ratio": f"""WITH {CHANGES}, kk AS (SELECT node, sum(k_out + k_in) AS k FROM k GROUP BY node),
base AS (SELECT p.node, p.r, p.s, t, k_out + k_in AS w, d AS d_now, d - CASE WHEN t = p.r THEN kk.k ELSE 0 END + CASE WHEN t = p.s THEN kk.k ELSE 0 END AS d_then FROM proposed p JOIN k USING (node) JOIN kk USING (node) JOIN deg ON block = t),
seen AS (SELECT b.*, coalesce(a1.m, 0) + coalesce(a2.m, 0) AS now_, coalesce(b1.m, 0) + coalesce(b2.m, 0) + coalesce(c1.chg, 0) + coalesce(c2.chg, 0) AS then_ FROM base b
LEFT JOIN m a1 ON a1.r = t AND a1.c = s LEFT JOIN m a2 ON a2.r = s AND a2.c = t LEFT JOIN m b1 ON b1.r = t AND b1.c = b.r LEFT JOIN m b2 ON b2.r = b.r AND b2.c = t
LEFT JOIN changes c1 ON c1.node = b.node AND c1.x = t AND c1.y = b.r LEFT JOIN changes c2 ON c2.node = b.node AND c2.x = b.r AND c2.y = t)
SELECT node, round(sum(w * (then_ + 1) / (d_then + 25)) / sum(w * (now_ + 1) / (d_now + 25)), 6) AS ratio FROM seen GROUP BY node""",
    "neighbour_blocks": f"WITH {MOVES} SELECT * FROM k",
    "contingency": f"WITH {CONTINGENCY} SELECT * FROM cont",
    "pair_metrics": f"""WITH {CONTINGENCY}, s AS (SELECT (SELECT sum(n) FROM cont) AS n, (SELECT sum(n * n) FROM cont) AS c2, (SELECT sum(n * n) FROM ra) AS a2, (SELECT sum(n * n) FROM rb) AS b2,
(SELECT sum(n * (n - 1) / 2) FROM cont) AS cp, (SELECT sum(n * (n - 1) / 2) FROM ra) AS ap, (SELECT sum(n * (n - 1) / 2) FROM rb) AS bp),
p AS (SELECT ((c2 - n) / 2 + (n * n + c2 - a2 - b2) / 2) / (n * (n - 1) / 2) AS rand, (cp - ap * bp / (n * (n - 1) / 2)) / ((ap + bp) / 2 - ap * bp / (n * (n - 1) / 2)) AS ari, (c2 - n) / 2 / ap AS r, (c2 - n) / 2 / bp AS p FROM s)
SELECT round(rand, 6) AS rand, round(ari, 6) AS adjusted_rand, round(r, 6) AS pair_recall, round(p, 6) AS pair_precision, round(2 * p * r / (p + r), 6) AS pair_f1 FROM p""",
    "information_metrics": f"""WITH {CONTINGENCY}, s AS (SELECT (SELECT sum(n) FROM cont) AS n, (SELECT sum(n * ln(n)) FROM cont) AS c, (SELECT sum(n * ln(n)) FROM ra) AS a, (SELECT sum(n * ln(n)) FROM rb) AS b),
h AS (SELECT ln(n) - a / n AS ha, ln(n) - b / n AS hb, ln(n) - c / n AS hc FROM s)
SELECT round(ha, 6) AS h_truth, round(hb, 6) AS h_found, round(hc - hb, 6) AS h_truth_given_found, round(hc - ha, 6) AS h_found_given_truth, round(ha + hb - hc, 6) AS mutual, round((hc - hb) / ha, 6) AS missed, round((hc - ha) / hb, 6) AS wrong FROM h""",
    "snowball_depth": f"WITH RECURSIVE {SYMMETRIC}, {BFS} SELECT node, CAST(depth AS INTEGER) AS depth FROM bfs",
    "snowball_stages": f"""WITH RECURSIVE {SYMMETRIC}, {BFS}, staged AS (SELECT node, CAST(floor((row_number() OVER (ORDER BY depth, node) - 1) * 4.0 / count(*) OVER ()) + 1 AS INTEGER) AS at FROM bfs)
SELECT co.a AS src, co.b AS dst, greatest(coalesce(x.at, 4), coalesce(y.at, 4)) AS stage FROM co LEFT JOIN staged x ON x.node = co.a LEFT JOIN staged y ON y.node = co.b""",
    "ktruss_5": truss(5, 6),
    "kron_check": f"""WITH {stars([3, 4, 5], 2, 119)}, und AS (SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b FROM kr WHERE i <> j),
tri AS (SELECT x.a, x.b, y.b AS c FROM und x JOIN und y ON x.a = y.a AND x.b < y.b JOIN und z ON z.a = x.b AND z.b = y.b),
deg AS (SELECT d, count(*) AS n FROM (SELECT i, count(*) AS d FROM kr GROUP BY i) GROUP BY d),
theory AS (SELECT d, sum(n) AS n FROM (SELECT x.d * y.d * z.d AS d, x.n * y.n * z.n AS n FROM {LOOPED.format(3)} x, {LOOPED.format(4)} y, {LOOPED.format(5)} z UNION ALL SELECT 8, -1 UNION ALL SELECT 7, 1) GROUP BY d HAVING sum(n) <> 0),
predicted AS (SELECT 'vertices' AS property, (3 + 1) * (4 + 1) * (5 + 1) AS n UNION ALL SELECT 'entries', 7 * 9 * 11 - 1 UNION ALL SELECT 'triangles', (64 - 3 * 8 + 2) // 6 UNION ALL SELECT 'truss_3_edges', (27 - 3) // 2 UNION ALL SELECT 'degree ' || d, n FROM theory),
measured AS (SELECT 'vertices' AS property, count(DISTINCT i) AS n FROM kr UNION ALL SELECT 'entries', count(*) FROM kr UNION ALL SELECT 'triangles', count(*) FROM tri UNION ALL SELECT 'truss_3_edges', count(*) FROM (SELECT a, b FROM tri UNION SELECT a, c FROM tri UNION SELECT b, c FROM tri) UNION ALL SELECT 'degree ' || d, n FROM deg)
SELECT property, CAST(p.n AS DECIMAL(38, 0)) AS predicted, CAST(m.n AS DECIMAL(38, 0)) AS measured FROM predicted p FULL JOIN measured m USING (property)""",
    "matching_accuracy": f"""WITH {CONTINGENCY}, s AS (SELECT truth, found, n, dense_rank() OVER (ORDER BY found) AS k FROM cont)
SELECT max(a.n + b.n + c.n + d.n + e.n) / (SELECT sum(n) FROM cont) AS accuracy FROM s a JOIN s b ON b.truth <> a.truth JOIN s c ON c.truth NOT IN (a.truth, b.truth) JOIN s d ON d.truth NOT IN (a.truth, b.truth, c.truth)
JOIN s e ON e.truth NOT IN (a.truth, b.truth, c.truth, d.truth) WHERE a.k = 1 AND b.k = 2 AND c.k = 3 AND d.k = 4 AND e.k = 5""",
    "triangle_count_incidence": f"WITH {TRIANGLES} SELECT count(*) AS triangles FROM tri",
    "edge_corners": f"WITH {TRIANGLES} SELECT a, b, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS corners FROM (SELECT a, b, c AS x FROM tri UNION ALL SELECT a, c, b FROM tri UNION ALL SELECT b, c, a FROM tri) GROUP BY a, b",
    "file_edges": f"WITH {SALES} SELECT * FROM sales",
    "file_edges_from_one": f"WITH {SALES} SELECT src - 1 AS src, dst - 1 AS dst, CAST(1 AS BIGINT) AS weight FROM sales",
    "file_labels": f"WITH {SALES} SELECT node, nullif(block, 7) AS block FROM nodes",
    "file_label_lines": "SELECT row_number() OVER (ORDER BY c_custkey) AS node, CAST(c_nationkey AS BIGINT) AS block FROM customer",
    "file_pieces": f"WITH {SALES} SELECT src, dst, weight, CAST(src % 3 + 1 AS INTEGER) AS piece FROM sales WHERE src % 3 < 2",
    "file_triples": f"WITH {MATRIX} SELECT r AS i, c AS j, CAST(m AS DOUBLE) AS v FROM m",
    "file_matrix_market": f"WITH {MATRIX} SELECT r + 1 AS i, c + 1 AS j, CAST(m AS DOUBLE) AS v FROM m",
    "file_matrix_market_symmetric": f"WITH {MATRIX} SELECT i + 1 AS i, j + 1 AS j, CAST(sum(v) AS DOUBLE) AS v FROM (SELECT r AS i, c AS j, m AS v FROM m UNION ALL SELECT c, r, m FROM m) GROUP BY i, j HAVING sum(v) <> 0",
    "file_layers": f"WITH {WEIGHTS} SELECT CAST(layer AS INTEGER) AS layer, i, j, w FROM w",
    "file_categories": 'SELECT CAST(s_nationkey AS BIGINT) AS "row" FROM supplier',
    "file_distribution": f"WITH {SYMMETRIC} SELECT CAST(degree AS DECIMAL(38, 0)) AS degree, CAST(count(*) AS DECIMAL(38, 0)) AS n FROM (SELECT i, sum(v) AS degree FROM adj GROUP BY i) GROUP BY degree",
    "file_factor": f"SELECT i, j, CAST(1 AS BIGINT) AS v FROM {star(5, 2)}",
    "file_stages": "SELECT CAST(stage AS INTEGER) AS stage, count(*) AS edges, CAST(sum(src) AS BIGINT) AS src FROM (SELECT DISTINCT l_orderkey, l_suppkey, o_custkey AS src, month(o_orderdate) AS stage FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY stage",
    "run_statistics": "SELECT o_orderstatus, o_orderpriority, count(*) AS runs, round(avg(o_totalprice), 3) AS mean, round(stddev_pop(o_totalprice), 3) AS spread FROM orders GROUP BY 1, 2",
    "round_robin": f"WITH {SALES} SELECT node, row_number() OVER (ORDER BY turn, block) - 1 AS place FROM (SELECT node, block, row_number() OVER (PARTITION BY block ORDER BY node) AS turn FROM nodes)",
    "stride_order": f"WITH {SALES} SELECT node, row_number() OVER (ORDER BY place % 7, place) - 1 AS place FROM (SELECT node, row_number() OVER (ORDER BY node) - 1 AS place FROM nodes)",
    "arrival_ids": "SELECT node, row_number() OVER (ORDER BY f, node) AS new FROM (SELECT user_id AS node, min(month(ts)) AS f FROM events GROUP BY user_id)",
    "stream_block_counts": f"WITH {MATRIX} SELECT r, c, m FROM m",
}
