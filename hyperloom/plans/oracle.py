"""The catalogue's queries as SQL."""

from __future__ import annotations

from hyperloom.functions import treelets

#: The threshold, the number of samples, and number and offset of a second sample, of the catalogue.
T_SPLIT, SAMPLES, SECOND = 4, 400, (200, 777)
_A, _B = 2654435761, 12345

INC = "inc AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS v FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL), sz AS (SELECT e, count(*) AS size FROM inc GROUP BY e)"


def _pairs(name: str, source: str) -> str:
    return f"{name} AS (SELECT DISTINCT a.v AS u, b.v AS v FROM {source} a JOIN {source} b ON a.e = b.e AND a.v < b.v)"


def _adj(name: str, pairs: str) -> str:
    return f"{name} AS (SELECT u, v FROM {pairs} UNION ALL SELECT v AS u, u AS v FROM {pairs})"


GRAPH = f"{INC}, {_pairs('pairs', 'inc')}, {_adj('adj', 'pairs')}"
SIDES = f"{INC}, low AS (SELECT inc.* FROM inc JOIN sz USING (e) WHERE size <= {T_SPLIT}), high AS (SELECT inc.* FROM inc JOIN sz USING (e) WHERE size > {T_SPLIT}), {_pairs('lp', 'low')}, {_pairs('hp', 'high')}, ov AS (SELECT * FROM lp INTERSECT SELECT * FROM hp)"


def _color(k: int, seed: int = 0) -> str:
    return f"CAST((((v * {_A} + {seed * 40503}) % 4294967296) >> 16) % {k} AS INTEGER)"


def _dim(k: int, keep=lambda s: True) -> str:
    rows = ", ".join(f"({r[0]}, {r[1]}, {r[2]}, {r[4]}, {r[5]}, {r[6]})" for r in treelets.rows(k) if keep(r[1]))
    return f"dim(k, s, comp_s, split_s, split_k, norm) AS (VALUES {rows})"


def counts(colors: int, k: int, keep=lambda s: True, roots: str | None = None) -> str:
    """The tables c1..ck and n1..n(k-1)."""
    out = [f"c1 AS (SELECT v, CAST(0 AS BIGINT) AS s, CAST(1 << {_color(colors)} AS INTEGER) AS c, CAST(1 AS BIGINT) AS n FROM (SELECT DISTINCT v FROM inc))", *([_dim(k, keep)] if k > 1 else [])]
    for size in range(2, k + 1):
        out.append(f"n{size - 1} AS (SELECT a.u AS v, s, c, CAST(sum(n) AS BIGINT) AS n FROM adj a JOIN c{size - 1} t ON a.v = t.v GROUP BY ALL)")
        parts = [f"SELECT x.v, d.s, x.c | y.c AS c, x.n * y.n AS n, d.norm FROM c{size - j} x JOIN dim d ON d.k = {size} AND d.split_k = {j} AND d.comp_s = x.s JOIN n{j} y ON y.v = x.v AND y.s = d.split_s AND (x.c & y.c) = 0" for j in range(1, size)]
        where = f"WHERE v IN ({roots})" if roots and size == k else ""
        out.append(f"c{size} AS (SELECT v, CAST(s AS BIGINT) AS s, CAST(c AS INTEGER) AS c, CAST(sum(n) // norm AS BIGINT) AS n FROM ({' UNION ALL '.join(parts)}) {where} GROUP BY v, s, c, norm)")
    return ", ".join(out)


DP3 = f"{GRAPH}, {counts(3, 3)}"
DIST = "dist AS (SELECT v, s, c, n, sum(n) OVER (ORDER BY v, s DESC, c ROWS UNBOUNDED PRECEDING) - n AS lo, sum(n) OVER (ORDER BY v, s DESC, c ROWS UNBOUNDED PRECEDING) AS hi FROM c3)"


def _cubed(x: str, prime: int) -> str:
    for step in (1, 7):
        r = f"(({x} + {step}) % {prime})"
        x = f"({r} * {r} % {prime} * {r} % {prime})"
    return x


def _spread(x: str, p: int, q: int) -> str:
    """A number under 2 ** 62 from cubes modulo two primes."""
    return f"({_cubed(x, p)} * 2147483648 + {_cubed(x, q)})"


def _draws(name: str, n: int, b: int, source: str = "c3") -> str:
    x = f"(i * 40503 + {b})"
    return f"{name} AS (SELECT i AS sample, (CAST({_spread(x, 2147483579, 2147483549)} AS HUGEINT) * 4611686018427387904 + {_spread(x, 2147483543, 2147483489)}) % (SELECT sum(n) FROM {source}) AS r FROM range({n}) t(i))"


def _drawn(n: int, b: int) -> str:
    return f"{DP3}, {DIST}, {_draws('draws', n, b)}, drawn AS (SELECT sample, v, s, c, n FROM draws JOIN dist ON r >= lo AND r < hi)"


def _options(tasks: str, size: int) -> str:
    """What trees of one size at a vertex split into, with running sums."""
    parts = [
        f"SELECT t.v, t.s, t.c, y.v AS w, x.c AS c1, y.c AS c2, d.comp_s, d.split_s, d.split_k, x.n * y.n AS weight FROM (SELECT DISTINCT v, s, c FROM {tasks}) t JOIN dim d ON d.s = t.s AND d.k = {size} AND d.split_k = {j} "
        f"JOIN c{size - j} x ON x.v = t.v AND x.s = d.comp_s AND (x.c & t.c) = x.c JOIN adj a ON a.u = t.v JOIN c{j} y ON y.v = a.v AND y.s = d.split_s AND y.c = xor(t.c, x.c)"
        for j in range(1, size)
    ]
    return f"SELECT *, sum(weight) OVER (PARTITION BY v, s, c ORDER BY w, c2 ROWS UNBOUNDED PRECEDING) AS hi, sum(weight) OVER (PARTITION BY v, s, c) AS total FROM ({' UNION ALL '.join(parts)})"


def _picked(tasks: str, options: str) -> str:
    pick = _spread("(k.sample * 40503 + k.q * 9973)", 2147483579, 2147483549)
    return f"SELECT k.sample, k.v, o.w, k.q, o.c1, o.c2, o.comp_s, o.split_s, o.split_k FROM {tasks} k JOIN {options} o ON k.v = o.v AND k.s = o.s AND k.c = o.c WHERE {pick} % o.total >= o.hi - o.weight AND {pick} % o.total < o.hi"


def placed(n: int = SAMPLES, b: int = _B) -> str:
    """Sampled vertices by position, for trees of three."""
    return ", ".join([
        _drawn(n, b),
        "t1 AS (SELECT sample, v, s, c, 1 AS q FROM drawn)",
        f"o1 AS ({_options('t1', 3)})",
        f"p1 AS ({_picked('t1', 'o1')})",
        "t2 AS (SELECT sample, w AS v, split_s AS s, c2 AS c, q + 1 AS q FROM p1 WHERE split_s <> 0 UNION ALL SELECT sample, v, comp_s, c1, q + split_k FROM p1 WHERE comp_s <> 0)",
        f"o2 AS ({_options('t2', 2)})",
        f"p2 AS ({_picked('t2', 'o2')})",
        "placed AS (SELECT sample, 0 AS pos, v FROM drawn UNION ALL SELECT sample, q, w FROM p1 UNION ALL SELECT sample, q, w FROM p2)",
        "induced AS (SELECT s.sample, coalesce(bits, 0) AS bits FROM (SELECT DISTINCT sample FROM placed) s LEFT JOIN (SELECT a.sample, bit_or(CAST(1 << (2 - (a.pos * (a.pos - 1) // 2 + b.pos)) AS BIGINT)) AS bits FROM placed a JOIN placed b ON a.sample = b.sample AND a.pos > b.pos JOIN adj ON adj.u = a.v AND adj.v = b.v GROUP BY a.sample) x USING (sample))",
        "masks AS (SELECT DISTINCT sample, m FROM (SELECT p.sample, i.e, bit_or(CAST(1 << (2 - p.pos) AS INTEGER)) AS m FROM placed p JOIN inc i ON i.v = p.v GROUP BY p.sample, i.e) WHERE bit_count(m) >= 2)",
        "classes AS (SELECT CAST(bit_count(bits) AS INTEGER) AS footprint, count(*) AS samples, min(vertices) AS vertices, CASE WHEN bit_count(bits) = 3 THEN 9 ELSE 3 END AS trees FROM induced JOIN (SELECT sample, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY v) AS vertices FROM placed GROUP BY sample) USING (sample) GROUP BY bits_class(bits))",
        "whole AS (SELECT CAST(sum(n) AS DOUBLE) / (2.0 / 9) AS total FROM c3)",
    ]).replace("GROUP BY bits_class(bits)", "GROUP BY bit_count(bits)")


def _with(text: str, select: str) -> str:
    return f"WITH {text} {select}"


_P = placed()
_EST = f"CAST(samples AS DOUBLE) / {SAMPLES} * (total / trees)"
_STARS = "stars AS (SELECT u AS v, count(*) AS degree, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS n FROM adj GROUP BY u HAVING count(*) >= 2)"


#: The grouped table of the second sample, as one query.
_OTHER = f"(WITH {placed(*SECOND)} SELECT footprint, samples, trees FROM classes)"


_COST = f"""{INC}, r AS (SELECT inc.v, inc.e, size, row_number() OVER (PARTITION BY inc.v ORDER BY size DESC, inc.e DESC) - 1 AS p FROM inc JOIN sz USING (e)),
b AS (SELECT size AS t, max(p) + 1 AS deepest, sum(CASE WHEN p >= 2 THEN CAST(pow(2, p) AS HUGEINT) ELSE 0 END) AS x FROM r GROUP BY size),
m AS (SELECT size AS t, count(*) AS m FROM sz GROUP BY size),
cost AS (SELECT t, max(deepest) OVER (ORDER BY t DESC) AS beta, least(sum(x) OVER (ORDER BY t DESC), 18446744073709551615) AS ie, CAST(sum(t * t * m) OVER (ORDER BY t) // 100 AS HUGEINT) AS naive FROM b JOIN m USING (t))"""

SQL: dict[str, str] = {
    "incidence": _with(INC, "SELECT e, v FROM inc"),
    "edge_sizes": _with(INC, "SELECT e, size FROM sz"),
    "vertex_degrees": _with(INC, "SELECT v, count(*) AS degree FROM inc GROUP BY v"),
    "second_member": _with(INC, "SELECT e, v FROM (SELECT e, v, row_number() OVER (PARTITION BY e ORDER BY v) AS i FROM inc) WHERE i = 2"),
    "renumbered_edges": _with(INC, "SELECT e, row_number() OVER (ORDER BY size DESC, verts, e) - 1 AS number FROM (SELECT e, count(*) AS size, list(v ORDER BY v) AS verts FROM inc GROUP BY e)"),
    "shared_edges": _with(INC, "SELECT a.v AS u, b.v AS v, count(*) AS shared FROM inc a JOIN inc b ON a.e = b.e AND a.v < b.v GROUP BY a.v, b.v"),
    "gaifman": _with(INC, "SELECT DISTINCT a.v AS u, b.v AS v FROM inc a JOIN inc b ON a.e = b.e AND a.v <> b.v"),
    "gaifman_max_edge_size": _with(INC, "SELECT DISTINCT a.v AS u, b.v AS v FROM inc a JOIN inc b ON a.e = b.e AND a.v <> b.v JOIN sz ON sz.e = a.e WHERE size <= 5"),
    "gaifman_upper_bound": _with(INC, "SELECT CAST(sum(size * (size - 1) // 2) AS BIGINT) AS upper_bound, count(*) AS hyperedges FROM sz WHERE size >= 2"),
    "gaifman_exact_size": _with(GRAPH, "SELECT count(*) AS pairs FROM pairs"),
    "graph_degrees": _with(GRAPH, "SELECT u AS v, count(*) AS degree FROM adj GROUP BY u"),
    "has_incident": _with(INC, "SELECT e, v + 1 AS v FROM inc INTERSECT SELECT e, v FROM inc"),
    "has_edge": _with(GRAPH, "SELECT u, v FROM adj WHERE v = u + 1"),
    "split_low": _with(SIDES, "SELECT e, v FROM low"),
    "split_high": _with(SIDES, "SELECT e, v FROM high"),
    "overlap_pairs": _with(SIDES, "SELECT u, v FROM ov"),
    "exclude_pairs": _with(f"{SIDES}, x AS (SELECT * FROM lp EXCEPT SELECT * FROM ov)", "SELECT u, v FROM x UNION ALL SELECT v, u FROM x"),
    "dedup_classes": _with(f"{INC}, g AS (SELECT v, list(e ORDER BY e) AS es FROM inc GROUP BY v), f AS (SELECT v, min(v) OVER (PARTITION BY es) AS first FROM g)", "SELECT v, dense_rank() OVER (ORDER BY first) - 1 AS class FROM f"),
    "dedup_edges": _with(f"{INC}, g AS (SELECT v, list(e ORDER BY e) AS es FROM inc GROUP BY v), f AS (SELECT v, min(v) OVER (PARTITION BY es) AS first FROM g), k AS (SELECT v, dense_rank() OVER (ORDER BY first) - 1 AS class FROM f)", "SELECT DISTINCT e, class AS v FROM inc JOIN k USING (v)"),
    "original_ids": _with(INC, "SELECT e, CASE WHEN v % 2 = 0 THEN v + 1000000 ELSE v END AS v FROM inc"),
    "min_size_filter": "SELECT label, v FROM (SELECT label, v, count(*) OVER (PARTITION BY label) AS n FROM (SELECT DISTINCT o_custkey AS label, l_suppkey AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey)) WHERE n >= 10",
    "label_numbers": "SELECT label, size, CAST(row_number() OVER (ORDER BY size DESC, label) AS INTEGER) AS number FROM (SELECT o_custkey AS label, count(DISTINCT l_suppkey) AS size FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) WHERE size >= 10",
    "hourly_hypergraph": "SELECT DISTINCT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS e, user_id AS v FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL",
    "parse_text_hypergraph": "SELECT DISTINCT doc_id AS e, v FROM (SELECT doc_id, TRY_CAST(unnest(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS v FROM documents) WHERE v IS NOT NULL",
    "dump_text_hypergraph": _with(INC, "SELECT e, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS value FROM inc GROUP BY e"),
    "graph_formats": _with(GRAPH, "SELECT u, v FROM adj"),
    "alpha_rank": _with(INC, "SELECT inc.v, inc.e, size, row_number() OVER (PARTITION BY inc.v ORDER BY size DESC, inc.e DESC) - 1 AS p FROM inc JOIN sz USING (e)"),
    "alpha_cost": _with(_COST, "SELECT t, beta, CAST(ie AS VARCHAR) AS ie, CAST(naive AS VARCHAR) AS naive, CAST(ie + naive AS VARCHAR) AS total FROM cost"),
    "best_alpha": _with(_COST, "SELECT t AS threshold FROM cost ORDER BY ie + naive, t LIMIT 1"),
    "coloring": _with(INC, f"SELECT v, {_color(4, 7)} AS color FROM (SELECT DISTINCT v FROM inc)"),
    "coloring_biased": _with(INC, f"SELECT v, CASE WHEN h < 536870912 THEN 0 WHEN h < 1073741824 THEN 1 WHEN h < 1610612736 THEN 2 ELSE 3 END AS color FROM (SELECT DISTINCT v, (v * {_A}) % 4294967296 AS h FROM inc)"),
    "c2": _with(DP3, "SELECT v, s, c, n FROM c2"),
    "c3": _with(DP3, "SELECT v, s, c, n FROM c3"),
    "c4": _with(f"{GRAPH}, {counts(4, 4)}", "SELECT v, s, c, n FROM c4"),
    "n1": _with(f"{GRAPH}, {counts(1, 1)}", "SELECT a.u AS v, s, c, CAST(sum(n) AS BIGINT) AS n FROM adj a JOIN c1 t ON a.v = t.v GROUP BY ALL"),
    "n2": _with(DP3, "SELECT v, s, c, n FROM n2"),
    "store0_c3": _with(f"{GRAPH}, {counts(3, 3, roots='SELECT v FROM c1 WHERE c = 1')}", "SELECT v, s, c, n FROM c3"),
    "selector_include": _with(DP3, f"SELECT v, s, c, n FROM c3 WHERE s = {treelets.path(3)}"),
    "selector_exclude": _with(DP3, f"SELECT v, s, c, n FROM c3 WHERE s <> {treelets.star(3)}"),
    "ie_level1": _with(f"{SIDES}, {counts(3, 1)}, t AS (SELECT e, c, count(*) AS total FROM high JOIN c1 USING (v) GROUP BY e, c)", "SELECT h.v, CAST(0 AS BIGINT) AS s, t.c, CAST(sum(total - CASE WHEN o.c = t.c THEN 1 ELSE 0 END) AS BIGINT) AS n FROM high h JOIN t USING (e) JOIN c1 o ON o.v = h.v GROUP BY h.v, t.c HAVING sum(total - CASE WHEN o.c = t.c THEN 1 ELSE 0 END) <> 0"),
    "ie_total": _with(f"{SIDES}, {_adj('adj', 'hp')}, {counts(3, 1)}", "SELECT a.u AS v, s, c, CAST(sum(n) AS BIGINT) AS n FROM adj a JOIN c1 t ON a.v = t.v GROUP BY ALL"),
    "fuse_low_high": _with(DP3, "SELECT v, s, c, n FROM c3"),
    "merged_shards": _with(DP3, "SELECT v, s, c, n FROM c2"),
    "treelet_totals": _with(DP3, "SELECT s, c, CAST(sum(n) AS BIGINT) AS n FROM c3 GROUP BY s, c"),
    "count_lookup": _with(DP3, f"SELECT o.v, CAST({treelets.path(3)} AS BIGINT) AS s, CAST(7 AS INTEGER) AS c, coalesce(t.n, 0) AS n FROM c1 o LEFT JOIN c3 t ON t.v = o.v AND t.s = {treelets.path(3)} AND t.c = 7"),
    "sums_at_vertices": _with(DP3, "SELECT o.v, CAST(coalesce(sum(t.n), 0) AS BIGINT) AS n FROM c1 o LEFT JOIN c3 t ON t.v = o.v GROUP BY o.v"),
    "table_stats": _with(f"{DP3}, w AS (SELECT v, sum(n) AS x FROM c3 GROUP BY v)", "SELECT CAST((SELECT sum(n) FROM c3) AS BIGINT) AS total, CAST((SELECT max(x) FROM w) AS BIGINT) AS max_vertex, (SELECT max(n) FROM c3) AS max_row, (SELECT count(*) FROM c3) AS n_rows, true AS fits_64"),
    "root_weights": _with(DP3, "SELECT v, CAST(sum(n) AS BIGINT) AS weight FROM c3 GROUP BY v"),
    "prefix_cdf": _with(f"{DP3}, {DIST}", "SELECT v, s, c, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM dist"),
    "prefix_by_vertex": _with(DP3, "SELECT v, s, c, CAST(sum(n) OVER (PARTITION BY v ORDER BY s DESC, c ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM c3"),
    "distinct_treelets": _with(DP3, "SELECT DISTINCT s, c FROM c3"),
    "sizes_in_range": _with(DP3, "SELECT v, s, c, n FROM c2"),
    "representative_totals": _with(f"{GRAPH}, {counts(4, 4)}, f(s, repr) AS (VALUES {', '.join(f'({s}, {treelets.canonical_rooting(s)})' for s in treelets.trees(4))})", "SELECT CAST(repr AS BIGINT) AS repr, CAST(sum(n) AS BIGINT) AS n FROM c4 JOIN f USING (s) GROUP BY repr"),
    "root_sample": _with(_drawn(SAMPLES, _B), "SELECT sample, v FROM drawn"),
    "treelet_sample": _with(_drawn(SAMPLES, _B), "SELECT sample, v, s, c, n FROM drawn"),
    "rooted_occurrence": _with(_P, "SELECT sample, CAST(pos AS INTEGER) AS pos, v FROM placed"),
    "traces": _with(_P, "SELECT s.sample, coalesce(t, '') AS traces FROM (SELECT DISTINCT sample FROM placed) s LEFT JOIN (SELECT sample, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m DESC) AS t FROM masks GROUP BY sample) USING (sample)"),
    "gaifman_bits": _with(_P, "SELECT s.sample, CAST(coalesce(b, 0) AS BIGINT) AS bits FROM (SELECT DISTINCT sample FROM placed) s LEFT JOIN (SELECT sample, bit_or(CASE m WHEN 7 THEN 7 WHEN 6 THEN 4 WHEN 5 THEN 2 ELSE 1 END) AS b FROM masks GROUP BY sample) USING (sample)"),
    "induced_bits": _with(_P, "SELECT sample, bits FROM induced"),
    "motif_class_k3": _with(_P, "SELECT CASE WHEN w THEN 'T' ELSE '-' END || p AS class, count(*) AS samples FROM (SELECT sample, bool_or(m = 7) AS w, count(*) FILTER (WHERE m <> 7) AS p FROM masks GROUP BY sample) GROUP BY 1"),
    "group_footprints": _with(_P, "SELECT footprint, samples, vertices FROM classes"),
    "text_footprints": _with(_P, "SELECT sample, chr(CAST(65 + bits * 2 AS INTEGER)) AS footprint FROM induced"),
    "spanning_stars": _with(_P, "SELECT sample, CAST(CASE bit_count(bits) WHEN 3 THEN 9 WHEN 2 THEN 3 ELSE 0 END AS BIGINT) AS stars FROM induced"),
    "spanning_trees_k3": _with(_P, "SELECT sample, CAST(CASE bit_count(bits) WHEN 3 THEN 9 WHEN 2 THEN 3 ELSE 0 END AS BIGINT) AS spanning_trees FROM induced"),
    "spanning_trees_kirchhoff": _with(_P, "SELECT sample, bits, CAST(CASE bit_count(bits) WHEN 3 THEN 9 WHEN 2 THEN 3 ELSE 0 END AS BIGINT) AS spanning_trees FROM induced"),
    "homomorphisms": _with(_P, "SELECT sample, bits, CAST(CASE bit_count(bits) WHEN 3 THEN 6 WHEN 2 THEN 2 ELSE 0 END AS BIGINT) AS homomorphisms FROM induced"),
    "estimate_occurrences": _with(_P, f"SELECT footprint, samples, round({_EST}, 7) AS est_occurrences FROM classes, whole"),
    "estimate_frequencies": _with(f"{_P}, est AS (SELECT footprint, {_EST} AS x FROM classes, whole)", "SELECT footprint, round(x / (SELECT sum(x) FROM est), 4) AS est_frequency FROM est"),
    "norm2": _with(_P, f"SELECT round(sqrt(sum(CAST(samples AS DOUBLE) * samples)) / {SAMPLES}, 4) AS norm2 FROM classes"),
    "merge_tables": _with(f"{_P}, other AS {_OTHER}", f"SELECT footprint, coalesce(a.samples, 0) + coalesce(b.samples, 0) AS samples, round((coalesce(a.samples, 0) + coalesce(b.samples, 0)) / ({SAMPLES + SECOND[0]} * coalesce(a.trees, b.trees) / total), 4) AS est_occurrences, 'M' AS sampling_algo FROM classes a FULL JOIN other b USING (footprint), whole"),
    "weighted_average": _with(f"{_P}, other AS {_OTHER}", f"SELECT footprint, coalesce(a.samples, 0) + coalesce(b.samples, 0) AS samples, round(coalesce(0.75::DOUBLE * (CAST(a.samples AS DOUBLE) / {SAMPLES} * (total / a.trees)) + 0.25::DOUBLE * (CAST(b.samples AS DOUBLE) / {SECOND[0]} * (total / b.trees)), CAST(a.samples AS DOUBLE) / {SAMPLES} * (total / a.trees), CAST(b.samples AS DOUBLE) / {SECOND[0]} * (total / b.trees)), 7) AS est_occurrences, 'W' AS sampling_algo FROM classes a FULL JOIN other b USING (footprint), whole"),
    "sample_output": _with(_P, "SELECT footprint AS hyper_motif, samples, 'H' AS sampling_algo, CAST(trees AS BIGINT) AS spanning_trees, vertices FROM classes"),
    "star_counts": _with(f"{GRAPH}, {_STARS}", "SELECT v, degree, n AS stars FROM stars"),
    "star_sample": _with(
        f"{GRAPH}, {_STARS}, cdf AS (SELECT v, sum(n) OVER (ORDER BY v) - n AS lo, sum(n) OVER (ORDER BY v) AS hi FROM stars), {_draws('draws', SAMPLES, _B, 'stars')}, roots AS (SELECT sample, v FROM draws JOIN cdf ON r >= lo AND r < hi), "
        f"near AS (SELECT sample, a.v AS w, row_number() OVER (PARTITION BY sample ORDER BY (a.v * {_A} + sample * 40503) % 4294967296, a.v) AS pos FROM roots JOIN adj a ON a.u = roots.v)",
        "SELECT sample, 0 AS pos, v FROM roots UNION ALL SELECT sample, CAST(pos AS INTEGER), w FROM near WHERE pos <= 2",
    ),
    "exact_census_k3": _with(
        f"{GRAPH}, sh AS (SELECT a.v AS u, b.v AS v, count(*) AS n FROM inc a JOIN inc b ON a.e = b.e AND a.v < b.v GROUP BY a.v, b.v), "
        "t3 AS (SELECT a.v AS a, b.v AS b, c.v AS c, count(*) AS n FROM inc a JOIN inc b ON a.e = b.e AND a.v < b.v JOIN inc c ON a.e = c.e AND b.v < c.v GROUP BY a.v, b.v, c.v), "
        "tri AS (SELECT x.n AS xy, y.n AS xz, z.n AS yz, coalesce(t3.n, 0) AS n FROM sh x JOIN sh y ON x.u = y.u AND x.v < y.v JOIN sh z ON z.u = x.v AND z.v = y.v LEFT JOIN t3 ON t3.a = x.u AND t3.b = x.v AND t3.c = y.v), "
        "closed AS (SELECT n > 0 AS whole, CAST(CAST(xy > n AS INTEGER) + CAST(xz > n AS INTEGER) + CAST(yz > n AS INTEGER) AS INTEGER) AS pairs, count(*) AS n FROM tri GROUP BY 1, 2), "
        "opened AS (SELECT false AS whole, 2 AS pairs, CAST((SELECT sum(d * (d - 1) // 2) FROM (SELECT count(*) AS d FROM adj GROUP BY u)) - 3 * (SELECT sum(n) FROM closed) AS BIGINT) AS n)",
        "SELECT * FROM closed UNION ALL SELECT * FROM opened",
    ),
    "decompose_star": "SELECT CAST(sum(CASE WHEN i < k - 1 THEN CAST(1 AS BIGINT) << (31 - 2 * i) ELSE 0 END) AS BIGINT) AS s FROM range(1, 7) a(k), range(6) b(i) GROUP BY k",
    "decompose_path": "SELECT CAST(sum(CASE WHEN i < k - 1 THEN CAST(1 AS BIGINT) << (31 - i) ELSE 0 END) AS BIGINT) AS s FROM range(1, 7) a(k), range(6) b(i) GROUP BY k",
    "treelet_dimension": "SELECT * FROM (VALUES (2, CAST(1 AS BIGINT)), (3, 2), (4, 4), (5, 9)) t(k, trees)",
}
SQL["rescaled_estimates"] = f"SELECT footprint, samples, est_occurrences * 0.5 AS est_occurrences FROM ({SQL['estimate_occurrences']})"
SQL["rooted_occurrence_split"] = SQL["rooted_occurrence"]
SQL["side_masses"] = _with(
    f"{SIDES}, {counts(3, 1)}, {_adj('hadj', 'hp')}, apart AS (SELECT * FROM lp EXCEPT SELECT * FROM hp), {_adj('ladj', 'apart')}, "
    "sums AS (SELECT a.u AS v, s, c, n AS low, 0 AS high FROM ladj a JOIN c1 t ON a.v = t.v UNION ALL SELECT a.u, s, c, 0, n FROM hadj a JOIN c1 t ON a.v = t.v)",
    "SELECT v, s, c, CAST(sum(low) AS BIGINT) AS low, CAST(sum(high) AS BIGINT) AS high FROM sums GROUP BY v, s, c",
)
#: Of trees of three, the star has the edges (0, 1) and (0, 2), and the path (0, 1) and (1, 2).
SQL["tree_mode_bits"] = _with(_drawn(SAMPLES, _B), f"SELECT sample, CAST(CASE s WHEN {treelets.star(3)} THEN 6 ELSE 5 END AS BIGINT) AS bits FROM drawn")
SQL["selective_sample"] = _with(
    f"{DP3}, stars AS (SELECT * FROM c3 WHERE s = {treelets.star(3)}), {DIST.replace('FROM c3', 'FROM stars')}, {_draws('draws', SAMPLES, _B, 'stars')}",
    "SELECT sample, v, s, c, n FROM draws JOIN dist ON r >= lo AND r < hi",
)
