"""The same queries as SQL that DuckDB runs on the shared tables."""

from __future__ import annotations

from odweave.plans import file_queries

FLOWS = """flows AS (SELECT c_nationkey o, s_nationkey d, CAST(SUM(l_quantity) AS BIGINT) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
LEGS = """pk AS (SELECT c_nationkey p, p_brand k, CAST(SUM(l_quantity) AS DOUBLE) AS cost, COUNT(*) n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
kq AS (SELECT p_brand k, s_nationkey q, CAST(SUM(l_quantity) AS DOUBLE) AS cost, COUNT(*) n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
 JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
ZONES = "z AS (SELECT n_nationkey AS zone FROM nation UNION ALL SELECT r_regionkey + 100 FROM region)"
REGIONS = "g AS (SELECT n_nationkey zone, n_regionkey grp FROM nation)"


def _best(cost: str = "pk.cost + kq.cost", order: str = "DESC", where: str = "", n: int = 3) -> str:
    return f"""WITH {LEGS}, c AS (SELECT p, q, pk.k, {cost} AS cost, pk.n + kq.n AS n FROM pk JOIN kq ON pk.k = kq.k {where})
SELECT p, q, k, cost, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p, q ORDER BY cost {order}, k DESC) r FROM c) WHERE r <= {n}"""


def _two_pass(f: str) -> str:
    return f"""WITH {FLOWS}, {REGIONS}, a AS (SELECT g.grp row_group, d, {f}(value) AS value FROM flows JOIN g ON o = zone GROUP BY 1, 2)
SELECT row_group, g.grp col_group, ROUND({f}(value), 4) AS value FROM a JOIN g ON d = zone GROUP BY 1, 2"""


def _one_pass(f: str) -> str:
    return f"WITH {FLOWS}, {REGIONS} SELECT r.grp row_group, c.grp col_group, CAST({f}(value) AS BIGINT) AS value FROM flows JOIN g r ON o = r.zone JOIN g c ON d = c.zone GROUP BY 1, 2"


def _tlfd(weight: str = "1", iz: bool = False, top: bool = False, kind: str = "BIGINT") -> str:
    keep = "NOT iz" if iz else "TRUE"
    parts = [
        f"""SELECT CAST(b.i AS INTEGER) AS position, 'bin' AS bin_type, (b.i * 4) || ' to ' || (b.i * 4 + 4) AS label, CAST(COALESCE(SUM(w), 0) AS {kind}) AS value
FROM range(10) b(i) LEFT JOIN t ON {keep} AND l_quantity BETWEEN 0 AND 40 AND LEAST(FLOOR(l_quantity / 4), 9) = b.i GROUP BY b.i"""
    ]
    if iz:
        parts.append(f"SELECT -1, 'intrazonal', 'intrazonal to 0', CAST(COALESCE(SUM(w), 0) AS {kind}) FROM t WHERE iz")
    if top:
        parts.append(f"SELECT 10, 'top', '40 to inf', CAST(COALESCE(SUM(w), 0) AS {kind}) FROM t WHERE {keep} AND l_quantity >= 40")
    return f"WITH t AS (SELECT l_quantity, {weight} AS w, l_partkey % 10 = 0 AS iz FROM lineitem) " + " UNION ALL ".join(parts)


def _distance(expr: str) -> str:
    return f"""WITH z AS (SELECT n_nationkey AS zone, CAST(n_nationkey * 37 % 101 AS DOUBLE) AS x, CAST(n_nationkey * 53 % 89 AS DOUBLE) AS y FROM nation)
SELECT a.zone AS o, b.zone AS d, ROUND({expr}, 5) AS value FROM z a CROSS JOIN z b"""


def _unrolled_balance(passes: int) -> str:
    """Proportional fitting as a chain of CTEs, rescaling the matrix itself."""
    ctes = [
        FLOWS,
        "m0 AS (SELECT a.n_nationkey o, b.n_nationkey d, CAST(COALESCE(value, 0) AS DOUBLE) v FROM nation a CROSS JOIN nation b LEFT JOIN flows ON o = a.n_nationkey AND d = b.n_nationkey)",
        "ra AS (SELECT o, SUM(v) + 100 * o AS t FROM m0 GROUP BY o)",
        "ca AS (SELECT d, SUM(v) + 100 * (24 - d) AS t FROM m0 GROUP BY d)",
        "goal AS (SELECT ((SELECT SUM(t) FROM ra) + (SELECT SUM(t) FROM ca)) / 2 AS t)",
        "a AS (SELECT o, t * (SELECT t FROM goal) / (SELECT SUM(t) FROM ra) AS t FROM ra)",
        "b AS (SELECT d, t * (SELECT t FROM goal) / (SELECT SUM(t) FROM ca) AS t FROM ca)",
    ]
    for i in range(passes):
        ctes.append(f"r{i} AS MATERIALIZED (SELECT m.o, m.d, m.v * a.t / (SUM(m.v) OVER (PARTITION BY m.o) + 1e-7) AS v FROM m{i} m JOIN a ON m.o = a.o)")
        ctes.append(f"m{i + 1} AS MATERIALIZED (SELECT m.o, m.d, m.v * b.t / (SUM(m.v) OVER (PARTITION BY m.d) + 1e-7) AS v FROM r{i} m JOIN b ON m.d = b.d)")
    return f"WITH {', '.join(ctes)} SELECT o, d, ROUND(v, 3) AS value FROM m{passes}"


STOPS = """stops AS (SELECT user_id AS line, ts AS line_no, CAST(COALESCE(list_position(['click','view','purchase','login','signup','logout','search'], event_type), 0) AS BIGINT) AS inode,
 CAST(COALESCE(ROUND(value, 0), 0) AS BIGINT) AS v FROM events),
s1 AS (SELECT *, COALESCE(LEAD(inode) OVER (PARTITION BY line ORDER BY line_no), 0) AS jnode, CAST(ROW_NUMBER() OVER (PARTITION BY line ORDER BY line_no) AS INTEGER) AS seg_seq FROM stops),
seg AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY line, inode, jnode ORDER BY seg_seq) AS INTEGER) AS loop FROM s1)"""
LINE_IDS = """ids AS (SELECT (['T','GT','B2','Y'])[o_orderkey % 4 + 1] || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE LPAD(CAST(o_orderkey AS VARCHAR), 8, '0') END || 'a' AS line FROM orders),
ops AS (SELECT line, REGEXP_REPLACE(SUBSTR(line, 1, 2), '[0-9]+', '', 'g') AS operator, LTRIM(REGEXP_REPLACE(line, '[^0-9]', '', 'g'), '0') AS digits FROM ids),
parsed AS (SELECT line, operator, CASE WHEN digits = '' THEN SUBSTR(line, LENGTH(operator) + 1, GREATEST(LENGTH(line) - LENGTH(operator) - 1, 0)) ELSE digits END AS route FROM ops)"""
SIDES = f"{FLOWS}, m AS (SELECT o id, SUM(value) AS v FROM flows GROUP BY 1), t AS (SELECT d id, SUM(value) AS v FROM flows GROUP BY 1)"


def all_oracles() -> dict[str, str]:
    return {
        "best_intermediate": _best(),
        "best_intermediate_minimize": _best(order="ASC"),
        "best_intermediate_masked": _best(where="WHERE p % 2 = 0 AND q % 3 = 0"),
        "best_intermediate_with_pair_cost": _best(cost="pk.cost + kq.cost + (p * 7 + q * 11) % 13 * LENGTH(pk.k)"),
        "best_intermediate_unavailable": f"""WITH {LEGS}, w AS (SELECT p, q, k, cost, n FROM (SELECT p, q, pk.k, pk.cost + kq.cost AS cost, pk.n + kq.n AS n,
 ROW_NUMBER() OVER (PARTITION BY p, q ORDER BY pk.cost + kq.cost DESC, pk.k DESC) r FROM pk JOIN kq ON pk.k = kq.k WHERE p % 5 <> 0) WHERE r = 1)
SELECT a.p, b.q, COALESCE(w.k, 'none') AS k, w.k IS NOT NULL AS available, w.cost, w.n FROM (SELECT DISTINCT p FROM pk) a CROSS JOIN (SELECT DISTINCT q FROM kq) b LEFT JOIN w ON w.p = a.p AND w.q = b.q""",
        "best_intermediate_subset": f"""WITH {LEGS}, s AS (SELECT p, q, pk.k, pk.cost + kq.cost AS cost, pk.n + kq.n AS n,
 ROW_NUMBER() OVER (PARTITION BY p, q ORDER BY pk.n, pk.k DESC) sr FROM pk JOIN kq ON pk.k = kq.k)
SELECT p, q, k, cost, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p, q ORDER BY cost DESC, sr) r FROM s WHERE sr <= 5) WHERE r <= 2""",
        "od_aggregate_regions": _one_pass("SUM"),
        "od_aggregate_max": _one_pass("MAX"),
        "od_aggregate_wide_mean": _two_pass("AVG"),
        "od_aggregate_wide_median": _two_pass("MEDIAN"),
        "od_map_to_square": f"WITH {FLOWS}, {ZONES} SELECT a.zone AS o, b.zone AS d, COALESCE(value, 0) AS value FROM z a CROSS JOIN z b LEFT JOIN flows ON o = a.zone AND d = b.zone",
        "od_map_into_existing": f"WITH {FLOWS}, {ZONES} SELECT a.zone AS o, b.zone AS d, COALESCE(value, 0) * 2 - COALESCE(value, 0) AS value FROM z a CROSS JOIN z b LEFT JOIN flows ON o = a.zone AND d = b.zone",
        "od_coerce_square": f"""WITH {FLOWS}, f AS (SELECT o, n_regionkey + 100 AS d, SUM(value) AS value FROM flows JOIN nation ON d = n_nationkey GROUP BY 1, 2), z AS (SELECT o AS zone FROM f UNION SELECT d FROM f)
SELECT a.zone AS o, b.zone AS d, CAST(CAST(COALESCE(value, 0) AS FLOAT) AS DOUBLE) AS value FROM z a CROSS JOIN z b LEFT JOIN f ON o = a.zone AND d = b.zone""",
        "expand_array": f"WITH {FLOWS}, z AS (SELECT CAST(i AS INTEGER) AS zone FROM range(27) r(i)) SELECT a.zone AS o, b.zone AS d, COALESCE(value, 0) AS value FROM z a CROSS JOIN z b LEFT JOIN flows ON o = a.zone AND d = b.zone",
        "od_stack": f"WITH {FLOWS} SELECT a.o, b.n_nationkey AS d, value FROM (SELECT DISTINCT o FROM flows) a CROSS JOIN nation b LEFT JOIN flows f ON f.o = a.o AND f.d = b.n_nationkey",
        "od_unstack": f"WITH {FLOWS} SELECT o, " + ", ".join(f"MAX(CASE WHEN d = {i} THEN value END) AS d{i}" for i in range(25)) + " FROM flows GROUP BY o",
        "od_totals": f"WITH {FLOWS} SELECT o AS zone, CAST(SUM(value) AS BIGINT) AS total, 'o' AS axis FROM flows GROUP BY o UNION ALL SELECT d, CAST(SUM(value) AS BIGINT), 'd' FROM flows GROUP BY d",
        "disaggregate_nations": f"""WITH {FLOWS}, f AS (SELECT n_regionkey o, d, SUM(value) AS value FROM flows JOIN nation ON o = n_nationkey GROUP BY 1, 2),
r AS (SELECT n_nationkey AS new, n_regionkey AS old, (n_nationkey + 1.0) / SUM(n_nationkey + 1.0) OVER (PARTITION BY n_regionkey) AS p FROM nation),
q AS (SELECT l_suppkey AS new, SUM(l_quantity) AS p FROM lineitem GROUP BY 1), c AS (SELECT new, s_nationkey AS old, p / SUM(p) OVER (PARTITION BY s_nationkey) AS p FROM q JOIN supplier ON new = s_suppkey)
SELECT r.new AS o, c.new AS d, ROUND(CAST(value AS DOUBLE) * CAST(r.p AS DOUBLE) * c.p, 4) AS value FROM f JOIN r ON f.o = r.old JOIN c ON f.d = c.old""",
        "split_zone": f"""WITH {FLOWS}, s AS (SELECT * FROM (VALUES (100, 0.5), (101, 0.25), (102, 0.25)) t(z, p)), e AS (SELECT n_nationkey AS old, n_nationkey AS new, 1.0 AS p FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 3, z, p FROM s)
SELECT a.new AS o, b.new AS d, ROUND(CAST(value AS DOUBLE) * CAST(a.p AS DOUBLE) * CAST(b.p AS DOUBLE), 4) AS value FROM flows JOIN e a ON o = a.old JOIN e b ON d = b.old""",
        "balance_rows_1d": f"WITH {FLOWS}, t AS (SELECT o, CAST(SUM(value) AS DOUBLE) AS s FROM flows GROUP BY o) SELECT f.o, f.d, ROUND(f.value * ((2 * s + f.o) / (s + 1e-7)), 4) AS value FROM flows f JOIN t ON f.o = t.o",
        "balance_cols_1d": f"WITH {FLOWS}, t AS (SELECT d, CAST(SUM(value) AS DOUBLE) AS s FROM flows GROUP BY d) SELECT f.o, f.d, ROUND(f.value * ((3 * s + f.d) / (s + 1e-7)), 4) AS value FROM flows f JOIN t ON f.d = t.d",
        "balance_2d_k_iters": _unrolled_balance(3),
        "balance_2d_converged": f"WITH {FLOWS} SELECT o AS zone, CAST(2 * SUM(value) AS BIGINT) AS total FROM flows GROUP BY o",
        "bucket_round_prices": """WITH e AS (SELECT user_id, ts, CAST(ROUND(value, 6) AS DECIMAL(38,9)) AS v FROM events WHERE value IS NOT NULL), s AS (SELECT user_id, ts, v, SUM(v) OVER (ORDER BY user_id, ts ROWS UNBOUNDED PRECEDING) AS u FROM e)
SELECT user_id, ts, CAST(ROUND_EVEN(u, 0) - ROUND_EVEN(u - v, 0) AS INTEGER) AS value FROM s""",
        "bucket_round_hundreds": f"WITH {FLOWS}, s AS (SELECT o, d, value, CAST(SUM(value) OVER (ORDER BY o, d ROWS UNBOUNDED PRECEDING) AS BIGINT) AS u FROM flows) SELECT o, d, CAST(ROUND_EVEN(u / 100.0, 0) * 100 - ROUND_EVEN((u - value) / 100.0, 0) * 100 AS INTEGER) AS value FROM s",
        "tlfd_quantity": _tlfd(),
        "tlfd_weighted": _tlfd(weight="CAST(l_extendedprice AS DECIMAL(18,2))", kind="DOUBLE"),
        "tlfd_top": _tlfd(top=True),
        "tlfd_intrazonal": _tlfd(iz=True, top=True),
        "distance_euclid": _distance("SQRT((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))"),
        "distance_manhattan": _distance("ABS(b.x - a.x) + ABS(b.y - a.y)"),
        "distance_haversine": _distance("6371.0 * 2 * ATAN2(SQRT(POW(SIN(RADIANS(b.y - a.y) / 2), 2) + COS(RADIANS(a.y)) * COS(RADIANS(b.y)) * POW(SIN(RADIANS(b.x - a.x) / 2), 2)), SQRT(1 - (POW(SIN(RADIANS(b.y - a.y) / 2), 2) + COS(RADIANS(a.y)) * COS(RADIANS(b.y)) * POW(SIN(RADIANS(b.x - a.x) / 2), 2))))"),
        "distance_rows": "SELECT o_orderkey, ROUND(SQRT(POW(o_custkey % 97 - o_orderkey % 97, 2) + POW(o_custkey % 89 - o_orderkey % 89, 2)), 5) AS distance FROM orders",
        "lookup_reindex": "SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 1",
        "lookup_fill": "SELECT c_custkey, c_nationkey, COALESCE(n_name, 'elsewhere') AS n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 1",
        "zone_indexers": f"WITH {FLOWS}, z AS (SELECT n_nationkey AS zone, CAST(ROW_NUMBER() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS ordinal FROM nation) SELECT DISTINCT o, ordinal FROM flows JOIN z ON o = zone",
        "sum_frames": """SELECT k, CAST(COALESCE(SUM(customers), 0) AS BIGINT) AS customers, CAST(COALESCE(SUM(suppliers), 0) AS BIGINT) AS suppliers FROM (SELECT c_nationkey AS k, COUNT(*) AS customers, NULL AS suppliers FROM customer GROUP BY 1
UNION ALL SELECT s_nationkey, MAX(s_suppkey), COUNT(*) FROM supplier GROUP BY 1) GROUP BY k""",
        "natural_sort_rank": "SELECT p_brand, CAST(ROW_NUMBER() OVER (ORDER BY REGEXP_REPLACE(p_brand, '[0-9]+', ''), CAST(REGEXP_EXTRACT(p_brand, '[0-9]+') AS INTEGER)) AS INTEGER) AS position FROM (SELECT DISTINCT p_brand FROM part)",
        "category_codes": "SELECT category, CAST(ROW_NUMBER() OVER (ORDER BY category) - 1 AS INTEGER) AS code FROM (SELECT o_orderpriority AS category FROM orders UNION SELECT c_mktsegment FROM customer)",
        "category_difference": "SELECT DISTINCT p_brand AS brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity = (SELECT MAX(l_quantity) FROM lineitem))",
        "align_categories": """WITH z AS (SELECT category, CAST(ROW_NUMBER() OVER (ORDER BY category) - 1 AS INTEGER) AS code FROM (SELECT o_orderpriority AS category FROM orders UNION SELECT c_mktsegment FROM customer)),
u AS (SELECT o_orderpriority AS c, COUNT(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT c_mktsegment, COUNT(*) FROM customer GROUP BY 1) SELECT c, code AS c_code, n AS "count" FROM u JOIN z ON c = category""",
        "line_id_parse": f"WITH {LINE_IDS} SELECT line, operator, route FROM parsed",
        "eng_notation": """WITH r AS (SELECT p_partkey, (p_partkey % 50) || (['k','m','M','.'])[p_partkey % 4 + 1] || (p_partkey % 9) AS raw FROM part)
SELECT p_partkey, raw, ROUND(CAST(REGEXP_REPLACE(raw, '[a-zA-Z]', '.') AS DOUBLE) * CASE WHEN raw LIKE '%k%' THEN 1e3 WHEN raw LIKE '%m%' THEN 1e-3 WHEN raw LIKE '%M%' THEN 1e6 ELSE 1 END, 6) AS amount FROM r""",
        "segment_next_node": f"WITH {STOPS} SELECT line, line_no, inode, jnode, seg_seq, loop FROM seg",
        "segment_alightings": f"""WITH {STOPS}, r AS (SELECT line, inode, jnode, seg_seq, loop, CASE WHEN jnode > 0 THEN CAST(v AS DOUBLE) ELSE 0.0 END AS b, CASE WHEN jnode > 0 THEN CAST(v * 2 AS DOUBLE) ELSE 0.0 END AS volume FROM seg)
SELECT line, inode, jnode, seg_seq, loop, CAST(b AS DOUBLE) AS boardings, CAST(COALESCE(LAG(volume) OVER (PARTITION BY line ORDER BY seg_seq), 0) + b - volume AS DOUBLE) AS alightings, CAST(volume AS DOUBLE) AS volume FROM r""",
        "result_summary": f"WITH {LINE_IDS} SELECT operator, route, CAST(SUM(LENGTH(line)) AS DOUBLE) AS boardings, CAST(SUM(2.0) AS DOUBLE) AS total_volume FROM parsed GROUP BY 1, 2",
        "station_on_off": f"""WITH {FLOWS}, s AS (SELECT CAST(UNNEST([2, 5, 7, 11, 40]) AS BIGINT) AS stn_node)
SELECT stn_node, (SELECT CAST(SUM(value) AS DOUBLE) FROM flows WHERE d = stn_node) AS "on", (SELECT CAST(SUM(value) AS DOUBLE) FROM flows WHERE o = stn_node) AS "off" FROM s""",
        "semi_join_countpost": f"WITH {FLOWS} SELECT o AS inode, d AS jnode, value FROM flows WHERE (o * 5 + d) % 4 - 1 > 0",
        "relative_error_summary": f"""WITH {SIDES}, j AS (SELECT n_nationkey AS id, n_name AS name, COALESCE(m.v, 0) AS model, COALESCE(t.v, 0) AS target FROM nation LEFT JOIN m ON m.id = n_nationkey LEFT JOIN t ON t.id = n_nationkey),
f AS (SELECT id, name, CAST(model AS DOUBLE) AS model, CAST(target AS DOUBLE) * ((SELECT CAST(SUM(model) AS DOUBLE) FROM j) / (SELECT CAST(SUM(target) AS DOUBLE) FROM j)) AS target FROM j),
e AS (SELECT *, model - target AS diff, (model - target) / NULLIF(target, 0) AS perc FROM f)
SELECT id, name, CAST(CASE WHEN id = (SELECT MAX(id) FROM e) THEN 99 ELSE ROW_NUMBER() OVER (ORDER BY id) END AS INTEGER) AS short_label, CAST(model AS BIGINT) AS model, ROUND(target, 4) AS target, ROUND(diff, 4) AS diff, ROUND(perc, 5) AS perc_diff,
CASE WHEN diff >= 5000 THEN 'dodgerblue' WHEN diff >= 2000 THEN 'skyblue' WHEN diff <= -5000 THEN 'tomato' WHEN diff <= -2000 THEN 'lightsalmon' ELSE 'grey' END AS diff_colour,
CASE WHEN perc >= 0.25 THEN 'dodgerblue' WHEN perc >= 0.1 THEN 'skyblue' WHEN perc <= -0.25 THEN 'tomato' WHEN perc <= -0.1 THEN 'lightsalmon' ELSE 'grey' END AS perc_colour FROM e""",
        "convergence_errors": f"""WITH {SIDES}, j AS (SELECT t.id AS zone, CAST(m.v AS DOUBLE) AS model, CAST(t.v AS DOUBLE) AS target FROM t JOIN m ON m.id = t.id WHERE t.v > 1000),
f AS (SELECT zone, model, target * (SUM(model) OVER () / SUM(target) OVER ()) AS target FROM j) SELECT zone, 'jobs' AS col, ROUND(target, 4) AS target, ROUND((model - target) / target, 5) AS error FROM f""",
        "convergence_summary": f"""WITH {FLOWS}, t AS (SELECT d AS zone, SUM(value) AS target FROM flows GROUP BY 1), m AS (SELECT o AS zone, SUM(value) AS model FROM flows GROUP BY 1),
e AS (SELECT CAST(model AS DOUBLE) AS model, CAST(target AS DOUBLE) AS target, CAST(model AS DOUBLE) - target AS error FROM t JOIN m USING (zone) WHERE target > 1000)
SELECT 'jobs' AS col, ROUND(SUM(model), 4) AS model_sum, ROUND(SUM(target), 4) AS target_sum, COUNT(*) AS zones, ROUND(quantile_cont(error, 0.25), 4) AS q1, ROUND(quantile_cont(error, 0.5), 4) AS median, ROUND(quantile_cont(error, 0.75), 4) AS q3 FROM e HAVING COUNT(*) > 0""",
        "trumpet_categories": f"""WITH {FLOWS}, t AS (SELECT d AS id, CAST(SUM(value) AS BIGINT) AS cnt FROM flows GROUP BY 1), m AS (SELECT o AS id, CAST(SUM(value) AS BIGINT) AS model FROM flows GROUP BY 1)
SELECT t.id, r_name, cnt, model, model - cnt AS error, ROUND((model - cnt) / CAST(cnt AS DOUBLE), 5) AS perc_error FROM t LEFT JOIN m USING (id) JOIN nation ON t.id = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
        "tlfd_multi_labels": """SELECT CAST(b.i AS INTEGER) AS position, CAST(b.i * 4 AS VARCHAR) AS "from", CAST(b.i * 4 + 4 AS VARCHAR) AS "to", COUNT(l_quantity) AS value
FROM range(10) b(i) LEFT JOIN lineitem ON l_quantity BETWEEN 0 AND 40 AND LEAST(FLOOR(l_quantity / 4), 9) = b.i GROUP BY b.i""",
        "trumpet_points": f"WITH {SIDES} SELECT t.id, CAST(t.v AS BIGINT) AS cnt, CAST(m.v AS BIGINT) AS model, CAST(m.v - t.v AS BIGINT) AS error, ROUND(CAST(m.v - t.v AS DOUBLE) / CAST(t.v AS DOUBLE), 5) AS perc_error FROM t LEFT JOIN m ON m.id = t.id",
        "trumpet_curve": """WITH c AS (SELECT MAX(n) AS top FROM (SELECT COUNT(*) AS n FROM customer GROUP BY c_nationkey)), x AS (SELECT CAST(10 * i + 1 AS DOUBLE) AS x FROM range(100000) r(i), c WHERE 10 * i + 1 < top * 1.05)
SELECT x, ROUND((-13.7722 + 555.1382 * POW(x, -0.26025)) / 100, 6) AS upper, ROUND(-(-13.7722 + 555.1382 * POW(x, -0.26025)) / 100, 6) AS lower FROM x""",
        "matrix_file_round_trip": f"WITH {FLOWS} SELECT kind, COUNT(*) AS cells, CAST(SUM(value) AS BIGINT) AS total FROM flows, (VALUES ('mdf'), ('emx'), ('fortran')) t(kind) WHERE value <> 0 GROUP BY kind",
    } | file_queries.ORACLES
