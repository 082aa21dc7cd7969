"""Operator queries whose one SQL text runs on Spark (through the dialect) and on the oracle."""

from __future__ import annotations

QUERIES: dict[str, str] = {
    # scans
    "scan_full": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "scan_projection": "SELECT l_orderkey, l_quantity FROM lineitem",
    "scan_filter_int": "SELECT p_partkey, p_size FROM part WHERE p_size = 15",
    "scan_filter_double": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice >= 50000.0",
    "scan_filter_string": "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'",
    "scan_filter_timestamp": "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00'",
    "scan_filter_and": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 20 AND l_linestatus = 'O' AND l_partkey <> 7",
    "scan_filter_decimal": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(l_extendedprice AS DECIMAL(15, 2)) BETWEEN CAST(10000.50 AS DECIMAL(15, 2)) AND CAST(20000.25 AS DECIMAL(15, 2)) AND CAST(-l_tax AS DECIMAL(15, 2)) <= CAST(-0.02 AS DECIMAL(15, 2))",
    "scan_filter_float": "SELECT event_id FROM events WHERE CAST(value AS FLOAT) > CAST(75.5 AS FLOAT)",
    "scan_is_not_null": "SELECT event_id FROM events WHERE props IS NOT NULL AND value > 50",
    "empty_result": "SELECT n_nationkey, n_name FROM nation WHERE 1 = 0",
    "dummy_scan": "SELECT CAST(1 AS INT) AS one, 'x' AS label",
    "values_scan": "SELECT a, b FROM (VALUES (CAST(1 AS BIGINT), 'one'), (2, 'two'), (3, NULL)) AS t(a, b)",
    # expressions
    "compare_all_ops": "SELECT l_orderkey, l_linenumber, l_tax = l_discount AS eq, l_tax <> l_discount AS ne, l_tax < l_discount AS lt, l_tax <= l_discount AS le, l_tax > l_discount AS gt, l_tax >= l_discount AS ge FROM lineitem",
    "between": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07",
    "and_or_not": "SELECT p_partkey FROM part WHERE (p_size < 5 OR p_size > 45) AND NOT p_type = 'PROMO'",
    "is_null": "SELECT k, v IS NULL AS missing, v IS NOT NULL AS present FROM (VALUES (10, CAST(NULL AS BIGINT)), (20, 7), (30, NULL), (40, 0)) AS t(k, v)",
    "null_comparison": "SELECT b, a = 3 AS is_three FROM (VALUES (CAST(3 AS BIGINT), 1), (NULL, 2), (4, 3)) AS t(a, b)",
    "in_const_int": "SELECT p_partkey FROM part WHERE p_size IN (1, 14, 23)",
    "in_const_string": "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "not_in_const": "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 14, 23)",
    "in_expr": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (l_quantity, l_suppkey - 1, 3)",
    "case_when": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "cast_numeric": "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) AS as_long, CAST(l_linenumber AS DOUBLE) AS as_double, CAST(l_quantity AS INT) AS as_int, CAST(CAST(l_extendedprice AS DECIMAL(15, 2)) AS DOUBLE) AS as_decimal FROM lineitem",
    "cast_string": "SELECT p_partkey, CAST(p_size AS VARCHAR(10)) AS size_text, CAST('42' AS INT) AS parsed FROM part",
    "cast_date": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS day, CAST('1997-03-01' AS DATE) < CAST(o_orderdate AS DATE) AS later FROM orders",
    "cast_decimal": "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) * CAST(l_discount AS DECIMAL(4, 2)) AS VARCHAR(30)) AS product FROM lineitem",
    "coalesce": "SELECT b, coalesce(a, 0) AS filled FROM (VALUES (CAST(3 AS BIGINT), 1), (NULL, 2)) AS t(a, b)",
    "distinct_from": "SELECT a, b, a IS DISTINCT FROM b AS differs, a IS NOT DISTINCT FROM b AS same FROM (VALUES (1, 1), (1, 2), (NULL, 1), (CAST(NULL AS INT), CAST(NULL AS INT))) AS t(a, b)",
    "negative_bigint": "SELECT min(a) AS low, max(a) AS high, count(CASE WHEN a = -1 THEN 1 END) AS minus_one FROM (VALUES (CAST(-1 AS BIGINT)), (5), (-9000000000)) AS t(a)",
    # functions
    "arith": "SELECT l_orderkey, l_linenumber, l_quantity + 1 AS plus, l_quantity - l_tax AS minus, l_extendedprice * l_discount AS times, l_extendedprice / nullif(l_quantity, 0) AS ratio FROM lineitem",
    "int_div": "SELECT l_orderkey, l_linenumber, CAST(l_orderkey // 7 AS BIGINT) AS q, CAST(-l_orderkey // 7 AS BIGINT) AS negative FROM lineitem",
    "modulo": "SELECT l_orderkey, l_linenumber, l_orderkey % 7 AS r, -l_orderkey % 7 AS negative FROM lineitem",
    "substring": "SELECT c_custkey, substring(c_name, 1, 4) AS head, substr(c_name, 5, 3) AS middle FROM customer",
    "like": "SELECT p_partkey FROM part WHERE p_name LIKE '%red%'",
    "not_like": "SELECT p_partkey FROM part WHERE p_name NOT LIKE 'red%'",
    "like_multi_term": "SELECT p_partkey FROM part WHERE p_name LIKE '%r_d%w%t'",
    "contains": "SELECT p_partkey, contains(p_name, 'green') AS hit FROM part",
    "prefix": "SELECT p_partkey FROM part WHERE prefix(p_name, 'red')",
    "suffix": "SELECT p_partkey FROM part WHERE suffix(p_name, 'widget')",
    "year_month_day": "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d FROM orders",
    "string_functions": "SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, length(c_name) AS n, concat(c_mktsegment, '-', c_name) AS joined, trim('  x ') AS trimmed, replace(c_name, '0', 'o') AS swapped FROM customer",
    "math_functions": "SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, floor(l_tax * 100) * 1.0e0 AS f, ceil(l_quantity / 3) * 1.0e0 AS c, sqrt(l_quantity) AS s FROM lineitem",
    "math_power_round": "SELECT l_orderkey, l_linenumber, power(l_quantity, 2) AS p, round(l_quantity / 8, 1) AS r, sign(l_discount - l_tax) * 1.0e0 AS s FROM lineitem WHERE l_quantity < 9",
    "error_untaken": "SELECT n_nationkey, CASE WHEN n_nationkey < 0 THEN error('negative key') ELSE n_name END AS name FROM nation",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_inner_multikey": "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
    "join_inner_three_keys": "SELECT a.o_orderkey, b.o_orderkey AS other FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey < b.o_orderkey",
    "join_inner_decimal_key": "SELECT a.l_orderkey, a.l_linenumber, b.n FROM (SELECT l_orderkey, l_linenumber, CAST(l_discount AS DECIMAL(4, 2)) AS d FROM lineitem) a JOIN (SELECT CAST(l_tax AS DECIMAL(4, 2)) AS d, count(*) AS n FROM lineitem GROUP BY 1) b ON a.d = b.d",
    "join_inner_string_key": "SELECT a.r_regionkey AS k, b.r_name AS n FROM region a JOIN region b ON a.r_name = b.r_name",
    "join_inner_residual": "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_extendedprice < o_totalprice / 10",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 400000",
    "join_full": "SELECT a.n_name AS left_name, b.n_name AS right_name FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 9) b ON a.n_nationkey = b.n_nationkey",
    "join_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    "join_semi_residual_ne": "SELECT l1.l_orderkey, l1.l_linenumber FROM lineitem l1 WHERE EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)",
    "join_mark_or": "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
    "join_not_in_null": "SELECT r_regionkey FROM region WHERE r_regionkey NOT IN (SELECT a FROM (VALUES (CAST(1 AS INT)), (NULL)) AS t(a))",
    "join_null_safe": "SELECT a.k AS ak, b.k AS bk FROM (VALUES (1), (CAST(NULL AS INT)), (-1)) AS a(k) JOIN (VALUES (1), (CAST(NULL AS INT)), (-1)) AS b(k) ON a.k IS NOT DISTINCT FROM b.k",
    "join_null_keys": "SELECT a.k AS ak, b.k AS bk FROM (VALUES (1), (CAST(NULL AS INT)), (-1)) AS a(k) JOIN (VALUES (1), (CAST(NULL AS INT)), (-1)) AS b(k) ON a.k = b.k",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_scalar_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "join_exists": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > l_tax)",
    "join_not_exists": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > l_tax)",
    "join_semi_theta": "SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey > n_regionkey AND r_name < n_name)",
    "join_anti_theta": "SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey > n_regionkey)",
    "join_left_theta": "SELECT r_name, n_name FROM region LEFT JOIN nation ON r_regionkey * 6 < n_nationkey AND n_regionkey <> r_regionkey",
    "join_full_theta": "SELECT a.r_name AS low, b.r_name AS high FROM region a FULL JOIN region b ON a.r_regionkey + 2 < b.r_regionkey",
    "join_mark_theta": "SELECT n_nationkey, EXISTS (SELECT 1 FROM region WHERE r_regionkey > n_regionkey) AS hit FROM nation",
    "join_tiny_left": "SELECT w.colour, h.tool FROM (VALUES ('red', 1), ('green', 2), ('blue', 4)) AS w(colour, shelf) LEFT JOIN (VALUES ('saw', 1), ('file', 1), ('drill', 2), ('lathe', 9)) AS h(tool, shelf) ON w.shelf = h.shelf",
    # aggregates
    "agg_ungrouped": "SELECT sum(l_quantity) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n FROM lineitem",
    "agg_grouped_multi": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_string_keys": "SELECT p_brand, p_type, count(*) AS n, sum(CAST(p_size AS BIGINT)) * 1.0e0 AS sizes FROM part GROUP BY p_brand, p_type",
    "agg_minmax": "SELECT c_nationkey, min(c_name) AS first_name, max(c_name) AS last_name, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY c_nationkey",
    "agg_avg": "SELECT o_orderstatus, avg(CAST(o_custkey AS DOUBLE)) AS a FROM orders GROUP BY o_orderstatus",
    "agg_avg_decimal": "SELECT l_linestatus, avg(CAST(CAST(l_quantity AS DECIMAL(15, 2)) AS DOUBLE)) AS a FROM lineitem GROUP BY l_linestatus",
    "agg_count_nulls": "SELECT count(*) AS n, count(a) AS known FROM (VALUES (CAST(3 AS BIGINT)), (NULL), (4), (NULL)) AS t(a)",
    "agg_count_distinct": "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey",
    "agg_count_distinct_ungrouped": "SELECT count(DISTINCT o_custkey) AS n FROM orders",
    "agg_mixed_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus",
    "agg_filter": "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS big, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "agg_having": "SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250",
    "agg_empty_input": "SELECT sum(l_quantity) AS s, min(l_quantity) AS lo, avg(l_quantity) AS a, count(*) AS n FROM lineitem WHERE l_quantity < 0",
    "agg_null_key": "SELECT a, count(*) AS n FROM (VALUES (CAST(NULL AS BIGINT)), (NULL), (1)) AS t(a) GROUP BY a",
    "agg_first": "SELECT o_orderkey, first(o_totalprice) AS price FROM orders GROUP BY o_orderkey",
    "agg_first_ungrouped": "SELECT first(r_name) AS name, any_value(r_regionkey) AS k FROM region WHERE r_regionkey = 2",
    "agg_max_by": "SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS last_price, min_by(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY o_custkey",
    "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "rollup": "SELECT n_regionkey, n_name, count(*) AS n, CAST(grouping(n_name) AS INT) AS g FROM nation GROUP BY ROLLUP (n_regionkey, n_name)",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    # order and limits
    "sort_asc_desc": "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_orderstatus ASC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey",
    "sort_nulls": "SELECT a FROM (VALUES (CAST(2 AS INT)), (NULL), (1)) AS t(a) ORDER BY a DESC NULLS FIRST LIMIT 2",
    "sort_default_nulls": "SELECT a, b FROM (VALUES (CAST(2 AS INT), 1), (NULL, 2), (1, 3), (NULL, 4)) AS t(a, b) ORDER BY a DESC, b LIMIT 3",
    "window_default_nulls": "SELECT a, row_number() OVER (ORDER BY a) * 1.0e0 AS up, row_number() OVER (ORDER BY a DESC) * 1.0e0 AS down FROM (VALUES (CAST(2 AS INT)), (NULL), (1)) AS t(a)",
    "topn": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST LIMIT 25",
    "topn_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST LIMIT 25 OFFSET 10",
    "limit_total_order": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 100",
    "limit_zero": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 0",
    # sets, common tables, subqueries
    "union_all": "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer",
    "union_distinct": "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer",
    "intersect": "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer",
    "except": "SELECT p_size AS k FROM part EXCEPT SELECT p_size FROM part WHERE p_retailprice > 1000 OR p_size < 30",
    "except_all": "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region",
    "intersect_all": "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT n_regionkey FROM nation WHERE n_nationkey < 12",
    "cte_shared": "WITH s AS MATERIALIZED (SELECT l_suppkey AS k, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey) SELECT a.k, a.q FROM s a WHERE a.q >= (SELECT avg(q) FROM s)",
    "cte_recursive": "WITH RECURSIVE t(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 50) SELECT n, total FROM t",
    "subquery_uncorrelated": "SELECT n_name FROM nation WHERE n_regionkey = (SELECT min(r_regionkey) FROM region WHERE r_name = 'ASIA')",
    # windows
    "row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) * 1.0e0 AS rn FROM orders",
    "rank_dense": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) * 1.0e0 AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) * 1.0e0 AS d FROM part",
    "percent_rank": "SELECT p_partkey, percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS p, cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size) AS c FROM part",
    "lag_lead": "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders",
    "running_sum": "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM lineitem",
    "moving_avg": "SELECT l_orderkey, l_linenumber, avg(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS q FROM lineitem",
    "range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS n FROM part",
    "ntile": "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) * 1.0e0 AS quarter FROM customer",
    "first_last_value": "SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS second FROM orders",
}
