"""Relational queries over lake tables: Spark's own operators on tables that are registered, not copied."""

from __future__ import annotations

from tarn.queries import relational as q

_LO = "lineitem orders"

# Projection and filters
q("project_expressions", "orders", "SELECT o_orderkey * 2 AS k2, o_totalprice / 2 AS half, concat(o_orderstatus, '-', o_orderpriority) AS label FROM orders")
q("star_except", "orders", "SELECT * EXCEPT (o_orderpriority, o_totalprice) FROM orders", "SELECT * EXCLUDE (o_orderpriority, o_totalprice) FROM orders")
q("filter_kinds", "orders", "SELECT o_orderkey FROM orders WHERE (o_totalprice BETWEEN 50000 AND 150000 AND o_orderstatus IN ('F', 'O')) OR o_orderpriority LIKE '1-%' AND o_orderpriority NOT LIKE '%LOW' AND o_custkey IS NOT NULL AND o_orderkey <> 5")
q("case_coalesce_nullif", "orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'F'), 'none') AS st FROM orders")

# Joins
q("join_inner", _LO, "SELECT l_orderkey, l_linenumber, l_quantity, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 250000")
q("join_left", "customer orders", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
q("join_right", "nation supplier", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
q("join_full", "customer supplier", "SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c FULL JOIN (SELECT * FROM supplier WHERE s_acctbal < 5000) s ON c_custkey = s_suppkey")
q("join_semi", "customer orders", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
q("join_anti", "customer orders", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey)")
q("join_cross", "region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation")
q("join_lateral", "customer orders", "SELECT c_custkey, m.top FROM customer c, LATERAL (SELECT max(o_totalprice) AS top FROM orders WHERE o_custkey = c.c_custkey) m")
q("join_theta", "region nation", "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON n_nationkey < r_regionkey * 4")
q("join_self_range", "supplier", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 2000")

# Aggregates
q("agg_basic", "orders", "SELECT o_orderstatus, count(*) AS n, count(o_custkey) AS c, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY o_orderstatus")
q("agg_distinct", "orders", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
q("agg_filter", "orders", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders")
q("agg_having", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15")
q("agg_group_by_all", "orders", "SELECT year(o_orderdate) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL", "SELECT CAST(year(o_orderdate) AS INT) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
q("agg_string", "nation", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
q("agg_statistics", "orders", "SELECT o_orderstatus, round(stddev_samp(o_totalprice), 3) AS sd, round(corr(o_totalprice, o_custkey), 6) AS r, round(percentile(o_totalprice, 0.5), 3) AS med FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(stddev_samp(o_totalprice), 3) AS sd, round(corr(o_totalprice, o_custkey), 6) AS r, round(quantile_cont(o_totalprice, 0.5), 3) AS med FROM orders GROUP BY o_orderstatus")
for _name, _by in (("cube", "CUBE (o_orderstatus, o_orderpriority)"), ("rollup", "ROLLUP (o_orderstatus, o_orderpriority)"), ("grouping_sets", "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")):
    q(_name, "orders", f"SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY {_by}")

# Windows
q("window_aggregate", "orders", "SELECT o_orderkey, count(*) OVER () AS every, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS of_customer FROM orders")
q("window_ranking", "orders", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
q("window_lead_lag", "orders", "SELECT o_orderkey, lead(o_orderkey) OVER w AS following, lag(o_orderkey, 2) OVER w AS second_before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
q("window_frames", "orders", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near FROM orders")

# Order, sets, subqueries
q("sort_limit_offset", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
q("union_all", "customer supplier", "SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier")
q("union_distinct", "customer supplier", "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
q("except_distinct", "nation supplier", "SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier")
q("except_all", "customer supplier", "SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
q("intersect_distinct", "customer supplier", "SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
q("subquery_scalar", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1.5 * (SELECT avg(o_totalprice) FROM orders)")
q("subquery_correlated", "orders", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")

# Table functions
q("table_functions", "region", "SELECT id AS n, r_name, part FROM range(0, 10, 3) CROSS JOIN region LATERAL VIEW explode(split(r_name, '_')) p AS part", "SELECT n, r_name, unnest(string_split(r_name, '_')) AS part FROM (SELECT range AS n FROM range(0, 10, 3)) CROSS JOIN region")

# Scalar functions
q("string_functions", "part", "SELECT p_partkey, length(p_name) AS len, lower(p_brand) AS lo, upper(p_type) AS up, substr(p_name, 2, 3) AS sub, replace(p_brand, '#', '-') AS rep, regexp_extract(p_brand, '([0-9]+)', 1) AS num, regexp_replace(p_name, '[aeiou]', '_') AS masked, concat(p_brand, '/', p_type) AS c FROM part", "SELECT p_partkey, length(p_name) AS len, lower(p_brand) AS lo, upper(p_type) AS up, substr(p_name, 2, 3) AS sub, replace(p_brand, '#', '-') AS rep, regexp_extract(p_brand, '([0-9]+)', 1) AS num, regexp_replace(p_name, '[aeiou]', '_', 'g') AS masked, concat(p_brand, '/', p_type) AS c FROM part")
q("date_functions", "orders", "SELECT o_orderkey, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, date_trunc('month', o_orderdate) AS month, o_orderdate + INTERVAL 3 DAY AS later, CAST(datediff(o_orderdate, DATE '1995-01-01') AS BIGINT) AS days FROM orders", "SELECT o_orderkey, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, date_trunc('month', o_orderdate) AS month, o_orderdate + INTERVAL 3 DAY AS later, date_diff('day', DATE '1995-01-01', o_orderdate) AS days FROM orders")
q("math_functions", "orders", "SELECT o_orderkey, round(o_totalprice, 1) AS r, floor(o_totalprice) AS f, ceil(o_totalprice) AS c, o_orderkey % 7 AS m, abs(o_custkey - 50) AS a, round(sqrt(o_totalprice), 4) AS s FROM orders", "SELECT o_orderkey, round(o_totalprice, 1) AS r, CAST(floor(o_totalprice) AS BIGINT) AS f, CAST(ceil(o_totalprice) AS BIGINT) AS c, o_orderkey % 7 AS m, abs(o_custkey - 50) AS a, round(sqrt(o_totalprice), 4) AS s FROM orders")
q("array_functions", "embeddings", "SELECT vec_id, size(embedding) AS n, round(embedding[0], 5) AS head, size(filter(embedding, x -> x > 0)) AS positive, round(aggregate(embedding, 0D, (s, x) -> s + x), 4) AS total FROM embeddings", "SELECT vec_id, len(embedding) AS n, round(embedding[1], 5) AS head, len(list_filter(embedding, lambda x: x > 0)) AS positive, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
q("array_explode", "embeddings", "SELECT vec_id, p, round(v, 5) AS v FROM embeddings LATERAL VIEW posexplode(embedding) e AS p, v WHERE p < 4", "SELECT vec_id, p, round(embedding[p + 1], 5) AS v FROM embeddings, (SELECT unnest(range(4)) AS p)")
q("json_functions", "events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
q("variant_functions", "events", "SELECT event_id, variant_get(parse_json(props), '$.k', 'bigint') AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
q("map_functions", "orders", "SELECT o_orderkey, map(o_orderstatus, o_totalprice)['F'] AS f, size(map_keys(map('a', 1, o_orderpriority, 2))) AS n FROM orders", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS f, 2 AS n FROM orders")

# Whole queries in the manner of TPC-H; products are summed as decimals, so that a rounded sum does not depend on the order of rows
q("tpch_q3", "customer orders lineitem", "SELECT l_orderkey, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))), 2) AS DOUBLE) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP_NTZ '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP_NTZ '1998-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10", "SELECT l_orderkey, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))), 2) AS DOUBLE) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10")
q("tpch_q5", "customer orders lineitem supplier nation region", "SELECT n_name, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))), 2) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
q("tpch_q6", "lineitem", "SELECT CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * CAST(l_discount AS DECIMAL(4, 2))), 2) AS DOUBLE) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
q("tpch_q9", "part supplier lineitem orders nation", "SELECT n_name, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))) - 0.1 * CAST(l_quantity AS DECIMAL(12, 2))), 2) AS DOUBLE) AS profit FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_size > 10 GROUP BY n_name, year(o_orderdate)")
q("tpch_q18", "customer orders lineitem", "SELECT c_name, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY c_name, o_orderkey, o_totalprice")
q("clickbench_like", "events", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS a, round(max(value), 4) AS m FROM events WHERE value > 1 AND props LIKE '%k%' GROUP BY event_type")
