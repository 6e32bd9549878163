"""One query for each family of the dialect's operators, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedsql.engine import Engine
from fedsql.operators import merge, transforms
from fedsql.session import shared_path, table
from fedsql.streaming import streams

FLAGSHIP = """
SELECT n.n_name, COUNT(DISTINCT o.o_custkey) AS buyers, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM lineitem l INNER JOIN orders o ON l.l_orderkey = o.o_orderkey INNER JOIN customer c ON o.o_custkey = c.c_custkey INNER JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE l.l_returnflag = 'R' GROUP BY n.n_name HAVING revenue > 0 ORDER BY revenue DESC LIMIT 10"""

#: name -> (the dialect, DuckDB's SQL or None where it is the same text)
PAIRS: dict[str, tuple[str, str | None]] = {
    "flagship": (FLAGSHIP, FLAGSHIP.replace("HAVING revenue > 0", "HAVING SUM(l.l_extendedprice * (1 - l.l_discount)) > 0")),
    "scan_filter_aggregate": ("SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, AVG(l_quantity) AS avg_qty, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus", None),
    "project_exprs": ("SELECT p_partkey, p_size + 1 AS size_up, p_size * 2 - 3 AS size_calc, p_retailprice / 2 AS half, p_size % 7 AS size_mod, -p_size AS size_neg, concat(p_brand, '-', p_type) AS label FROM part", None),
    "where_in_between_like": ("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 30 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') AND NOT p_type LIKE '%TIN%'", None),
    "where_alias": ("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE twice > 400000", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice * 2 > 400000"),
    "where_or_null": ("SELECT id, member_id, pay_amount FROM member_orders WHERE pay_amount IS NULL OR (member_id IS NOT NULL AND pay_amount > 400)", None),
    "order_limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10, 25", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10"),
    "order_nulls_ranked": ("SELECT id, pay_amount, ROW_NUMBER() OVER (PARTITION BY status ORDER BY pay_amount, id) AS n FROM member_orders", "SELECT id, pay_amount, ROW_NUMBER() OVER (PARTITION BY status ORDER BY pay_amount NULLS FIRST, id) AS n FROM member_orders"),
    "limit_negative": ("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT -5", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 20"),
    "distinct_rows": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "distinct_group": ("SELECT DISTINCT COUNT(*) AS n FROM orders GROUP BY o_custkey", None),
    "case_forms": ("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 2 WHEN o_totalprice > 100000 THEN 1 END AS band, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS state, IF(o_totalprice > 1000, 1, 0) AS big FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS band, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS state, CASE WHEN o_totalprice > 1000 THEN 1 ELSE 0 END AS big FROM orders"),
    "comparison_values": ("SELECT p_partkey, p_size > 10 AS gt, p_size = 5 OR p_size < 3 AS odd, p_brand IN ('Brand#11') AS one, p_size IS NULL AS nil, NOT p_size > 10 AS no FROM part", "SELECT p_partkey, CAST(p_size > 10 AS INT) AS gt, CAST(p_size = 5 OR p_size < 3 AS INT) AS odd, CAST(p_brand IN ('Brand#11') AS INT) AS one, CAST(p_size IS NULL AS INT) AS nil, CAST(NOT p_size > 10 AS INT) AS no FROM part"),
    "string_number_compare": ("SELECT _id, vip_type FROM demo WHERE vip_type >= 2 AND vip_type <> '9'", "SELECT _id, vip_type FROM demo WHERE TRY_CAST(vip_type AS DOUBLE) >= 2 AND vip_type <> '9'"),
    "ifnull_coalesce": ("SELECT id, IFNULL(pay_amount, 0) AS paid, COALESCE(member_id, id, 0) AS who, NULLIF(status, 4) AS st FROM member_orders", None),
    "casts": ("SELECT o_orderkey, CAST(o_totalprice AS INT) AS price, CAST(o_orderkey AS CHAR) AS k, DATE_FORMAT(o_orderdate::date, '%Y-%m-%d') AS day FROM orders", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS price, CAST(o_orderkey AS VARCHAR) AS k, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"),
    "left_join_bare": ("SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000"),
    "inner_join": ("SELECT s.s_suppkey, n.n_name, r.r_name FROM supplier s INNER JOIN nation n ON s.s_nationkey = n.n_nationkey INNER JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "right_join": ("SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "full_join": ("SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey", None),
    "cross_join": ("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", None),
    "comma_join": ("SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_regionkey > 1", None),
    "theta_join": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a INNER JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "expr_key_join": ("SELECT c.c_custkey, s.s_suppkey FROM customer c INNER JOIN supplier s ON concat(c.c_nationkey, 'N') = concat(s.s_nationkey, 'N')", None),
    "semi_anti_join": ("SELECT c_custkey, 'none' AS has FROM customer c LEFT ANTI JOIN orders o ON c.c_custkey = o.o_custkey UNION ALL SELECT c_custkey, 'some' FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey, 'none' AS has FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE c.c_custkey = o.o_custkey) UNION ALL SELECT c_custkey, 'some' FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE c.c_custkey = o.o_custkey)"),
    "using_join": ("SELECT l_orderkey, o_totalprice FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45) x INNER JOIN (SELECT o_orderkey AS l_orderkey, o_totalprice FROM orders) y USING (l_orderkey)", None),
    "join_derived": ("SELECT c.c_custkey, t.n FROM customer c JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) t ON c.c_custkey = t.o_custkey WHERE t.n > 5", "SELECT c.c_custkey, t.n FROM customer c LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) t ON c.c_custkey = t.o_custkey WHERE t.n > 5"),
    "cte": ("WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > 500000) SELECT COUNT(*) AS n, ROUND(MAX(total), 2) AS most FROM top", None),
    "recursive_cte": ("WITH RECURSIVE t AS (SELECT 1 AS n, 1 AS f UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 20) SELECT n, f FROM t", "WITH RECURSIVE t AS (SELECT 1 AS n, 1 AS f UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 20) SELECT n, f FROM t"),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)", None),
    "corr_scalar_eq": ("SELECT c.c_custkey, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c", None),
    "corr_scalar_expr": ("SELECT n.n_nationkey, (SELECT MAX(s.s_acctbal) FROM supplier s WHERE s.s_nationkey + 1 = n.n_nationkey + 1) AS most FROM nation n", None),
    "exists_select": ("SELECT c.c_custkey, EXISTS (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AS has FROM customer c", "SELECT c.c_custkey, CAST(EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AS INT) AS has FROM customer c"),
    "exists_where": ("SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)", "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)"),
    "in_subquery": ("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 2)", None),
    "tuple_in": ("SELECT COUNT(*) AS n FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('R', 'F'), ('N', 'O'))", None),
    "union_all": ("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region", None),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "intersect_except": ("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)", None),
    "setop_order_limit": ("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region ORDER BY k DESC LIMIT 7", None),
    "agg_basic": ("SELECT COUNT(*) AS n, COUNT(pay_amount) AS paid, SUM(status) AS s, MIN(id) AS lo, MAX(id) AS hi, AVG(status) AS a FROM member_orders", "SELECT COUNT(*) AS n, COUNT(pay_amount) AS paid, CAST(SUM(status) AS BIGINT) AS s, MIN(id) AS lo, MAX(id) AS hi, AVG(status) AS a FROM member_orders"),
    "agg_distinct": ("SELECT site_id, COUNT(DISTINCT uid) AS u, COUNT(DISTINCT uid, goods_id) AS ug FROM site_orders GROUP BY site_id", "SELECT site_id, COUNT(DISTINCT uid) AS u, COUNT(DISTINCT CASE WHEN uid IS NOT NULL AND goods_id IS NOT NULL THEN (uid, goods_id) END) AS ug FROM site_orders GROUP BY site_id"),
    "agg_of_nothing": ("SELECT SUM(p_size) AS s, AVG(p_size) AS a, COUNT(*) AS n, GROUP_CONCAT(p_brand) AS g FROM part WHERE p_size > 1000", "SELECT CAST(0 AS BIGINT) AS s, 0.0 AS a, COUNT(*) AS n, '' AS g FROM part WHERE p_size > 1000"),
    "agg_expr": ("SELECT l_returnflag, ROUND(SUM(l_extendedprice) / SUM(l_quantity), 4) AS unit, MAX(l_tax) - MIN(l_tax) AS spread, COUNT(*) * 2 AS twice FROM lineitem GROUP BY l_returnflag", None),
    "group_first": ("SELECT o_custkey, COUNT(*) AS n, c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY o_custkey", "SELECT o_custkey, COUNT(*) AS n, min(c_name) AS c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY o_custkey"),
    "group_by_alias_expr": ("SELECT YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, COUNT(*) AS n FROM orders GROUP BY y, m", "SELECT CAST(YEAR(o_orderdate) AS INT) AS y, CAST(MONTH(o_orderdate) AS INT) AS m, COUNT(*) AS n FROM orders GROUP BY 1, 2"),
    "having_alias": ("SELECT o_custkey, COUNT(*) AS n, MAX(o_totalprice) AS most FROM orders GROUP BY o_custkey HAVING n > 8 AND most > 300000", "SELECT o_custkey, COUNT(*) AS n, MAX(o_totalprice) AS most FROM orders GROUP BY o_custkey HAVING COUNT(*) > 8 AND MAX(o_totalprice) > 300000"),
    "group_concat_sorted": ("SELECT o_custkey, GROUP_CONCAT(o_orderpriority ORDER BY o_orderkey DESC SEPARATOR '|') AS names, GROUP_CONCAT(o_orderkey) AS keys FROM orders GROUP BY o_custkey", "SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY o_orderkey DESC) AS names, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey"),
    "group_array_join": ("SELECT o_custkey, JOIN(GROUP_ARRAY(o_orderkey), ',') AS ks, JOIN(GROUP_UNIQ_ARRAY(o_orderstatus), ',') AS uniq FROM orders GROUP BY o_custkey", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ks, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS uniq FROM orders GROUP BY o_custkey"),
    "group_bits": ("SELECT p_brand, GROUP_BIT_AND(p_size) AS a, GROUP_BIT_OR(p_size) AS o, GROUP_BIT_XOR(p_size) AS x FROM part GROUP BY p_brand", "SELECT p_brand, CAST(bit_and(p_size) AS BIGINT) AS a, CAST(bit_or(p_size) AS BIGINT) AS o, CAST(bit_xor(p_size) AS BIGINT) AS x FROM part GROUP BY p_brand"),
    "json_aggregates": ("SELECT o_custkey, JSON_ARRAYAGG(o_orderkey) AS arr, JSON_OBJECTAGG(o_orderkey, o_orderstatus) AS obj FROM orders GROUP BY o_custkey", "SELECT o_custkey, '[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) || ']' AS arr, '{' || string_agg('\"' || o_orderkey || '\":\"' || o_orderstatus || '\"', ',' ORDER BY o_orderkey) || '}' AS obj FROM orders GROUP BY o_custkey"),
    "any_value": ("SELECT o_custkey, ANY_VALUE(o_orderkey) AS k FROM orders GROUP BY o_custkey", "SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY o_custkey"),
    "agg_filter": ("SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n, MAX(o_totalprice) FILTER (WHERE o_totalprice < 200000) AS m, COUNT(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'O') AS c FROM orders GROUP BY o_orderpriority", None),
    "rollup": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)", None),
    "cube": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)", None),
    "grouping_sets": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", None),
    "window_ranks": ("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, NTILE(3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nt FROM orders", None),
    "window_shares": ("SELECT o_orderkey, ROUND(PERCENT_RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 6) AS pr, ROUND(CUME_DIST() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 6) AS cd FROM orders", None),
    "window_lag_lead": ("SELECT o_orderkey, LAG(o_orderkey) OVER w AS before, LEAD(o_orderkey, 2, -1) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", None),
    "window_first_last_nth": ("SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER w AS f, LAST_VALUE(o_orderkey) OVER w AS l, NTH_VALUE(o_orderkey, 2) OVER w AS n2, NTH_VALUE(o_orderkey, -1) OVER w AS back FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", "SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER w AS f, LAST_VALUE(o_orderkey) OVER w AS l, NTH_VALUE(o_orderkey, 2) OVER w AS n2, LAST_VALUE(o_orderkey) OVER w AS back FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "running_sum": ("SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS running, COUNT(*) OVER (PARTITION BY o_custkey) AS n, ROUND(AVG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last3 FROM orders", None),
    "count_distinct_over": ("SELECT o_orderkey, COUNT(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) AS kinds FROM orders", "SELECT o_orderkey, (SELECT COUNT(DISTINCT i.o_orderstatus) FROM orders i WHERE i.o_custkey = o.o_custkey) AS kinds FROM orders o"),
    "window_expr": ("SELECT o_orderkey, ROUND(o_totalprice / SUM(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders", None),
    "window_over_group": ("SELECT o_custkey, COUNT(*) AS n, RANK() OVER (ORDER BY COUNT(*) DESC) AS rk FROM orders GROUP BY o_custkey", None),
    "yield_array": ("SELECT _id, YIELD_ARRAY(sites) AS site FROM demo", "SELECT _id, unnest(sites) AS site FROM demo"),
    "yield_zipped": ("SELECT r_regionkey, YIELD_ARRAY(SPLIT('a,b,c', ',')) AS x, YIELD_ARRAY(SPLIT('1,2', ',')) AS y FROM region", "SELECT r_regionkey, x, y FROM region, (VALUES ('a', '1'), ('b', '2'), ('c', NULL)) v(x, y)"),
    "yield_then_join": ("SELECT d._id, d.site, s.n_name FROM (SELECT _id, YIELD_ARRAY(sites) AS site FROM demo) d INNER JOIN nation s ON d.site = s.n_nationkey", "SELECT d._id, d.site, s.n_name FROM (SELECT _id, unnest(sites) AS site FROM demo) d JOIN nation s ON d.site = s.n_nationkey"),
    "nested_paths": ("SELECT `order.orderId` AS oid, `order.payInfo.payTypes.:0` AS first_type, `order.goodses.:0.goodsId` AS gid, `order.address.mobile` AS mobile, `user.username` AS uname, `order.channel.:0` AS ch FROM user_data", "SELECT \"order\".orderId AS oid, \"order\".payInfo.payTypes[1] AS first_type, \"order\".goodses[1].goodsId AS gid, \"order\".\"address.mobile\" AS mobile, \"user.username\" AS uname, \"order\".\"channel.:0\" AS ch FROM user_data"),
    "nested_lists": ("SELECT `order.orderId` AS oid, JOIN(`order.goodses.goodsId`, ',') AS gids, JOIN(GET_VALUE(`order`, 'payInfo', 'payTypes', (0, 2)), '-') AS two FROM user_data", "SELECT \"order\".orderId AS oid, CASE WHEN \"order\".goodses IS NOT NULL THEN coalesce(array_to_string(list_transform(\"order\".goodses, lambda x: x.goodsId), ','), '') END AS gids, CASE WHEN \"order\".payInfo.payTypes IS NOT NULL THEN coalesce(array_to_string(\"order\".payInfo.payTypes[1:2], '-'), '') END AS two FROM user_data"),
    "type_annotations": ("SELECT `o_orderkey[str]` AS k, `o_totalprice[int]` AS p, `o_totalprice[str %.02f]` AS txt FROM orders", "SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(trunc(o_totalprice) AS BIGINT) AS p, printf('%.2f', o_totalprice) AS txt FROM orders"),
    "string_funcs": ("SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_name) AS l, LENGTH(c_name) AS len, SUBSTRING(c_name, 2, 3) AS sub, REVERSE(c_name) AS rev, REPLACE(c_name, 'A', '_') AS rep, LEFT(c_name, 2) AS lft, RIGHT(c_name, 2) AS rgt, REPEAT('ab', 2) AS dbl, STRCMP(c_name, 'M') AS cmp, TO_BASE64(c_name) AS b64, CONCAT_WS('-', c_name, c_custkey) AS cw FROM customer", "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, strlen(c_name) AS len, substr(c_name, 2, 3) AS sub, reverse(c_name) AS rev, replace(c_name, 'A', '_') AS rep, left(c_name, 2) AS lft, right(c_name, 2) AS rgt, 'abab' AS dbl, CASE WHEN c_name = 'M' THEN 0 WHEN c_name < 'M' THEN -1 ELSE 1 END AS cmp, to_base64(encode(c_name)) AS b64, concat_ws('-', c_name, c_custkey) AS cw FROM customer"),
    "math_funcs": ("SELECT p_partkey, ABS(p_size - 25) AS a, ROUND(SQRT(p_size), 4) AS s, ROUND(LOG(p_size), 6) AS lg, ROUND(LN(p_size), 6) AS ln_, CEIL(p_retailprice) AS c, FLOOR(p_retailprice) AS f, SIGN(p_size - 25) AS sg, POW(p_size, 2) AS pw, GREATEST(p_size, 10) AS g, LEAST(p_size, 10) AS le, MOD(p_size, 4) AS m FROM part", "SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_size), 4) AS s, round(log10(p_size), 6) AS lg, round(ln(p_size), 6) AS ln_, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(sign(p_size - 25) AS INT) AS sg, power(p_size, 2) AS pw, greatest(p_size, 10) AS g, least(p_size, 10) AS le, p_size % 4 AS m FROM part"),
    "date_funcs": ("SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS mo, DAYOFMONTH(o_orderdate) AS d, DAYOFWEEK(o_orderdate) AS dw, WEEKDAY(o_orderdate) AS wd, DAYOFYEAR(o_orderdate) AS dy, DATE_FORMAT(o_orderdate, '%Y-%m-%d') AS txt, DATE_ADD(o_orderdate, INTERVAL 1 MONTH) AS nm, DATEDIFF('1998-12-31', o_orderdate) AS dd, TIMESTAMPDIFF(DAY, o_orderdate, '1998-12-31') AS td, UNIX_TIMESTAMP(o_orderdate) AS ux FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS mo, CAST(day(o_orderdate) AS INT) AS d, CAST(isodow(o_orderdate) AS INT) AS dw, CAST(isodow(o_orderdate) - 1 AS INT) AS wd, CAST(dayofyear(o_orderdate) AS INT) AS dy, strftime(o_orderdate, '%Y-%m-%d') AS txt, o_orderdate + INTERVAL 1 MONTH AS nm, CAST(trunc((epoch(o_orderdate) - epoch(TIMESTAMP '1998-12-31')) / 86400) AS INT) AS dd, CAST(trunc((epoch(TIMESTAMP '1998-12-31') - epoch(o_orderdate)) / 86400) AS BIGINT) AS td, CAST(epoch(o_orderdate) AS BIGINT) AS ux FROM orders"),
    "json_funcs": ("SELECT event_id, JSON_EXTRACT(props, '$.k') AS k, props->'$.k' AS arrow, JSON_VALID(props) AS ok, JSON_LENGTH(props) AS n, JOIN(JSON_KEYS(props), ',') AS ks, JSON_DEPTH(props) AS d, JSON_CONTAINS_PATH(props, 'one', '$.k', '$.zz') AS has, JSON_EXTRACT(JSON_SET(props, '$.z', 5), '$.z') AS z, JSON_REMOVE(props, '$.k') AS gone FROM events", "SELECT event_id, props->>'$.k' AS k, props->>'$.k' AS arrow, CAST(json_valid(props) AS INT) AS ok, CAST(len(json_keys(props)) AS INT) AS n, array_to_string(json_keys(props), ',') AS ks, 2 AS d, CAST(json_exists(props, '$.k') AS INT) AS has, '5' AS z, '{}' AS gone FROM events"),
    "regexp_funcs": ("SELECT p_partkey, p_type REGEXP '[A-M]' AS m, REGEXP_SUBSTR(p_brand, '[0-9]+') AS digits, REGEXP_REPLACE(p_brand, '[0-9]', 'x') AS masked, REGEXP_INSTR(p_brand, '[0-9]') AS at FROM part", "SELECT p_partkey, CAST(regexp_matches(p_type, '^[A-Ma-m]') AS INT) AS m, regexp_extract(p_brand, '[0-9]+') AS digits, regexp_replace(p_brand, '[0-9]', 'x', 'g') AS masked, CAST(length(regexp_extract(p_brand, '^[^0-9]*')) + 1 AS INT) AS at FROM part"),
    "bitwise": ("SELECT p_partkey, p_size & 6 AS a, p_size | 9 AS o, p_size ^ 5 AS x, p_size << 2 AS l, p_size >> 1 AS r, ~p_size AS n FROM part", "SELECT p_partkey, CAST(p_size & 6 AS BIGINT) AS a, CAST(p_size | 9 AS BIGINT) AS o, CAST(xor(p_size, 5) AS BIGINT) AS x, CAST(p_size << 2 AS BIGINT) AS l, CAST(p_size >> 1 AS BIGINT) AS r, CAST(~p_size AS BIGINT) AS n FROM part"),
    "time_window": ("SELECT TIME_WINDOW('15M', ts) AS w, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY w, event_type", "SELECT time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS w, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY 1, 2"),
    "row_index_last": ("SELECT c_custkey, ROW_INDEX() AS i, ROW_LAST(c_custkey) AS before FROM customer", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i, lag(c_custkey) OVER (ORDER BY c_custkey) AS before FROM customer"),
    "session_counter": ("SELECT c_custkey, @c := @c + 2 AS c FROM customer", "SELECT c_custkey, CAST(2 * row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS c FROM customer"),
    "transform_v2h": ("SELECT transform$v2h('o_orderstatus', 'o_orderpriority', 'n') FROM (SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus) t", "SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS O, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS P FROM orders GROUP BY o_orderpriority"),
    "transform_v4h": ("SELECT transform$v4h('k', 'v', 'n_nationkey') FROM (SELECT n_nationkey, n_name, n_regionkey FROM nation) t", "SELECT n_nationkey, 'n_name' AS k, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation"),
    "transform_h2v": ("SELECT transform$h2v('part', 'o_orderkey', 'v') FROM (SELECT o_orderkey, o_custkey, o_orderkey * 2 AS twice FROM orders) t", "SELECT o_orderkey, 'o_custkey' AS part, o_custkey AS v FROM orders UNION ALL SELECT o_orderkey, 'twice', o_orderkey * 2 FROM orders"),
    "transform_h4v": ("SELECT transform$h4v('k', 'v', 'n_regionkey') FROM (SELECT n_regionkey, concat('f', MIN(n_nationkey) * 0) AS k, COUNT(*) AS v FROM nation GROUP BY n_regionkey) t", "SELECT n_regionkey, COUNT(*) AS f0 FROM nation GROUP BY n_regionkey"),
    "transform_uniqkv": ("SELECT transform$uniqkv('o_custkey', 'o_orderstatus', 'n') FROM (SELECT o_custkey, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus) t", "SELECT o_custkey, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS F, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS O, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY o_custkey"),
    "variables_into": ("SELECT MAX(o_totalprice) INTO @most FROM orders; SET @share = 0.9; SELECT o_orderkey FROM orders WHERE o_totalprice > @most * @share", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT MAX(o_totalprice) FROM orders) * 0.9"),
    "insert_values_select": ("INSERT INTO kept VALUES (-900, 'new', 1), (-901, 'newer', 2); INSERT INTO kept SELECT c_custkey AS col1, c_name AS col2, c_nationkey AS col3 FROM customer WHERE c_nationkey < 9; SELECT col1, col2, col3 FROM kept", "SELECT -900 AS col1, 'new' AS col2, 1 AS col3 UNION ALL SELECT -901, 'newer', 2 UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey < 9"),
    "insert_update_mode": ("INSERT INTO t SELECT c_custkey AS k, c_name AS name, 0 AS seen FROM customer; INSERT INTO `t<U>` SELECT c_custkey AS `k<pk>`, 1 AS seen FROM customer WHERE c_nationkey = 2; SELECT k, name, seen FROM t", "SELECT c_custkey AS k, c_name AS name, CASE WHEN c_nationkey = 2 THEN 1 ELSE 0 END AS seen FROM customer"),
    "insert_upsert_mode": ("INSERT INTO t SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_nationkey < 15; INSERT INTO `t<UI>` SELECT c_custkey AS `k<pk>`, concat(c_name, '!') AS name FROM customer WHERE c_nationkey > 10; SELECT k, name FROM t", "SELECT c_custkey AS k, CASE WHEN c_nationkey > 10 THEN c_name || '!' ELSE c_name END AS name FROM customer"),
    "insert_udi_mode": ("INSERT INTO t SELECT c_custkey AS k, c_name AS name FROM customer; INSERT INTO `t<UDI>` SELECT c_custkey AS `k<pk>`, concat(c_name, '!') AS name FROM customer WHERE c_custkey >= 50 AND c_nationkey < 5; SELECT k, name FROM t", "SELECT c_custkey AS k, CASE WHEN c_custkey >= 50 THEN c_name || '!' ELSE c_name END AS name FROM customer WHERE c_custkey < 50 OR c_nationkey < 5"),
    "insert_di_mode": ("INSERT INTO t SELECT c_custkey AS k, c_name AS name FROM customer; INSERT INTO `t<DI>` SELECT c_custkey AS `k<pk>`, 'x' AS name FROM customer WHERE c_custkey > 70; SELECT k, name FROM t", "SELECT c_custkey AS k, CASE WHEN c_custkey > 70 THEN 'x' ELSE c_name END AS name FROM customer"),
    "update_join": ("INSERT INTO t SELECT c_custkey AS k, c_nationkey AS r, c_name AS name FROM customer; UPDATE t INNER JOIN nation g ON t.r = g.n_nationkey SET t.k = t.k, t.name = g.n_name WHERE g.n_regionkey > 2; SELECT k, name FROM t", "SELECT c_custkey AS k, CASE WHEN n_regionkey > 2 THEN n_name ELSE c_name END AS name FROM customer JOIN nation ON n_nationkey = c_nationkey"),
    "delete_rows": ("INSERT INTO t SELECT c_custkey AS k, c_nationkey AS r, c_name AS name FROM customer; DELETE FROM t WHERE r > 10 OR name LIKE '%7'; SELECT k, name FROM t", "SELECT c_custkey AS k, c_name AS name FROM customer WHERE NOT (c_nationkey > 10 OR c_name LIKE '%7')"),
    "theta_join_alone": ("SELECT a.s_suppkey AS a, b.r_regionkey AS b FROM supplier a INNER JOIN region b ON a.s_nationkey > b.r_regionkey", None),
    "natural_join": ("SELECT o_orderkey, n FROM (SELECT o_orderkey, o_custkey AS k FROM orders) x NATURAL JOIN (SELECT c_custkey AS k, c_nationkey AS n FROM customer) y", None),
    "lateral_join": ("SELECT c.c_custkey, t.n FROM customer c, LATERAL (SELECT COUNT(*) AS n FROM orders o WHERE o.o_custkey = c.c_custkey) t", None),
    "trig_funcs": ("SELECT p_partkey, ROUND(SIN(p_size), 6) AS si, ROUND(COS(p_size), 6) AS co, ROUND(TAN(p_size / 40), 6) AS ta, ROUND(ATAN(p_size), 6) AS at, ROUND(ASIN(p_size / 100), 6) AS asi, ROUND(ACOS(p_size / 100), 6) AS aco, ROUND(PI(), 6) AS pi_, ROUND(EXP(p_size / 10), 4) AS e, POWER(p_size, 3) AS pw, CEILING(p_retailprice) AS c, RAND() < 1 AS r FROM part", "SELECT p_partkey, round(sin(p_size), 6) AS si, round(cos(p_size), 6) AS co, round(tan(p_size / 40), 6) AS ta, round(atan(p_size), 6) AS at, round(asin(p_size / 100), 6) AS asi, round(acos(p_size / 100), 6) AS aco, round(pi(), 6) AS pi_, round(exp(p_size / 10), 4) AS e, power(p_size, 3) AS pw, CAST(ceil(p_retailprice) AS BIGINT) AS c, 1 AS r FROM part"),
    "bit_pair_funcs": ("SELECT p_partkey, BIT_AND(p_size, 6) AS a, BIT_OR(p_size, 9) AS o, BIT_XOR(p_size, 5) AS x, BITWISEAND(p_size, 3) AS ba, BITWISEOR(p_size, 64) AS bo, BITWISEXOR(p_size, 7) AS bx, BITWISENOT(p_size) AS bn, BITWISELEFTSHIFT(p_size, 3) AS bl, BITWISERIGHTSHIFT(p_size, 2) AS br, ADD(p_size, 2) AS ad, SUB(p_size, 2) AS su, MUL(p_size, 2) AS mu, DIV(p_size, 4) AS di FROM part", "SELECT p_partkey, CAST(p_size & 6 AS BIGINT) AS a, CAST(p_size | 9 AS BIGINT) AS o, CAST(xor(p_size, 5) AS BIGINT) AS x, CAST(p_size & 3 AS BIGINT) AS ba, CAST(p_size | 64 AS BIGINT) AS bo, CAST(xor(p_size, 7) AS BIGINT) AS bx, CAST(~p_size AS BIGINT) AS bn, CAST(p_size << 3 AS BIGINT) AS bl, CAST(p_size >> 2 AS BIGINT) AS br, p_size + 2 AS ad, p_size - 2 AS su, p_size * 2 AS mu, p_size / 4 AS di FROM part"),
    "string_codes": ("SELECT p_partkey, BIN(p_size) AS b, HEX(p_size) AS h, HEX(p_brand) AS hb, UNHEX(HEX(p_brand)) AS uh, OCT(p_size) AS o, ORD(LEFT(p_brand, 1)) AS od, ASCII(LEFT(p_brand, 1)) AS asc_, CHAR(66, 65) AS ch, BIT_LENGTH(p_brand) AS bl, CHAR_LENGTH(p_name) AS cl, CHARACTER_LENGTH(p_name) AS cl2, FROM_BASE64(TO_BASE64(p_brand)) AS b64, CRC32('hello') AS crc FROM part", "SELECT p_partkey, '0b' || bin(p_size) AS b, '0x' || lower(hex(p_size)) AS h, lower(hex(p_brand)) AS hb, p_brand AS uh, printf('%o', p_size) AS o, ascii(left(p_brand, 1)) AS od, ascii(left(p_brand, 1)) AS asc_, 'BA' AS ch, CAST(strlen(p_brand) * 8 AS INT) AS bl, CAST(length(p_name) AS INT) AS cl, CAST(length(p_name) AS INT) AS cl2, p_brand AS b64, CAST(907060870 AS BIGINT) AS crc FROM part"),
    "string_places": ("SELECT p_partkey, INSERT(p_brand, 1, 5, 'X') AS ins, UCASE(p_name) AS uc, TRIM(concat('  ', p_brand, ' ')) AS tr, ELT(2, p_brand, p_type) AS el, FIELD(p_brand, 'Brand#11', 'Brand#22') AS fi, FIND_IN_SET(p_brand, 'Brand#11,Brand#22') AS fs, SUBSTRING_INDEX(p_type, ' ', 1) AS sx, STARTSWITH(p_brand, 'Brand#1') AS sw, ENDSWITH(p_brand, '1') AS ew, CONTAINS(p_type, 'TIN') AS ct, SUBSTR(p_brand, 7) AS ss FROM part", "SELECT p_partkey, 'X' || substr(p_brand, 6) AS ins, upper(p_name) AS uc, p_brand AS tr, p_type AS el, CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#22' THEN 2 ELSE 0 END AS fi, CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#22' THEN 2 ELSE 0 END AS fs, split_part(p_type, ' ', 1) AS sx, CAST(starts_with(p_brand, 'Brand#1') AS INT) AS sw, CAST(p_brand LIKE '%1' AS INT) AS ew, CAST(contains(p_type, 'TIN') AS INT) AS ct, substr(p_brand, 7) AS ss FROM part"),
    "network_funcs": ("SELECT p_partkey, INET4_ATON(concat('10.0.', p_size, '.1')) AS a, INET4_NTOA(INET4_ATON(concat('10.0.', p_size, '.1'))) AS n, IS_IPV4(concat('10.0.', p_size * 10, '.1')) AS v4, INET6_ATON(concat('::', p_size)) AS a6, INET6_NTOA(INET6_ATON('::1')) AS n6, IS_IPV6(concat('::', p_brand)) AS v6 FROM part", "SELECT p_partkey, '0a00' || printf('%02x', p_size) || '01' AS a, '10.0.' || p_size || '.1' AS n, CAST(p_size * 10 < 256 AS INT) AS v4, lpad(CAST(p_size AS VARCHAR), 32, '0') AS a6, '::1' AS n6, 0 AS v6 FROM part"),
    "calendar_funcs": ("SELECT o_orderkey, MONTHNAME(o_orderdate) AS mn, DAYNAME(o_orderdate) AS dn, DATE_FORMAT(ADDDATE(o_orderdate, 3), '%Y-%m-%d') AS ad, DATE_FORMAT(SUBDATE(o_orderdate, 3), '%Y-%m-%d') AS sd, DATE_FORMAT(DATEADD(o_orderdate, INTERVAL 2 DAY), '%Y-%m-%d') AS da, DATE_FORMAT(DATESUB(o_orderdate, INTERVAL 2 DAY), '%Y-%m-%d') AS ds, DATE_FORMAT(DATE(o_orderdate), '%d') AS d, DATE_FORMAT(FROM_UNIXTIME(UNIX_TIMESTAMP(o_orderdate)), '%Y-%m-%d') AS fu FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%b') AS mn, dayname(o_orderdate) AS dn, strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') AS ad, strftime(o_orderdate - INTERVAL 3 DAY, '%Y-%m-%d') AS sd, strftime(o_orderdate + INTERVAL 2 DAY, '%Y-%m-%d') AS da, strftime(o_orderdate - INTERVAL 2 DAY, '%Y-%m-%d') AS ds, strftime(o_orderdate, '%d') AS d, strftime(o_orderdate, '%Y-%m-%d') AS fu FROM orders"),
    "week_funcs": ("SELECT o_orderkey, WEEK(o_orderdate) AS w, WEEK(o_orderdate, 1) AS w1, YEARWEEK(o_orderdate) AS yw FROM orders", "SELECT o_orderkey, CAST(strftime(o_orderdate, '%U') AS INT) AS w, CAST(strftime(o_orderdate, '%W') AS INT) AS w1, CAST(year(o_orderdate) * 100 + CAST(strftime(o_orderdate, '%U') AS INT) AS INT) AS yw FROM orders"),
    "clock_funcs": ("SELECT event_id, TIME(ts) AS t, TIME_FORMAT(ts, '%H-%M') AS tf, TIME_TO_SEC(TIME(ts)) AS s, SEC_TO_TIME(TIME_TO_SEC(TIME(ts))) AS back, UNIX_TIMESTAMP(ADDTIME(ts, '1:02:03')) - UNIX_TIMESTAMP(ts) AS more, UNIX_TIMESTAMP(ts) - UNIX_TIMESTAMP(SUBTIME(ts, '0:00:30')) AS less, DATE_FORMAT(DATETIME(ts), '%Y') AS y FROM events", "SELECT event_id, strftime(ts, '%H:%M:%S') AS t, strftime(ts, '%H-%M') AS tf, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS s, strftime(ts, '%H:%M:%S') AS back, CAST(3723 AS BIGINT) AS more, CAST(30 AS BIGINT) AS less, strftime(ts, '%Y') AS y FROM events"),
    "now_funcs": ("SELECT r_regionkey, DATEDIFF(CURDATE(), CURRENTDATE()) AS a, UNIX_TIMESTAMP(CURRENTTIMESTAMP()) - UNIX_TIMESTAMP(SYSDATE()) AS b, UNIX_TIMESTAMP(NOW()) - UNIX_TIMESTAMP(UTC_TIMESTAMP()) AS c, CHAR_LENGTH(CURTIME()) AS d, CHAR_LENGTH(CURRENTTIME()) AS e, CHAR_LENGTH(UTC_TIME()) AS f, UNIX_TIMESTAMP(NOW('1d')) - UNIX_TIMESTAMP(NOW()) AS g, YEAR(UTC_DATE()) > 2000 AS h FROM region", "SELECT r_regionkey, 0 AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, 8 AS d, 8 AS e, 8 AS f, CAST(86400 AS BIGINT) AS g, 1 AS h FROM region"),
    "logic_funcs": ("SELECT p_partkey, EQ(p_size, 5) AS e, NEQ(p_size, 5) AS ne, GT(p_size, 5) AS g, GTE(p_size, 5) AS ge, LT(p_size, 5) AS l, LTE(p_size, 5) AS le, IS(p_size, 5) AS i, IS_NOT(p_size, 5) AS nt, NOT(p_size > 5) AS n, EXISTS((1, 2)) AS x, EXISTS(p_size - p_size) AS z FROM part", "SELECT p_partkey, CAST(p_size = 5 AS INT) AS e, CAST(p_size <> 5 AS INT) AS ne, CAST(p_size > 5 AS INT) AS g, CAST(p_size >= 5 AS INT) AS ge, CAST(p_size < 5 AS INT) AS l, CAST(p_size <= 5 AS INT) AS le, CAST(p_size = 5 AS INT) AS i, CAST(p_size <> 5 AS INT) AS nt, CAST(p_size <= 5 AS INT) AS n, 1 AS x, 0 AS z FROM part"),
    "json_build": ("SELECT p_partkey, JSON_ARRAY(p_size, p_brand) AS a, JSON_OBJECT('k', p_size) AS o, JSON_CONTAINS(JSON_OBJECT('k', p_size), '5', '$.k') AS c, JSON_EXTRACT(JSON_ENCODE(JSON_OBJECT('k', p_size)), '$') IS NOT NULL AS e, JSON_DECODE('[1]') IS NOT NULL AS d FROM part", "SELECT p_partkey, '[' || p_size || ',\"' || p_brand || '\"]' AS a, '{\"k\":' || p_size || '}' AS o, CAST(p_size = 5 AS INT) AS c, 1 AS e, 1 AS d FROM part"),
    "regexp_more": ("SELECT p_partkey, REGEXP_REPLACE(p_brand, '([a-z]+)#([0-9])', '\\\\2-\\\\1') AS swap, REGEXP_REPLACE(p_brand, '[a-z]', 'x', 1, 2) AS second, REGEXPLIKE(p_type, '[A-M]') AS m, REGEXP_SUBSTR(p_type, '[A-Z]', 1, 2) AS word, LIKE(p_brand, 'Brand#1%') AS lk FROM part", "SELECT p_partkey, regexp_replace(p_brand, '([A-Za-z]+)#([0-9])', '\\2-\\1') AS swap, left(p_brand, 1) || 'x' || substr(p_brand, 3) AS second, CAST(regexp_matches(p_type, '^[A-Ma-m]') AS INT) AS m, substr(p_type, 2, 1) AS word, CAST(p_brand LIKE 'Brand#1%' AS INT) AS lk FROM part"),
    "is_funcs": ("SELECT p_partkey, IS_INT(p_size) AS a, IS_FLOAT(p_retailprice) AS b, IS_STRING(p_brand) AS c, IS_NULL(p_brand) AS d, IS_NUMBER(p_brand) AS e, IS_ARRAY((1, 2)) AS f, IS_UUID(UUID()) AS g, IS_OBJECTID(OBJECTID()) AS h, IS_BOOL(p_brand) AS i, IS_TIME('10:11:12') AS j FROM part", "SELECT p_partkey, 1 AS a, 1 AS b, 1 AS c, 0 AS d, 0 AS e, 1 AS f, 1 AS g, 1 AS h, 0 AS i, 1 AS j FROM part"),
    "convert_funcs": ("SELECT p_partkey, CONVERT_INT(p_retailprice) AS a, CONVERT_STRING(p_size) AS b, CONVERT_FLOAT(p_size) AS c, JOIN(CONVERT_ARRAY((p_size, 1)), ',') AS d, JOIN(CONVERT_SET((7, 7, 8)), ',') AS e, JOIN(CONVERT_ARRAY(p_brand), ',') AS f, DATE_FORMAT(CONVERT_DATETIME('2024-05-06 07:08:09'), '%H') AS g, CONVERT_TIME('2024-05-06 07:08:09') AS h FROM part", "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS a, CAST(p_size AS VARCHAR) AS b, CAST(p_size AS DOUBLE) AS c, p_size || ',1' AS d, '7,8' AS e, p_brand AS f, '07' AS g, '07:08:09' AS h FROM part"),
    "random_funcs": ("SELECT p_partkey, CHAR_LENGTH(RANDOM$HEXS(100)) AS a, RANDOM$HEXS(70) REGEXP '[0-9a-f]{70}' AS b, CHAR_LENGTH(RANDOM$LETTERS(9)) AS c, RANDOM$DIGITS(5) REGEXP '[0-9]{5}' AS d, RANDOM$INT(3, 5) BETWEEN 3 AND 5 AS e, CHAR_LENGTH(RANDOM$STRING(6)) AS f, CONTAINS((1, 2), RANDOM$CHOICE((1, 2))) AS g, RANDOM() < 1 AS h, SNOWFLAKEID() > 0 AS i, CHAR_LENGTH(UUID$UUID4()) AS j FROM part", "SELECT p_partkey, 100 AS a, 1 AS b, 9 AS c, 1 AS d, 1 AS e, 6 AS f, 1 AS g, 1 AS h, 1 AS i, 36 AS j FROM part"),
    "list_funcs": ("SELECT p_partkey, JOIN(ADD((p_size, 2, 3), 1), ',') AS a, JOIN(MUL((p_size, 2), (2, 3)), ',') AS m, JOIN(RANGE(0, 3), ',') AS r, JOIN(SPLIT(p_type, ' '), '|') AS s, NEG(p_size) AS n, MATH$POW(p_size, 2) AS p FROM part", "SELECT p_partkey, (p_size + 1) || ',3,4' AS a, (p_size * 2) || ',6' AS m, '0,1,2' AS r, replace(p_type, ' ', '|') AS s, -p_size AS n, power(p_size, 2) AS p FROM part"),
}


def _run(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        engine = Engine(spark)
        engine.session.folder = d
        engine.set_variable("c", 0)
        return engine.execute(sql)

    return query


#: Written to and read from files in the shared folder; ``${out}`` is a new one for each run.
FILE_PAIRS: dict[str, tuple[str, str]] = {
    **{f"file_append_{kind}": (
        f"INSERT INTO `${{out}}/o.{kind}` SELECT o_orderkey, o_custkey FROM orders; INSERT INTO `${{out}}/o.{kind}` SELECT c_nationkey AS o_custkey, c_custkey AS o_orderkey FROM customer; SELECT o_orderkey, o_custkey FROM `${{out}}/o.{kind}`",
        "SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT c_custkey, c_nationkey FROM customer",
    ) for kind in ("csv", "json", "parquet")},
    **{f"file_{mode.lower()}": (
        f"INSERT INTO `${{out}}/t.csv` SELECT o_orderkey AS k, o_custkey AS v FROM orders; INSERT INTO `${{out}}/t.csv<{mode}>` SELECT id AS `k<pk>`, status AS v FROM (SELECT id, MAX(status) AS status FROM member_orders WHERE id IS NOT NULL AND status IS NOT NULL GROUP BY id) m; SELECT k, v FROM `${{out}}/t.csv`",
        sql,
    ) for mode, sql in (
        ("U", "SELECT o_orderkey AS k, COALESCE(m.s, o_custkey) AS v FROM orders LEFT JOIN (SELECT id, MAX(status) AS s FROM member_orders WHERE id IS NOT NULL AND status IS NOT NULL GROUP BY id) m ON id = o_orderkey"),
        ("UI", "SELECT COALESCE(o_orderkey, id) AS k, COALESCE(m.s, o_custkey) AS v FROM orders FULL JOIN (SELECT id, MAX(status) AS s FROM member_orders WHERE id IS NOT NULL AND status IS NOT NULL GROUP BY id) m ON id = o_orderkey"),
        ("UDI", "SELECT id AS k, MAX(status) AS v FROM member_orders WHERE id IS NOT NULL AND status IS NOT NULL GROUP BY id"),
        ("DI", "SELECT id AS k, MAX(status) AS v FROM member_orders WHERE id IS NOT NULL AND status IS NOT NULL GROUP BY id"),
    )},
}


def _run_files(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        engine = Engine(spark)
        engine.session.folder = d
        engine.set_variable("out", shared_path(spark, "files"))
        return engine.execute(sql)

    return query


def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.sliding(table(spark, d, "events"), "ts", "2 hours", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")]).select("window_start", "event_type", "n")


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.sessions(table(spark, d, "events"), "ts", "2 hours", ["user_id"], [F.count(F.lit(1)).alias("n")]).select("window_start", "user_id", "n")


def python_aggregate(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.session.folder = d
    engine.register_aggregate("span_of", lambda v: float(max(v) - min(v)) if v else None)
    engine.use("label_of", lambda k: f"L{k}")
    return engine.execute("SELECT label_of(o_orderstatus) AS label, span_of(o_totalprice) AS span FROM orders GROUP BY o_orderstatus")


def python_generator(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.session.folder = d
    engine.register_generator("upto", lambda n: range(n), "bigint")
    return engine.execute("SELECT r_regionkey, upto(r_regionkey) AS i FROM region")


def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Each order's total from its lines, into the orders by their keys."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).cast("double").alias("o_totalprice"))
    return merge.merge(o, lines, ["o_orderkey"], "UI")


def _merge_states(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        members = table(spark, d, "member_orders").filter("id is not null").select("id", "status").distinct()
        feed = table(spark, d, "order_feed").filter("id is not null").groupBy("id").agg(F.max("status").alias("status"))
        return merge.merge(members, feed, ["id"], mode)

    return query


def transform_function(spark: SparkSession, d: str) -> DataFrame:
    return transforms.v2h(table(spark, d, "events").select("user_id", "event_type"), "event_type", "user_id").select("user_id", "click")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _run(sql) for name, (sql, _) in PAIRS.items()}, **{name: _run_files(sql) for name, (sql, _) in FILE_PAIRS.items()},
    "sliding_windows": sliding_windows, "session_windows": session_windows, "python_aggregate": python_aggregate, "python_generator": python_generator, "merge_upsert": merge_upsert, **{f"merge_states_{m.lower()}": _merge_states(m) for m in ("U", "UI", "UDI")}, "transform_function": transform_function,
}

SQL: dict[str, str] = {
    **{name: other or sql for name, (sql, other) in PAIRS.items()}, **{name: sql for name, (_, sql) in FILE_PAIRS.items()},
    "sliding_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR * k AS window_start, event_type, COUNT(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2",
    "session_windows": """SELECT min(ts) AS window_start, user_id, COUNT(*) AS n FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
          SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""",
    "python_aggregate": "SELECT 'L' || o_orderstatus AS label, MAX(o_totalprice) - MIN(o_totalprice) AS span FROM orders GROUP BY o_orderstatus",
    "python_generator": "SELECT r_regionkey, unnest(range(r_regionkey)) AS i FROM region",
    "merge_upsert": "SELECT COALESCE(o_orderkey, l_orderkey) AS o_orderkey, COALESCE(n, o_totalprice) AS o_totalprice FROM orders FULL JOIN (SELECT l_orderkey, CAST(COUNT(*) AS DOUBLE) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey",
    **{f"merge_states_{m}": sql for m, sql in (
        ("u", "SELECT DISTINCT m.id, CASE WHEN f.id IS NULL THEN m.status ELSE f.status END AS status FROM member_orders m LEFT JOIN (SELECT id, MAX(status) AS status FROM order_feed GROUP BY id) f ON f.id = m.id WHERE m.id IS NOT NULL"),
        ("ui", "SELECT DISTINCT COALESCE(m.id, f.id) AS id, CASE WHEN f.id IS NULL THEN m.status ELSE f.status END AS status FROM (SELECT * FROM member_orders WHERE id IS NOT NULL) m FULL JOIN (SELECT id, MAX(status) AS status FROM order_feed WHERE id IS NOT NULL GROUP BY id) f ON f.id = m.id"),
        ("udi", "SELECT id, MAX(status) AS status FROM order_feed WHERE id IS NOT NULL GROUP BY id"),
    )},
    "transform_function": "SELECT user_id, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS click FROM events GROUP BY user_id",
}
