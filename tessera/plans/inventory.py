"""One query an operator of the dialect: the statement in the dialect, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name -> (dialect, DuckDB; None where DuckDB takes the dialect's text as it is)
SELECTS: dict[str, tuple[str, str | None]] = {
    # 2.1 scans and sources
    "scan_full": ("SELECT o_orderkey, o_custkey, o_totalprice FROM orders", None),
    "scan_point": ("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 77", None),
    "scan_point_in": ("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 5, 77, 99999999)", None),
    "scan_range": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200", None),
    "scan_prefix_range": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45", None),
    "scan_covering": ("SELECT l_shipdate FROM lineitem WHERE l_shipdate >= '1995-01-01' AND l_shipdate < '1995-02-01'", None),
    "scan_or": ("SELECT p_partkey FROM part WHERE p_size = 3 OR p_brand = 'Brand#13' OR p_retailprice > 1900", None),
    "scan_not_indexed": ("SELECT count(*) AS n FROM orders NOT INDEXED WHERE o_custkey = 5", "SELECT count(*) AS n FROM orders WHERE o_custkey = 5"),
    "source_subquery": ("SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 15", "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE n > 15"),
    "source_parenthesised_join": ("SELECT r_name, n_name FROM region JOIN (nation JOIN supplier ON s_nationkey = n_nationkey) ON n_regionkey = r_regionkey WHERE s_acctbal > 5000", None),
    "source_single_row": ("SELECT 1 AS one, 'x' AS x, NULL IS NULL AS t", "SELECT 1::BIGINT AS one, 'x' AS x, 1::BIGINT AS t"),
    "count_fast": ("SELECT count(*) AS n FROM lineitem", None),
    # 2.2 projection and predicates
    "project_star": ("SELECT * FROM nation", None),
    "project_table_star": ("SELECT n.*, r.r_name AS region FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey", None),
    "project_expr": ("SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_linenumber = 1", None),
    "distinct_rows": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "where_numeric_truth": ("SELECT count(*) AS n FROM lineitem WHERE l_linenumber - 1", "SELECT count(*) AS n FROM lineitem WHERE l_linenumber - 1 <> 0"),
    "compare_all": ("SELECT p_partkey, p_size = 5 AS eq, p_size == 5 AS eq2, p_size != 5 AS ne, p_size <> 5 AS ne2, p_size < 5 AS lt, p_size <= 5 AS le, p_size > 5 AS gt, p_size >= 5 AS ge FROM part WHERE p_partkey < 300",
        "SELECT p_partkey, (p_size = 5)::BIGINT AS eq, (p_size = 5)::BIGINT AS eq2, (p_size <> 5)::BIGINT AS ne, (p_size <> 5)::BIGINT AS ne2, (p_size < 5)::BIGINT AS lt, (p_size <= 5)::BIGINT AS le, (p_size > 5)::BIGINT AS gt, (p_size >= 5)::BIGINT AS ge FROM part WHERE p_partkey < 300"),
    "is_operators": ("SELECT e.user_id, e.n IS 3 AS a, e.n IS NOT 3 AS b, e.n IS NULL AS c FROM (SELECT user_id, nullif(count(*), 2) AS n FROM events GROUP BY user_id) e",
        "SELECT e.user_id, (e.n IS NOT DISTINCT FROM 3)::BIGINT AS a, (e.n IS DISTINCT FROM 3)::BIGINT AS b, (e.n IS NULL)::BIGINT AS c FROM (SELECT user_id, nullif(count(*), 2) AS n FROM events GROUP BY user_id) e"),
    "null_tests": ("SELECT NULL ISNULL AS a, 1 NOTNULL AS b, NULL NOT NULL AS c, 2 IS NOT NULL AS d", "SELECT 1::BIGINT AS a, 1::BIGINT AS b, 0::BIGINT AS c, 1::BIGINT AS d"),
    "three_valued": ("SELECT NULL AND 0 AS a, NULL AND 1 AS b, NULL OR 1 AS c, NULL OR 0 AS d, NOT NULL AS e, 3 AND 0.5 AS f, NOT 7 AS g", "SELECT 0::BIGINT AS a, NULL::BIGINT AS b, 1::BIGINT AS c, NULL::BIGINT AS d, NULL::BIGINT AS e, 1::BIGINT AS f, 0::BIGINT AS g"),
    "between": ("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12 AND p_retailprice NOT BETWEEN 1000 AND 1500", None),
    "in_list": ("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)", None),
    "in_nulls": ("SELECT 1 IN (1, NULL) AS a, 2 IN (1, NULL) AS b, 2 NOT IN (1, NULL) AS c, NULL IN (1) AS d", "SELECT 1::BIGINT AS a, NULL::BIGINT AS b, NULL::BIGINT AS c, NULL::BIGINT AS d"),
    "in_empty": ("SELECT count(*) AS n FROM region WHERE NULL NOT IN () AND NOT (r_regionkey IN ())", "SELECT count(*) AS n FROM region"),
    "in_select": ("SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)", None),
    "not_in_select": ("SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", None),
    "exists": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", None),
    "not_exists": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", None),
    "exists_value": ("SELECT r_name, EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 22) AS has FROM region", "SELECT r_name, EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 22)::BIGINT AS has FROM region"),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)", None),
    "scalar_subquery_first_row": ("SELECT (SELECT n_name FROM nation ORDER BY n_nationkey DESC) AS last, (SELECT n_name FROM nation WHERE n_nationkey > 99) AS none", "SELECT (SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 1) AS last, NULL::VARCHAR AS none"),
    "like": ("SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%brass%' OR p_name LIKE 'PART%9_'", "SELECT p_partkey, p_name FROM part WHERE p_type ILIKE '%brass%' OR p_name ILIKE 'PART%9_'"),
    "like_escape": ("SELECT c_custkey FROM customer WHERE c_name LIKE '%#_00000004%' ESCAPE '#' OR c_name NOT LIKE '%0%'", "SELECT c_custkey FROM customer WHERE c_name ILIKE '%#_00000004%' ESCAPE '#' OR c_name NOT ILIKE '%0%'"),
    "glob": ("SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[12]?' AND p_brand NOT GLOB '*[^0-4]'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#[12].') AND NOT regexp_full_match(p_brand, '.*[^0-4]')"),
    "glob_column": ("SELECT n_nationkey, pat FROM nation JOIN (SELECT '*_1?' AS pat UNION ALL SELECT 'NATION_[2-4]' UNION ALL SELECT '[^N]*' UNION ALL SELECT 'N.TION*') ON n_name GLOB pat",
        "SELECT n_nationkey, pat FROM nation JOIN (VALUES ('*_1?', '.*_1.'), ('NATION_[2-4]', 'NATION_[2-4]')) v(pat, re) ON regexp_full_match(n_name, re)"),
    "call_forms": ("SELECT n_nationkey, like('%\\_%', n_name) AS l FROM nation WHERE glob('NATION_1*', n_name) AND like('%5', n_name) OR regexp('_2$', n_name)", "SELECT n_nationkey, 0::BIGINT AS l FROM nation WHERE n_name IN ('NATION_15', 'NATION_2')"),
    "regexp": ("SELECT c_custkey FROM customer WHERE c_name REGEXP '0[1-3]5$'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '0[1-3]5$')"),
    "case_searched": ("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS band FROM orders", None),
    "case_simple": ("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END AS code FROM lineitem", "SELECT l_orderkey, l_linenumber, (CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END)::BIGINT AS code FROM lineitem"),
    "cast_prefix": ("SELECT CAST('12abc' AS INTEGER) AS a, CAST('abc' AS INTEGER) AS b, CAST(' -3.5e2xyz' AS REAL) AS c, CAST(7.9 AS INTEGER) AS d, CAST(12 AS TEXT) AS e, CAST(-7.9 AS INT) AS f", "SELECT 12::BIGINT AS a, 0::BIGINT AS b, -350.0::DOUBLE AS c, 7::BIGINT AS d, '12' AS e, -7::BIGINT AS f"),
    "cast_columns": ("SELECT o_orderkey, CAST(o_totalprice AS INTEGER) AS whole, CAST(o_custkey AS TEXT) AS t FROM orders", "SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS whole, o_custkey::VARCHAR AS t FROM orders"),
    "collate_nocase": ("SELECT n_nationkey FROM nation WHERE n_name COLLATE NOCASE = 'nation_7'", "SELECT n_nationkey FROM nation WHERE lower(n_name) = 'nation_7'"),
    "collate_rtrim": ("SELECT 'ab  ' COLLATE RTRIM = 'ab' AS a, 'ab' = 'ab ' AS b", "SELECT 1::BIGINT AS a, 0::BIGINT AS b"),
    "literals": ("SELECT 1 AS i, 2.5 AS d, 'it''s' AS s, 1e3 AS e, -4 AS m, hex(X'00ff') AS h", "SELECT 1::BIGINT AS i, 2.5::DOUBLE AS d, 'it''s' AS s, 1000::DOUBLE AS e, -4::BIGINT AS m, '00FF' AS h"),
    "affinity_compare": ("SELECT count(*) AS n FROM part WHERE p_size = '7' AND p_brand <> 5 AND p_size < 'abc'", "SELECT count(*) AS n FROM part WHERE p_size = 7"),
    # 2.3 joins
    "join_inner": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000", None),
    "join_comma": ("SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey", None),
    "join_cross": ("SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b", None),
    "join_left": ("SELECT c_custkey, o_orderkey FROM customer LEFT OUTER JOIN orders ON o_custkey = c_custkey AND o_totalprice > 350000", None),
    "join_natural": ("SELECT r_name, n_name FROM region NATURAL JOIN (SELECT n_name, n_regionkey AS r_regionkey FROM nation)", "SELECT r_name, n_name FROM region NATURAL JOIN (SELECT n_name, n_regionkey AS r_regionkey FROM nation) t"),
    "join_using": ("SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) JOIN (SELECT s_nationkey AS k, s_name FROM supplier) USING (k)", "SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) a JOIN (SELECT s_nationkey AS k, s_name FROM supplier) b USING (k)"),
    "join_theta": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey + 20 < b.n_nationkey", None),
    "join_self": ("SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey", None),
    "join_five": ("SELECT r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= '1994-01-01' GROUP BY r_name", None),
    "join_semi_in": ("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)", None),
    "correlated_aggregate": ("SELECT l_orderkey, l_linenumber FROM lineitem a WHERE l_quantity > (SELECT 1.5 * avg(l_quantity) FROM lineitem b WHERE b.l_partkey = a.l_partkey)", None),
    "outer_on_where": ("SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 8000 WHERE s_suppkey IS NULL", None),
    # 2.4 aggregation
    "group_by": ("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "pricing_summary": ("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", None),
    "aggregate_empty": ("SELECT count(*) AS n, sum(o_totalprice) AS s, total(o_totalprice) AS t, avg(o_totalprice) AS a, min(o_orderkey) AS lo, group_concat(o_orderstatus) AS g FROM orders WHERE o_orderkey < 0", "SELECT 0::BIGINT AS n, NULL::DOUBLE AS s, 0.0::DOUBLE AS t, NULL::DOUBLE AS a, NULL::BIGINT AS lo, NULL::VARCHAR AS g"),
    "count_column": ("SELECT count(o_orderkey) AS a, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS b FROM orders", None),
    "count_distinct": ("SELECT count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, sum(DISTINCT l_linenumber) AS d FROM lineitem", "SELECT count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, sum(DISTINCT l_linenumber)::BIGINT AS d FROM lineitem"),
    "min_max": ("SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS d0, max(o_orderpriority) AS p FROM orders", None),
    "sum_total_avg": ("SELECT c_nationkey, sum(c_custkey) AS s, total(c_custkey) AS t, round(avg(c_acctbal), 6) AS a FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, sum(c_custkey)::BIGINT AS s, sum(c_custkey)::DOUBLE AS t, round(avg(c_acctbal), 6) AS a FROM customer GROUP BY c_nationkey"),
    "group_concat": ("SELECT n_regionkey, group_concat(n_name) AS names, group_concat(n_name, '; ') AS spaced, group_concat(DISTINCT n_regionkey) AS one FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(n_name, '; ' ORDER BY n_name) AS spaced, any_value(n_regionkey)::VARCHAR AS one FROM nation GROUP BY n_regionkey"),
    "having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND max(o_totalprice) > 1000", None),
    "having_alias": ("SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY k HAVING n > 15", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15"),
    "bare_column": ("SELECT c_nationkey, count(*) AS n, c_custkey, c_name FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, count(*) AS n, max(c_custkey) AS c_custkey, arg_max(c_name, c_custkey) AS c_name FROM customer GROUP BY c_nationkey"),
    "group_by_expression": ("SELECT strftime('%Y', o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1", "SELECT strftime(o_orderdate, '%Y') AS y, count(*) AS n FROM orders GROUP BY 1"),
    # 2.6 sort, limit, set operations
    "order_by": ("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_nationkey DESC, c_acctbal, 1", None),
    "order_nulls": ("SELECT k FROM (SELECT NULL AS k UNION ALL SELECT 2 UNION ALL SELECT 1) ORDER BY k LIMIT 2", "SELECT k FROM (VALUES (NULL::BIGINT), (1::BIGINT)) t(k)"),
    "order_collate": ("SELECT x FROM (SELECT 'b' AS x UNION ALL SELECT 'A' UNION ALL SELECT 'C') ORDER BY x COLLATE NOCASE LIMIT 2", "SELECT x FROM (VALUES ('A'), ('b')) t(x)"),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5", None),
    "limit_comma": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5"),
    "limit_negative": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT -1 OFFSET 20", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20"),
    "limit_expression": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT (SELECT count(*) FROM region) OFFSET 1 + 1", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 2"),
    "top_k": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000", None),
    "compound_left": ("SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey + 100 FROM region INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey < 9 EXCEPT SELECT 3 ORDER BY k DESC", "SELECT k FROM (SELECT n_nationkey::BIGINT AS k FROM nation) t WHERE k < 9 AND k <> 3"),
    # 2.7 scalar expressions
    "arithmetic": ("SELECT o_orderkey, o_custkey / 7 AS d, o_custkey % 7 AS m, o_totalprice / 3 AS r, - o_custkey AS neg, o_custkey * 2 - 1 AS x FROM orders", "SELECT o_orderkey, o_custkey // 7 AS d, o_custkey % 7 AS m, o_totalprice / 3 AS r, - o_custkey AS neg, o_custkey * 2 - 1 AS x FROM orders"),
    "division_edges": ("SELECT -7 / 2 AS a, 7 / 0 AS b, 7.0 / 0 AS c, 7 % 0 AS d, -7 % 3 AS e, 7.5 % 2 AS f, 9223372036854775807 + 1 AS g", "SELECT -3::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS c, NULL::BIGINT AS d, -1::BIGINT AS e, 1.0::DOUBLE AS f, 9223372036854775808.0::DOUBLE AS g"),
    "nan_result": ("SELECT 1e308 * 10 - 1e308 * 10 AS a, s_suppkey, s_acctbal * 0.0 + (1e308 * 10 - 1e308 * 10) AS b FROM supplier WHERE s_suppkey < 5", "SELECT NULL::DOUBLE AS a, s_suppkey, NULL::DOUBLE AS b FROM supplier WHERE s_suppkey < 5"),
    "shifts": ("SELECT 1 << 4 AS a, 1 << 64 AS b, -1 >> 70 AS c, 256 >> 4 AS d, 1 << -1 AS e, 8 >> -2 AS f, 6 & 3 AS g, 6 | 3 AS h, ~5 AS i", "SELECT 16::BIGINT AS a, 0::BIGINT AS b, -1::BIGINT AS c, 16::BIGINT AS d, 0::BIGINT AS e, 32::BIGINT AS f, 2::BIGINT AS g, 7::BIGINT AS h, -6::BIGINT AS i"),
    "concat": ("SELECT c_custkey, c_name || '/' || c_nationkey AS s, 'x' || NULL AS n FROM customer", "SELECT c_custkey, c_name || '/' || c_nationkey AS s, NULL::VARCHAR AS n FROM customer"),
    "text_arithmetic": ("SELECT '12abc' + 1 AS a, 'abc' * 2 AS b, '3' || 4 AS c, +'7' AS d", "SELECT 13.0::DOUBLE AS a, 0.0::DOUBLE AS b, '34' AS c, '7' AS d"),
    "fn_coalesce": ("SELECT coalesce(NULL, n_regionkey, 1) AS a, ifnull(NULL, n_name) AS b, nullif(n_regionkey, 2) AS c, n_nationkey FROM nation", "SELECT n_regionkey::BIGINT AS a, n_name AS b, nullif(n_regionkey, 2)::BIGINT AS c, n_nationkey FROM nation"),
    "fn_min_max": ("SELECT n_nationkey, max(n_nationkey, n_regionkey * 5, 3) AS hi, min(n_nationkey, 7) AS lo, max(1, NULL) AS n FROM nation", "SELECT n_nationkey, greatest(n_nationkey, n_regionkey * 5, 3)::BIGINT AS hi, least(n_nationkey, 7)::BIGINT AS lo, NULL::BIGINT AS n FROM nation"),
    "fn_string": ("SELECT p_partkey, upper(p_type) AS u, lower(p_brand) AS l, length(p_name) AS n, substr(p_name, 2, 3) AS s, substr(p_name, -3) AS e, replace(p_brand, '#', '-') AS r, trim('  x ') AS t, ltrim('xxa', 'x') AS lt, rtrim('abb', 'b') AS rt FROM part", "SELECT p_partkey, upper(p_type) AS u, lower(p_brand) AS l, length(p_name)::BIGINT AS n, substr(p_name, 2, 3) AS s, substr(p_name, -3) AS e, replace(p_brand, '#', '-') AS r, 'x' AS t, 'a' AS lt, 'a' AS rt FROM part"),
    "fn_substr_edges": ("SELECT substr('hello', 0, 2) AS a, substr('hello', -3, 2) AS b, substr('hello', 3, -2) AS c, substr('hello', 9) AS d, substr('hello', 2) AS e", "SELECT 'h' AS a, 'll' AS b, 'he' AS c, '' AS d, 'ello' AS e"),
    "fn_numeric": ("SELECT s_suppkey, abs(s_acctbal) AS a, round(s_acctbal) AS r0, round(s_acctbal, 1) AS r1 FROM supplier", None),
    "fn_typeof_quote": ("SELECT typeof(1) AS a, typeof(1.5) AS b, typeof('x') AS c, typeof(NULL) AS d, typeof(X'00') AS e, quote('it''s') AS f, quote(NULL) AS g, quote(5) AS h, quote(X'ab') AS i, hex('abc') AS j", "SELECT 'integer' AS a, 'real' AS b, 'text' AS c, 'null' AS d, 'blob' AS e, '''it''''s''' AS f, 'NULL' AS g, '5' AS h, 'X''AB''' AS i, '616263' AS j"),
    "fn_blob": ("SELECT length(zeroblob(5)) AS a, hex(zeroblob(2)) AS b, length(randomblob(7)) AS c, typeof(random()) AS d, soundex('Robert') AS e", "SELECT 5::BIGINT AS a, '0000' AS b, 7::BIGINT AS c, 'integer' AS d, 'R163' AS e"),
    "fn_date": ("SELECT o_orderkey, date(o_orderdate) AS d, date(o_orderdate, 'start of month') AS m, date(o_orderdate, '+10 days') AS p, strftime('%Y/%m', o_orderdate) AS f, date(o_orderdate, 'weekday 0') AS w FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS p, strftime(o_orderdate, '%Y/%m') AS f, strftime(o_orderdate + to_days(((7 - dayofweek(o_orderdate)) % 7)::INTEGER), '%Y-%m-%d') AS w FROM orders"),
    "fn_datetime": ("SELECT datetime('2004-01-31 10:20:30', '+1 month') AS a, time('2004-01-01 13:45:06') AS b, julianday('2000-01-01') AS c, strftime('%s', '1970-01-02') AS d, datetime(0, 'unixepoch') AS e, date(2451544.5) AS f, strftime('%w %j %W %H', '2004-02-29 07:08:09') AS g", "SELECT '2004-03-02 10:20:30' AS a, '13:45:06' AS b, 2451544.5::DOUBLE AS c, '86400' AS d, '1970-01-01 00:00:00' AS e, '2000-01-01' AS f, '0 060 08 07' AS g"),
    "fn_current": ("SELECT current_date = date('now') AS d, length(current_time) AS t, length(current_timestamp) AS ts, current_timestamp > '2020' AS later", "SELECT 1::BIGINT AS d, 8::BIGINT AS t, 19::BIGINT AS ts, 1::BIGINT AS later"),
    "fn_version": ("SELECT typeof(sqlite_version()) AS v, length(sqlite_source_id()) > 0 AS s, sqlite_compileoption_used('NONE') AS u", "SELECT 'text' AS v, 1::BIGINT AS s, 0::BIGINT AS u"),
    "events_by_hour": ("SELECT strftime('%H', ts) AS h, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY h, event_type", "SELECT strftime(ts, '%H') AS h, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2"),
    # benchmark workloads
    "workload_read": ("SELECT o_custkey, o_totalprice FROM orders WHERE o_orderkey = 4242", None),
    "workload_scan": ("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 1000 ORDER BY o_orderkey LIMIT 5", None),
    "workload_keys": ("SELECT o_orderkey FROM orders", None),
    "workload_join_sort": ("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' ORDER BY l_quantity DESC, o_orderkey, l_linenumber LIMIT 100", None),
}

#: name -> (statements that change managed tables, the query after them, DuckDB SQL)
CHANGES: dict[str, tuple[list[str], str, str]] = {
    "create_table_as": (["CREATE TABLE big AS SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000"], "SELECT o_orderkey, o_totalprice FROM big", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000"),
    "insert_values": (["CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT DEFAULT 'none', c REAL)", "INSERT INTO t (b, c) VALUES ('x', 1)", "INSERT INTO t (c) VALUES ('2.5')", "INSERT INTO t DEFAULT VALUES"], "SELECT a, b, c FROM t", "SELECT * FROM (VALUES (1::BIGINT, 'x', 1.0::DOUBLE), (2, 'none', 2.5), (3, 'none', NULL)) v(a, b, c)"),
    "insert_select": (["CREATE TABLE t (k INTEGER, v REAL)", "INSERT INTO t SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = 3"], "SELECT k, v FROM t", "SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_nationkey = 3"),
    "insert_or_ignore": (["CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT)", "INSERT INTO t SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10", "INSERT OR IGNORE INTO t SELECT n_nationkey, 'new' FROM nation WHERE n_nationkey < 15"], "SELECT k, v FROM t", "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey < 10 THEN n_name ELSE 'new' END AS v FROM nation WHERE n_nationkey < 15"),
    "replace_into": (["CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT)", "INSERT INTO t SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10", "REPLACE INTO t SELECT n_nationkey, 'new' FROM nation WHERE n_nationkey BETWEEN 5 AND 15"], "SELECT k, v FROM t", "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey < 5 THEN n_name ELSE 'new' END AS v FROM nation WHERE n_nationkey <= 15"),
    "update_where": (["UPDATE customer SET c_acctbal = c_acctbal + 100, c_mktsegment = upper('vip') WHERE c_acctbal < 0"], "SELECT c_custkey, round(c_acctbal, 2) AS b, c_mktsegment AS s FROM customer", "SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN c_acctbal + 100 ELSE c_acctbal END, 2) AS b, CASE WHEN c_acctbal < 0 THEN 'VIP' ELSE c_mktsegment END AS s FROM customer"),
    "delete_where": (["DELETE FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 250000"], "SELECT o_orderkey FROM orders", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 250000)"),
    "transfer_invariant": (["BEGIN", "UPDATE customer SET c_acctbal = c_acctbal - 50 WHERE c_custkey = 1", "UPDATE customer SET c_acctbal = c_acctbal + 50 WHERE c_custkey = 2", "COMMIT"], "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer", "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer"),
    "rollback": (["BEGIN", "DELETE FROM nation", "ROLLBACK"], "SELECT n_nationkey, n_name FROM nation", "SELECT n_nationkey, n_name FROM nation"),
    "savepoint": (["SAVEPOINT a", "DELETE FROM nation WHERE n_nationkey < 5", "SAVEPOINT b", "DELETE FROM nation", "ROLLBACK TO b", "RELEASE a"], "SELECT n_nationkey FROM nation", "SELECT n_nationkey FROM nation WHERE n_nationkey >= 5"),
    "view": (["CREATE VIEW rich AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000"], "SELECT count(*) AS n, round(avg(c_acctbal), 4) AS a FROM rich", "SELECT count(*) AS n, round(avg(c_acctbal), 4) AS a FROM customer WHERE c_acctbal > 9000"),
    "alter_table": (["CREATE TABLE t (a INTEGER)", "INSERT INTO t VALUES (1)", "ALTER TABLE t ADD COLUMN b TEXT DEFAULT 'd'", "ALTER TABLE t RENAME TO u", "INSERT INTO u VALUES (2, 'e')"], "SELECT a, b FROM u", "SELECT * FROM (VALUES (1::BIGINT, 'd'), (2, 'e')) v(a, b)"),
    "trigger_after": (["CREATE TABLE t (a INTEGER PRIMARY KEY, b INTEGER)", "CREATE TABLE log (what TEXT, was INTEGER, now INTEGER)", "CREATE TRIGGER tr AFTER UPDATE OF b ON t WHEN new.b > old.b BEGIN INSERT INTO log VALUES ('up', old.b, new.b); END", "INSERT INTO t SELECT n_nationkey, n_regionkey FROM nation", "UPDATE t SET b = b + 1 WHERE a < 3", "UPDATE t SET b = 0 WHERE a = 2"], "SELECT what, was, now FROM log", "SELECT 'up' AS what, n_regionkey::BIGINT AS was, (n_regionkey + 1)::BIGINT AS now FROM nation WHERE n_nationkey < 3"),
    "foreign_key_cascade": (["PRAGMA foreign_keys = ON", "CREATE TABLE p (id INTEGER PRIMARY KEY)", "CREATE TABLE c (id INTEGER PRIMARY KEY, p INTEGER REFERENCES p(id) ON DELETE CASCADE)", "INSERT INTO p SELECT r_regionkey FROM region", "INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation", "DELETE FROM p WHERE id IN (1, 2)"], "SELECT id, p FROM c", "SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS p FROM nation WHERE n_regionkey NOT IN (1, 2)"),
    "rowid": (["CREATE TABLE t (x TEXT)", "INSERT INTO t VALUES ('a')", "INSERT INTO t VALUES ('b')", "DELETE FROM t WHERE rowid = 1"], "SELECT rowid AS r, x FROM t", "SELECT 2::BIGINT AS r, 'b' AS x"),
    "in_table": (["CREATE TABLE keys AS SELECT c_custkey FROM customer WHERE c_nationkey = 7"], "SELECT o_orderkey FROM orders WHERE o_custkey IN keys", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)"),
    "pragma_catalog": (["CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT NOT NULL)", "CREATE INDEX i ON t (b)"], "SELECT type, name, tbl_name FROM sqlite_master WHERE name IN ('t', 'i')", "SELECT * FROM (VALUES ('table', 't', 't'), ('index', 'i', 't')) v(type, name, tbl_name)"),
    "ctas_rowids": (["CREATE TABLE big AS SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey"], "SELECT count(*) AS n, count(DISTINCT rowid) AS ids, min(rowid) AS lo, max(rowid) AS hi FROM big", "SELECT count(DISTINCT o_custkey) AS n, count(DISTINCT o_custkey) AS ids, 1::BIGINT AS lo, count(DISTINCT o_custkey) AS hi FROM orders"),
    "index_hint": (["CREATE INDEX by_cust ON orders (o_custkey)"], "SELECT o_orderkey FROM orders INDEXED BY by_cust WHERE o_custkey = 7", "SELECT o_orderkey FROM orders WHERE o_custkey = 7"),
    "fn_changes": (["CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT)", "INSERT INTO t SELECT n_nationkey + 1, n_name FROM nation", "UPDATE t SET b = 'x' WHERE a <= 4", "INSERT INTO t (b) VALUES ('y')", "DELETE FROM t WHERE a > 20"], "SELECT last_insert_rowid() AS r, changes() AS c, total_changes() AS t", "SELECT 26::BIGINT AS r, 6::BIGINT AS c, 36::BIGINT AS t"),
    "autoincrement": (["CREATE TABLE t (a INTEGER PRIMARY KEY AUTOINCREMENT, b TEXT)", "CREATE TABLE u (a INTEGER PRIMARY KEY, b TEXT)", "INSERT INTO t VALUES (7, 'x')", "INSERT INTO u VALUES (7, 'x')", "DELETE FROM t", "DELETE FROM u", "INSERT INTO t (b) VALUES ('y')", "INSERT INTO u (b) VALUES ('y')"], "SELECT t.a AS t, u.a AS u FROM t, u", "SELECT 8::BIGINT AS t, 1::BIGINT AS u"),
    "trigger_instead_of": (["CREATE TABLE base (k INTEGER PRIMARY KEY, v TEXT)", "INSERT INTO base SELECT r_regionkey, r_name FROM region", "CREATE VIEW shown AS SELECT k, v FROM base WHERE k < 4",
        "CREATE TRIGGER add_it INSTEAD OF INSERT ON shown BEGIN INSERT INTO base VALUES (new.k + 100, new.v); END", "CREATE TRIGGER set_it INSTEAD OF UPDATE ON shown BEGIN UPDATE base SET v = new.v || old.v WHERE k = old.k; END",
        "CREATE TRIGGER drop_it INSTEAD OF DELETE ON shown BEGIN DELETE FROM base WHERE k = old.k; END", "INSERT INTO shown VALUES (1, 'new')", "UPDATE shown SET v = 'x' WHERE k = 2", "DELETE FROM shown WHERE k IN (0, 4)"],
        "SELECT k, v FROM base", "SELECT r_regionkey::BIGINT AS k, CASE WHEN r_regionkey = 2 THEN 'x' || r_name ELSE r_name END AS v FROM region WHERE r_regionkey <> 0 UNION ALL SELECT 101, 'new'"),
    "trigger_insert_select": (["CREATE TABLE t (a INTEGER PRIMARY KEY, b INTEGER)", "CREATE TABLE log (a INTEGER, name TEXT)", "CREATE TRIGGER tr AFTER INSERT ON t WHEN new.b > 0 BEGIN INSERT INTO log SELECT new.a, n_name FROM nation WHERE n_regionkey = new.b; END", "INSERT INTO t SELECT r_regionkey, r_regionkey FROM region"],
        "SELECT a, name FROM log", "SELECT n_regionkey::BIGINT AS a, n_name AS name FROM nation WHERE n_regionkey > 0"),
    "foreign_key_set_null": (["PRAGMA foreign_keys = ON", "CREATE TABLE p (id INTEGER PRIMARY KEY)", "CREATE TABLE c (id INTEGER PRIMARY KEY, p INTEGER REFERENCES p(id) ON DELETE SET NULL)", "INSERT INTO p SELECT r_regionkey FROM region", "INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation", "DELETE FROM p WHERE id = 3"], "SELECT id, p FROM c", "SELECT n_nationkey::BIGINT AS id, nullif(n_regionkey, 3)::BIGINT AS p FROM nation"),
    "foreign_key_deferred": (["PRAGMA foreign_keys = ON", "CREATE TABLE p (id INTEGER PRIMARY KEY)", "CREATE TABLE c (id INTEGER PRIMARY KEY, p INTEGER REFERENCES p(id) DEFERRABLE INITIALLY DEFERRED)", "BEGIN", "INSERT INTO c VALUES (1, 9)", "INSERT INTO p VALUES (9)", "COMMIT"], "SELECT c.id AS c, p.id AS p FROM c JOIN p ON c.p = p.id", "SELECT 1::BIGINT AS c, 9::BIGINT AS p"),
    "pragma_table_info": (["CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT NOT NULL, c REAL DEFAULT 2)"], "PRAGMA table_info(t)", "SELECT * FROM (VALUES (0::BIGINT, 'a', 'INTEGER', 0::BIGINT, NULL, 1::BIGINT), (1, 'b', 'TEXT', 1, NULL, 0), (2, 'c', 'REAL', 0, '2', 0)) v(cid, name, type, \"notnull\", dflt_value, pk)"),
    "pragma_foreign_keys": (["PRAGMA foreign_keys = ON"], "PRAGMA foreign_keys", "SELECT 1::BIGINT AS foreign_keys"),
    "vacuum_analyze": (["CREATE TABLE t AS SELECT n_nationkey AS k FROM nation", "INSERT INTO t VALUES (99)", "DELETE FROM t WHERE k < 5", "VACUUM", "ANALYZE t"], "SELECT tbl, stat FROM sqlite_stat1", "SELECT 't' AS tbl, (count(*) - 4)::VARCHAR AS stat FROM nation"),
    "virtual_module": (["CREATE VIRTUAL TABLE s USING series(1, 1000)"], "SELECT value FROM s WHERE value > 990", "SELECT range::BIGINT AS value FROM range(991, 1001)"),
    "workload_update": (["CREATE TABLE usertable (userid INTEGER PRIMARY KEY, f TEXT)", "INSERT INTO usertable SELECT o_orderkey, o_orderpriority || 'x' FROM orders", "UPDATE OR FAIL usertable SET f = upper(f) WHERE userid = 77"], "SELECT userid, f FROM usertable", "SELECT o_orderkey AS userid, CASE WHEN o_orderkey = 77 THEN upper(o_orderpriority || 'x') ELSE o_orderpriority || 'x' END AS f FROM orders"),
    "workload_insert": (["CREATE TABLE usertable (userid INTEGER PRIMARY KEY, f TEXT)", "INSERT OR REPLACE INTO usertable SELECT o_orderkey, o_orderstatus FROM orders", "INSERT OR REPLACE INTO usertable (userid, f) VALUES (5, 'new')", "INSERT INTO usertable (f) VALUES ('last')", "DELETE FROM usertable WHERE userid = 6"], "SELECT userid, f FROM usertable",
        "SELECT o_orderkey AS userid, CASE WHEN o_orderkey = 5 THEN 'new' ELSE o_orderstatus END AS f FROM orders WHERE o_orderkey <> 6 UNION ALL SELECT max(o_orderkey) + 1, 'last' FROM orders"),
    "workload_transaction": (["CREATE TABLE usertable (userid INTEGER PRIMARY KEY, f INTEGER)", "INSERT INTO usertable SELECT c_custkey, c_nationkey FROM customer", "BEGIN", "UPDATE usertable SET f = (SELECT f FROM usertable WHERE userid = 2) + (SELECT f FROM usertable WHERE userid = 3) WHERE userid = 1", "COMMIT"], "SELECT userid, f FROM usertable WHERE userid >= 1 ORDER BY userid LIMIT 10",
        "SELECT c_custkey AS userid, CASE WHEN c_custkey = 1 THEN (SELECT sum(c_nationkey) FROM customer WHERE c_custkey IN (2, 3)) ELSE c_nationkey END::BIGINT AS f FROM customer WHERE c_custkey >= 1 ORDER BY c_custkey LIMIT 10"),
}
