"""Relational queries over the star schema and the event table.

Each is declared as SQL over named tables ({orders} stands for the table's DataFrame), so Catalyst prunes, pushes down
and picks the joins. Where the independent engine's dialect differs, its text is given beside ours. Money is summed as
decimals: sums of doubles depend on their order, which a distributed plan does not fix.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query callable for SQL text with {table} placeholders."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{n: read(spark, sf_dir, n) for n in names})

    return run


def bucket_case_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day: rows, purchase value by SUM(CASE), clicks by COUNT(CASE), and purchases less errors."""
    e = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    value = F.col("value").cast("decimal(18,4)")
    bought, failed = F.sum(F.when(kind == "purchase", value).otherwise(0)), F.sum(F.when(kind == "error", value).otherwise(0))
    return e.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("bucket")).agg(
        F.count("*").alias("n"), bought.cast("double").alias("purchase_value"), F.count(F.when(kind == "click", 1)).alias("clicks"), (bought - failed).cast("double").alias("net_value")
    )


#: Queries whose text both engines take.
SAME = {
    # filters
    "filter_eq_in_null": """
        SELECT o_orderkey, o_orderstatus, o_orderpriority FROM {orders}
        WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IS NOT NULL""",
    "filter_between_like_ilike": """
        SELECT p_partkey, p_name, p_type FROM {part}
        WHERE p_size BETWEEN 5 AND 25 AND p_name LIKE '%a%' AND p_type ILIKE '%e%' AND p_name NOT LIKE 'z%'""",
    "filter_or_not": """
        SELECT c_custkey, c_mktsegment, c_acctbal FROM {customer}
        WHERE (c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND NOT (c_nationkey = 3)""",
    "filter_compare_ops": """
        SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem}
        WHERE l_quantity >= 10 AND l_quantity < 40 AND l_discount <> 0.05 AND l_tax > 0.01 AND l_linenumber <= 5
          AND l_quantity NOT BETWEEN 20 AND 30 AND l_returnflag NOT IN ('A') AND l_shipdate IS NOT NULL""",
    # joins
    "join_inner": """
        SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
        WHERE o.o_totalprice > 100000""",
    "join_left": """
        SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM {customer} c
        LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey""",
    "join_right": """
        SELECT n.n_name, s.s_name FROM {supplier} s RIGHT JOIN {nation} n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000""",
    "join_full": """
        SELECT c.k AS indebted, o.k AS ordering FROM (SELECT c_custkey AS k FROM {customer} WHERE c_acctbal < 0) c
        FULL JOIN (SELECT DISTINCT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F') o ON c.k = o.k""",
    "join_cross_small": "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n WHERE r.r_regionkey < n.n_regionkey",
    "join_using": """
        SELECT k, a.x, b.y FROM (SELECT c_nationkey AS k, count(*) AS x FROM {customer} GROUP BY c_nationkey) a
        JOIN (SELECT s_nationkey AS k, count(*) AS y FROM {supplier} GROUP BY s_nationkey) b USING (k)""",
    "join_theta_range": """
        SELECT s.s_suppkey, count(*) AS richer FROM {supplier} s JOIN {customer} c
        ON c.c_nationkey = s.s_nationkey AND c.c_acctbal > s.s_acctbal AND (c.c_mktsegment <> 'MACHINERY' OR s.s_acctbal IS NULL)
        GROUP BY s.s_suppkey""",
    "join_semi_in": """
        SELECT c_custkey, c_name FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000)""",
    "join_semi_exists": """
        SELECT s_suppkey, s_name FROM {supplier} s
        WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey AND l.l_returnflag = 'R')""",
    "join_anti_not_exists": """
        SELECT p_partkey FROM {part} p
        WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)""",
    "join_anti_not_in": """
        SELECT n_nationkey, n_name FROM {nation}
        WHERE n_nationkey NOT IN (SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 9000 AND s_nationkey IS NOT NULL)""",
    "join_multi_star": """
        SELECT r.r_name, p.p_brand, count(*) AS n, CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS revenue
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
        JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
        JOIN {part} p ON l.l_partkey = p.p_partkey
        WHERE o.o_orderstatus <> 'P' GROUP BY r.r_name, p.p_brand""",
    "join_self_alias": """
        SELECT a.n_name AS left_name, b.n_name AS right_name FROM {nation} a JOIN {nation} b
        ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""",
    # aggregates
    "agg_basic": """
        SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_tax) AS n_tax,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS sum_qty,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) / count(l_quantity) AS avg_qty,
               min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price
        FROM {lineitem} GROUP BY l_returnflag, l_linestatus""",
    "agg_distinct": """
        SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, count(*) AS n
        FROM {lineitem} GROUP BY l_returnflag""",
    "agg_sum_distinct": "SELECT p_brand, CAST(sum(DISTINCT p_size) AS BIGINT) AS sum_sizes, count(DISTINCT p_type) AS types FROM {part} GROUP BY p_brand",
    "agg_stats": """
        SELECT event_type, round(stddev(value), 6) AS sd, round(stddev_pop(value), 6) AS sd_pop, round(stddev_samp(value), 6) AS sd_samp,
               round(variance(value), 4) AS v, round(var_pop(value), 4) AS v_pop, round(var_samp(value), 4) AS v_samp
        FROM {events} GROUP BY event_type""",
    "agg_bool": """
        SELECT user_id, bool_and(value >= 0) AS all_positive, bool_or(event_type = 'error') AS any_error
        FROM {events} GROUP BY user_id""",
    "agg_case_in_and": """
        SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' AND o_custkey IN (1, 2, 3, 5, 8, 13, 21) THEN 1 ELSE 0 END) AS BIGINT) AS picked,
               count(CASE WHEN o_orderstatus IN ('O', 'P') THEN 1 END) AS not_final,
               CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,4)) ELSE 0 END) AS DOUBLE) AS open_value
        FROM {orders} GROUP BY o_orderpriority""",
    "agg_composition_net": """
        SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,4))) - sum(CASE WHEN event_type = 'error' THEN CAST(value AS DECIMAL(18,4)) ELSE 0 END)
               - (sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) - sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)) AS DOUBLE) AS net
        FROM {events} GROUP BY user_id""",
    "agg_filter_clause": """
        SELECT event_type, count(*) FILTER (WHERE value > 20) AS big, count(*) FILTER (WHERE value <= 20) AS small FROM {events} GROUP BY event_type""",
    # grouping
    "group_positional": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY 1, 2",
    "group_alias_expr": "SELECT o_custkey % 10 AS d, count(*) AS n FROM {orders} GROUP BY d",
    "group_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "group_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "group_grouping_sets": """
        SELECT p_brand, p_size, count(*) AS n FROM {part} GROUP BY GROUPING SETS ((p_brand), (p_size), ())""",
    "group_having": "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) >= 3",
    "group_function": "SELECT lower(event_type) AS kind, CAST(length(props) AS BIGINT) AS width, count(*) AS n FROM {events} GROUP BY lower(event_type), length(props)",
    "distinct_rows": "SELECT DISTINCT c_mktsegment, c_nationkey FROM {customer}",
    "distinct_function": "SELECT DISTINCT lower(p_brand) AS brand FROM {part}",
    # windows
    "win_rank": """
        SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn,
               CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk,
               CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS drk
        FROM {orders}""",
    "win_running_frame": """
        SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last3,
               count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen
        FROM {events}""",
    "win_ntile_first_last": """
        SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS quarter,
               first_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS poorest
        FROM {customer}""",
    "win_named": """
        SELECT s_suppkey, CAST(row_number() OVER w AS BIGINT) AS rn, count(*) OVER (PARTITION BY s_nationkey) AS in_nation FROM {supplier}
        WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)""",
    # time
    "time_range_between": """
        SELECT event_id, ts FROM {events} WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-07 12:00:00'""",
    "time_range_literal": "SELECT event_id FROM {events} WHERE ts > TIMESTAMP '2024-01-28 00:00:00' AND event_type = 'signup'",
    # strings, maths
    "string_functions": """
        SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, CAST(length(c_name) AS BIGINT) AS len, substring(c_name, 1, 4) AS head,
               concat(c_name, '/', c_mktsegment) AS both, replace(c_name, '0', 'o') AS swapped, trim(concat('  ', c_mktsegment, ' ')) AS trimmed
        FROM {customer}""",
    "math_expressions": """
        SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_quantity AS DECIMAL(18,4)) AS DOUBLE) AS product,
               abs(l_discount - l_tax) AS gap, CAST(floor(l_extendedprice) AS BIGINT) AS whole, CAST(ceil(l_quantity / 7) AS BIGINT) AS weeks, l_orderkey % 7 AS m
        FROM {lineitem}""",
    # sorting
    "sort_topk": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "limit_offset": "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal ASC, c_custkey LIMIT 20 OFFSET 15",
    "sort_nulls_last": """
        SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000
        ORDER BY o.o_orderkey DESC NULLS LAST, c.c_custkey LIMIT 25""",
    "topk_per_group": """
        SELECT p_brand, p_partkey, rn FROM (
            SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS rn FROM {part}) ranked
        WHERE rn <= 3""",
    # sets
    "set_union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey AS k FROM {supplier}",
    "set_union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}",
    "set_intersect": "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey AS k FROM {supplier}",
    "set_except": "SELECT p_partkey AS k FROM {part} EXCEPT SELECT l_partkey AS k FROM {lineitem} WHERE l_quantity > 45",
    "set_except_all": "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey AS k FROM {supplier}",
    # subqueries, CTEs
    "sub_scalar_select": """
        SELECT n.n_name, (SELECT count(*) FROM {customer} c WHERE c.c_nationkey = n.n_nationkey) AS customers FROM {nation} n""",
    "sub_derived": """
        SELECT d.k, count(*) AS n FROM (SELECT o_custkey AS k, count(*) AS c FROM {orders} GROUP BY o_custkey) d
        JOIN (SELECT c_custkey AS k FROM {customer} WHERE c_acctbal > 0) e ON d.k = e.k WHERE d.c > 2 GROUP BY d.k""",
    "cte_chain": """
        WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} WHERE o_totalprice > 150000 GROUP BY o_custkey),
             named AS (SELECT c.c_name, b.n FROM big b JOIN {customer} c ON b.o_custkey = c.c_custkey)
        SELECT n, count(*) AS customers FROM named GROUP BY n""",
    "cte_recursive": """
        WITH RECURSIVE days(d) AS (SELECT 1 UNION ALL SELECT d + 1 FROM days WHERE d < 31)
        SELECT days.d, count(e.event_id) AS n FROM days LEFT JOIN {events} e ON day(e.ts) = days.d AND e.event_type = 'purchase' GROUP BY days.d""",
}

#: Queries whose texts differ: ours, the independent engine's.
PAIRS = {
    "agg_list_string": (
        "SELECT r_name, array_join(array_sort(collect_list(n_name)), ',') AS names, to_json(array_sort(collect_list(n_nationkey))) AS keys FROM {nation} JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name",
        "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS names, CAST(to_json(list(n_nationkey ORDER BY n_nationkey)) AS VARCHAR) AS keys FROM {nation} JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "agg_every": (
        "SELECT o_orderstatus, every(o_totalprice > 1000) AS all_big FROM {orders} GROUP BY o_orderstatus",
        "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS all_big FROM {orders} GROUP BY o_orderstatus",
    ),
    "distinct_on_latest": (
        "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM {orders}) t WHERE rn = 1",
        "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM {orders} ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC",
    ),
    "win_lag_lead": (
        "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after2, unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(CAST(lag(ts) OVER w AS TIMESTAMP)) AS gap_us FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
        "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after2, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_us FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    ),
    "win_range_frame": (
        "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY unix_seconds(CAST(ts AS TIMESTAMP)) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_hour FROM {events}",
        "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_hour FROM {events}",
    ),
    "time_bucket_hour": (
        "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS bucket, event_type, count(*) AS n FROM {events} GROUP BY 1, 2",
        "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, event_type, count(*) AS n FROM {events} GROUP BY 1, 2",
    ),
    "time_bucket_units": (
        "SELECT CAST(date_trunc('week', o_orderdate) AS TIMESTAMP_NTZ) AS week, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS month, count(*) AS n FROM {orders} GROUP BY 1, 2",
        "SELECT CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS week, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS n FROM {orders} GROUP BY 1, 2",
    ),
    "time_sliding_fixed_now": (
        "SELECT user_id, count(*) AS n FROM {events} WHERE ts >= TIMESTAMP_NTZ '2024-01-20 00:00:00' - INTERVAL '36 hours' AND ts < TIMESTAMP_NTZ '2024-01-20 00:00:00' GROUP BY user_id",
        "SELECT user_id, count(*) AS n FROM {events} WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL '36 hours' AND ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY user_id",
    ),
    "time_hop_window": (
        "SELECT CAST(window.start AS TIMESTAMP_NTZ) AS start, event_type, count(*) AS n FROM {events} GROUP BY window(ts, '6 hours', '3 hours'), event_type",
        "SELECT start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL '3 hours', ts) - to_hours(3 * k) AS start, event_type FROM {events}, (VALUES (0), (1)) s(k)) t GROUP BY 1, 2",
    ),
    "time_extract": (
        "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, CAST(extract(DOW FROM ts) - 1 AS INT) AS dow, quarter(ts) AS q FROM {events}",
        "SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(day(ts) AS INT) AS d, CAST(hour(ts) AS INT) AS h, CAST(extract(dow FROM ts) AS INT) AS dow, CAST(quarter(ts) AS INT) AS q FROM {events}",
    ),
    "time_session_gaps": (
        "SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT user_id, ts, event_id, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '6 hours' THEN 1 ELSE 0 END AS fresh FROM {events}) a) b GROUP BY user_id, session",
        "SELECT user_id, session, count(*) AS n FROM (SELECT user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT user_id, ts, event_id, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '6 hours' THEN 1 ELSE 0 END AS fresh FROM {events}) a) b GROUP BY user_id, session",
    ),
    "json_path_text": (
        "SELECT event_id, get_json_object(props, '$.k') AS k, get_json_object(props, '$.missing') AS missing FROM {events}",
        "SELECT event_id, props->>'$.k' AS k, props->>'$.missing' AS missing FROM {events}",
    ),
    "json_path_filter_agg": (
        "SELECT event_type, count(*) AS n, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS total FROM {events} WHERE CAST(get_json_object(props, '$.k') AS INT) > 50 GROUP BY event_type",
        "SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total FROM {events} WHERE CAST(props->>'$.k' AS INT) > 50 GROUP BY event_type",
    ),
    # the two highest prices of a customer (pruned before the shuffle) answer "the highest of the others" for every order
    "sub_scalar_correlated": (
        "WITH ranked AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}), top AS (SELECT o_custkey, max(CASE WHEN rn = 1 THEN o_orderkey END) AS best_key, max(CASE WHEN rn = 1 THEN o_totalprice END) AS best, max(CASE WHEN rn = 2 THEN o_totalprice END) AS second FROM ranked WHERE rn <= 2 GROUP BY o_custkey) SELECT o.o_orderkey, o.o_totalprice FROM {orders} o JOIN top t ON o.o_custkey = t.o_custkey WHERE o.o_totalprice > (CASE WHEN o.o_orderkey = t.best_key THEN t.second ELSE t.best END) * 0.9",
        "SELECT o.o_orderkey, o.o_totalprice FROM {orders} o WHERE o.o_totalprice > (SELECT max(i.o_totalprice) * 0.9 FROM {orders} i WHERE i.o_custkey = o.o_custkey AND i.o_orderkey <> o.o_orderkey)",
    ),
    "array_functions": (
        "SELECT n_regionkey, array_join(array_append(ks, 99), ',') AS appended, array_join(array_prepend(ks, -1), ',') AS prepended, array_join(concat(ks, array(7, 8)), ',') AS joined, array_join(array_remove(ks, 3), ',') AS removed, array_join(transform(ks, x -> CASE WHEN x = 4 THEN 40 ELSE x END), ',') AS replaced, size(ks) AS n, concat('[1:', size(ks), ']') AS dims, 1 AS low, size(ks) AS high FROM (SELECT n_regionkey, array_sort(collect_list(n_nationkey)) AS ks FROM {nation} GROUP BY n_regionkey) t",
        "SELECT n_regionkey, array_to_string(list_append(ks, 99), ',') AS appended, array_to_string(list_prepend(-1, ks), ',') AS prepended, array_to_string(list_concat(ks, [7, 8]), ',') AS joined, array_to_string(list_filter(ks, lambda x: x <> 3), ',') AS removed, array_to_string(list_transform(ks, lambda x: CASE WHEN x = 4 THEN 40 ELSE x END), ',') AS replaced, CAST(len(ks) AS INT) AS n, concat('[1:', len(ks), ']') AS dims, 1 AS low, CAST(len(ks) AS INT) AS high FROM (SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS ks FROM {nation} GROUP BY n_regionkey) t",
    ),
    "array_unnest_embedding": (
        "SELECT label, pos, count(*) AS n, CAST(sum(CAST(x AS DECIMAL(12,6))) AS DOUBLE) AS total FROM (SELECT label, posexplode(embedding) AS (pos, x) FROM {embeddings}) t GROUP BY label, pos",
        "SELECT label, CAST(pos - 1 AS INT) AS pos, count(*) AS n, CAST(sum(CAST(x AS DECIMAL(12,6))) AS DOUBLE) AS total FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM {embeddings}) t GROUP BY label, pos",
    ),
    "map_functions": (
        "SELECT o_custkey, array_join(array_sort(map_keys(m)), ',') AS statuses, coalesce(m['F'], 0) AS finished FROM (SELECT o_custkey, map_from_entries(collect_list(struct(o_orderstatus, n))) AS m FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_custkey, o_orderstatus) a GROUP BY o_custkey) b",
        "SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN n END), 0) AS BIGINT) AS finished FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_custkey, o_orderstatus) a GROUP BY o_custkey",
    ),
}


#: Statements in the PostgreSQL dialect, run through its printer, and the independent engine's text. For INSERT, UPDATE
#: and DELETE the result is the table that the statement leaves.
PRINTED = {
    "json_key_exists": (
        "SELECT event_type, count(*) AS n FROM events WHERE props ? 'k' AND NOT props ? 'z' GROUP BY event_type",
        "SELECT event_type, count(*) AS n FROM events WHERE json_exists(props, '$.k') AND NOT json_exists(props, '$.z') GROUP BY event_type",
    ),
    "json_any_all_keys": (
        "SELECT count(*) AS n FROM events WHERE props ?| ARRAY['z', 'k'] AND NOT props ?& ARRAY['k', 'z']",
        "SELECT count(*) AS n FROM events WHERE (json_exists(props, '$.k') OR json_exists(props, '$.z')) AND NOT (json_exists(props, '$.k') AND json_exists(props, '$.z'))",
    ),
    "json_containment": (
        "SELECT event_id, event_type FROM events WHERE props @> '{\"k\": 69}' OR '{\"k\": 7}' @> props",
        "SELECT event_id, event_type FROM events WHERE json_contains(props, '{\"k\": 69}') OR json_contains('{\"k\": 7}', props)",
    ),
    "json_path_list": (
        "SELECT event_id, props #>> '{k}' AS k, props #>> '{k,z}' AS deeper FROM events WHERE (props->>'k')::int < 50",
        "SELECT event_id, props->>'$.k' AS k, props->>'$.k.z' AS deeper FROM events WHERE CAST(props->>'$.k' AS INT) < 50",
    ),
    "dml_insert_select": (
        "INSERT INTO customer (c_custkey, c_name) SELECT s_suppkey + 1000000, s_name FROM supplier WHERE s_acctbal > 0",
        "SELECT * FROM customer UNION ALL SELECT s_suppkey + 1000000, s_name, NULL, NULL, NULL FROM supplier WHERE s_acctbal > 0",
    ),
    "dml_update_from": (
        "UPDATE customer SET c_mktsegment = 'moved ' || n.n_name, c_acctbal = 0.0 FROM nation n WHERE customer.c_nationkey = n.n_nationkey AND n.n_regionkey = 2",
        "SELECT c_custkey, c_name, c_nationkey, CASE WHEN hit THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN hit THEN 'moved ' || n_name ELSE c_mktsegment END AS c_mktsegment FROM (SELECT *, coalesce(n_regionkey = 2, false) AS hit FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey) t",
    ),
    "dml_delete_using": (
        "DELETE FROM orders USING customer c WHERE orders.o_custkey = c.c_custkey AND c.c_acctbal < 0",
        "SELECT * FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE o.o_custkey = c.c_custkey AND c.c_acctbal < 0)",
    ),
}


def printed(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query callable for a PostgreSQL statement over the tables that it names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tideline.functions import analyze
        from tideline.functions.sqlparse import parse
        from tideline.plans import dialect

        return dialect.run(spark, text, **{n: read(spark, sf_dir, n) for n in analyze.tables(parse(text))["base"]})

    return run


def _plain(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text).replace("{{", "{").replace("}}", "}")


QUERIES = {"bucket_case_agg": bucket_case_agg, **{k: sql_query(v) for k, v in SAME.items()}, **{k: sql_query(v[0]) for k, v in PAIRS.items()}, **{k: printed(v[0]) for k, v in PRINTED.items()}}
ORACLES = {
    "bucket_case_agg": """
        SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, count(*) AS n,
               sum(CASE WHEN event_type = 'purchase' THEN value::DECIMAL(18,4) ELSE 0 END)::DOUBLE AS purchase_value,
               count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks,
               (sum(CASE WHEN event_type = 'purchase' THEN value::DECIMAL(18,4) ELSE 0 END)
                - sum(CASE WHEN event_type = 'error' THEN value::DECIMAL(18,4) ELSE 0 END))::DOUBLE AS net_value
        FROM events GROUP BY 1""",
    **{k: _plain(v) for k, v in SAME.items()},
    **{k: _plain(v[1]) for k, v in PAIRS.items()},
    **{k: v[1] for k, v in PRINTED.items()},
}
