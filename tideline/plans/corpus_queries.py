"""Queries over a small corpus of SQL texts, with the expected values written out as literal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.intervals import interval_micros
from tideline.operators.corpus import analyzed

CORPUS = {
    "q01": "SELECT id, name FROM users WHERE active = true AND email ILIKE '%@example.com'",
    "q02": "SELECT u.name, COUNT(*) AS n FROM users u JOIN orders o ON u.id = o.user_id WHERE o.status IN ('paid', 'sent') GROUP BY u.name",
    "q03": "SELECT date_trunc('hour', created_at) AS bucket, SUM(amount) FROM orders GROUP BY 1",
    "q04": "SELECT merchant_id, SUM(CASE WHEN type = 'charge' THEN amount ELSE 0 END) - SUM(CASE WHEN type = 'refund' THEN amount ELSE 0 END) AS net FROM transactions GROUP BY merchant_id",
    "q05": "SELECT COUNT(*) FROM events WHERE ts > NOW() - INTERVAL '1 hour' AND status = 'ok'",
    "q06": "SELECT data->'address'->>'city' AS city, profile #>> '{a,b}' FROM users WHERE data->>'zip' = '123'",
    "q07": "WITH recent AS (SELECT user_id FROM orders WHERE created_at BETWEEN '2024-01-01' AND '2024-02-01') SELECT r.user_id FROM recent r LEFT JOIN users u ON u.id = r.user_id AND u.region = r.region",
    "q08": "SELECT DISTINCT ON (user_id) user_id, amount FROM payments ORDER BY user_id, amount DESC",
    "q09": "SELECT name, RANK() OVER (PARTITION BY dept ORDER BY salary DESC) FROM employees",
    "q10": "INSERT INTO archive SELECT * FROM orders WHERE priority > 5",
    "q11": "UPDATE orders SET status = 'x' FROM users WHERE orders.user_id = users.id",
    "q12": "DELETE FROM sessions USING users WHERE sessions.user_id = users.id AND users.active = false",
    "q13": "SELECT category, region, COUNT(DISTINCT user_id) FROM sales GROUP BY ROLLUP (category, region)",
    "q14": "SELECT id FROM a UNION ALL SELECT id FROM b WHERE id NOT IN (SELECT id FROM c)",
    "q15": "SELECT user_id * 2 AS d, lower(email) FROM users GROUP BY d, lower(email), user_id",
    "q16": "SELECT FROM WHERE",
    "q17": "SELECT * FROM metrics WHERE CURRENT_TIMESTAMP - '7 days'::interval <= metrics.ts AND value > 3 ORDER BY ts LIMIT 10 OFFSET 5",
    "q18": "SELECT array_agg(name), unnest(tags) FROM items WHERE tags @> '{\"a\": 1}' AND meta ? 'k'",
}


def corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(CORPUS.items()), "query_id string, sql string")


def _values(columns: str, rows: list[tuple]) -> str:
    """DuckDB SQL of literal rows."""

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    names = [c.split(":")[0].strip() for c in columns.split(",")]
    kinds = [c.split(":")[1].strip() for c in columns.split(",")]
    picked = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(names, kinds))
    return f"SELECT {picked} FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({', '.join(names)})"


def _joined(column: str):
    return F.array_join(column, ",")


def sql_corpus_tables(spark, sf_dir):
    found = analyzed(corpus(spark), "tables", "metadata")
    return found.select("query_id", _joined("tables.base").alias("tables"), _joined("tables.ctes").alias("ctes"), F.col("metadata.operation").alias("operation"), F.col("error").isNull().alias("valid"))


def sql_corpus_metadata(spark, sf_dir):
    m = F.col("metadata")
    found = analyzed(corpus(spark), "metadata").where("error is null")
    return found.select(
        "query_id", _joined("metadata.aggregations").alias("aggregations"), m["is_aggregate"].alias("is_aggregate"), m["has_distinct"].alias("has_distinct"), m["has_subquery"].alias("has_subquery"),
        m["has_window_functions"].alias("has_windows"), m["has_ctes"].alias("has_ctes"), _joined("metadata.database_operations").alias("database_operations"), m["is_deterministic"].alias("is_deterministic"), m["limit"].alias("row_limit"), m["offset"].alias("row_offset"),
    )


def sql_corpus_filters(spark, sf_dir):
    found = analyzed(corpus(spark), "filters").select("query_id", F.explode("filters").alias("f"))
    return found.select("query_id", F.col("f.column.column").alias("col"), F.col("f.operator").alias("op"), F.col("f.value").alias("val"))


def sql_corpus_joins(spark, sf_dir):
    found = analyzed(corpus(spark), "joins").select("query_id", F.explode("joins").alias("j"))
    return found.select("query_id", F.col("j.type").alias("kind"), "j.left_table", "j.right_table", "j.left_column", "j.right_column", F.col("j.on_expr").alias("on_expr"))


def sql_corpus_groupby(spark, sf_dir):
    found = analyzed(corpus(spark), "group_items").select("query_id", F.posexplode("group_items").alias("pos", "g"))
    return found.select("query_id", "pos", "g.kind", F.col("g.column").alias("col"), F.col("g.alias").alias("alias"), F.col("g.position").alias("position"), F.col("g.raw_expr").alias("expr"))


def sql_corpus_aggregates(spark, sf_dir):
    found = analyzed(corpus(spark), "aggregates").select("query_id", F.explode("aggregates").alias("a"))
    return found.select("query_id", "a.func", F.col("a.column").alias("col"), F.col("a.alias").alias("alias"), F.col("a.distinct").alias("is_distinct"))


def sql_corpus_compositions(spark, sf_dir):
    found = analyzed(corpus(spark), "compositions").select("query_id", F.explode("compositions").alias("c")).select("query_id", "c.alias", F.posexplode("c.terms").alias("pos", "t"))
    return found.select("query_id", "alias", "pos", "t.sign", "t.func", F.col("t.column").alias("col"), F.col("t.case").alias("cond"))


def sql_corpus_temporal(spark, sf_dir):
    found = analyzed(corpus(spark), "temporal", "time_bucket", "sliding_window").where("temporal.has_now or temporal.has_date_trunc or size(temporal.where_ranges) > 0")
    first = F.try_element_at("temporal.where_ranges", F.lit(1))
    return found.select(
        "query_id", F.col("temporal.has_now").alias("has_now"), F.col("temporal.has_date_trunc").alias("has_trunc"), first["kind"].alias("kind"), first["column"].alias("col"), first["operator"].alias("op"),
        F.col("time_bucket.interval").alias("bucket"), F.col("sliding_window.duration_us").alias("window_us"), F.col("sliding_window.operator").alias("window_op"),
    )


def sql_corpus_jsonpaths(spark, sf_dir):
    found = analyzed(corpus(spark), "json_paths").select("query_id", F.explode("json_paths").alias("j"))
    return found.select("query_id", F.col("j.table").alias("tbl"), F.col("j.column").alias("col"), F.array_join("j.path", ".").alias("path"), F.col("j.operator").alias("op"), F.col("j.is_text").alias("is_text"))


VARIANTS = [
    ("a1", "SELECT id FROM users WHERE age > 18 AND name = 'x'"),
    ("a2", "select id  from users\nwhere age > 65 and name = 'it''s' -- note"),
    ("b1", "SELECT id FROM users WHERE age IN (1, 2, 3)"),
    ("b2", "SELECT id FROM users WHERE age IN (7);"),
    ("c1", "SELECT id FROM orders WHERE age > 18 AND name = 'x'"),
    ("d1", "SELECT email FROM users WHERE age > 18 AND name = 'x'"),
]


def sql_normalize_fingerprint(spark, sf_dir):
    """Classes of texts with equal fingerprints, by their smallest id, and the normalised texts."""
    found = analyzed(spark.createDataFrame(VARIANTS, "query_id string, sql string"), "normalized", "fingerprint")
    first = found.groupBy("fingerprint").agg(F.min("query_id").alias("class"))
    return found.join(first, "fingerprint").select("query_id", "class", F.lower("normalized").alias("normalized"))


INTERVALS = {
    "interval '2 hours'": 7200000000, "'3 days'::interval": 259200000000, '"6 hours"::interval': 21600000000, "make_interval(days => 2, hours => 6)": 194400000000,
    "PT50M": 3000000000, "'P2DT3H15M'::interval": 184500000000, "interval 'PT4H'": 14400000000, "-2 days 1 hour": -176400000000, "2 days -1 hour": 169200000000, "0.5 hours": 1800000000,
    "3 weeks": 1814400000000, "2 months": 5184000000000, "2 years 1 mon": 65664000000000, "45 secs": 45000000, "125 milliseconds": 125000, "-P2D": -172800000000,
    "make_interval(secs => 2.5)": 2500000, "make_interval(moons => 1)": None, "": None, "day": None, "2 parsecs": None, "make_interval()": None, "PT": None,
}


def interval_parse_table(spark, sf_dir):
    rows = spark.createDataFrame([(t,) for t in INTERVALS], "expr string")
    return rows.select("expr", interval_micros(F.col("expr")).alias("micros"))


QUERIES = {f.__name__: f for f in (sql_corpus_tables, sql_corpus_metadata, sql_corpus_filters, sql_corpus_joins, sql_corpus_groupby, sql_corpus_aggregates, sql_corpus_compositions, sql_corpus_temporal, sql_corpus_jsonpaths, sql_normalize_fingerprint, interval_parse_table)}

T, N = True, False
ORACLES = {
    "sql_corpus_tables": _values("query_id:VARCHAR, tables:VARCHAR, ctes:VARCHAR, operation:VARCHAR, valid:BOOLEAN", [
        ("q01", "users", "", "SELECT", T), ("q02", "orders,users", "", "SELECT", T), ("q03", "orders", "", "SELECT", T), ("q04", "transactions", "", "SELECT", T), ("q05", "events", "", "SELECT", T),
        ("q06", "users", "", "SELECT", T), ("q07", "orders,users", "recent", "SELECT", T), ("q08", "payments", "", "SELECT", T), ("q09", "employees", "", "SELECT", T), ("q10", "archive,orders", "", "INSERT", T),
        ("q11", "orders,users", "", "UPDATE", T), ("q12", "sessions,users", "", "DELETE", T), ("q13", "sales", "", "SELECT", T), ("q14", "a,b,c", "", "SELECT", T), ("q15", "users", "", "SELECT", T),
        ("q16", None, None, None, N), ("q17", "metrics", "", "SELECT", T), ("q18", "items", "", "SELECT", T),
    ]),
    "sql_corpus_metadata": _values("query_id:VARCHAR, aggregations:VARCHAR, is_aggregate:BOOLEAN, has_distinct:BOOLEAN, has_subquery:BOOLEAN, has_windows:BOOLEAN, has_ctes:BOOLEAN, database_operations:VARCHAR, is_deterministic:BOOLEAN, row_limit:INTEGER, row_offset:INTEGER", [
        ("q01", "", N, N, N, N, N, "ILIKE", T, -1, -1), ("q02", "COUNT", T, N, N, N, N, "", T, -1, -1), ("q03", "SUM", T, N, N, N, N, "", T, -1, -1), ("q04", "SUM", T, N, N, N, N, "", T, -1, -1),
        ("q05", "COUNT", T, N, N, N, N, "", N, -1, -1), ("q06", "", N, N, N, N, N, "JSONB", T, -1, -1), ("q07", "", N, N, N, N, T, "", T, -1, -1), ("q08", "", N, T, N, N, N, "DISTINCT ON", T, -1, -1),
        ("q09", "", N, N, N, T, N, "", T, -1, -1), ("q10", "", N, N, N, N, N, "", T, -1, -1), ("q11", "", N, N, N, N, N, "", T, -1, -1), ("q12", "", N, N, N, N, N, "", T, -1, -1),
        ("q13", "COUNT", T, N, N, N, N, "", T, -1, -1), ("q14", "", N, N, T, N, N, "", T, -1, -1), ("q15", "", T, N, N, N, N, "", T, -1, -1), ("q17", "", N, N, N, N, N, "", N, 10, 5),
        ("q18", "ARRAY_AGG", T, N, N, N, N, "ARRAY,JSONB", T, -1, -1),
    ]),
    "sql_corpus_filters": _values("query_id:VARCHAR, col:VARCHAR, op:VARCHAR, val:VARCHAR", [
        ("q01", "active", "=", "true"), ("q01", "email", "ILIKE", "%@example.com"), ("q02", "status", "IN", "paid, sent"), ("q05", "status", "=", "ok"), ("q07", "created_at", "BETWEEN", "2024-01-01 AND 2024-02-01"),
        ("q10", "priority", ">", "5"), ("q12", "active", "=", "false"), ("q17", "value", ">", "3"),
    ]),
    "sql_corpus_joins": _values("query_id:VARCHAR, kind:VARCHAR, left_table:VARCHAR, right_table:VARCHAR, left_column:VARCHAR, right_column:VARCHAR, on_expr:VARCHAR", [
        ("q02", "INNER", "users", "orders", "id", "user_id", "u.id = o.user_id"), ("q07", "LEFT", "recent", "users", "user_id", "id", "u.id = r.user_id AND u.region = r.region"),
    ]),
    "sql_corpus_groupby": _values("query_id:VARCHAR, pos:INTEGER, kind:VARCHAR, col:VARCHAR, alias:VARCHAR, position:INTEGER, expr:VARCHAR", [
        ("q02", 0, "column", "name", "", 0, ""), ("q03", 0, "positional", "", "bucket", 1, "date_trunc('hour', created_at)"), ("q04", 0, "column", "merchant_id", "", 0, ""),
        ("q13", 0, "expression", "", "", 0, "ROLLUP (category, region)"), ("q15", 0, "alias", "", "d", 0, "user_id * 2"), ("q15", 1, "function", "", "", 0, "lower(email)"), ("q15", 2, "column", "user_id", "", 0, ""),
    ]),
    "sql_corpus_aggregates": _values("query_id:VARCHAR, func:VARCHAR, col:VARCHAR, alias:VARCHAR, is_distinct:BOOLEAN", [
        ("q02", "COUNT", "*", "n", N), ("q03", "SUM", "amount", "", N), ("q05", "COUNT", "*", "", N), ("q13", "COUNT", "user_id", "", T),
    ]),
    "sql_corpus_compositions": _values("query_id:VARCHAR, alias:VARCHAR, pos:INTEGER, sign:INTEGER, func:VARCHAR, col:VARCHAR, cond:VARCHAR", [
        ("q04", "net", 0, 1, "SUM", "amount", "type = charge"), ("q04", "net", 1, -1, "SUM", "amount", "type = refund"),
    ]),
    "sql_corpus_temporal": _values("query_id:VARCHAR, has_now:BOOLEAN, has_trunc:BOOLEAN, kind:VARCHAR, col:VARCHAR, op:VARCHAR, bucket:VARCHAR, window_us:BIGINT, window_op:VARCHAR", [
        ("q03", N, T, None, None, None, "hour", None, None), ("q05", T, N, "now_minus_interval", "ts", ">", None, 3600000000, ">"), ("q07", N, N, "between", "created_at", "BETWEEN", None, None, None),
        ("q17", T, N, "now_minus_interval", "ts", ">=", None, 604800000000, ">="),
    ]),
    "sql_corpus_jsonpaths": _values("query_id:VARCHAR, tbl:VARCHAR, col:VARCHAR, path:VARCHAR, op:VARCHAR, is_text:BOOLEAN", [
        ("q06", "users", "data", "address.city", "->>", T), ("q06", "users", "profile", "a.b", "#>>", T), ("q06", "users", "data", "zip", "->>", T),
    ]),
    "sql_normalize_fingerprint": _values("query_id:VARCHAR, class:VARCHAR, normalized:VARCHAR", [
        ("a1", "a1", "select id from users where age > $1 and name = $2"), ("a2", "a1", "select id from users where age > $1 and name = $2"), ("b1", "b1", "select id from users where age in ($1, $2, $3)"),
        ("b2", "b1", "select id from users where age in ($1)"), ("c1", "c1", "select id from orders where age > $1 and name = $2"), ("d1", "d1", "select email from users where age > $1 and name = $2"),
    ]),
    "interval_parse_table": _values("expr:VARCHAR, micros:BIGINT", list(INTERVALS.items())),
}
