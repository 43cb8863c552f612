"""Registered queries of reuse, routing, the query graph, change streams, publications and scores.

Inputs are small literal tables or derived from the shared tables by arithmetic, so that an independent engine can compute
the same from the same start."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.plans import graph, reuse, routing
from tideline.plans.corpus_queries import _values
from tideline.plans.relational import read
from tideline.sources import publication
from tideline.streaming import cdc

# the query graph
GRAPH_SQL = {
    "g1": "SELECT id FROM users",
    "g2": "SELECT id FROM users WHERE active = true",
    "g3": "SELECT o.id FROM orders o JOIN users u ON o.user_id = u.id",
    "g4": "SELECT COUNT(*) FROM orders",
    "g5": "SELECT o.id, p.name FROM orders o JOIN products p ON o.product_id = p.id JOIN users u ON u.id = o.user_id",
    "g6": "DELETE FROM orders WHERE id = 1",
    "g7": "SELECT name FROM products",
}
#: The same graph as literal rows for the independent engine: id, tables, operation, whether it aggregates.
_GRAPH_ROWS = "(VALUES ('g1', ['users'], 'SELECT', false), ('g2', ['users'], 'SELECT', false), ('g3', ['orders', 'users'], 'SELECT', false), ('g4', ['orders'], 'SELECT', true), ('g5', ['orders', 'products', 'users'], 'SELECT', false), ('g6', ['orders'], 'DELETE', false), ('g7', ['products'], 'SELECT', false)) t(id, tabs, op, agg)"
_GRAPH_CTE = f"n AS (SELECT * FROM {_GRAPH_ROWS}), e AS (SELECT a.id AS src, b.id AS dst FROM n a JOIN n b ON a.id <> b.id AND a.op = b.op AND len(list_intersect(a.tabs, b.tabs)) = len(b.tabs))"


def _graph(spark: SparkSession) -> DataFrame:
    return graph.nodes(spark.createDataFrame(sorted(GRAPH_SQL.items()), "query_id string, sql string"))


def graph_dependencies(spark, sf_dir):
    return graph.dependencies(_graph(spark))


def graph_affected(spark, sf_dir):
    nodes = _graph(spark)
    return graph.affected(nodes, graph.dependencies(nodes), "Products")


def graph_reusable(spark, sf_dir):
    nodes = _graph(spark)
    return graph.reusable(nodes.where("query_id in ('g3', 'g5')"), nodes.where("query_id not in ('g3', 'g5')"))


def graph_reuse_chain(spark, sf_dir):
    nodes = _graph(spark)
    return graph.reuse_chain(nodes.where("query_id = 'g5'"), nodes.where("query_id != 'g5'"))


def graph_stats(spark, sf_dir):
    nodes = _graph(spark)
    return graph.stats(nodes, graph.dependencies(nodes))


# reuse
REGISTRY_SQL = [("SELECT id, name, age FROM users WHERE active = true", 40.0, 100), ("SELECT o.id FROM orders o JOIN users u ON o.user_id = u.id", 30.0, 5)]
NEEDED_SQL = {"n1": "SELECT id, name FROM users WHERE active = true AND age > 30", "n2": "SELECT o.id FROM orders o JOIN users u ON o.user_id = u.id", "n3": "SELECT id, name, age FROM users WHERE active = true", "n4": "SELECT id FROM users WHERE vip = true"}


def _registry(spark: SparkSession) -> DataFrame:
    rows = [(c["signature"], c["type"], c["tables"], c["columns"], c["filters"], cost if c["type"] == "SELECT" else c["cost"], until) for sql, cost, until in REGISTRY_SQL for c in reuse.components(sql)]
    return spark.createDataFrame(rows, "signature string, type string, tables array<string>, columns array<string>, filters array<string>, cost double, valid_until int")


def _matched(spark: SparkSession) -> DataFrame:
    needed = reuse.query_components(spark.createDataFrame(sorted(NEEDED_SQL.items()), "query_id string, sql string"))
    return reuse.match(needed, _registry(spark), F.lit(10))


def reuse_component_match(spark, sf_dir):
    return _matched(spark).select("query_id", "type", "how", "saved")


def reuse_gate(spark, sf_dir):
    return reuse.gate(_matched(spark), 5.0)


def reuse_similarity(spark, sf_dir):
    wanted = spark.createDataFrame([("s1", "SELECT id FROM users WHERE age > 30", ["users"]), ("s2", "SELECT name FROM products", ["products"])], "query_id string, text string, tables array<string>")
    cached = spark.createDataFrame([("k1", "SELECT id FROM users WHERE age > 65", ["users"], 20, False), ("k2", "SELECT id FROM users WHERE age > 30", ["users"], 0, False), ("k3", "SELECT id, name FROM users", ["users"], 0, True), ("k4", "SELECT name FROM products LIMIT 5", ["products"], 1, True)], "cached_id string, text string, tables array<string>, hits int, recent boolean")
    return reuse.reuse_opportunities(wanted, cached)


def reuse_scores(spark, sf_dir):
    rows = spark.createDataFrame([("r1", 0, 0, False, 0, 0, 1, 0, 0, 0, 0, 0, True, True), ("r2", 1, 1, True, 2, 2, 0, 1, 1, 1, 1, 1, False, False), ("r3", 0, 0, False, 0, 1, 0, 0, 0, 1, 0, 0, True, False)], "query_id string, subqueries int, ctes int, recursive boolean, depth int, joins int, aggregates int, windows int, distinct int, ordered int, parameters int, reuses int, deterministic boolean, aggregate boolean")
    names = {"subqueries": "subqueries", "ctes": "ctes", "recursive": "recursive", "depth": "depth", "joins": "joins", "aggregates": "aggregates", "windows": "windows", "distinct": "distinct", "order": "ordered", "parameters": "parameters", "reuses": "reuses"}
    score, cache = reuse.complexity_score(names).cast("int"), reuse.cacheable_score(F.col("deterministic"), F.col("aggregate"))
    return rows.select("query_id", score.alias("complexity"), cache.alias("cacheable"), reuse.complexity_level(score).alias("level"), reuse.action(cache, score, (F.col("subqueries") + F.col("ctes")) > 0, F.col("windows") > 0).alias("action"))


def reuse_subqueries(spark, sf_dir):
    """Costs and caching of nested queries, from their texts and levels."""
    sql = "SELECT id FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.k = a.id) AND x IN (SELECT DISTINCT y FROM c JOIN d ON c.i = d.i WHERE z = (SELECT max(q) FROM e GROUP BY r ORDER BY r))"
    rows = [(s["kind"], s["text"], s["level"], ",".join(s["tables"]), s["correlated"]) for s in reuse.subqueries(sql)]
    df = spark.createDataFrame(rows, "kind string, text string, lvl int, tables string, correlated boolean")
    return df.select("kind", "lvl", "tables", "correlated", reuse.subquery_cost_us(F.col("text"), F.col("lvl")).cast("int").alias("cost_us"))


# routing
ROUTE_ROWS = [("t1", True, 0.9, 0.2, 8000, 4000), ("t2", True, 0.1, 0.9, 100, 4000), ("t3", False, 0.5, 0.9, 1000, 4000), ("t4", False, 0.5, 0.9, 3000, 4000), ("t5", False, 0.9, 0.3, 100, 4000)]


def route_decisions(spark, sf_dir):
    df = spark.createDataFrame(ROUTE_ROWS, "query_id string, cached boolean, load double, score double, memory_mb int, cache_mb int")
    return routing.route(df).select("query_id", "strategy", "reason", "estimate_ms")


def route_complexity(spark, sf_dir):
    from tideline.plans.corpus_queries import corpus
    from tideline.operators.corpus import analyzed

    m = F.col("metadata")
    found = analyzed(corpus(spark), "metadata").where("error is null")
    score = routing.complexity(m["operation"], m["has_ctes"], m["is_recursive_cte"], m["has_window_functions"], m["has_distinct"], m["is_aggregate"], m["has_database_specific_ops"], F.size(m["tables"]))
    return found.select("query_id", score.alias("score"))


def _query_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("ts", (F.col("event_id") % 3 == 0).alias("cache_hit"), (F.col("event_id") % 1000 + 1).alias("response_us"), F.element_at(F.array(F.lit("LOCAL_CACHE"), F.lit("LOCAL_DATABASE"), F.lit("BYPASS")), (F.col("event_id") % 3 + 1).cast("int")).alias("strategy"))


def route_rolling_metrics(spark, sf_dir):
    return routing.rolling_metrics(_query_events(spark, sf_dir), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), "6 hours", "1 hour")


def route_strategy_stats(spark, sf_dir):
    return routing.strategy_stats(_query_events(spark, sf_dir))


# change streams
#: How far apart in the log its kinds of change begin: beyond any order's number.
_PHASE = 1 << 40


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log made of orders by arithmetic, in one pass: each order is inserted; every third is updated (status only), every
    fifth updated again (price to null), every seventh deleted, every 35th inserted anew. Ten orders a transaction."""
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    hexed = lambda n: F.concat(F.hex(F.shiftright(n, 32)), F.lit("/"), F.hex(n.bitwiseAND(F.lit(0xFFFFFFFF))))
    kinds = [
        (F.lit(True), "insert", F.to_json(F.struct(key.alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("price")))),
        (key % 3 == 0, "update", F.to_json(F.struct(F.lit("U").alias("status")))),
        (key % 5 == 0, "update", F.lit('{"price":null}')),
        (key % 7 == 0, "delete", F.lit(None).cast("string")),
        (key % 35 == 0, "insert", F.to_json(F.struct(key.alias("id"), F.lit("N").alias("status")))),
    ]
    made = F.array(*[F.when(cond, F.struct(F.lit(k * _PHASE).alias("base"), F.lit(kind).alias("operation"), new.alias("new"))) for k, (cond, kind, new) in enumerate(kinds)])
    rows = o.select("o_orderkey", F.explode(F.array_compact(made)).alias("c"))
    return rows.select(
        hexed(F.expr("o_orderkey div 10 + 1") + F.col("c.base")).alias("commit_lsn"), (key % 10).cast("int").alias("seq"), F.lit("public.orders").alias("table_name"), F.col("c.operation").alias("operation"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("commit_time"), F.to_json(F.struct(key.alias("id"))).alias("keys"), F.lit(None).cast("string").alias("old"), F.col("c.new").alias("new"),
    )


def _between(log: DataFrame, low: int, high: int) -> DataFrame:
    """The log's changes of phases low to high - 1."""
    lsn = cdc.lsn_number(F.col("commit_lsn"))
    return log.where((lsn >= F.lit(low * _PHASE)) & (lsn < F.lit(high * _PHASE)))


STATE = {"status": "string", "price": "decimal(18,2)"}
_STATE_SQL = """
    SELECT o_orderkey AS id,
           CASE WHEN o_orderkey % 35 = 0 THEN 'N' WHEN o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS status,
           CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS price
    FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 35 = 0"""


def _state(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("bigint").alias("id"), "status", F.col("price").cast("double").alias("price"))


def cdc_apply_final_state(spark, sf_dir):
    return _state(cdc.final_state(change_log(spark, sf_dir), "id", STATE))


def _streamed(spark: SparkSession, root: str) -> tuple[cdc.TableApplier, int]:
    """The log in root's folder, read by the change-log source and applied from where its checkpoint stands."""
    from tideline.sources.changes import ChangeLogSource

    spark.dataSource.register(ChangeLogSource)
    source = spark.readStream.format("changelog").option("path", f"{root}/log").option("acknowledged", f"{root}/acknowledged").load()
    applier = cdc.TableApplier(spark, f"{root}/state", "id", STATE)
    return applier, cdc.apply_stream(source, applier, f"{root}/checkpoint")


def cdc_stream_final_state(spark, sf_dir):
    """The log read as a stream of whole transactions and applied to a bucketed table."""
    from tideline.streaming.local import shared_folder

    root = shared_folder(spark, "stream")
    change_log(spark, sf_dir).write.parquet(f"{root}/log")
    applier, last = _streamed(spark, root)
    return _state(applier.table(last))


def cdc_checkpoint_resume(spark, sf_dir):
    """The log arrives in three parts; each run of the stream goes on from the checkpoint of the one before."""
    from tideline.streaming.local import shared_folder

    root, log = shared_folder(spark, "resume"), change_log(spark, sf_dir)
    for low, high in ((0, 1), (1, 3), (3, 5)):
        _between(log, low, high).write.mode("append").parquet(f"{root}/log")
        applier, last = _streamed(spark, root)
    return _state(applier.table(last)).withColumn("position", F.lit(applier.position(last)))


def cdc_snapshot_then_stream(spark, sf_dir):
    """A snapshot that holds the first two kinds of change, then the log after its position."""
    from tideline.sources import snapshot
    from tideline.streaming.local import shared_folder

    log = change_log(spark, sf_dir)
    held = cdc.final_state(_between(log, 0, 2), "id", STATE)
    made = snapshot.export(spark, shared_folder(spark, "snapshots"), {"orders": held}, cdc.format_lsn(2 * _PHASE - 1))
    again, tables = snapshot.load(spark, made.path, made.name)
    return _state(cdc.final_state(snapshot.after(log, again), "id", STATE, tables["orders"]))


def cdc_tx_batches(spark, sf_dir):
    return cdc.transactions(change_log(spark, sf_dir)).select("commit_lsn", F.col("lsn").cast("bigint").alias("lsn"), "changes", "inserts", "updates", "deletes")


def cdc_backpressure_drop(spark, sf_dir):
    return cdc.transactions(cdc.limited(change_log(spark, sf_dir), 2, "drop")).select("commit_lsn", "changes")


def lsn_compare_distance(spark, sf_dir):
    rows = spark.createDataFrame([("0/10", "0/A"), ("1/0", "0/FFFFFFFF"), ("", "0/1"), ("A/B", "A/B"), ("FFFFFFFF/FFFFFFFF", "0/0"), ("x/1", "0/1")], "a string, b string")
    n = cdc.lsn_number
    return rows.select("a", "b", cdc.lsn_compare(F.col("a"), F.col("b")).alias("cmp"), cdc.lsn_distance(F.col("a"), F.col("b")).cast("string").alias("distance"), n(F.col("a")).cast("string").alias("number"))


def cdc_decode_values(spark, sf_dir):
    rows = spark.createDataFrame([(20, "007"), (1700, "1.50"), (701, "1e3"), (16, "t"), (16, "f"), (23, "oops"), (25, "text"), (20, None)], "oid int, raw string")
    return rows.select("oid", "raw", cdc.decode_value(F.col("raw"), F.col("oid")).alias("value"))


def stream_tumbling_counts(spark, sf_dir):
    """Counts by day and type, read as a stream; the complete mode holds all groups, the last window too."""
    from tideline.streaming.local import complete_table

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return complete_table(spark, f"{sf_dir}/events.parquet", schema, lambda df: cdc.tumbling_counts(df.withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "event_type")).withColumn("start", F.col("start").cast("timestamp_ntz"))


def publication_reconcile(spark, sf_dir):
    have = spark.createDataFrame([("p1", "public.orders"), ("p2", "public.users")], "publication string, table_name string")
    want = spark.createDataFrame([("p1", "orders"), ("p1", "sales.items"), ("p1", " items "), ("p2", "users"), ("p3", "events"), ("p3", "bad name"), ("p3", "public.events")], "publication string, table_name string")
    return publication.reconcile(have, want)


QUERIES = {f.__name__: f for f in (
    graph_dependencies, graph_affected, graph_reusable, graph_reuse_chain, graph_stats, reuse_component_match, reuse_gate, reuse_similarity, reuse_scores, reuse_subqueries,
    route_decisions, route_complexity, route_rolling_metrics, route_strategy_stats, cdc_apply_final_state, cdc_stream_final_state, cdc_checkpoint_resume, cdc_snapshot_then_stream, cdc_tx_batches, cdc_backpressure_drop,
    lsn_compare_distance, cdc_decode_values, stream_tumbling_counts, publication_reconcile,
)}

_LOG_SQL = """
    SELECT upper(to_hex(lsn >> 32)) || '/' || upper(to_hex(lsn & 4294967295)) AS commit_lsn, lsn, seq, op FROM (
        SELECT o_orderkey // 10 + 1 + phase * 1099511627776 AS lsn, o_orderkey % 10 AS seq, op
        FROM orders JOIN (VALUES (0, 1, 'insert'), (1, 3, 'update'), (2, 5, 'update'), (3, 7, 'delete'), (4, 35, 'insert')) p(phase, every, op) ON o_orderkey % every = 0) t"""
_EVENTS_SQL = "SELECT ts, event_id % 3 = 0 AS cache_hit, event_id % 1000 + 1 AS response_us, ['LOCAL_CACHE', 'LOCAL_DATABASE', 'BYPASS'][event_id % 3 + 1] AS strategy FROM events"

ORACLES = {
    "graph_dependencies": f"WITH {_GRAPH_CTE} SELECT src, dst FROM e",
    "graph_affected": f"WITH RECURSIVE {_GRAPH_CTE}, r(id) AS (SELECT id FROM n WHERE list_contains(tabs, 'products') UNION SELECT e.src FROM r JOIN e ON e.dst = r.id) SELECT id AS query_id FROM r",
    "graph_reusable": f"WITH n AS (SELECT * FROM {_GRAPH_ROWS}) SELECT w.id AS query_id, c.id AS cached_id, round(CAST(0.9 + CASE WHEN w.agg = c.agg THEN 0.1 ELSE 0 END AS DOUBLE), 6) AS confidence FROM n w JOIN n c ON w.id IN ('g3', 'g5') AND c.id NOT IN ('g3', 'g5') AND w.op = c.op AND len(list_intersect(w.tabs, c.tabs)) = len(c.tabs)",
    "graph_reuse_chain": f"WITH n AS (SELECT * FROM {_GRAPH_ROWS}), c AS (SELECT id, row_number() OVER (ORDER BY agg, id) AS step FROM n WHERE id <> 'g5' AND op = 'SELECT'), b AS (SELECT * FROM c WHERE step <= 3) SELECT 'g5' AS query_id, CAST(step AS INTEGER) AS step, id AS node FROM b UNION ALL SELECT 'g5', CAST(max(step) + 1 AS INTEGER), 'compute' FROM b",
    "graph_stats": f"WITH {_GRAPH_CTE} SELECT (SELECT count(*) FROM n) AS queries, (SELECT count(*) FROM e) AS edges, (SELECT max(c) FROM (SELECT count(*) AS c FROM e GROUP BY src) x) AS most_dependencies, (SELECT max(c) FROM (SELECT count(*) AS c FROM e GROUP BY dst) x) AS most_dependents, (SELECT count(DISTINCT t) FROM (SELECT unnest(tabs) AS t FROM n) x) AS tables",
    "reuse_component_match": _values("query_id:VARCHAR, type:VARCHAR, how:VARCHAR, saved:DOUBLE", [
        ("n1", "SELECT", "superset", "0.8"), ("n1", "FROM", "exact", "1"), ("n1", "WHERE", "new", "0"), ("n2", "SELECT", "new", "0"), ("n2", "FROM", "new", "0"), ("n2", "JOIN", "new", "0"),
        ("n3", "SELECT", "exact", "40"), ("n3", "FROM", "exact", "1"), ("n3", "WHERE", "exact", "5"), ("n4", "SELECT", "new", "0"), ("n4", "FROM", "exact", "1"), ("n4", "WHERE", "new", "0"),
    ]),
    "reuse_gate": _values("query_id:VARCHAR, total_cost:DOUBLE, saved_cost:DOUBLE, saved_ms:DOUBLE, optimized:BOOLEAN, steps:VARCHAR", [
        ("n1", "7", "0", "0", False, "compute"), ("n2", "22", "0", "0", False, "compute"), ("n3", "7", "46", "46", True, "cached"), ("n4", "7", "0", "0", False, "compute"),
    ]),
    "reuse_similarity": _values("query_id:VARCHAR, cached_id:VARCHAR, score:DOUBLE", [("s1", "k1", "1"), ("s1", "k2", "1"), ("s2", "k4", "0.796667")]),
    "reuse_scores": _values("query_id:VARCHAR, complexity:INTEGER, cacheable:DOUBLE, level:VARCHAR, action:VARCHAR", [
        ("r1", 25, "1.0", "medium", "standard_caching"), ("r2", 208, "0.5", "very_high", "decomposition_recommended"), ("r3", 40, "0.8", "high", "standard_caching"),
    ]),
    "reuse_subqueries": _values("kind:VARCHAR, lvl:INTEGER, tables:VARCHAR, correlated:BOOLEAN, cost_us:INTEGER", [
        ("exists", 1, "b", True, 150), ("in", 1, "c,d,e", False, 675), ("scalar", 2, "e", False, 450),
    ]),
    "route_decisions": _values("query_id:VARCHAR, strategy:VARCHAR, reason:VARCHAR, estimate_ms:INTEGER", [
        ("t1", "LOCAL_CACHE", "high load", 5), ("t2", "LOCAL_CACHE", "cached", 5), ("t3", "BYPASS", "too complex for memory", 200), ("t4", "LOCAL_DATABASE", "default", 100), ("t5", "LOCAL_DATABASE", "default", 100),
    ]),
    "route_complexity": """
        WITH facts(query_id, op, cte, rec, win, dist, agg, dbs, tabs) AS (VALUES
            ('q01','SELECT',false,false,false,false,false,true,1), ('q02','SELECT',false,false,false,false,true,false,2), ('q03','SELECT',false,false,false,false,true,false,1), ('q04','SELECT',false,false,false,false,true,false,1),
            ('q05','SELECT',false,false,false,false,true,false,1), ('q06','SELECT',false,false,false,false,false,true,1), ('q07','SELECT',true,false,false,false,false,false,2), ('q08','SELECT',false,false,false,true,false,true,1),
            ('q09','SELECT',false,false,true,false,false,false,1), ('q10','INSERT',false,false,false,false,false,false,2), ('q11','UPDATE',false,false,false,false,false,false,2), ('q12','DELETE',false,false,false,false,false,false,2),
            ('q13','SELECT',false,false,false,false,true,false,1), ('q14','SELECT',false,false,false,false,false,false,3), ('q15','SELECT',false,false,false,false,true,false,1), ('q17','SELECT',false,false,false,false,false,false,1),
            ('q18','SELECT',false,false,false,false,true,true,1))
        SELECT query_id, CAST(round(least(1.0, CASE WHEN op = 'SELECT' THEN 0.1 ELSE 0.3 END + CASE WHEN cte THEN 0.3 ELSE 0 END + CASE WHEN cte AND rec THEN 0.2 ELSE 0 END + CASE WHEN win THEN 0.2 ELSE 0 END
               + CASE WHEN dist THEN 0.1 ELSE 0 END + CASE WHEN agg THEN 0.1 ELSE 0 END + CASE WHEN dbs THEN 0.1 ELSE 0 END + CASE WHEN tabs > 3 THEN 0.2 WHEN tabs > 1 THEN 0.1 ELSE 0 END), 6) AS DOUBLE) AS score FROM facts""",
    "route_rolling_metrics": f"""
        WITH e AS ({_EVENTS_SQL}), w AS (SELECT *, ts > TIMESTAMP '2024-01-15 11:00:00' AS fresh FROM e WHERE ts > TIMESTAMP '2024-01-15 06:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00')
        SELECT count(*) AS n, CAST(sum(response_us) AS DOUBLE) / count(*) AS mean_us, count(*) / 21600.0::DOUBLE AS per_second,
               CAST(count(*) FILTER (WHERE cache_hit AND fresh) AS DOUBLE) / count(*) FILTER (WHERE fresh) AS recent_hit_rate FROM w""",
    "route_strategy_stats": f"SELECT strategy, count(*) AS n, count(*) FILTER (WHERE cache_hit) AS hits, CAST(sum(response_us) AS DOUBLE) / count(*) AS mean_us FROM ({_EVENTS_SQL}) e GROUP BY strategy",
    "cdc_apply_final_state": _STATE_SQL,
    "cdc_stream_final_state": _STATE_SQL,
    "cdc_snapshot_then_stream": _STATE_SQL,
    "cdc_checkpoint_resume": f"SELECT s.*, (SELECT arg_max(commit_lsn, lsn) FROM ({_LOG_SQL}) l) AS position FROM ({_STATE_SQL}) s",
    "cdc_tx_batches": f"SELECT commit_lsn, lsn, count(*) AS changes, count(*) FILTER (WHERE op = 'insert') AS inserts, count(*) FILTER (WHERE op = 'update') AS updates, count(*) FILTER (WHERE op = 'delete') AS deletes FROM ({_LOG_SQL}) l GROUP BY commit_lsn, lsn",
    "cdc_backpressure_drop": f"SELECT commit_lsn, least(count(*), 2) AS changes FROM ({_LOG_SQL}) l GROUP BY commit_lsn",
    "lsn_compare_distance": _values("a:VARCHAR, b:VARCHAR, cmp:INTEGER, distance:VARCHAR, number:VARCHAR", [
        ("0/10", "0/A", 1, "6", "16"), ("1/0", "0/FFFFFFFF", 1, "1", "4294967296"), ("", "0/1", -1, "0", "0"), ("A/B", "A/B", 0, "0", "42949672971"),
        ("FFFFFFFF/FFFFFFFF", "0/0", 1, "18446744073709551615", "18446744073709551615"), ("x/1", "0/1", None, "0", None),
    ]),
    "cdc_decode_values": _values("oid:INTEGER, raw:VARCHAR, value:VARCHAR", [(20, "007", "7"), (1700, "1.50", "1.5000000000"), (701, "1e3", "1000.0"), (16, "t", "true"), (16, "f", "false"), (23, "oops", "oops"), (25, "text", "text"), (20, None, None)]),
    "stream_tumbling_counts": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "publication_reconcile": _values("publication:VARCHAR, table_name:VARCHAR, action:VARCHAR", [
        ("p1", "public.orders", "keep"), ("p1", "sales.items", "add"), ("p1", "public.items", "add"), ("p2", "public.users", "keep"), ("p3", "public.events", "create"),
    ]),
}


def catalog_fk_join_paths(spark, sf_dir):
    """What joins to orders (o) and to lineitem (l) by a foreign key, composite keys included."""
    from tideline.plans import catalog

    bound = spark.createDataFrame([("public", "orders", "o"), ("public", "lineitem", "l")], "schema string, table_name string, qualifier string")
    return catalog.join_paths(catalog.edges_table(spark, catalog.star_catalog()), bound).select("schema", "table_name", "on_expr")


def completion_ranking(spark, sf_dir):
    """The first candidates for some texts, in order."""
    from tideline.plans import catalog, completion

    engine = completion.Engine(catalog.star_catalog())
    texts = {"c1": "SELECT o.o_ord FROM orders o", "c2": "SELECT * FROM orders o JOIN ", "c3": "SELECT * FROM customer WHERE c_a", "c4": "SELECT * FROM nat"}
    cursors = {"c1": 14}
    rows = []
    for name, sql in texts.items():
        got = engine.complete(completion.Request(sql, cursors.get(name, len(sql)), max_candidates=3))
        rows += [(name, got.clause, k + 1, c.kind, c.insert_text, c.score) for k, c in enumerate(got.candidates)]
    return spark.createDataFrame(rows, "text_id string, clause string, pos int, kind string, insert_text string, score double")


QUERIES |= {f.__name__: f for f in (catalog_fk_join_paths, completion_ranking)}
ORACLES |= {
    "catalog_fk_join_paths": _values("schema:VARCHAR, table_name:VARCHAR, on_expr:VARCHAR", [
        ("public", "customer", "o.o_custkey = customer.c_custkey"), ("public", "part", "l.l_partkey = part.p_partkey"), ("public", "supplier", "l.l_suppkey = supplier.s_suppkey"),
        ("sales", "returns", "returns.l_orderkey = l.l_orderkey AND returns.l_linenumber = l.l_linenumber"),
    ]),
    "completion_ranking": _values("text_id:VARCHAR, clause:VARCHAR, pos:INTEGER, kind:VARCHAR, insert_text:VARCHAR, score:DOUBLE", [
        ("c1", "select", 1, "column", "o.o_orderdate", "100"), ("c1", "select", 2, "column", "o.o_orderkey", "100"), ("c1", "select", 3, "column", "o.o_orderpriority", "100"),
        ("c2", "join", 1, "join", "customer ON o.o_custkey = customer.c_custkey", "70"), ("c2", "join", 2, "join", "lineitem ON lineitem.l_orderkey = o.o_orderkey", "70"), ("c2", "join", 3, "table", "customer", "50"),
        ("c3", "where", 1, "column", "customer.c_acctbal", "105"),
        ("c4", "from", 1, "table", "nation", "100"),
    ]),
}
