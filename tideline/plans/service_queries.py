"""Registered queries of what surrounds a query: slots, checkpoints, retries, providers, compilation, opportunities,
the graph's upkeep, completion requests and edits. Each has SQL for the independent engine: computed from the shared
tables or from the case's own facts where SQL can, written-out rows where the operator is a program of its own."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tideline.functions.edits import Edit, apply, canonical, check
from tideline.plans import catalog, completion, decompose, graph, reuse, routing
from tideline.plans.corpus_queries import _values, corpus
from tideline.plans.intelligence_queries import _EVENTS_SQL, _GRAPH_CTE, _graph, _query_events
from tideline.plans.relational import read
from tideline.streaming import cdc, sliding, supervisor

QUERIES, ORACLES = {}, {}


def _query(oracle: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return keep


# slots, checkpoints, heartbeats, retries
@_query(_values("step:INTEGER, slot_name:VARCHAR, outcome:VARCHAR", [(1, "main", "created"), (2, "main", "exists"), (3, "other", "created"), (4, "main", "dropped"), (5, "main", "created"), (6, "Bad name", "refused")]))
def cdc_slot_ensure(spark, sf_dir):
    """Slots are made if absent and found if there; a dropped one may be made again."""
    from tideline.streaming.local import shared_folder

    slots, rows = cdc.Slots(spark, shared_folder(spark, "slots")), []
    for name, drop in (("main", False), ("main", False), ("other", False), ("main", True), ("main", False), ("Bad name", False)):
        try:
            outcome = ("dropped" if slots.drop(name) else "absent") if drop else slots.ensure(name)
        except ValueError:
            outcome = "refused"
        rows.append((len(rows) + 1, name, outcome))
    return spark.createDataFrame(rows, "step int, slot_name string, outcome string")


@_query("""
    WITH saved(slot_name, lsn, n) AS (VALUES ('a', '0/A', 10), ('a', '0/A', 10), ('a', '1/0', 4294967296), ('b', '0/FF', 255)),
         cases(slot_name, configured) AS (VALUES ('a', '0/1'), ('a', NULL), ('b', NULL), ('c', '0/7'), ('c', NULL))
    SELECT c.slot_name, c.configured, coalesce((SELECT arg_max(lsn, n) FROM saved s WHERE s.slot_name = c.slot_name), c.configured, '0/0') AS start FROM cases c""")
def cdc_start_position(spark, sf_dir):
    """Where a stream begins: its slot's checkpoint, else the configured position, else the log's start."""
    from tideline.streaming.local import shared_folder

    points = cdc.Checkpoint(spark, shared_folder(spark, "checkpoints"))
    for slot, lsn in (("a", "0/A"), ("a", "0/A"), ("a", "1/0"), ("b", "0/FF")):
        points.save(slot, lsn)
    rows = [(slot, configured, points.start(slot, configured)) for slot, configured in (("a", "0/1"), ("a", None), ("b", None), ("c", "0/7"), ("c", None))]
    return spark.createDataFrame(rows, "slot_name string, configured string, start string")


@_query(_values("step:INTEGER, slot_name:VARCHAR, lsn:VARCHAR, outcome:VARCHAR, held:VARCHAR", [(1, "a", "0/A", "saved", "0/A"), (2, "a", "0/A", "saved", "0/A"), (3, "a", "0/9", "refused", "0/A"), (4, "b", "0/1", "saved", "0/1"), (5, "a", "1/0", "saved", "1/0"), (6, "a", "FF", "refused", "1/0")]))
def cdc_checkpoint_monotonic(spark, sf_dir):
    """Saves of a slot's position: equal ones are allowed, smaller and malformed ones refused; the table is made when needed."""
    from tideline.streaming.local import shared_folder

    points, rows = cdc.Checkpoint(spark, shared_folder(spark, "checkpoints")), []
    for slot, lsn in (("a", "0/A"), ("a", "0/A"), ("a", "0/9"), ("b", "0/1"), ("a", "1/0"), ("a", "FF")):
        try:
            points.save(slot, lsn)
            outcome = "saved"
        except ValueError:
            outcome = "refused"
        rows.append((len(rows) + 1, slot, lsn, outcome, points.load(slot)))
    return spark.createDataFrame(rows, "step int, slot_name string, lsn string, outcome string, held string")


_ERRORS = [
    ("e1", "Connection refused by host", ""), ("e2", "could not read: i/o TIMEOUT", ""), ("e3", "shutting down", "08006"), ("e4", "relation is missing", "42P01"), ("e5", "too many connections", "53300"), ("e6", "io error", "58030"),
    ("e7", 'replication slot "x" does not exist', "42704"), ("e8", 'publication "p" does not exist', "42704"), ("e9", "something else", ""), ("e10", "unexpected EOF", "XX000"),
]
_ERRORS_SQL = f"""
    SELECT error_id, CASE WHEN t LIKE '%replication slot%does not exist%' THEN 'slot_missing' WHEN t LIKE '%publication%does not exist%' THEN 'publication_missing' WHEN state[1:2] IN ('42', '53', '58') THEN 'fatal'
        WHEN state[1:2] = '08' OR regexp_matches(t, 'connection refused|connection reset|broken pipe|timeout|timed out|temporarily unavailable|network is unreachable|unexpected eof|server closed') THEN 'transient' ELSE 'unknown' END AS kind
    FROM (SELECT error_id, lower(message) AS t, state FROM ({_values("error_id:VARCHAR, message:VARCHAR, state:VARCHAR", _ERRORS)}) e) x"""


@_query(f"SELECT error_id, kind, kind IN ('transient', 'unknown') AS retried, kind NOT IN ('fatal') AS retried_reconciling FROM ({_ERRORS_SQL}) k")
def stream_error_classes(spark, sf_dir):
    """The class of each error, and whether it is retried, with and without reconciling."""
    kind = supervisor.error_class(F.col("message"), F.col("state"))
    rows = spark.createDataFrame(_ERRORS, "error_id string, message string, state string").select("error_id", kind.alias("kind"))
    return rows.withColumn("retried", F.col("kind").isin("transient", "unknown")).withColumn("retried_reconciling", F.col("kind") != "fatal")


@_query("SELECT CAST(a AS INTEGER) AS attempt, least(30.0, power(2.0, a))::DOUBLE AS least_s, 1.5 * least(30.0, power(2.0, a))::DOUBLE AS most_s FROM range(0, 12) t(a)")
def stream_retry_delays(spark, sf_dir):
    rows = [(a, supervisor.retry_delay(a, jitter=lambda: 0.0), supervisor.retry_delay(a, jitter=lambda: 1.0)) for a in range(12)]
    return spark.createDataFrame(rows, "attempt int, least_s double, most_s double")


@_query(_values("pos:INTEGER, event:VARCHAR, detail:VARCHAR", [(1, "started", "0"), (2, "retry", "transient"), (3, "started", "1"), (4, "rows", "all")]))
def stream_supervised_run(spark, sf_dir):
    """A stream over events whose first start fails with a dropped connection; the supervisor starts it again."""
    from tideline.streaming.local import shared_folder

    root, log, tries = shared_folder(spark, "supervised"), [], []
    seen = []

    class Broken:
        def awaitTermination(self):
            raise ConnectionResetError("connection reset by peer")

    def begin():
        tries.append(1)
        if len(tries) == 1:
            return Broken()
        source = spark.readStream.schema(read(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        return source.writeStream.foreachBatch(lambda df, k: seen.append(df.count())).option("checkpointLocation", root).trigger(availableNow=True).start()

    boss = supervisor.Supervisor(begin, sleep=lambda s: None, on_event=lambda name, data: log.append((name, str(data.get("kind", data.get("attempt", ""))))))
    boss.run()
    log.append(("rows", "all" if sum(seen) == read(spark, sf_dir, "events").count() and boss.stop() else "some"))
    return spark.createDataFrame([(k, *row) for k, row in enumerate(log, 1)], "pos int, event string, detail string")


@_query(_values("at_s:DOUBLE, requested:BOOLEAN, told:BOOLEAN", [("0", False, True), ("4", False, False), ("9.9", False, False), ("10", False, True), ("12", True, True), ("21", False, False), ("22", False, True), ("33", False, False), ("34", False, True)]))
def cdc_heartbeat(spark, sf_dir):
    """Ticks of a heartbeat of 10 s: on time, on request, and after a failure to tell (at 33 s) again."""
    now, told = [0.0], []

    def send(position):
        if now[0] == 33:
            raise ConnectionError("closed")
        told.append(position)

    beat, rows = supervisor.Heartbeat(send, 10.0, lambda: now[0]), []
    for at, asked in ((0.0, False), (4.0, False), (9.9, False), (10.0, False), (12.0, True), (21.0, False), (22.0, False), (33.0, False), (34.0, False)):
        now[0] = at
        rows.append((at, asked, beat.tick("0/1", asked)))
    return spark.createDataFrame(rows, "at_s double, requested boolean, told boolean")


@_query("SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) AS n FROM events WHERE date_trunc('hour', ts) > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL '36 hours' AND date_trunc('hour', ts) <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY user_id")
def stream_sliding_totals(spark, sf_dir):
    """Totals by user over the last 36 hours before a fixed time, from hourly sums that a stream keeps up batch by batch;
    sums older than four days before it leave the state."""
    from tideline.streaming.local import shared_folder

    root = shared_folder(spark, "sliding")
    now, kept = F.lit("2024-01-20 00:00:00").cast("timestamp"), {}

    def add(batch, batch_id):
        rows = batch.withColumn("ts", F.col("ts").cast("timestamp"))
        new = sliding.slots(rows, ["user_id"], F.col("value").cast("decimal(18,4)"), "1 hour")
        state = spark.read.parquet(f"{root}/v{batch_id - 1}") if batch_id else None
        sliding.merged(state, new, ["user_id"], now - F.expr("INTERVAL 4 DAYS")).write.mode("overwrite").parquet(f"{root}/v{batch_id}")
        kept["last"] = batch_id

    source = spark.readStream.schema(read(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    source.writeStream.foreachBatch(add).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    state = spark.read.parquet(f"{root}/v{kept['last']}")
    return sliding.current(state, ["user_id"], now, "36 hours").select("user_id", F.col("total").cast("double").alias("total"), F.col("n").cast("long").alias("n"))


@_query("SELECT 'stream.rows' AS name, count(*) AS value FROM events UNION ALL SELECT 'stream.batches', 1")
def stream_report(spark, sf_dir):
    """What a stream's progress adds up to in the metrics contract."""
    from tideline.streaming import observe
    from tideline.streaming.local import shared_folder

    counters, root = observe.Counters(), shared_folder(spark, "report")
    source = spark.readStream.schema(read(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    query = source.writeStream.format("noop").option("checkpointLocation", root).trigger(availableNow=True).start()
    query.awaitTermination()
    for progress in query.recentProgress:
        if progress["numInputRows"]:
            counters.count("stream.batches")
            counters.count("stream.rows", progress["numInputRows"])
    return spark.createDataFrame(sorted(counters.counts.items()), "name string, value long")


@_query(f"""
    WITH e AS ({_EVENTS_SQL}), w AS (SELECT * FROM e WHERE ts > TIMESTAMP '2024-01-05 12:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00'),
         n AS (SELECT *, row_number() OVER (ORDER BY ts DESC) AS k, count(*) OVER () AS c FROM w), kept AS (SELECT * FROM n WHERE c <= 200 OR k <= 100)
    SELECT count(*) AS n, CAST(sum(response_us) AS DOUBLE) / count(*) AS mean_us, count(*) / 864000.0::DOUBLE AS per_second,
           CAST(count(*) FILTER (WHERE cache_hit AND ts > TIMESTAMP '2024-01-15 06:00:00') AS DOUBLE) / nullif(count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-15 06:00:00'), 0) AS recent_hit_rate FROM kept""")
def route_capped_metrics(spark, sf_dir):
    """Rolling metrics of a bounded buffer: beyond 200 events of the window the newest 100 count."""
    return routing.rolling_metrics(_query_events(spark, sf_dir), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), "10 days", "6 hours", most=200, kept=100)


# snapshots and providers
@_query("SELECT 'nation' AS tbl, n_nationkey::BIGINT AS k, '0/2A' AS lsn, 'gone' AS after_drop FROM nation UNION ALL SELECT 'region', r_regionkey, '0/2A', 'gone' FROM region")
def snapshot_pinned_read(spark, sf_dir):
    """Tables exported under a name and position, read back by the name, and dropped with the session that made them."""
    from tideline.sources import snapshot
    from tideline.streaming.local import shared_folder, written

    tables = {"nation": read(spark, sf_dir, "nation"), "region": read(spark, sf_dir, "region")}
    with snapshot.exported(spark, shared_folder(spark, "snapshots"), tables, "0/2A") as made:
        again, pinned = snapshot.load(spark, made.path, made.name)
        rows = [df.select(F.lit(name).alias("tbl"), F.col(df.columns[0]).cast("long").alias("k"), F.lit(again.consistent_lsn).alias("lsn")) for name, df in pinned.items()]
        kept = written(rows[0].unionByName(rows[1]), "pinned")
    try:
        snapshot.load(spark, made.path, made.name)
        state = "there"
    except Exception as error:  # the path is gone: Spark's own error for that
        state = "gone" if "PATH_NOT_FOUND" in str(error) else "broken"
    return kept.withColumn("after_drop", F.lit(state))


def _provider(spark, sf_dir, *names):
    from tideline.sources.provider import Provider

    return Provider(spark, {n: read(spark, sf_dir, n) for n in names}, {"lineitem": ["l_orderkey", "l_linenumber"]})


@_query("SELECT '{\"r_name\":\"' || r_name || '\",\"nations\":' || count(n_nationkey) || ',\"none\":null}' AS row FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def provider_json_rows(spark, sf_dir):
    """A PostgreSQL text answered as JSON rows."""
    return _provider(spark, sf_dir, "region", "nation").json_rows("SELECT r_name, count(n_nationkey) AS nations, NULL::text AS none FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")


@_query("""
    SELECT * FROM (VALUES ('lineitem', 'l_orderkey,l_linenumber')) t(tbl, key_columns)
    UNION ALL SELECT 'customer', CASE WHEN count(*) = count(DISTINCT c_custkey) THEN 'c_custkey' ELSE '' END FROM customer
    UNION ALL SELECT 'orders', CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN 'o_orderkey' ELSE '' END FROM orders
    UNION ALL SELECT 'labels', CASE WHEN count(*) = count(DISTINCT doc_id) THEN 'doc_id' ELSE '' END FROM labels
    UNION ALL SELECT 'conversations', CASE WHEN count(*) = count(DISTINCT text) AND count(text) = count(*) THEN 'text' ELSE '' END FROM conversations""")
def provider_primary_keys(spark, sf_dir):
    """Declared keys, and for tables without one the first column that is unique over the whole table."""
    p = _provider(spark, sf_dir, "customer", "orders", "lineitem", "labels", "conversations")
    return spark.createDataFrame([(t, ",".join(p.primary_keys(t))) for t in sorted(p.tables)], "tbl string, key_columns string")


@_query(_values("flag:VARCHAR, value:BOOLEAN", [("window_functions", True), ("recursive_ctes", True), ("json", True), ("arrays", True), ("streaming", True), ("incremental_sum", True), ("incremental_count", True), ("incremental_min_max", False), ("incremental_distinct", False)]))
def provider_capabilities(spark, sf_dir):
    from dataclasses import asdict

    p = _provider(spark, sf_dir, "region")
    return spark.createDataFrame(list(asdict(p.capabilities).items()) + list(asdict(p.hints).items()), "flag string, value boolean")


@_query(_values("item:VARCHAR, status:VARCHAR", [("version", "ok"), ("adaptive", "ok"), ("key:lineitem", "ok"), ("key:nation", "warn"), ("key:part", "fail"), ("shared_folder", "fail")]))
def provider_probe(spark, sf_dir):
    """What a stream needs before it starts: version, settings, keys, the shared folder."""
    from tideline.streaming.local import shared_folder

    p = _provider(spark, sf_dir, "lineitem", "nation", "part")
    p.keys["part"] = ["p_nokey"]
    rows = [(item, status) for item, status, _ in p.probe(shared_folder(spark, "not-there")) if item != "time_zone"]  # the driver's session may have any zone
    return spark.createDataFrame(rows, "item string, status string")


# reuse
_CACHED_SQL = ["SELECT id, name, age FROM users WHERE active = true", "SELECT a, count(*) FROM t WHERE b > 1 GROUP BY a"]
_COMPILED_SQL = {
    "p1": "SELECT id, name, age FROM users WHERE active = true", "p2": "SELECT id FROM users WHERE active = true AND age > 30", "p3": "SELECT x FROM y", "p4": "SELECT FROM WHERE",
    "p5": "SELECT a, count(*) FROM t WHERE b > 1 GROUP BY a ORDER BY a LIMIT 3",
}


def _registry_rows():
    return [c | {"valid_until": 10.0} for sql in _CACHED_SQL for c in reuse.components(sql)]


@_query(_values("query_id:VARCHAR, state:VARCHAR, steps:VARCHAR, matched:VARCHAR, saved_cost:DOUBLE, saved_ms:DOUBLE", [
    ("p1", "reused", "cached,cached,cached", "SELECT=exact,FROM=exact,WHERE=exact", "7", "7"), ("p2", "reused", "cached,cached,compute,merge", "SELECT=superset,FROM=exact,WHERE=new", "1.8", "1.8"),
    ("p3", "computed", "compute,compute", "SELECT=new,FROM=new", "0", "0"), ("p4", "refused", "", "", "0", "0"),
    ("p5", "reused", "cached,cached,cached,cached,cached,compute,compute,merge", "SELECT=exact,FROM=exact,WHERE=exact,GROUP_BY=exact,AGGREGATION=exact,ORDER_BY=new,LIMIT=new", "18", "18"),
]))
def compile_plans(spark, sf_dir):
    """Texts compiled against cached components: validated, taken apart, matched, gated, planned."""
    rows, cached = [], _registry_rows()
    for name, sql in _COMPILED_SQL.items():
        try:
            plan = decompose.compile_query(sql, cached, now=5.0)
            rows.append((name, "reused" if plan.optimized else "computed", ",".join(s.kind for s in plan.steps), ",".join(f"{m['type']}={m['how']}" for m in plan.matched), float(plan.saved_cost), float(plan.saved_ms)))
        except decompose.SqlError:
            rows.append((name, "refused", "", "", 0.0, 0.0))
    return spark.createDataFrame(rows, "query_id string, state string, steps string, matched string, saved_cost double, saved_ms double")


@_query(_values("query_id:VARCHAR, type:VARCHAR, needs:VARCHAR", [("d1", "SELECT", ""), ("d1", "FROM", ""), ("d1", "WHERE", "FROM"), ("d1", "GROUP_BY", ""), ("d1", "AGGREGATION", "GROUP_BY"), ("d2", "SELECT", ""), ("d2", "FROM", ""), ("d2", "JOIN", ""), ("d2", "ORDER_BY", ""), ("d2", "LIMIT", ""), ("d3", "SELECT", ""), ("d3", "AGGREGATION", ""), ("d3", "FROM", "")]))
def compile_component_types(spark, sf_dir):
    """All eight kinds of component, and which kind each depends on, for a table of texts."""
    texts = [("d1", "SELECT a, sum(b) FROM t WHERE c = 1 GROUP BY a"), ("d2", "SELECT t.a FROM t JOIN u ON t.i = u.i ORDER BY t.a LIMIT 5"), ("d3", "SELECT count(*) FROM t")]
    found = reuse.query_components(spark.createDataFrame(texts, "query_id string, sql string"))
    names = found.select("query_id", F.col("signature").alias("dep"), F.col("type").alias("needs"))
    return found.select("query_id", "type", F.explode_outer("deps").alias("dep")).join(names, ["query_id", "dep"], "left").select("query_id", "type", F.coalesce("needs", F.lit("")).alias("needs"))


@_query("""
    WITH old(signature, type, cost, valid_until) AS (VALUES ('s1', 'FROM', 1.0, TIMESTAMP '2024-01-01 10:30:00'), ('s2', 'WHERE', 5.0, TIMESTAMP '2024-01-01 09:00:00'), ('s3', 'JOIN', 20.0, TIMESTAMP '2024-01-01 12:00:00')),
         fresh(signature, type, cost) AS (VALUES ('s1', 'FROM', 2.0), ('s4', 'SELECT', 1.0), ('s4', 'SELECT', 3.0), ('s3', 'JOIN', 9.0)),
         everything AS (SELECT * FROM old WHERE valid_until > TIMESTAMP '2024-01-01 10:00:00' UNION ALL SELECT *, TIMESTAMP '2024-01-01 11:00:00' FROM fresh)
    SELECT signature, type, CAST(cost AS DOUBLE) AS cost, valid_until FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY valid_until DESC, cost DESC) AS n FROM everything) t WHERE n = 1""")
def reuse_registry_store(spark, sf_dir):
    """Components stored for an hour in a registry of which one entry has expired; each signature once."""
    stamp = lambda df: df.withColumn("valid_until", F.col("valid_until").cast("timestamp"))
    old = stamp(spark.createDataFrame([("s1", "FROM", 1.0, "2024-01-01 10:30:00"), ("s2", "WHERE", 5.0, "2024-01-01 09:00:00"), ("s3", "JOIN", 20.0, "2024-01-01 12:00:00")], "signature string, type string, cost double, valid_until string"))
    new = spark.createDataFrame([("s1", "FROM", 2.0), ("s4", "SELECT", 1.0), ("s4", "SELECT", 3.0), ("s3", "JOIN", 9.0)], "signature string, type string, cost double")
    return reuse.stored(old, new, F.lit("2024-01-01 10:00:00").cast("timestamp")).withColumn("valid_until", F.col("valid_until").cast("timestamp_ntz"))


@_query("""
    SELECT case_id, len(list_filter(tables, lambda x: NOT list_contains(cached_tables, x))) = 0 AND len(list_filter(cols, lambda x: NOT list_contains(cached_cols, x))) = 0 AS fits
    FROM (VALUES ('v1', ['a','b'], ['x','y'], ['a'], ['x']), ('v2', ['a'], ['x'], ['a','b'], ['x']), ('v3', ['a'], ['x'], ['a'], ['x','z']), ('v4', ['a'], ['x'], CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]))) t(case_id, cached_tables, cached_cols, tables, cols)""")
def reuse_schema_compatible(spark, sf_dir):
    rows = [("v1", ["a", "b"], ["x", "y"], ["a"], ["x"]), ("v2", ["a"], ["x"], ["a", "b"], ["x"]), ("v3", ["a"], ["x"], ["a"], ["x", "z"]), ("v4", ["a"], ["x"], [], [])]
    df = spark.createDataFrame(rows, "case_id string, cached_tables array<string>, cached_cols array<string>, tables array<string>, cols array<string>")
    return df.select("case_id", reuse.compatible("cached_tables", "cached_cols", "tables", "cols").alias("fits"))


@_query("""
    WITH found(query_id, cached_id, score, original_us) AS (VALUES ('q1', 'c1', 0.9, 10000.0), ('q1', 'c2', 1.0, 10000.0), ('q1', 'c3', 0.8, 10000.0), ('q2', 'c4', 0.7, 10000.0), ('q2', 'c1', 0.6, 1.9), ('q2', 'c5', 0.55, 3.0)),
         cached(cached_id, age_s, ttl_s) AS (VALUES ('c1', 60, 3600), ('c2', 7200, 0), ('c3', 7200, 3600), ('c5', 4000, 0)),
         both_ AS (SELECT f.*, age_s, ttl_s, CASE WHEN age_s > 3600 THEN 1.5 ELSE 1.0 END AS retrieval FROM found f LEFT JOIN cached c USING (cached_id)),
         judged AS (SELECT *, round(original_us / retrieval, 4) AS speedup, original_us - retrieval AS saving_us,
                    CASE WHEN age_s IS NULL THEN 'gone' WHEN ttl_s > 0 AND age_s > ttl_s THEN 'expired' WHEN round(original_us / retrieval, 4) < 2 THEN 'too little gain' ELSE '' END AS why FROM both_)
    SELECT query_id, cached_id, CAST(score AS DOUBLE) AS score, why = '' AS valid, why, CAST(speedup AS DOUBLE) AS speedup, CAST(saving_us AS DOUBLE) AS saving_us,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY saving_us DESC, score DESC, cached_id) AS INTEGER) AS place FROM judged""")
def reuse_opportunities_validated(spark, sf_dir):
    """Opportunities, the most saving first, each checked: still there, not expired, at least twice as fast."""
    found = spark.createDataFrame([("q1", "c1", 0.9, 10000.0), ("q1", "c2", 1.0, 10000.0), ("q1", "c3", 0.8, 10000.0), ("q2", "c4", 0.7, 10000.0), ("q2", "c1", 0.6, 1.9), ("q2", "c5", 0.55, 3.0)], "query_id string, cached_id string, score double, original_us double")
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    cached = spark.createDataFrame([("c1", 60, 3600), ("c2", 7200, 0), ("c3", 7200, 3600), ("c5", 4000, 0)], "cached_id string, age_s int, ttl_s int").withColumn("created", now - F.make_dt_interval(secs=F.col("age_s")))
    return reuse.validated(found, cached, now, F.col("original_us"))


_TEXTS = [("x1", "SELECT 1", 0), ("x2", "  with a as (select 1) select * from a", 0), ("x3", "EXPLAIN SELECT 1", 0), ("x4", "SELECT invalid syntax", 0), ("x5", "SELECT x FROM t WHERE state = 'invalid'", 1), ("x6", "syntax error here", 0), ("x7", "SELECT now() FROM", 0), ("x8", "select sysdate from dual", 0), ("x9", "", 0), ("y1", "DROP TABLE t", 0)]


@_query(f"""
    SELECT text_id, CASE WHEN contains(up, 'SYNTAX ERROR') THEN 'syntax error words' WHEN contains(up, 'INVALID') AND NOT contains(up, 'WHERE') THEN 'invalid'
        WHEN NOT regexp_matches(up, '^(SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|WITH)') THEN 'no statement keyword'
        WHEN up LIKE 'SELECT%' AND contains(up, 'FROM') AND NOT contains(up, 'DUAL') AND tabs = 0 THEN 'FROM without tables' END AS problem
    FROM (SELECT text_id, upper(trim(sql)) AS up, tabs FROM ({_values("text_id:VARCHAR, sql:VARCHAR, tabs:INTEGER", _TEXTS)}) t) u""")
def decompose_text_rules(spark, sf_dir):
    """What is wrong with texts before they are taken apart."""
    rows = spark.createDataFrame(_TEXTS, "text_id string, sql string, tabs int")
    return rows.select("text_id", reuse.text_problem(F.col("sql"), F.col("tabs")).alias("problem"))


_NESTED = "WITH RECURSIVE r AS (SELECT id FROM a UNION ALL SELECT a.id FROM a JOIN r ON a.up = r.id), s AS (SELECT id, count(*) AS n FROM r GROUP BY id) SELECT * FROM s WHERE EXISTS (SELECT 1 FROM b WHERE b.k = s.id) AND n > (SELECT avg(n) FROM s) AND id IN (SELECT id FROM c WHERE t > now())"


@_query(_values("kind:VARCHAR, name:VARCHAR, tables:VARCHAR, depends_on:VARCHAR, correlated:BOOLEAN, recursive:BOOLEAN, cost_us:INTEGER, cacheable:DOUBLE", [
    ("cte", "r", "a,r", "", False, True, 350, "1"), ("cte", "s", "r", "r", False, False, 250, "1"), ("exists", "", "b", "", True, False, 150, "0.7"), ("scalar", "", "s", "s", False, False, 150, "1"), ("in", "", "c", "", False, False, 150, "0.5"),
]))
def decompose_parts(spark, sf_dir):
    """A statement's CTEs and nested queries: what they read and depend on, cost and worth of caching."""
    rows = [(p.kind, p.name, ",".join(p.tables), ",".join(p.depends_on), p.correlated, p.recursive, p.cost_us, float(p.cacheable)) for p in decompose.decompose(_NESTED).parts]
    return spark.createDataFrame(rows, "kind string, name string, tables string, depends_on string, correlated boolean, recursive boolean, cost_us int, cacheable double")


@_query(_values("query_id:VARCHAR, outcome:VARCHAR, complexity:INTEGER, cacheable:DOUBLE, level:VARCHAR, action:VARCHAR", [
    ("m1", "done", 10, "0.8", "simple", "simple_caching"), ("m2", "done", 10, "0.7", "simple", "simple_caching"), ("m3", "refused", None, None, None, None), ("m4", "late", None, None, None, None),
    ("m5", "done", 78, "1", "high", "decomposition_recommended"),
]))
def decompose_statements(spark, sf_dir):
    """Statements taken apart: scores, level and recommendation; one that doesn't parse, one that gets no time."""
    rows = []
    for name, sql, limit in (("m1", "SELECT a FROM t", 1.0), ("m2", "SELECT count(*) FROM t WHERE x > now()", 1.0), ("m3", "SELECT FROM WHERE", 1.0), ("m4", "SELECT a FROM t", -1.0), ("m5", "SELECT x.a, x.b FROM (SELECT a, b FROM t WHERE c > 1) x WHERE x.a IN (SELECT a FROM u)", 1.0)):
        try:
            d = decompose.decompose(sql, limit, clock=itertools.count().__next__ if limit < 0 else lambda: 0.0)
            rows.append((name, "done", d.complexity, float(d.cacheable), d.level, d.action))
        except decompose.DecompositionTimeout:
            rows.append((name, "late", None, None, None, None))
        except decompose.SqlError:
            rows.append((name, "refused", None, None, None, None))
    return spark.createDataFrame(rows, "query_id string, outcome string, complexity int, cacheable double, level string, action string")


# the graph
@_query(f"WITH {_GRAPH_CTE}, kept AS (SELECT * FROM n WHERE id NOT IN ('g1', 'g7', 'nobody')) SELECT a.id AS src, b.id AS dst FROM kept a JOIN e ON e.src = a.id JOIN kept b ON e.dst = b.id UNION ALL SELECT id, NULL FROM kept")
def graph_remove(spark, sf_dir):
    """Nodes (dst null) and edges that are left when queries are removed."""
    nodes = _graph(spark)
    kept, edges = graph.remove(nodes, graph.dependencies(nodes), spark.createDataFrame([("g1",), ("g7",), ("nobody",)], "query_id string"))
    return edges.unionByName(kept.select(F.col("query_id").alias("src"), F.lit(None).cast("string").alias("dst")))


@_query(_values("step:INTEGER, query_id:VARCHAR", [(1, "g2"), (2, "g1"), (3, "g4"), (4, "g3"), (5, "g7"), (6, "g5")]))
def graph_dependency_chain(spark, sf_dir):
    """What g5 depends on and g5 itself, each after what it needs (g1 and g2 need each other, as do queries of equal tables)."""
    nodes = _graph(spark)
    return graph.dependency_chain(graph.dependencies(nodes), "g5")


@_query(f"""WITH {_GRAPH_CTE} SELECT 0 AS part, '' AS a, '' AS b, 'digraph queries {{' AS line UNION ALL SELECT 3, '', '', '}}'
    UNION ALL SELECT 1, id, '', '  "' || id || '" [label="' || id || '\\n' || array_to_string(tabs, ',') || '"];' FROM n
    UNION ALL SELECT 2, src, dst, '  "' || src || '" -> "' || dst || '";' FROM e""")
def graph_dot(spark, sf_dir):
    nodes = _graph(spark)
    return graph.dot_lines(nodes.withColumn("tables", F.array_sort("tables")), graph.dependencies(nodes))


# completion
def _engine():
    return completion.Engine(catalog.star_catalog())


@_query(_values("change:VARCHAR, same_version:BOOLEAN", [("order", True), ("added column", False), ("search path", False), ("same again", True)]))
def catalog_versions(spark, sf_dir):
    """Whether a catalog's version stays when its content is given in another order or changed."""
    base = catalog.star_catalog()
    more = catalog.Catalog((*base.tables[1:], catalog.Table("public", "region", (*base.tables[0].columns, catalog.Column("extra")))), base.search_path)
    cases = {"order": catalog.Catalog(base.tables[::-1], base.search_path), "added column": more, "search path": catalog.Catalog(base.tables, ("sales", "public")), "same again": catalog.star_catalog()}
    return spark.createDataFrame([(k, v.version() == base.version()) for k, v in cases.items()], "change string, same_version boolean")


@_query(_values("case_id:VARCHAR, outcome:VARCHAR", [("schema", "sales.returns"), ("path", "public.orders"), ("case", "public.nation"), ("order of path", "b.t"), ("order of schema", "a.t"), ("unknown", "none"), ("bad foreign key", "False"), ("no name", "refused")]))
def catalog_resolution(spark, sf_dir):
    """Names looked up by schema, search path, then order of schema; validity of keys and tables."""
    star = catalog.star_catalog()
    two = catalog.Catalog((catalog.Table("a", "t"), catalog.Table("b", "t")), ("b",))
    text = lambda t: f"{t.schema}.{t.name}" if t else "none"
    rows = [("schema", text(star.resolve("returns", "sales"))), ("path", text(star.resolve("orders"))), ("case", text(star.resolve("NATION"))), ("order of path", text(two.resolve("t"))), ("order of schema", text(catalog.Catalog(two.tables[::-1], ("c",)).resolve("t"))), ("unknown", text(star.resolve("nothing")))]
    rows.append(("bad foreign key", str(catalog.ForeignKey("k", ("a", "b"), "t", ("x",)).valid())))
    try:
        catalog.Catalog((catalog.Table("a", ""),)).canonical()
    except ValueError:
        rows.append(("no name", "refused"))
    return spark.createDataFrame(rows, "case_id string, outcome string")


_REQUESTS = {
    "empty": ("", 0, "", None), "cursor": ("SELECT a", 99, "", None), "inside a character": ("SELECT é", 8, "", None), "version": ("SELECT ", 7, "sha256:0", None), "parser": ("SELECT * FROM orders o WHERE ", 29, "", None),
    "degraded": ("SELECT o. FROM orders o JOIN ON", 9, "", None), "provider": ("SELECT * FROM nat", 17, "", "good"), "provider fails": ("SELECT * FROM nat", 17, "", "bad"),
}


@_query(_values("case_id:VARCHAR, clause:VARCHAR, source:VARCHAR, diagnostics:VARCHAR, n:INTEGER, first_text:VARCHAR", [
    ("empty", "unknown", "parser", "CatalogMissing", 0, ""), ("cursor", "unknown", "parser", "InvalidCursorSpan", 0, ""), ("inside a character", "unknown", "parser", "InvalidCursorSpan", 0, ""), ("version", "unknown", "parser", "CatalogVersionUnknown", 0, ""),
    ("parser", "where", "parser", "ParseDegraded", 20, "o.o_custkey"), ("degraded", "select", "parser", "ParseDegraded", 7, "o.o_custkey"), ("provider", "from", "provider", "", 2, "nation"), ("provider fails", "from", "parser", "ProviderUnavailable", 1, "nation"),
]))
def completion_requests(spark, sf_dir):
    """Requests that end early, degrade, or go through a provider; at most 20 candidates unless told otherwise."""
    def good(request):
        return [completion.Candidate("table", "nat_from_provider", "nat_from_provider")]

    rows = []
    for name, (sql, cursor, version, provider) in _REQUESTS.items():
        engine = completion.Engine(catalog.star_catalog(), {"good": good, "bad": lambda r: 1 / 0}.get(provider))
        got = engine.complete(completion.Request(sql, cursor, version))
        rows.append((name, got.clause, got.source, ",".join(got.diagnostics), len(got.candidates), got.candidates[0].insert_text if got.candidates else ""))
    return spark.createDataFrame(rows, "case_id string, clause string, source string, diagnostics string, n int, first_text string")


@_query(_values("text_id:VARCHAR, pos:INTEGER, kind:VARCHAR, insert_text:VARCHAR", [
    *[("star", k, "snippet", f"* FROM {t}") for k, t in enumerate(["customer", "lineitem", "nation", "orders", "part", "region", "sales.returns", "supplier"], 1)], ("star", 9, "snippet", "SELECT * FROM "),
    ("typed", 1, "snippet", "r_name FROM region"), ("typed", 2, "snippet", "r_regionkey FROM region"),
]))
def completion_select_without_from(spark, sf_dir):
    """SELECT without a FROM: whole statements over a table, or over a column whose beginning is typed."""
    rows = []
    for name, sql in (("star", "SELECT "), ("typed", "SELECT r_")):
        got = _engine().complete(completion.Request(sql, len(sql), max_candidates=50))
        rows += [(name, k, c.kind, c.insert_text) for k, c in enumerate((c for c in got.candidates if c.kind == "snippet"), 1)]
    return spark.createDataFrame(rows, "text_id string, pos int, kind string, insert_text string")


@_query(_values("case_id:VARCHAR, outcome:VARCHAR", [
    ("qualifier kept", "SELECT o.o_orderdate FROM orders o"), ("word replaced", "SELECT * FROM nation WHERE 1 = 1"), ("space not doubled", "SELECT * FROM nation WHERE x"), ("cuts a character", "EditConflict"),
]))
def completion_edit_plan(spark, sf_dir):
    """Chosen candidates put into their texts."""
    engine, rows = _engine(), []
    column, table, word = completion.Candidate("column", "o.o_orderdate", "o.o_orderdate"), completion.Candidate("table", "nation", "nation"), completion.Candidate("keyword", "WHERE", "WHERE ", "parser")
    for name, sql, cursor, chosen in (("qualifier kept", "SELECT o.o_ord FROM orders o", 14, column), ("word replaced", "SELECT * FROM nat WHERE 1 = 1", 16, table), ("space not doubled", "SELECT * FROM nation WH x", 23, word), ("cuts a character", "SELECT é", 8, table)):
        try:
            rows.append((name, apply(sql, [engine.plan_edit(completion.Request(sql, cursor), chosen)])))
        except ValueError as error:
            rows.append((name, str(error).split(":")[0]))
    return spark.createDataFrame(rows, "case_id string, outcome string")


@_query(_values("case_id:VARCHAR, outcome:VARCHAR", [("order", "0-1=x;3-3=i;3-4=z"), ("applied", "xπiz"), ("overlap", "refused"), ("backwards", "refused"), ("beyond the end", "refused"), ("cuts a character", "refused")]))
def text_edit_sets(spark, sf_dir):
    """Sets of edits in canonical order, checked for overlap and range, applied."""
    rows = [("order", ";".join(f"{e.start}-{e.end}={e.new_text}" for e in canonical([Edit(3, 4, "z"), Edit(0, 1, "x"), Edit(3, 3, "i")]))), ("applied", apply("aπc", [Edit(3, 4, "z"), Edit(0, 1, "x"), Edit(3, 3, "i")]))]
    for name, edits in (("overlap", [Edit(0, 3, ""), Edit(2, 4, "")]), ("backwards", [Edit(2, 1, "")]), ("beyond the end", [Edit(0, 99, "")]), ("cuts a character", None)):
        try:
            rows.append((name, "fine" if (check(edits, 10) if edits else apply("aπc", [Edit(2, 3, "")])) is None else "applied"))
        except ValueError:
            rows.append((name, "refused"))
    return spark.createDataFrame(rows, "case_id string, outcome string")


@_query(_values("code:VARCHAR", [(c,) for c in ("InvalidCursorSpan", "ParseDegraded", "AmbiguousContext", "EditConflict", "ProviderUnavailable", "CatalogMissing", "CatalogIncompatible", "CatalogVersionUnknown")]))
def completion_diagnostic_codes(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in completion.DIAGNOSTICS], "code string")


@_query(_values("text_id:VARCHAR, clause:VARCHAR, bound:VARCHAR, degraded:BOOLEAN", [
    ("t1", "where", "c=customer,o=orders", False), ("t2", "join_on", "c=customer,o=orders", True), ("t3", "from_tail", "orders=orders", False), ("t4", "select", "", False),
]))
def completion_contexts(spark, sf_dir):
    """The clause at the end of a text and the tables it binds, by the parser or, for broken texts, by the words."""
    cat, rows = catalog.star_catalog(), []
    for name, sql in (("t1", "SELECT * FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderkey > 1"), ("t2", "SELECT * FROM orders o JOIN customer c ON "), ("t3", "SELECT * FROM orders "), ("t4", "SELECT 1")):
        bound, good = completion._bindings(sql, cat)
        rows.append((name, completion.clause_at(sql, len(sql.encode())), ",".join(sorted(f"{q}={t.name}" for q, t in bound)), not good))
    return spark.createDataFrame(rows, "text_id string, clause string, bound string, degraded boolean")


# decoded messages
def _message_log(spark, sf_dir):
    """Messages made of orders by arithmetic, each a transaction of its own: every order inserted, every third updated with
    its price not sent, every fifth with its price null, every seventh deleted, and truncates, which count for nothing."""
    o = read(spark, sf_dir, "orders")
    key, cell = F.col("o_orderkey"), lambda name, kind, text, oid, is_key=False: F.struct(F.lit(name).alias("name"), F.lit(is_key).alias("is_key"), F.lit(oid).alias("oid"), F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    none = F.lit(None).cast("string")
    own = cell("id", "t", key, 20, True)
    row = lambda status, price: F.array(own, status, price)
    status, price = cell("status", "t", F.col("o_orderstatus"), 25), cell("price", "t", F.col("o_totalprice").cast("decimal(18,2)"), 1700)
    changed, unsent, null = cell("status", "t", F.lit("U"), 25), cell("price", "u", none, 1700), cell("price", "n", none, 1700)
    nothing = F.lit(None).cast(cdc.TUPLE)
    kinds = [(1, "I", nothing, row(status, price)), (3, "U", nothing, row(changed, unsent)), (5, "U", nothing, row(cell("status", "u", none, 25), null)), (7, "D", F.array(own), nothing), (11, "T", nothing, nothing)]
    made = [F.when(key % every == 0, F.struct(F.lit(k).alias("phase"), F.lit(action).alias("action"), old.cast(cdc.TUPLE).alias("old"), new.cast(cdc.TUPLE).alias("new"))) for k, (every, action, old, new) in enumerate(kinds)]
    rows = o.select("o_orderkey", F.explode(F.array_compact(F.array(*made))).alias("m"))
    lsn = F.concat(F.hex(F.col("m.phase").cast("long") + 1), F.lit("/"), F.hex(key))
    return rows.select(lsn.alias("commit_lsn"), F.lit(0).alias("seq"), F.lit("public.orders").alias("table_name"), "m.action", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("commit_time"), "m.old", "m.new")


@_query("""
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS status,
           CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS price FROM orders WHERE o_orderkey % 7 <> 0""")
def cdc_decode_messages(spark, sf_dir):
    """Insert, update and delete messages decoded (nulls, columns that were not sent, values by type number) and applied."""
    state = cdc.final_state(cdc.decoded(_message_log(spark, sf_dir)), "id", {"status": "string", "price": "decimal(18,2)"})
    return state.select(F.col("id").cast("bigint").alias("id"), "status", F.col("price").cast("double").alias("price"))


@_query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN 0.0 ELSE CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DOUBLE) END AS quantity
    FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber) t WHERE l_linenumber <> 3""")
def cdc_composite_keys(spark, sf_dir):
    """A log of rows that two columns identify: all are inserted, those of even orders updated, third lines deleted."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    new = [("insert", F.lit(True), F.to_json(F.struct(F.col("l_quantity").cast("decimal(18,2)").alias("quantity")))), ("update", F.col("l_orderkey") % 2 == 0, F.lit('{"quantity":0}')), ("delete", F.col("l_linenumber") == 3, F.lit(None).cast("string"))]
    made = F.array_compact(F.array(*[F.when(cond, F.struct(F.concat(F.lit(f"{k}/"), F.hex(F.col("l_orderkey"))).alias("commit_lsn"), F.lit(op).alias("operation"), text.alias("new"))) for k, (op, cond, text) in enumerate(new, 1)]))
    log = rows.select("l_orderkey", "l_linenumber", F.explode(made).alias("c"))
    log = log.select("c.commit_lsn", F.col("l_linenumber").alias("seq"), F.lit("public.lineitem").alias("table_name"), "c.operation", F.lit(None).cast("timestamp").alias("commit_time"), F.to_json(F.struct("l_orderkey", "l_linenumber")).alias("keys"), F.lit(None).cast("string").alias("old"), "c.new")
    state = cdc.final_state(log, "l_orderkey", {"quantity": "double"}, keys=["l_orderkey", "l_linenumber"])
    return state.select(F.col("l_orderkey").cast("bigint").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"), "quantity")


@_query(_values("text_id:VARCHAR, tbl:VARCHAR, col:VARCHAR, path:VARCHAR, op:VARCHAR, is_text:BOOLEAN", [
    ("w1", "users", "data", "address.city", "->>", True), ("w2", "events", "props", "a.b", "#>", False), ("w2", "u", "extra", "0.k", "->>", True), ("w3", "t", "doc", "it's", "->", False),
]))
def sql_jsonpaths_of_any_text(spark, sf_dir):
    """JSON paths of a text that parses and of texts that don't."""
    from tideline.functions.analyze import json_paths_of_text

    texts = [("w1", "SELECT data->'address'->>'city' FROM users"), ("w2", "SELECT props #> '{a,b}', u.extra->0->>'k' FROM events WHERE ) broken"), ("w3", "SELECT doc->'it''s' /* x->'no' */ FROM t GROUP HAVING"), ("w4", "nothing here")]
    rows = [(name, p["table"], p["column"], ".".join(p["path"]), p["operator"], p["is_text"]) for name, sql in texts for p in json_paths_of_text(sql)]
    return spark.createDataFrame(rows, "text_id string, tbl string, col string, path string, op string, is_text boolean")
