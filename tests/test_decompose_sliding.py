"""Decomposition, single-query reuse plans, sliding sums, stream reports."""

import pytest
from pyspark.sql import functions as F

from tideline.functions.sqlparse import SqlError
from tideline.plans import decompose as D
from tideline.plans import reuse
from tideline.streaming import observe, sliding


def test_parts_and_scores():
    sql = "with recent as (select user_id from orders where ts > now()), big as (select user_id from recent) SELECT u.id FROM users u WHERE EXISTS (select 1 from big b where b.user_id = u.id) AND x = (SELECT max(y) FROM t GROUP BY z)"
    got = D.decompose(sql)
    assert [(p.kind, p.name, p.tables, p.depends_on, p.correlated, p.recursive) for p in got.parts] == [
        ("cte", "recent", ["orders"], [], False, False), ("cte", "big", ["recent"], ["recent"], False, False), ("exists", "", ["big"], ["big"], True, False), ("scalar", "", ["t"], [], False, False),
    ]
    assert got.complexity == 10 + 40 + 60 + 10 + 15 + 25 and got.action == "decomposition_recommended"
    assert [p.kind for p in D.worth_caching(got)] == ["scalar", "cte", "cte"]
    assert got.parts[0].cacheable == 0.5 and got.parts[2].cacheable == 0.7


def test_only_self_reference_is_recursive():
    got = D.decompose("WITH RECURSIVE a AS (SELECT 1 UNION ALL SELECT n FROM a), b AS (SELECT 2) SELECT * FROM a, b")
    assert {p.name: p.recursive for p in got.parts} == {"a": True, "b": False}


def test_normal_forms_and_time():
    assert D.normalized("select  t.a from t where x = 'it''s' and y > 10") == "SELECT ?.? FROM T WHERE X = ? AND Y > ?"
    assert D.decompose("SELECT 1 FROM t").query_id == D.decompose("select 2\nfrom t").query_id
    ticks = iter([0.0, 0.0, 5.0, 5.0])
    with pytest.raises(D.DecompositionTimeout):
        D.decompose("SELECT 1 FROM t", clock=lambda: next(ticks))
    with pytest.raises(SqlError):
        D.decompose("SELECT FROM")


def test_compile_gate_and_steps():
    cached = [c | {"valid_until": 10} for c in reuse.components("SELECT a, b FROM t WHERE k = 1")]
    plan = D.compile_query("SELECT a FROM t WHERE k = 1 AND j = 2", cached)
    assert plan.optimized and [s.kind for s in plan.steps] == ["cached", "cached", "compute", "merge"]
    assert not D.compile_query("SELECT a FROM t WHERE k = 2", [c for c in cached if c["type"] == "SELECT"]).optimized
    assert not D.compile_query("SELECT a FROM t WHERE k = 1 AND j = 2", cached, threshold=99).optimized
    assert not D.compile_query("SELECT a, b FROM t WHERE k = 1", cached, now=10).optimized
    assert D.compile_query("WITH w AS (SELECT 1) SELECT a FROM w", []).steps
    with pytest.raises(SqlError):
        D.compile_query("DELETE FROM t", [])


def test_sliding_sums_equal_a_recount(spark):
    rows = spark.range(200).select((F.timestamp_seconds(1704067200 + F.col("id") * 37)).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    state = None
    for part in range(4):
        state = sliding.merged(state, sliding.slots(rows.where(f"v % 4 = {part}"), ["k"], F.col("v"), "1 minute"), ["k"])
    now = F.lit("2024-01-01 01:30:00").cast("timestamp")
    got = {r["k"]: (r["total"], r["n"]) for r in sliding.current(state, ["k"], now, "30 minutes").collect()}
    plain = rows.where("ts >= timestamp'2024-01-01 01:01:00' and ts < timestamp'2024-01-01 01:31:00'").groupBy("k").agg(F.sum("v"), F.count("*"))
    assert got == {r[0]: (r[1], r[2]) for r in plain.collect()}
    assert sliding.merged(state, state.limit(0), ["k"], F.lit("2024-01-01 01:00:00").cast("timestamp")).count() < state.count()


def test_reports(spark, tmp_path):
    counters = observe.Counters()
    listener = observe.Reporter(counters)
    spark.streams.addListener(listener)
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        import time

        end = time.time() + 10
        while "stream.ended" not in counters.counts and time.time() < end:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert counters.counts["stream.rows"] == 5 and counters.counts["stream.ended"] == 1
