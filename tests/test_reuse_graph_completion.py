"""Reuse, graph, catalog, edits and completion."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.functions.edits import Edit, apply, check
from tideline.plans import catalog, completion, graph, reuse

CAT = catalog.star_catalog()


def test_signatures_hold_their_context():
    sig = lambda sql, kind: next(c["signature"] for c in reuse.components(sql) if c["type"] == kind)
    assert sig("SELECT a FROM t WHERE id = 1", "WHERE") != sig("SELECT a FROM u WHERE id = 1", "WHERE")
    assert sig("SELECT count(x) FROM t", "AGGREGATION") != sig("SELECT count(DISTINCT x) FROM t", "AGGREGATION")
    assert sig("SELECT a FROM t WHERE x = 1 AND y = 2", "WHERE") == sig("SELECT a FROM t WHERE y = 2 AND x = 1", "WHERE")
    assert {c["type"] for c in reuse.components("SELECT country, count(*) FROM t JOIN u ON t.a = u.b GROUP BY country ORDER BY 1 LIMIT 3")} == {"SELECT", "FROM", "JOIN", "GROUP_BY", "AGGREGATION", "ORDER_BY", "LIMIT"}


def test_expired_components_are_not_used(spark):
    needed = reuse.query_components(spark.createDataFrame([("q", "SELECT a FROM t")], "query_id string, sql string"))
    rows = [(c["signature"], c["type"], c["tables"], c["columns"], c["filters"], 9.0, 5) for c in reuse.components("SELECT a FROM t")]
    registry = spark.createDataFrame(rows, "signature string, type string, tables array<string>, columns array<string>, filters array<string>, cost double, valid_until int")
    from pyspark.sql import functions as F

    hows = lambda at: {r["type"]: r["how"] for r in reuse.match(needed, registry, F.lit(at)).collect()}
    assert hows(4) == {"SELECT": "exact", "FROM": "exact"} and hows(5) == {"SELECT": "new", "FROM": "new"}


def test_plan_registry(spark):
    now = [0.0]
    r = reuse.PlanRegistry(spark, ttl_s=10, clock=lambda: now[0])
    df = spark.range(10).selectExpr("id * 2 AS x")
    r.put(df)
    assert r.get(spark.range(10).selectExpr("id * 2 AS x")) is not None and r.get(spark.range(11).selectExpr("id * 2 AS x")) is None
    now[0] = 10.0
    assert r.get(df) is None and not r.entries
    r.clear()


def test_chain_survives_cycles():
    assert graph.chain([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")], "a") == ["c", "b", "d", "a"]
    assert graph.chain([], "x") == ["x"]


def test_affected_with_a_cycle(spark):
    nodes = graph.nodes(spark.createDataFrame([("a", "SELECT 1 FROM t"), ("b", "SELECT 2 FROM t"), ("c", "SELECT 1 FROM t JOIN u ON t.x = u.x"), ("d", "SELECT FROM")], "query_id string, sql string"))
    edges = graph.dependencies(nodes)
    assert sorted(r[0] for r in graph.affected(nodes, edges, "T").collect()) == ["a", "b", "c"]
    assert [r[0] for r in graph.affected(nodes, edges, "u").collect()] == ["c"]
    assert '"c" -> "a"' in graph.dot(nodes, edges)


def test_catalog_version_ignores_order():
    tables = list(CAT.tables)
    random.Random(1).shuffle(tables)
    assert catalog.Catalog(tuple(tables)).version() == CAT.version() != catalog.Catalog(tuple(tables[1:])).version()


@pytest.mark.parametrize("sql,clause", [("SELECT ", "select"), ("SELECT a FROM ", "from"), ("SELECT a FROM t ", "from_tail"), ("SELECT a FROM t, ", "from"), ("SELECT a FROM t JOIN ", "join"), ("SELECT a FROM t JOIN u ON ", "join_on"), ("SELECT a FROM t WHERE ", "where"), ("SELECT a FROM t GROUP BY ", "group_by"), ("SELECT a FROM t ORDER BY ", "order_by"), ("", "unknown"), ("SELECT 'from ' ", "select"), ("SELECT a FROM t WHERE x IN (SELECT ", "select"), ("SELECT a /* FROM */ ", "select"), ("SELECT (SELECT 1 FROM x WHERE y) ", "select")])
def test_clause(sql, clause):
    assert completion.clause_at(sql, len(sql.encode())) == clause


def test_completion_is_deterministic_and_degrades():
    engine = completion.Engine(CAT, provider=lambda r: 1 / 0)
    sql = "SELECT o.o_orderkey FROM orders o JOIN customer c ON "
    got = engine.complete(completion.Request(sql, len(sql)))
    assert got == engine.complete(completion.Request(sql, len(sql))) and got.diagnostics == ["ParseDegraded", "ProviderUnavailable"]
    assert got.candidates[0].kind == "column" and any(c.insert_text.startswith("c.") for c in got.candidates)
    assert engine.complete(completion.Request(sql, len(sql), "nope")).diagnostics == ["CatalogVersionUnknown"]
    assert engine.complete(completion.Request(sql, 999)).diagnostics == ["InvalidCursorSpan"]


def test_plan_edit_keeps_the_typed_qualifier():
    engine = completion.Engine(CAT)
    sql = "SELECT o.o_ord FROM orders o"
    request = completion.Request(sql, 14)
    edit = engine.plan_edit(request, engine.complete(request).candidates[0])
    assert apply(sql, [edit]) == "SELECT o.o_orderdate FROM orders o"


@given(st.text(alphabet="aπ漢 SELECTFROM.,('", max_size=40), st.integers(0, 60))
@settings(max_examples=300, deadline=None)
def test_completion_never_fails(sql, cursor):
    got = completion.Engine(CAT).complete(completion.Request(sql, cursor))
    assert len(got.candidates) <= completion.DEFAULT_CANDIDATES
    assert got.candidates == sorted(got.candidates, key=lambda c: -c.score)


def test_edits():
    assert apply("aπc", [Edit(3, 4, "z"), Edit(0, 1, "x")]) == "xπz"
    for bad in ([Edit(0, 3, ""), Edit(2, 4, "")], [Edit(2, 1, "")], [Edit(0, 99, "")]):
        with pytest.raises(ValueError):
            check(sorted(bad), 10)
    with pytest.raises(ValueError):
        apply("aπc", [Edit(2, 3, "")])
