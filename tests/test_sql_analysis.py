"""The parser, the extractors and the Spark printer."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.functions import analyze as A
from tideline.functions.sqlparse import SqlError, parse
from tideline.plans import dialect

GOOD = [
    "SELECT DISTINCT ON (a) a, b->'x'->>'y' k FROM t WHERE ts > NOW() - INTERVAL '1 hour' ORDER BY 1 DESC NULLS LAST LIMIT 5 OFFSET 2",
    "WITH RECURSIVE a(n) AS (SELECT 1 UNION ALL SELECT n+1 FROM a WHERE n<5) SELECT * FROM a, b LEFT JOIN c USING (id, k) JOIN LATERAL (SELECT 1) z ON true",
    "UPDATE a SET x = 1 FROM b WHERE a.id=b.id AND EXISTS (SELECT 1 FROM c)",
    "DELETE FROM a USING b WHERE a.id=b.id",
    "INSERT INTO t (a,b) SELECT 1, 2 FROM u ON CONFLICT DO NOTHING",
    "SELECT rank() OVER (PARTITION BY d ORDER BY s DESC ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM e WINDOW w AS (PARTITION BY q)",
    "SELECT a::int, '1 day'::interval, data #>> '{a,b}', d @> '{\"a\":1}', d ? 'k', $1 FROM \"My T\".x AS y -- hi\n",
    "SELECT * FROM a UNION SELECT * FROM b INTERSECT SELECT * FROM c ORDER BY 1",
    "SELECT 1 FROM t GROUP BY ROLLUP(a,b), GROUPING SETS ((a),(b),())",
    "SELECT x NOT BETWEEN 1 AND 2 AND NOT y IS NULL OR z NOT ILIKE '%q' FROM t",
]
BAD = ["", ";", "SELECT FROM WHERE", "SELECT a FROM", "SELEC a", "SELECT * FROM a JOIN b", "SELECT (1", "SELECT 'x", "SELECT a b c FROM t"]


@pytest.mark.parametrize("sql", GOOD)
def test_parses(sql):
    assert A.metadata(parse(sql))["operation"] in ("SELECT", "INSERT", "UPDATE", "DELETE")
    assert A.metadata(sql) == A.metadata(sql)


@pytest.mark.parametrize("sql", BAD)
def test_rejects(sql):
    with pytest.raises(SqlError):
        parse(sql)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_parses_or_is_an_error(text):
    try:
        A.metadata(text)
    except (SqlError, RecursionError):
        pass


@pytest.mark.parametrize("cond", ["a = 1", "a IN (1, 2)", "a IS NOT NULL", "a LIKE 'x%'", "a BETWEEN 1 AND 2", "a <> 3", "NOT a = 1", "4 > a"])
def test_filters(cond):
    want = {"a = 1": "=", "a IN (1, 2)": "IN", "a IS NOT NULL": "IS NOT", "a LIKE 'x%'": "LIKE", "a BETWEEN 1 AND 2": "BETWEEN", "a <> 3": "!=", "NOT a = 1": "!=", "4 > a": "<"}
    assert [f["operator"] for f in A.filters(f"SELECT 1 FROM t WHERE {cond}")] == [want[cond]]
    assert A.filters(f"SELECT 1 FROM t WHERE {cond} OR b = 2") == []


def test_case_aggregates():
    got = A.case_aggregates("SELECT SUM(CASE WHEN s = 'x' AND k IN (1, 2) THEN 1 END) AS n, COUNT(CASE WHEN ok THEN 1 END) c, SUM(CASE WHEN s = 'y' THEN amount ELSE 5 END) FROM t")
    assert [(g["func"], g["then_column"], g["else_const"]) for g in got] == [("COUNT", "", "0"), ("COUNT", "", "0"), ("SUM", "amount", "5")]
    assert [c["kind"] for c in got[0]["conditions"]] == ["eq", "in"]


def test_composition_signs():
    got = A.compositions("SELECT SUM(a) - (SUM(b) - SUM(c)) AS net FROM t")
    assert [(t["sign"], t["column"]) for t in got[0]["terms"]] == [(1, "a"), (-1, "b"), (1, "c")]


def test_sliding_window_turns_the_comparison():
    assert A.sliding_window("SELECT 1 FROM t WHERE NOW() - INTERVAL '2 hours' < ts")["operator"] == ">"
    assert A.sliding_window("SELECT 1 FROM t WHERE ts > NOW() - INTERVAL '2 hours' OR a = 1") is None


def test_tables_of_nested_places():
    sql = "SELECT (SELECT max(x) FROM a), f((SELECT 1 FROM b)) FROM c GROUP BY 1 HAVING count(*) > (SELECT 2 FROM d) UNION SELECT 1, 2 FROM e"
    assert A.tables(sql)["base"] == ["a", "b", "c", "d", "e"]


def test_fingerprint_classes():
    same = A.fingerprint("select * from t where a in (1,2,3) and b='x'")
    assert same == A.fingerprint("SELECT  * FROM t WHERE a IN (4) AND b = 'yy' -- c")
    assert same != A.fingerprint("SELECT * FROM u WHERE a IN (4) AND b = 'yy'")


def test_normalize_numbers_constants():
    assert A.normalize("SELECT a FROM t WHERE b = 'x' AND c > 10") == "SELECT a FROM t WHERE b = $1 AND c > $2"


DIALECT = {
    "SELECT event_id FROM events WHERE (props->>'k')::int > 90 AND props ? 'k'": None,
    "SELECT DISTINCT ON (user_id) user_id, event_id FROM events ORDER BY user_id, ts DESC": None,
    "SELECT count(*) AS n FROM events WHERE ts > NOW() - INTERVAL '1.5 hours' AND event_type = ANY(ARRAY['view','click'])": None,
    "SELECT date_trunc('hour', ts) AS b, count(*) FILTER (WHERE value > 20) AS n FROM events GROUP BY 1 ORDER BY 1 LIMIT 3": None,
}


@pytest.mark.parametrize("sql", DIALECT)
def test_printed_sql_gives_the_same_rows(spark, sf_dir, sql):
    import duckdb

    df = dialect.run(spark, sql, now="2024-01-20 00:00:00", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    plain = sql.replace("NOW()", "TIMESTAMP '2024-01-20 00:00:00'").replace("props ? 'k'", "json_exists(props, '$.k')").replace("'1.5 hours'", "'90 minutes'").replace("ANY(ARRAY['view','click'])", "ANY(['view','click'])")
    want = duckdb.sql(plain.replace("FROM events", f"FROM '{sf_dir}/events.parquet'")).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and want


def test_delete_and_update_leave_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, v string")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    assert [r.id for r in dialect.run(spark, "DELETE FROM a USING b WHERE a.id = b.k", a=a, b=b).collect()] == [2]
    assert sorted((r.id, r.v) for r in dialect.run(spark, "UPDATE a SET v = 'new' FROM b WHERE a.id = b.k", a=a, b=b).collect()) == [(1, "new"), (2, "y"), (3, "new")]
    assert sorted((r.id, r.v) for r in dialect.run(spark, "UPDATE a SET v = 'n' WHERE v = 'x'", a=a).collect()) == [(1, "n"), (2, "y"), (3, None)]


def test_corpus_errors_are_rows(spark):
    from tideline.operators.corpus import analyzed

    df = spark.createDataFrame([("a", "SELECT 1 FROM t"), ("b", "SELECT FROM"), ("c", None)], "id string, sql string")
    got = {r["id"]: r for r in analyzed(df, "metadata", "fingerprint").collect()}
    assert got["a"]["error"] is None and got["a"]["metadata"]["tables"] == ["t"]
    assert got["b"]["error"] and got["c"]["error"] and got["c"]["metadata"] is None
