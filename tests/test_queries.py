"""Every registered query of the engine against its independent SQL."""

import math

import duckdb
import pytest

from tideline.plans import registry, relational

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(data, names):
    order = [names.index(n) for n in sorted(names)]
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_oracle(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    found = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(found.fetchall(), names)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = registry.QUERIES["filter_eq_in_null"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(o_orderstatus,F)" in plan
    assert "o_totalprice" not in plan.split("ReadSchema")[1]


#: Queries whose all-pairs plan is their feature, over tables of a few rows.
SMALL_PAIRS = {"join_cross_small", "join_self_alias", "cte_recursive", "graph_stats"}


@pytest.mark.parametrize("name", [*relational.QUERIES, "graph_dependencies", "reuse_component_match", "reuse_similarity", "cdc_apply_final_state", "catalog_fk_join_paths", "reuse_opportunities_validated"])
def test_no_plan_pairs_all_rows(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert name in SMALL_PAIRS or "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_entry_module(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
