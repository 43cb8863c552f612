"""The pipeline's stages and the registered queries of the text operators."""

import random

import duckdb
import pytest

import corpus_pipeline
from tests.llm import plain
from tests.llm.test_operators import prose
from tideline.llm import queries as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus: prose of two languages, exact copies, a repeated line, a benchmark passage, odd rows."""
    root = tmp_path_factory.mktemp("sf")
    r = random.Random(1)
    texts = ["\n".join(f"{a} {b}." for a, b in zip(prose(20 + i, 4, most=30), prose(70 + i, 4, most=30))) for i in range(40)]
    other = [" ".join("".join(r.choice("mnpqrstuvéèü") for _ in range(r.randint(2, 8))) for _ in range(80)) for _ in range(40)]
    passage = " ".join(prose(99, 1, vocabulary=2000, most=60)[0].split()[:30]) + " " + " ".join(f"q{k}z" for k in range(15))
    docs = [(i, t, "xx", "s", len(t)) for i, t in enumerate(texts)] + [(100 + i, t, "yy", "s", len(t)) for i, t in enumerate(other)]
    docs += [(206, texts[6] + "\n\n \n" + texts[7], "xx", "s", 1), (200, texts[3], "xx", "s", len(texts[3])), (201, texts[4] + "\n" + texts[5].split("\n")[0], "xx", "s", 1), (202, other[0] + " " + passage, "yy", "s", 1), (203, None, "xx", "s", 0), (204, "", "xx", "s", 0), (205, "12 34", "xx", "s", 5)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages_one_after_the_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.save(stage(spark, docs, folder), name)
        assert docs.schema.simpleString() == spark.read.parquet(f"{folder}/documents.parquet").schema.simpleString()
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(before) - set(kept["language_id"]) == {203, 204, 205}
    assert 206 not in kept["line_dedup"] and 200 not in kept["line_dedup"] and 201 not in kept["line_dedup"] and kept["line_dedup"][3] == before[3]
    assert set(kept["simhash_neardup"]) == {g for _, g in plain.near_groups(list(kept["line_dedup"].items()), 5).values()}
    assert set(kept["simhash_neardup"]) - set(kept["decontamination"]) == {202}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.collect()} == set(kept["decontamination"])
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
        docs = docs if "text" in docs.columns else spark.createDataFrame([], SCHEMA)


def test_names_and_contract_columns(spark, sf_dir):
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 11))
    import __spark_entry__ as entry

    assert set(Q.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_url_query_matches_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    found = con.execute(Q.ORACLES["op4_url_digest_array"])
    names = [c[0] for c in found.description]
    got = Q.op4_url_digest_array(spark, sf_dir).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())


@pytest.mark.parametrize("name", ["op1_suffix_array_decontamination", "op6_columnwise_suffix_dedup", "op9_repetition_rules"])
def test_queries_match_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(Q.ORACLES[name])
    names = [c[0] for c in found.description]
    got = Q.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())


@pytest.mark.parametrize("name", ["op1_suffix_array_decontamination", "op6_columnwise_suffix_dedup"])
def test_queries_over_a_shared_table(spark, sf_dir, name):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    if name.startswith("op1"):
        want = plain.decontaminated(docs, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    else:
        want = plain.suffix_dedup(docs)
    assert sorted(map(tuple, Q.QUERIES[name](spark, sf_dir).collect())) == sorted(want)
