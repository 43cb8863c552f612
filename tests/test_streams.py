"""Change streams, checkpoints, retries, snapshots, publications and the provider."""

import pytest
from pyspark.sql import functions as F

from tideline.sources import publication, snapshot
from tideline.sources.changes import ChangeLogSource
from tideline.sources.provider import Provider
from tideline.streaming import cdc, supervisor


def change(lsn, seq, op, key, new=None):
    import json

    return (lsn, seq, "t", op, None, json.dumps({"id": key}), None, None if new is None else json.dumps(new))


LOG = [
    change("0/1", 0, "insert", 1, {"id": 1, "a": "x", "b": 1}), change("0/1", 1, "insert", 2, {"id": 2, "a": "y", "b": 2}), change("0/2", 0, "update", 1, {"a": None}),
    change("0/3", 0, "delete", 2), change("0/3", 1, "truncate", 9), change("0/4", 0, "update", 1, {"b": 7}), change("0/5", 0, "insert", 2, {"id": 2, "a": "z"}),
]
STATE = [(1, None, 7), (2, "z", None)]


def state(df):
    return sorted((int(r["id"]), r["a"], r["b"]) for r in df.collect())


def test_missing_is_not_null(spark):
    log = spark.createDataFrame(LOG, cdc.CHANGES)
    assert state(cdc.final_state(log, "id", {"a": "string", "b": "int"})) == STATE


def test_base_table_is_older_than_the_log(spark):
    base = spark.createDataFrame([(1, "old", 5), (3, "only", 6)], "id int, a string, b int")
    log = spark.createDataFrame([change("0/4", 0, "update", 1, {"b": 7})], cdc.CHANGES)
    assert state(cdc.final_state(log, "id", {"a": "string", "b": "int"}, base)) == [(1, "old", 7), (3, "only", 6)]


def test_empty_log(spark):
    assert cdc.final_state(spark.createDataFrame([], cdc.CHANGES), "id", {"a": "string"}).count() == 0


def test_stream_of_whole_transactions(spark, tmp_path):
    for k, part in enumerate((LOG[:3], LOG[3:])):
        spark.createDataFrame(part, cdc.CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        spark.dataSource.register(ChangeLogSource)
        source = spark.readStream.format("changelog").option("path", str(tmp_path / "log")).load()
        applier = cdc.TableApplier(spark, str(tmp_path / "state"), "id", {"a": "string", "b": "int"})
        last = cdc.apply_stream(source, applier, str(tmp_path / "checkpoint"))
        assert last == k
    assert state(applier.table(last)) == STATE
    applier(spark.createDataFrame(LOG[3:], cdc.CHANGES), last)  # delivered again
    assert state(applier.table(last)) == STATE


def test_backpressure(spark):
    log = spark.createDataFrame(LOG, cdc.CHANGES)
    assert cdc.limited(log, 1, "drop").count() == 5
    assert cdc.limited(log, 1, "block").count() == cdc.limited(log, 0, "drop").count() == cdc.limited(log, 1, "merge").count() == 7


def test_lsn():
    assert cdc.parse_lsn("A/B") == (10 << 32) + 11 and cdc.format_lsn((10 << 32) + 11) == "A/B" and cdc.parse_lsn("") == 0
    for bad in ("x", "1", "1/", "/1", "123456789/0", "G/1"):
        with pytest.raises(ValueError):
            cdc.parse_lsn(bad)


def test_checkpoint_never_goes_back(spark, tmp_path):
    c = cdc.Checkpoint(spark, str(tmp_path / "c"))
    assert c.load("s") is None and c.start("s", "0/7") == "0/7" and c.start("s") == "0/0"
    c.save("s", "0/A")
    c.save("s", "0/A")
    c.save("s", "1/0")
    c.save("other", "0/1")
    with pytest.raises(ValueError):
        c.save("s", "0/FF")
    assert c.load("s") == "1/0" and c.start("s", "0/7") == "1/0"


def test_retry_rules():
    class WithState(Exception):
        sqlstate = "42P01"

    assert supervisor.classify(ConnectionResetError("connection reset")) == "transient"
    assert supervisor.classify(WithState("nope")) == "fatal"
    assert supervisor.classify(Exception('replication slot "x" does not exist')) == "slot_missing"
    assert not supervisor.should_retry(Exception('publication "x" does not exist')) and supervisor.should_retry(Exception('publication "x" does not exist'), reconcile=True)
    assert [supervisor.retry_delay(k, jitter=lambda: 0.0) for k in (0, 1, 2, 10)] == [1, 2, 4, 30]
    assert supervisor.retry_delay(0, jitter=lambda: 1.0) == 1.5


def test_supervisor_retries_then_gives_up():
    seen, calls = [], []

    class Query:
        def awaitTermination(self):
            calls.append(1)
            if len(calls) < 3:
                raise TimeoutError("timed out")

    supervisor.Supervisor(Query, sleep=seen.append).run()
    assert len(calls) == 3 and len(seen) == 2

    def fatal():
        raise supervisor.FatalError("no")

    with pytest.raises(supervisor.FatalError):
        supervisor.Supervisor(fatal, sleep=seen.append).run()


def test_snapshot_then_stream(spark, tmp_path):
    base = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "id int, a string, b int")
    log = spark.createDataFrame(LOG, cdc.CHANGES)
    with snapshot.exported(spark, str(tmp_path), {"t": base}, "0/1") as made:
        again, tables = snapshot.load(spark, str(tmp_path), made.name)
        assert again == made
        assert state(cdc.final_state(snapshot.after(log, made), "id", {"a": "string", "b": "int"}, tables["t"])) == STATE
    assert not (tmp_path / made.name).exists()
    with pytest.raises(ValueError):
        snapshot.load(spark, str(tmp_path), "x'; drop")


def test_publications(spark):
    have = spark.createDataFrame([("p", "public.a")], "publication string, table_name string")
    want = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c"), ("bad name", "d")], "publication string, table_name string")
    actions = publication.reconcile(have, want)
    assert {r["publication"]: r["result"] for r in publication.outcome(actions).collect()} == {"p": "reconciled", "q": "created"}
    assert publication.ensured(have, want).count() == 3
    assert [r[0] for r in publication.listed(publication.ensured(have, want), "p").collect()] == ["public.a", "public.b"]


def test_provider(spark, sf_dir):
    p = Provider(spark, {"nation": spark.read.parquet(f"{sf_dir}/nation.parquet")}, {"nation": ["n_nationkey"]})
    assert list(p.query_json("SELECT n_nationkey, NULL AS x FROM nation WHERE n_nationkey = 1")) == ['{"n_nationkey":1,"x":null}']
    assert p.primary_keys("nation") == ["n_nationkey"] and p.primary_keys("none") == []
    assert {c[0]: c[1] for c in p.probe()}["key:nation"] == "ok"


def test_rolling_metrics_ignore_old_events(spark):
    from tideline.plans import routing

    rows = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ '2024-01-01 00:00:00', true, 100L, 'a'), (TIMESTAMP_NTZ '2024-01-01 00:09:00', true, 300L, 'a'), (TIMESTAMP_NTZ '2024-01-01 00:09:30', false, 500L, 'b') t(ts, cache_hit, response_us, strategy)")
    got = routing.rolling_metrics(rows, F.lit("2024-01-01 00:10:00").cast("timestamp_ntz")).first()
    assert (got["n"], got["mean_us"], got["recent_hit_rate"]) == (2, 400.0, 0.0)


def test_change_log_holds_every_order(spark, tmp_path):
    """Keys past 10,000, past what a phase of 100,000 positions holds, and past 32 bits of log position."""
    from tideline.plans import intelligence_queries as Q

    keys = [1, 2, 3, 5, 7, 35, 9_999, 10_000, 10_005, 10_010, 10_011, 1_000_005, 1_000_020, 2_000_021, 3_000_035, 70_000_000_021, 70_000_000_035, 70_000_000_041]
    for most in (1_000_000, 10_000_000, 1 << 40):
        some, folder = [k for k in keys if k < most], f"{tmp_path}/{most}"
        spark.createDataFrame([(k, "O", k + 0.25) for k in some], "o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
        want = {k: ("N" if k % 35 == 0 else "U" if k % 3 == 0 else "O", None if k % 5 == 0 else k + 0.25) for k in some if k % 7 or k % 35 == 0}
        for query in (Q.cdc_apply_final_state, Q.cdc_stream_final_state):
            assert {r["id"]: (r["status"], r["price"]) for r in query(spark, folder).collect()} == want
        batches = Q.cdc_tx_batches(spark, folder).collect()
        assert sum(r["changes"] for r in batches) == sum(1 + sum(k % n == 0 for n in (3, 5, 7, 35)) for k in some)
        assert len(batches) == len({(k // 10, 0) for k in some} | {(k // 10, n) for k in some for n in (3, 5, 7, 35) if k % n == 0})
        assert sum(r["changes"] for r in Q.cdc_backpressure_drop(spark, folder).collect()) == sum(min(2, r["changes"]) for r in batches)
