"""Upkeep of stored tables by key."""

from pyspark.sql import functions as F

from tallyspark.operators import store
from tallyspark.sources.keyed import KeyedTable


def kept(spark, path, rows, schema, *keys):
    table = KeyedTable(spark, str(path), schema, keys, 32)
    table.change(1, spark.createDataFrame(rows, schema))
    return table


def moved(table, before, after):
    old, new = table.manifest(before), table.manifest(after)
    return {b for b in old.keys() | new.keys() if old.get(b) != new.get(b)}


def test_submitting_touches_only_the_buckets_of_reviewed_documents(spark, tmp_path):
    finals = kept(spark, tmp_path / "f", [(i, f"old{i}", "{}", "VALID", "{}", "2024-01-01") for i in range(100)],
                  "doc_id bigint, invoice string, confidence string, validation_status string, metadata string, submitted_at string", "doc_id")
    corrections = spark.createDataFrame([(3, "new", "2024-02-02"), (3, "older", "2024-02-01"), (200, "first", "2024-02-01")],
                                        "doc_id bigint, corrected_invoice string, submitted_at string")
    extractions = spark.createDataFrame([(3, 1, "2024", '{"metadata":{"pages":2}}', "{}")], "doc_id bigint, id bigint, created_at string, invoice_json string, confidence_json string")
    validations = spark.createDataFrame([(3, 1, "2024", "INVALID")], "doc_id bigint, id bigint, created_at string, status string")
    store.submit(finals, 2, corrections, extractions, validations)
    got = {r.doc_id: r for r in finals.read().collect()}
    assert len(got) == 101 and (got[3].invoice, got[3].validation_status, got[3].metadata) == ("new", "INVALID", '{"pages":2}')
    assert got[200].validation_status == "PENDING" and got[4].invoice == "old4"
    assert moved(finals, 1, 2) == finals.touched(corrections)
    store.submit(finals, 2, corrections, extractions, validations)  # the same review handed in again
    assert {r.doc_id: r for r in finals.read().collect()} == got


def test_upkeep_of_stored_tables(spark, tmp_path):
    documents = kept(spark, tmp_path / "d", [(i, "CONNECTOR" if i % 2 else None, "ROUTING" if i in (5, 6) else "VALID") for i in range(60)],
                     "doc_id bigint, source string, status string", "doc_id")
    store.reap_documents(documents, 2)
    assert {r.doc_id for r in documents.read().collect() if r.status == "FAILED"} == {5} and documents.read().count() == 60
    assert len(moved(documents, 1, 2)) == 1
    runs = kept(spark, tmp_path / "r", [(f"r{i}", "RUNNING" if i == 7 else "COMPLETED", None, None) for i in range(60)],
                "run_id string, status string, error_message string, finished_at string", "run_id")
    store.reap_runs(runs, 2, F.lit("now"))
    assert [(r.status, r.error_message, r.finished_at) for r in runs.read().filter("run_id = 'r7'").collect()] == [("FAILED", store.INTERRUPTED, "now")]
    assert len(moved(runs, 1, 2)) == 1 and runs.read().filter("status = 'FAILED'").count() == 1
    pending = kept(spark, tmp_path / "p", [(i, "PENDING" if i < 3 else "CONNECTED", None if i == 1 else f"2024-01-01 00:0{i}:00") for i in range(9)],
                   "connection_id bigint, status string, oauth_state_created_at string", "connection_id")
    rows = pending.read()
    assert rows.count() == 9
    store.purge_stale_pending(pending, 2, F.lit("2024-01-01 00:12:00").cast("timestamp"))
    assert {r.connection_id for r in pending.read().collect()} == set(range(2, 9))
    assert rows.count() == 9  # a reader of the version before is not disturbed


def test_changed_keys_are_not_gathered_in_the_driver(spark, tmp_path, monkeypatch):
    """Written keys are a small part of their rows in memory: a change shuffles them, however few bytes they have."""
    from pyspark.sql.classic.dataframe import DataFrame

    from tallyspark.sources.keyed import KeyedTable

    table, plans, join = KeyedTable(spark, str(tmp_path / "kept"), "id bigint, x bigint", ("id",), 2), [], DataFrame.join
    table.change(1, spark.range(10).selectExpr("id", "id as x"))
    monkeypatch.setattr(DataFrame, "join", lambda self, *more: plans.append(join(self, *more)) or plans[-1])
    table.change(2, spark.range(5).selectExpr("id", "7L as x"), removed=spark.range(9, 10))
    assert len(plans) == 2 and not any("BroadcastHashJoin" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
    monkeypatch.undo()
    assert sorted(map(tuple, table.read().collect())) == [(i, 7 if i < 5 else i) for i in range(9)]
