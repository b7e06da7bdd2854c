from datetime import datetime

from tallyspark.operators import intake
from tallyspark.sources.keyed import KeyedTable
from tallyspark.streaming import intake as stream

REF = ("connection_id string, ord bigint, message_id string, part_index bigint, filename string, mime_type string, "
       "size_bytes bigint, is_inline boolean, outcome string")
DOC = "doc_id bigint, source_connector_id string, source_ref string, status string"


def ref(ord_, message, outcome=intake.OK, filename="a.pdf", size=50_000):
    return ("c", ord_, message, 0, filename, "application/pdf", size, False, outcome)


BATCHES = [[ref(1, "m1"), ref(2, "m2", intake.PIPELINE_FAILED), ref(3, "m1"), ref(4, "known")],
           [ref(5, "m1"), ref(6, "m2"), ref(7, "old-failure")],
           [ref(8, "m2"), ref(9, "m3", filename="x.exe"), ref(10, "m4", size=10)]]
ACTIONS = {1: intake.CREATE, 2: intake.CREATE, 3: intake.DUPLICATE, 4: intake.DUPLICATE,
           5: intake.DUPLICATE, 6: intake.RETRY, 7: intake.RETRY,
           8: intake.DUPLICATE, 9: intake.UNSUPPORTED, 10: intake.INLINE}


def recorded(spark):
    others = [(100 + i, "c", f"other{i}:0:a.pdf", "VALID") for i in range(200)]
    return spark.createDataFrame([(1, "c", "known:0:a.pdf", "VALID"), (2, "c", "old-failure:0:a.pdf", "FAILED"), (3, "c", None, "VALID"), *others], DOC)


def test_state_carries_over_batches(spark, tmp_path):
    """New, repeated, failed-then-retried and skipped attachments over three files."""
    source = str(tmp_path / "refs")
    known = stream.known_documents(spark, str(tmp_path / "known"), 16)
    for rows in BATCHES:
        spark.createDataFrame(rows, REF).coalesce(1).write.mode("append").parquet(source)
        refs = spark.readStream.schema(REF).parquet(source)
        stream.start(refs, recorded(spark), str(tmp_path / "log"), str(tmp_path / "checkpoint"), known).awaitTermination()
    assert {r.ord: r.action for r in stream.item_log(spark, str(tmp_path / "log")).collect()} == ACTIONS
    states = {r.source_ref: (r.doc_id, r.status) for r in known.read().collect()}
    assert states["m1:0:a.pdf"] == states["m2:0:a.pdf"] == (None, "COMPLETED") and states["old-failure:0:a.pdf"] == (2, "COMPLETED")
    assert len(states) == 204


def test_a_batch_touches_only_its_buckets_and_may_run_again(spark, tmp_path):
    known, log = stream.known_documents(spark, str(tmp_path / "known"), 64), str(tmp_path / "log")
    known.change(0, recorded(spark).filter("source_ref is not null"))
    manifests = []
    for number, rows in enumerate(BATCHES):
        batch = spark.createDataFrame(rows, REF)
        stream.settle(batch, number, known, log)
        once = (known.manifest(number + 1), sorted(known.read(number + 1).collect()), sorted(stream.item_log(spark, log).collect()))
        stream.settle(batch, number, known, log)
        assert once == (known.manifest(number + 1), sorted(known.read(number + 1).collect()), sorted(stream.item_log(spark, log).collect()))
        manifests.append(once[0])
    first = known.manifest(0)
    assert {b for b, v in manifests[0].items() if v != 0} == known.touched(recorded(spark).limit(0).selectExpr("source_connector_id", "source_ref").union(
        spark.createDataFrame([("c", "m1:0:a.pdf"), ("c", "m2:0:a.pdf")], "source_connector_id string, source_ref string")))
    assert sum(v == 0 for v in manifests[2].values()) >= len(first) - 4


def test_states_follow_a_log_over_batches(spark, tmp_path):
    schema = "document_id bigint, step string, status string, created_at timestamp, id bigint"
    rows = [(i % 30, f"s{i % 4}", "OK", datetime(2024, 1, 1 + (i * 7) % 28), i) for i in range(300)]
    source, states = str(tmp_path / "log"), None
    for k in range(3):
        spark.createDataFrame(rows[k * 100:k * 100 + 100] + [(None, "x", "y", None, 5)], schema).coalesce(1).write.mode("append").parquet(source)
        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        states = states or stream.state_table(log, str(tmp_path / "states"), 8)
        stream.track(log, states, str(tmp_path / "checkpoint")).awaitTermination()
    best = {d: max((r for r in rows if r[0] == d), key=lambda r: (r[3], r[4])) for d in range(30)}
    got = {r.document_id: (r.step, r.id) for r in states.read().collect()}
    assert got == {d: (r[1], r[4]) for d, r in best.items()} and states.versions() == [1, 2, 3]
    before, files = sorted(states.read().collect()), states.manifest(3)
    stream.save_states(spark.createDataFrame([best[3]], schema), 3, states)
    assert sorted(states.read().collect()) == before and sum(states.manifest(4)[b] != v for b, v in files.items()) == 1


def test_a_keyed_table_replaces_removes_and_forgets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k bigint, v string", ("k",), 8)
    assert table.versions() == [] and table.read().count() == 0
    table.change(1, spark.createDataFrame([(i, "a") for i in range(40)], "k bigint, v string"))
    table.change(2, spark.createDataFrame([(1, "b"), (50, "b")], "k bigint, v string"), removed=spark.createDataFrame([(2,), (99,)], "k bigint"))
    want = {i: "a" for i in range(40) if i != 2} | {1: "b", 50: "b"}
    assert {r.k: r.v for r in table.read().collect()} == want
    assert {r.k: r.v for r in table.read(1).collect()} == {i: "a" for i in range(40)}  # a reader of version 1 still has it
    data = tmp_path / "t" / "data" / "v=9"  # a change that stopped before its manifest
    spark.createDataFrame([(1, "lost", 0)], "k bigint, v string, _bucket int").write.partitionBy("_bucket").parquet(str(data))
    assert {r.k: r.v for r in table.read().collect()} == want
    table.change(3, spark.createDataFrame([], "k bigint, v string"))
    assert table.manifest(3) == table.manifest(2)
    table.vacuum(1)
    assert table.versions() == [3] and {r.k: r.v for r in table.read().collect()} == want
    table.change(4, spark.createDataFrame([], "k bigint, v string"), removed=spark.range(60).withColumnRenamed("id", "k"))
    assert table.read().count() == 0
