"""Intake decided at once, in batches, and one listing after the other must agree."""

import random

import pytest

from tallyspark.operators import intake
from tallyspark.streaming import intake as stream

REFS = ("connection_id string, ord bigint, message_id string, part_index int, filename string, mime_type string, size_bytes bigint, "
        "is_inline boolean, outcome string, run_id string")
DOCS = "source_connector_id string, source_ref string, doc_id bigint, status string"
OUTCOMES = [intake.OK, intake.DOWNLOAD_FAILED, intake.PIPELINE_FAILED]


def cases(seed):
    rnd = random.Random(seed)
    refs, documents = [], []
    for c in range(60):
        for k in range(rnd.randint(1, 12)):
            refs.append((f"c{c}", k, f"m{rnd.randrange(3)}", 0, rnd.choice(["a.pdf", "a.pdf", "n.txt"]), "application/pdf", 50_000, False,
                         rnd.choice(OUTCOMES), "run"))
        for m in range(3):
            if rnd.random() < 0.4:
                documents.append((f"c{c}", f"m{m}:0:a.pdf", 100 * c + m, rnd.choice(["FAILED", "COMPLETED", "PENDING"])))
    return refs, documents


def one_by_one(refs, documents):
    status = {(d[0], d[1]): d[3] for d in documents}
    out = {}
    for r in sorted(refs, key=lambda r: (r[0], r[1])):
        key = r[0], f"{r[2]}:{r[3]}:{r[4]}"
        if r[4].endswith(".txt"):
            out[r[0], r[1]] = intake.UNSUPPORTED, False
            continue
        before = status.get(key)
        if before not in (None, "FAILED"):
            out[r[0], r[1]] = intake.DUPLICATE, False
            continue
        action = intake.RETRY if before else intake.CREATE
        failed = r[8] == intake.PIPELINE_FAILED or (r[8] == intake.DOWNLOAD_FAILED and action == intake.CREATE)
        if not (action == intake.CREATE and r[8] == intake.DOWNLOAD_FAILED):
            status[key] = "FAILED" if failed else "COMPLETED"
        out[r[0], r[1]] = action, failed
    return out


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_batches_agree_with_one_listing_at_a_time(spark, tmp_path, parts):
    refs, documents = cases(parts)
    known, log = stream.known_documents(spark, str(tmp_path / "known"), 8), str(tmp_path / "log")
    known.change(0, spark.createDataFrame(documents, DOCS))
    for k in range(parts):
        stream.settle(spark.createDataFrame([r for r in refs if r[1] * parts // 12 == k], REFS), k, known, log)
    assert {(r.connection_id, r.ord): (r.action, r.failed) for r in stream.item_log(spark, log).collect()} == one_by_one(refs, documents)


def test_failed_downloads_create_nothing(spark):
    refs = [("c", k, f"m{k}", 0, "a.pdf", "application/pdf", 50_000, False, o, "run") for k, o in enumerate(OUTCOMES)]
    planned = intake.plan(spark.createDataFrame(refs, REFS), spark.createDataFrame([], DOCS))
    scanned = spark.createDataFrame([("run", 3)], "run_id string, messages_scanned bigint")
    row = intake.run_counters(planned, scanned).first()
    assert (row.documents_created, row.documents_processed, row.documents_failed, row.status) == (2, 1, 2, "PARTIAL")
