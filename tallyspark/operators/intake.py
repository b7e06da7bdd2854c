"""Attachment intake: what to skip, what is new, what to retry, and what a sync run amounted to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.values import half_up
from tallyspark.operators.ranking import ranked
from tallyspark.operators.store import top_per_key
from tallyspark.sources.tabular import UPLOAD_SUFFIXES, suffix

# ---- fixed values -----------------------------------------------------------
UNSUPPORTED, INLINE, DUPLICATE = "SKIPPED_UNSUPPORTED", "SKIPPED_INLINE", "SKIPPED_DUPLICATE"
CREATE, RETRY = "CREATE", "RETRY"
OK, DOWNLOAD_FAILED, PIPELINE_FAILED = "ok", "download_failed", "pipeline_failed"
MAX_BYTES, MIN_BYTES = 15 * 1024 * 1024, 20 * 1024
COUNTERS = [
    "messages_scanned", "messages_with_attachments", "attachments_found", "documents_created",
    "documents_processed", "documents_failed", "skipped_duplicates", "skipped_unsupported", "skipped_inline",
]
# -----------------------------------------------------------------------------


def source_ref(message_id: Column, part_index: Column, filename: Column) -> Column:
    return F.concat_ws(":", message_id, part_index.cast("string"), filename)


def skip_reason(max_bytes: int = MAX_BYTES, min_bytes: int = MIN_BYTES) -> Column:
    """Why an attachment is passed over, in this order; an unknown size passes the size rules."""
    size = F.col("size_bytes")
    image = F.lower("mime_type").startswith("image/")
    return (F.when(~suffix(F.col("filename")).isin(UPLOAD_SUFFIXES), UNSUPPORTED)
            .when(size > max_bytes, UNSUPPORTED)
            .when((size != 0) & (size < min_bytes), INLINE)
            .when(F.col("is_inline") & image, INLINE))


def is_inline(headers: Column) -> Column:
    """Content-Disposition decides; a Content-ID counts only where it is silent. The last header
    of a name wins."""
    def values_of(name: str) -> Column:
        return F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name),
                           lambda h: F.lower(F.coalesce(h["value"], F.lit(""))))

    disposition = F.coalesce(F.try_element_at(values_of("content-disposition"), F.lit(-1)), F.lit(""))
    has_id = F.exists(values_of("content-id"), lambda v: v != "")
    return (F.when(disposition.startswith("attachment"), False).when(disposition.startswith("inline"), True)
            .otherwise(F.coalesce(has_id, F.lit(False))))


def plan(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """Each listed attachment with its action and whether it failed.

    ``refs``: connection_id, ord, message_id, part_index, filename, mime_type, size_bytes, is_inline, outcome (OK,
    DOWNLOAD_FAILED or PIPELINE_FAILED: what would come of working on it). ``documents``: source_connector_id, source_ref, doc_id,
    status. Every listing is decided by what those before it in ``ord`` left behind: nothing if the download failed, a
    FAILED document if the pipeline did (which is tried again, without a download), else a document that makes all later
    listings duplicates. Two minimums per attachment say this, so no attachment's listings are gathered.
    """
    keys = ["connection_id", "source_ref"]
    outcome = F.col("outcome")
    listed = refs.withColumns({
        "source_ref": source_ref(F.col("message_id"), F.col("part_index"), F.col("filename")), "skip": skip_reason()})
    known = documents.filter("source_ref is not null").select(
        F.col("source_connector_id").alias("connection_id"), "source_ref", F.col("doc_id").alias("existing_id"),
        F.col("status").alias("existing_status"))
    open_ = listed.filter("skip is null")
    broken = open_.groupBy(*keys).agg(F.min(F.when(outcome == PIPELINE_FAILED, F.col("ord"))).alias("broken_at"),
                                      F.min(F.when(outcome == OK, F.col("ord"))).alias("fine_at")).join(known, keys, "left")
    retried = F.coalesce(F.col("existing_status") == "FAILED", F.lit(False)) | F.coalesce(F.col("ord") > F.col("broken_at"), F.lit(False))
    repaired = open_.filter(outcome == DOWNLOAD_FAILED).join(broken, keys).filter(retried).groupBy(*keys).agg(F.min("ord").alias("repaired_at"))
    facts = broken.join(repaired, keys, "left").withColumn("done_at", F.least("fine_at", "repaired_at")).drop("fine_at", "repaired_at")
    duplicate = (F.coalesce(F.col("existing_status") != "FAILED", F.lit(False))
                 | F.coalesce(F.col("ord") > F.col("done_at"), F.lit(False)))
    action = F.when(F.col("skip").isNotNull(), F.col("skip")).when(duplicate, DUPLICATE).when(retried, RETRY).otherwise(CREATE)
    failed = F.col("action").isin(CREATE, RETRY) & (
        (outcome == PIPELINE_FAILED) | ((outcome == DOWNLOAD_FAILED) & (F.col("action") == CREATE)))
    return (listed.join(facts, keys, "left").withColumn("action", action).withColumn("failed", failed)
            .drop("skip", "broken_at", "done_at", "existing_status"))


def run_counters(items: DataFrame, scanned: DataFrame) -> DataFrame:
    """Counters and status of each run. ``items``: run_id, message_id, action, outcome, failed."""
    action = F.col("action")
    worked = action.isin(CREATE, RETRY)
    per_run = items.groupBy("run_id").agg(
        F.count_distinct("message_id").alias("messages_with_attachments"), F.count("*").alias("attachments_found"),
        F.count_if((action == CREATE) & (F.col("outcome") != DOWNLOAD_FAILED)).alias("documents_created"),
        F.count_if(worked & ~F.col("failed")).alias("documents_processed"),
        F.count_if(worked & F.col("failed")).alias("documents_failed"),
        F.count_if(action == DUPLICATE).alias("skipped_duplicates"),
        F.count_if(action == UNSUPPORTED).alias("skipped_unsupported"),
        F.count_if(action == INLINE).alias("skipped_inline"))
    joined = scanned.join(per_run, "run_id", "left").select(
        "run_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS])
    status = (F.when((F.col("documents_failed") > 0) & (F.col("documents_processed") == 0), "FAILED")
              .when(F.col("documents_failed") > 0, "PARTIAL").otherwise("COMPLETED"))
    return joined.withColumn("status", status)


def connection_totals(connections: DataFrame, runs: DataFrame) -> DataFrame:
    sums = runs.groupBy("connection_id").agg(F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in COUNTERS])
    return connections.select("connection_id").join(sums, "connection_id", "left").select(
        "connection_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("runs", *COUNTERS)])


def progress(runs: DataFrame) -> DataFrame:
    done = sum((F.col(c) for c in ("documents_failed", "skipped_duplicates", "skipped_unsupported", "skipped_inline")),
               F.col("documents_processed"))
    total = F.greatest(F.col("attachments_found"), done)
    return runs.select("run_id", done.alias("done"), total.alias("total"),
                       F.when(total > 0, half_up(done / total * 100)).otherwise(F.lit(0)).alias("pct"))


def run_history(runs: DataFrame, n: int = 20) -> DataFrame:
    return top_per_key(runs, "connection_id", [F.desc("started_at"), F.desc("run_id")], n)


def run_items(items: DataFrame) -> DataFrame:
    """Items of every run with their place in the order they were worked on; a run may be of any size."""
    return ranked(items, ["run_id"], "ord", "position")


def capped_messages(messages: DataFrame, caps: DataFrame) -> DataFrame:
    """The first messages of each listing up to the connection's cap: 25 unless set, within 1..100."""
    cap = F.when(F.coalesce("max_messages", F.lit(0)) == 0, 25).otherwise(
        F.greatest(F.lit(1), F.least(F.col("max_messages"), F.lit(100))))
    first = top_per_key(messages, "connection_id", [F.col("ord")], 100)
    return (first.join(caps.select("connection_id", cap.alias("cap")), "connection_id")
            .filter(F.col("position") <= F.col("cap")).drop("cap"))
