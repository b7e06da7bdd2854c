"""Attachment intake and status tracking as streams, with state in keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.operators import intake
from tallyspark.sources.keyed import KeyedTable

ITEMS = "connection_id string, ord bigint, message_id string, source_ref string, action string, existing_id bigint, outcome string, failed boolean"
DOCUMENTS = "source_connector_id string, source_ref string, doc_id bigint, status string"
STATES = "document_id {id}, step string, status string, created_at {created}, id {row}"


def item_log(spark: SparkSession, path: str) -> DataFrame:
    """All items the stream has settled so far, one folder per batch."""
    return spark.read.schema(f"{ITEMS}, batch bigint").parquet(path)


def known_documents(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """The documents on record, by the attachment they came from."""
    return KeyedTable(spark, path, DOCUMENTS, ("source_connector_id", "source_ref"), buckets)


def _made(items: DataFrame) -> DataFrame:
    """What a batch leaves of each attachment it worked on: the document's status after the last item."""
    left = F.col("action").isin(intake.CREATE, intake.RETRY) & ~((F.col("action") == intake.CREATE) & (F.col("outcome") == intake.DOWNLOAD_FAILED))
    last = F.max(F.struct("ord", "existing_id", F.when(F.col("failed"), "FAILED").otherwise("COMPLETED").alias("status"))).alias("last")
    return (items.filter(left).groupBy(F.col("connection_id").alias("source_connector_id"), "source_ref").agg(last)
            .select("source_connector_id", "source_ref", F.col("last.existing_id").alias("doc_id"), "last.status"))


def settle(batch: DataFrame, batch_id: int, known: KeyedTable, log_path: str) -> None:
    """Settle one batch of refs: write its items, then what they make of the documents.

    Of the documents on record only the buckets of the batch's attachments are read and written. Version 0 of the table is
    what was on record at the start and version n + 1 follows batch n, so a batch that is run again finds the same state,
    overwrites its own folder of the log and its own version, and leaves the same result.
    """
    spark = batch.sparkSession
    keys = batch.select(F.col("connection_id").alias("source_connector_id"),
                        intake.source_ref(F.col("message_id"), F.col("part_index"), F.col("filename")).alias("source_ref"))
    before = max(v for v in known.versions() if v <= batch_id)
    planned = intake.plan(batch, known.read(before, known.touched(keys)))
    columns = [field.split()[0] for field in ITEMS.split(", ")]
    folder = f"{log_path}/batch={batch_id}"
    planned.select(*columns).write.mode("overwrite").parquet(folder)
    known.change(batch_id + 1, _made(spark.read.schema(ITEMS).parquet(folder)))


def start(refs: DataFrame, documents: DataFrame, log_path: str, checkpoint: str, known: KeyedTable) -> StreamingQuery:
    """Settle streamed attachment refs batch by batch. ``documents``, on record before the first batch, are loaded once."""
    if not known.versions():
        known.change(0, documents.filter("source_ref is not null and source_connector_id is not null"))
    return (refs.writeStream.foreachBatch(lambda batch, batch_id: settle(batch, batch_id, known, log_path))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_state(log: DataFrame) -> DataFrame:
    """Newest step of every document."""
    row = F.struct("step", "status", "created_at", "id")
    return (log.groupBy("document_id").agg(F.max_by(row, F.struct("created_at", "id")).alias("r"))
            .select("document_id", "r.*"))


def state_table(log: DataFrame, path: str, buckets: int = 64) -> KeyedTable:
    """Where ``track`` keeps the newest step of every document of a status log."""
    kinds = {c: log.schema[c].dataType.simpleString() for c in ("document_id", "created_at", "id")}
    schema = STATES.format(id=kinds["document_id"], created=kinds["created_at"], row=kinds["id"])
    return KeyedTable(log.sparkSession, path, schema, ("document_id",), buckets)


def save_states(batch: DataFrame, batch_id: int, states: KeyedTable) -> None:
    """Bring the documents a batch speaks of up to date; all others keep their files. Run again, it changes nothing."""
    newest = current_state(batch.filter("document_id is not null"))
    states.change(batch_id + 1, newest, merge=lambda old, new: current_state(old.unionByName(new)))


def track(log: DataFrame, states: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Follow a streamed status log."""
    return (log.writeStream.foreachBatch(lambda batch, batch_id: save_states(batch, batch_id, states))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
