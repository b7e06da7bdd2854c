"""Document store operators: newest versions, listings, review and submit assembly, upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import country_code, is_blank
from tallyspark.session import cut, shuffled
from tallyspark.sources.keyed import KeyedTable

# ---- fixed values -----------------------------------------------------------
TERMINAL = ["VALID", "INVALID", "NEEDS_REVIEW", "COMPLETED", "FAILED"]
IN_FLIGHT = [
    "UPLOADED", "SAVING", "SAVED", "CONVERTING", "PREPROCESSING", "PREPROCESSED", "ANALYZING_COMPLEXITY",
    "COMPLEXITY_ANALYZED", "ROUTING", "ROUTED", "OCR_RUNNING", "EXTRACTING", "EXTRACTED", "VALIDATING",
]
ABANDONED = [
    "SAVING", "CONVERTING", "PREPROCESSING", "ANALYZING_COMPLEXITY", "ROUTING", "ROUTED", "OCR_RUNNING",
    "EXTRACTING", "EXTRACTED", "VALIDATING",
]
SECRET_COLUMNS = ["access_token", "refresh_token", "oauth_state"]
HIDDEN_CONNECTIONS = ["DISCONNECTED", "PENDING"]
INTERRUPTED = "Interrupted by a server restart"
# -----------------------------------------------------------------------------


def latest(versions: DataFrame, keys: list[str], newest_by: list[str]) -> DataFrame:
    """The newest row per key. An aggregate, so most versions are dropped before the shuffle."""
    others = [c for c in versions.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*newest_by)).alias("_row")
    return versions.groupBy(*keys).agg(best).select(*keys, "_row.*")


def top_per_key(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """At most ``n`` rows per key; Spark limits each group before it is shuffled."""
    place = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(place)).filter(F.col("position") <= n)


def terminal_documents(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("status").isin(TERMINAL))


def newest_first(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.desc("created_at"), F.desc("doc_id"))


def in_list(documents: DataFrame, country: str, source: str | None = None) -> DataFrame:
    """Documents of a country's list, optionally of one source; a missing source is MANUAL."""
    shown = documents.filter(country_code(F.coalesce("country", F.lit("INDIA"))) == country)
    return shown if source is None else shown.filter(F.coalesce("source", F.lit("MANUAL")) == source)


def neighbours(listed: DataFrame) -> DataFrame:
    """Previous and next document in the newest-first list.

    The list is dealt to even ranges of its order, so a day that holds most documents is many tasks. Inside a range a window
    finds the neighbours; across ranges a window over one row per range does.
    """
    order = [F.desc("created_at"), F.desc("doc_id")]
    ranges = cut(listed.select("doc_id", "created_at").repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(*order)
    key = F.struct("created_at", "doc_id")
    ends = ranges.groupBy("_range").agg(F.max(key).alias("first"), F.min(key).alias("last"))
    along = Window.orderBy("_range")
    edges = ends.select("_range", F.lag("last.doc_id").over(along).alias("_before"),
                        F.lead("first.doc_id").over(along).alias("_after"))
    return (ranges.withColumns({"_prev": F.lag("doc_id").over(inside), "_next": F.lead("doc_id").over(inside)})
            .join(edges, "_range")
            .select("doc_id", F.coalesce("_prev", "_before").alias("prev_id"), F.coalesce("_next", "_after").alias("next_id")))


def source_counts(documents: DataFrame, country: str) -> DataFrame:
    """Chip counts of a country's list: one row per source, and ALL."""
    return (in_list(documents, country).groupBy(F.coalesce("source", F.lit("MANUAL")).alias("source"))
            .agg(F.count("*").alias("n")).rollup("source").agg(F.sum("n").alias("n"))
            .select(F.coalesce("source", F.lit("ALL")).alias("source"), F.coalesce("n", F.lit(0)).alias("n")))


def outcome_counts(documents: DataFrame) -> DataFrame:
    """Documents of each connection by where they stand."""
    status = F.col("status")
    return documents.filter("source_connector_id is not null").groupBy("source_connector_id").agg(
        F.count("*").alias("total"), F.count_if(status.isin(IN_FLIGHT)).alias("in_progress"),
        F.count_if(status.isin("VALID", "COMPLETED")).alias("ready"),
        F.count_if(status == "NEEDS_REVIEW").alias("needs_review"), F.count_if(status == "INVALID").alias("invalid"),
        F.count_if(status == "FAILED").alias("failed"))


def visible_connections(connections: DataFrame) -> DataFrame:
    return connections.filter(~F.col("status").isin(HIDDEN_CONNECTIONS)).drop(*SECRET_COLUMNS)


def without_stale_pending(connections: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    stamp = F.col("oauth_state_created_at")
    stale = (F.col("status") == "PENDING") & (
        stamp.isNull() | (stamp < now - F.make_dt_interval(mins=F.lit(minutes))))
    return connections.filter(~stale)


def reaped_runs(runs: DataFrame, now: Column) -> DataFrame:
    running = F.col("status") == "RUNNING"
    return runs.withColumns({
        "status": F.when(running, "FAILED").otherwise(F.col("status")),
        "error_message": F.when(running, INTERRUPTED).otherwise(F.col("error_message")),
        "finished_at": F.when(running, now).otherwise(F.col("finished_at"))})


def reaped_documents(documents: DataFrame) -> DataFrame:
    return documents.withColumn("status", F.when(_abandoned(), "FAILED").otherwise(F.col("status")))


def _abandoned() -> Column:
    return (F.coalesce("source", F.lit("")) == "CONNECTOR") & F.col("status").isin(ABANDONED)


def given(raw: Column, empty: str) -> Column:
    """JSON text, or the text of an empty container where there is none."""
    return F.when(is_blank(raw), empty).otherwise(raw)


def page_lists(pages: DataFrame) -> DataFrame:
    """Pages of each document in order; the preprocessed image where there is one."""
    path = F.when(~is_blank(F.col("preprocessed_path")), F.col("preprocessed_path")).otherwise(
        F.coalesce("original_path", F.lit("")))
    return pages.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page_number", path.alias("path")))).alias("_pages")
    ).select("doc_id", F.col("_pages.path").alias("page_paths"))


def review(documents: DataFrame, pages: DataFrame, extractions: DataFrame, validations: DataFrame,
           ocr: DataFrame) -> DataFrame:
    """One row per document with its pages and newest results, defaults where there are none."""
    ex = latest(extractions, ["doc_id"], ["created_at", "id"]).select("doc_id", "invoice_json", "confidence_json")
    va = latest(validations, ["doc_id"], ["created_at", "id"]).select(
        "doc_id", F.col("status").alias("validation_status"), "rule_checks_json", "warnings_json", "errors_json")
    oc = latest(ocr, ["doc_id"], ["created_at", "id"]).select("doc_id", F.col("engine").alias("_engine"))
    joined = documents
    for side in (page_lists(pages), ex, va, oc):
        joined = joined.join(side, "doc_id", "left")
    listed = F.coalesce(F.size("page_paths"), F.lit(0))
    return joined.select(
        "doc_id", "status", "filename", F.coalesce("country", F.lit("INDIA")).alias("country"),
        F.coalesce("ocr_engine", "_engine").alias("ocr_engine"),
        F.when(F.coalesce("page_count", F.lit(0)) != 0, F.col("page_count")).otherwise(listed).alias("page_count"),
        F.coalesce("page_paths", F.array().cast("array<string>")).alias("page_paths"),
        F.coalesce(F.get_json_object(given(F.col("invoice_json"), "{}"), "$.invoice"), F.lit("{}")).alias("invoice"),
        given(F.col("confidence_json"), "{}").alias("confidence"),
        F.coalesce("validation_status", F.lit("PENDING")).alias("validation_status"),
        given(F.col("rule_checks_json"), "[]").alias("rule_checks"), given(F.col("warnings_json"), "[]").alias("warnings"),
        given(F.col("errors_json"), "[]").alias("errors"))


def submissions(corrections: DataFrame, extractions: DataFrame, validations: DataFrame) -> DataFrame:
    """The final output of each reviewed document. ``corrections``: doc_id, corrected_invoice (JSON text), submitted_at."""
    ex = latest(extractions, ["doc_id"], ["created_at", "id"])
    va = latest(validations, ["doc_id"], ["created_at", "id"]).withColumnRenamed("status", "validation_status")
    built = (corrections.join(ex.select("doc_id", "invoice_json", "confidence_json"), "doc_id", "left")
             .join(va.select("doc_id", "validation_status"), "doc_id", "left")
             .select("doc_id", F.col("corrected_invoice").alias("invoice"),
                     given(F.col("confidence_json"), "{}").alias("confidence"),
                     F.coalesce("validation_status", F.lit("PENDING")).alias("validation_status"),
                     F.coalesce(F.get_json_object("invoice_json", "$.metadata"), F.lit("{}")).alias("metadata"),
                     "submitted_at"))
    return latest(built, ["doc_id"], ["submitted_at"])


def submitted(finals: DataFrame, corrections: DataFrame, extractions: DataFrame, validations: DataFrame) -> DataFrame:
    """Final outputs after a batch of reviews: one row per document, a new one replaces the old."""
    new = submissions(corrections, extractions, validations)
    return finals.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)


def submit(finals: KeyedTable, version: int, corrections: DataFrame, extractions: DataFrame, validations: DataFrame) -> None:
    """The same on a stored table: only the buckets of reviewed documents are read and written."""
    finals.change(version, submissions(corrections, extractions, validations))


def purge_stale_pending(connections: KeyedTable, version: int, now: Column, minutes: int = 10) -> None:
    """Remove stale pending connections from a stored table."""
    table = connections.read()
    kept = without_stale_pending(table, now, minutes)
    gone = table.select(*connections.keys).join(shuffled(kept.select(*connections.keys)), list(connections.keys), "left_anti")
    connections.change(version, table.limit(0), removed=gone)


def reap_runs(runs: KeyedTable, version: int, now: Column) -> None:
    """Close interrupted runs of a stored table; buckets without one keep their files."""
    runs.change(version, reaped_runs(runs.read().filter("status = 'RUNNING'"), now))


def reap_documents(documents: KeyedTable, version: int) -> None:
    """Fail abandoned documents of a stored table; buckets without one keep their files."""
    table = documents.read()
    failed = reaped_documents(table.filter(_abandoned()))
    documents.change(version, failed)


def export_json(documents: DataFrame, finals: DataFrame, extractions: DataFrame) -> DataFrame:
    """The corrected output of each document, else its newest extraction; documents with neither are left out."""
    ex = latest(extractions, ["doc_id"], ["created_at", "id"]).select("doc_id", given(F.col("invoice_json"), "{}").alias("_ex"))
    fin = finals.select("doc_id", F.col("invoice").alias("_final"))
    return (documents.select("doc_id").join(fin, "doc_id", "left").join(ex, "doc_id", "left")
            .select("doc_id", F.coalesce("_final", "_ex").alias("output"),
                    F.when(F.col("_final").isNotNull(), "final").otherwise("extraction").alias("origin"))
            .filter("output is not null"))


def patched(extractions: DataFrame, patches: DataFrame) -> DataFrame:
    """Newest extraction per document with its coa and ledger parts replaced where a patch gives them.

    Documents without an extraction get one made of the patch alone.
    """
    base = latest(extractions, ["doc_id"], ["created_at", "id"]).select("doc_id", "bank_statement", "coa", "ledger")
    new = patches.select("doc_id", F.col("coa").alias("_coa"), F.col("ledger").alias("_ledger"))
    return base.join(new, "doc_id", "full").select(
        "doc_id", "bank_statement", F.coalesce("_coa", "coa").alias("coa"), F.coalesce("_ledger", "ledger").alias("ledger"))


def migrated(table: DataFrame, additions: dict[str, tuple[str, object]]) -> DataFrame:
    """Add missing columns and fill unset ones with their default; running it twice changes nothing."""
    out = table
    for name, (kind, default) in additions.items():
        value = F.lit(default).cast(kind)
        out = out.withColumn(name, value if name not in table.columns else F.coalesce(F.col(name), value))
    return out


def repeated_source_refs(documents: DataFrame) -> DataFrame:
    return (documents.filter("source_ref is not null").groupBy("source_connector_id", "source_ref")
            .agg(F.count("*").alias("n")).filter("n > 1"))
