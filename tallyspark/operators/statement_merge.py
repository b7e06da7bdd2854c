"""Merging the page batches of a bank statement into one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import values

# ---- fixed values -----------------------------------------------------------
INFO = ["bank_name", "period_start", "period_end"]
TOTALS = ["debit_total", "credit_total"]
# -----------------------------------------------------------------------------


def merged_headers(batches: DataFrame, info_columns: list[str] = INFO, total_columns: list[str] = TOTALS) -> DataFrame:
    """One row per statement from its batches.

    ``batches``: statement_id, batch, failed, the info and total columns (any number of each), opening, opening_conf, closing,
    closing_conf, overall_conf, txn_conf. The document info is the first batch's that has any; every total is the first known;
    a balance is the one read with most confidence, the later batch on ties.
    """
    ok = ~F.col("failed")
    batch = F.col("batch")
    has_info = ok & F.coalesce(*[F.col(c).cast("string") for c in info_columns]).isNotNull()

    def surest(value: str, conf: str):
        confidence = F.coalesce(conf, F.lit(0.0))
        rank = F.when(ok & F.col(value).isNotNull(), F.struct(confidence, batch))
        return F.max_by(value, rank).alias(value), F.coalesce(F.max_by(confidence, rank), F.lit(0.0)).alias(conf)

    def first_known(value: str):
        return F.min_by(value, F.when(ok & F.col(value).isNotNull(), batch)).alias(value)

    def mean(conf: str):
        known = F.when(ok, F.col(conf))
        total = F.sum(known.cast("decimal(38,6)")).cast("double")
        return F.when(F.count(known) > 0, total / F.count(known)).otherwise(0.0).alias(conf)

    info = F.min_by(F.struct(*info_columns), F.when(has_info, batch)).alias("info")
    return (batches.groupBy("statement_id")
            .agg(info, *surest("opening", "opening_conf"), *surest("closing", "closing_conf"),
                 *map(first_known, total_columns), mean("overall_conf"), mean("txn_conf"),
                 F.count_if("failed").alias("n_failed"), F.count("*").alias("n_batches"))
            .select("statement_id", "info.*", *[c for c in (
                "opening", "opening_conf", "closing", "closing_conf", *total_columns, "overall_conf",
                "txn_conf", "n_failed", "n_batches")]))


def failed_batches(batches: DataFrame) -> DataFrame:
    return batches.filter("failed").select("statement_id", "batch")


def merged_transactions(batches: DataFrame, transactions: DataFrame) -> DataFrame:
    """Transactions of the batches that were read, in batch order by (batch, ord), dates repaired.

    A date in one of the day-first layouts becomes ISO; one outside the statement period gets
    day and month swapped if only that brings it inside.
    """
    read = batches.filter(~F.col("failed")).select("statement_id", "batch")
    periods = merged_headers(batches).select("statement_id", "period_start", "period_end")
    date = values.swap_into_period(F.col("iso"), F.col("period_start"), F.col("period_end"))
    return (transactions.join(read, ["statement_id", "batch"], "left_semi")
            .withColumn("iso", values.statement_date(F.col("transaction_date")))
            .join(periods, "statement_id", "left").withColumn("transaction_date", date)
            .drop("iso", "period_start", "period_end"))
