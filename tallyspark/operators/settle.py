"""Settlement rollup of vouchers to invoices, and counts over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import values
from tallyspark.options import COMBINED, FULLY, MATCHED, NEEDS_REVIEW, NOT_SETTLED, OVERPAID, PARTLY


def invoice_rollup(vouchers: DataFrame) -> DataFrame:
    """One row per (statement_id, invoice_no); blank numbers form one group of their own.

    The date is the first one given and the amount the first one known, in ledger order. All
    aggregates combine on the map side, so one very large group is no burden. The vouchers of an
    invoice are listed by ``voucher_refs``, one per row.
    """
    given_date = F.when(F.col("invoice_date") != "", F.col("led_idx"))
    invoice_cents = values.cents(F.col("invoice_amount"))
    counted = F.col("status").isin(MATCHED, COMBINED)
    rolled = vouchers.groupBy("statement_id", "invoice_no").agg(
        F.min_by("invoice_date", given_date).alias("invoice_date"),
        F.min_by(invoice_cents, F.when(invoice_cents.isNotNull(), F.col("led_idx"))).alias("invoice_cents"),
        F.coalesce(F.sum(F.when(counted, values.cents(F.col("matched_amount")))), F.lit(0)).alias("settled_cents"),
        F.count("*").alias("n_vouchers"))
    owed, settled = F.col("invoice_cents"), F.col("settled_cents")
    over = settled > owed
    return rolled.select(
        "statement_id", "invoice_no", "invoice_date",
        values.amount(owed).alias("invoice_amount"),
        values.amount(settled).alias("total_settled"),
        values.amount(F.when(owed.isNotNull(), F.greatest(F.lit(0), owed - settled))).alias("outstanding"),
        values.amount(F.when(over, settled - owed).otherwise(F.lit(0))).alias("mismatch_amount"),
        F.when(owed.isNull(), NEEDS_REVIEW).when(over, OVERPAID)
        .when((owed == settled) & (settled > 0), FULLY).when(settled > 0, PARTLY)
        .otherwise(NOT_SETTLED).alias("status"),
        "n_vouchers")


def voucher_refs(vouchers: DataFrame) -> DataFrame:
    """The ledger rows behind each invoice, in ledger order by ``led_idx``."""
    return vouchers.filter("led_idx is not null").select("statement_id", "invoice_no", "led_idx", F.col("id").alias("voucher_ref"))


def matching_stats(invoices: DataFrame, bank: DataFrame, unmatched: DataFrame) -> DataFrame:
    """The eight counts of a reconciliation, per statement."""
    def having(status: str):
        return F.count_if(F.col("status") == status)

    by_invoice = invoices.groupBy("statement_id").agg(
        F.count("*").alias("total_invoices"), having(FULLY).alias("fully_settled"),
        having(PARTLY).alias("partially_settled"), having(NOT_SETTLED).alias("not_settled"),
        having(OVERPAID).alias("mismatched"), having(NEEDS_REVIEW).alias("needs_review"))
    totals = bank.groupBy("statement_id").agg(F.count("*").alias("total_bank_txns"))
    left = unmatched.groupBy("statement_id").agg(F.count("*").alias("n_unmatched"))
    joined = by_invoice.join(totals, "statement_id", "full").join(left, "statement_id", "left")
    zero = F.lit(0)
    return joined.select(
        "statement_id",
        *[F.coalesce(c, zero).alias(c) for c in (
            "total_invoices", "fully_settled", "partially_settled", "not_settled", "mismatched", "needs_review",
            "total_bank_txns")],
        (F.coalesce("total_bank_txns", zero) - F.coalesce("n_unmatched", zero)).alias("matched_bank_txns"))
