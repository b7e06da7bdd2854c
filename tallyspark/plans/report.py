"""Reconciliation results seen from the bank side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import values
from tallyspark.options import COMBINED, MATCHED, PARTIAL, THREE_WAY, UNMATCHED
from tallyspark.plans.reconcile import GAP_REASONS

NO_SETTLEMENT = "No settlement found for this bank transaction"


def bank_results(bank: DataFrame, vouchers: DataFrame) -> DataFrame:
    """Each bank row with its vouchers; ``n_vouchers`` of them, status of the first in order.

    A combined settlement puts at most three vouchers on one bank row, so the list is short.
    """
    order = F.coalesce(F.col("led_idx"), F.lit((1 << 63) - 1))
    per_bank = (vouchers
                .select("statement_id", F.explode("bank_rows").alias("bank_idx"),
                        F.struct(order.alias("order"), "invoice_no", "ledger_voucher", "status", "score",
                                 "accounts_ok", "reasons").alias("v"))
                .groupBy("statement_id", "bank_idx").agg(F.array_sort(F.collect_list("v")).alias("vs")))
    first = F.get("vs", F.lit(0))
    return (bank.join(per_bank, ["statement_id", "bank_idx"], "left")
            .withColumns({
                "status": F.coalesce(first["status"], F.lit(UNMATCHED)),
                "score": F.coalesce(first["score"], F.lit(0)),
                "n_vouchers": F.coalesce(F.size("vs"), F.lit(0)),
                "accounts_ok": first["accounts_ok"],
                "reasons": first["reasons"],
            })
            .withColumn("rank", F.when(F.col("status").isin(MATCHED, COMBINED), 0)
                        .when(F.col("status") == PARTIAL, 1).otherwise(2))
            .withColumn("has_gap", F.coalesce(F.arrays_overlap(
                "reasons", F.array(*[F.lit(r) for r in GAP_REASONS])), F.lit(False))))


def ordered(results: DataFrame) -> DataFrame:
    """Matched, then partial, then unmatched, statement by statement in bank order."""
    return results.orderBy("statement_id", "rank", "bank_idx")


def only(results: DataFrame, which: str) -> DataFrame:
    ranks = {"matched": 0, "partial": 1, "unmatched": 2}
    return results if which == "all" else results.filter(F.col("rank") == ranks[which])


def bank_stats(results: DataFrame) -> DataFrame:
    def ranked(rank: int):
        return F.count_if(F.col("rank") == rank)

    share = values.half_up(ranked(0) / F.count("*") * 1000) / 10
    return results.groupBy("statement_id").agg(
        F.count("*").alias("total"), ranked(0).alias("matched"), ranked(1).alias("partially_matched"),
        ranked(2).alias("unmatched"), share.alias("match_percent"))


def report(results: DataFrame, mode: str) -> DataFrame:
    """The ten columns of the reconciliation report, one row per bank row."""
    credit = F.coalesce(F.col("credit") > 0, F.lit(False))
    invoices = F.array_join(F.transform("vs", lambda v: F.concat(
        v.invoice_no, F.when(F.coalesce(v.ledger_voucher, F.lit("")) == "", "")
        .otherwise(F.concat(F.lit(" ("), v.ledger_voucher, F.lit(")"))))), " + ")
    checked = F.when(F.lit(mode == THREE_WAY) & F.col("accounts_ok").isNotNull(),
                     F.when(F.col("accounts_ok"), "Yes").otherwise("No")).otherwise("")
    return results.select(
        "statement_id", "bank_idx",
        F.coalesce("transaction_date", F.lit("")).alias("date"),
        F.coalesce("narration", F.lit("")).alias("narration"),
        F.coalesce("reference_number", F.lit("")).alias("reference"),
        F.when(credit, F.col("credit")).otherwise(F.col("debit")).alias("amount"),
        F.when(credit, "Credit").otherwise("Debit").alias("direction"),
        F.coalesce(invoices, F.lit("")).alias("matched_invoices"),
        "status", "score", checked.alias("coa_validated"),
        F.coalesce(F.array_join("reasons", " | "), F.lit(NO_SETTLEMENT)).alias("reasons"))
