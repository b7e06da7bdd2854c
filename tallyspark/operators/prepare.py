"""Canonical matching columns for bank and ledger rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import values
from tallyspark.options import PURCHASE, SALES


def direction(credit: Column, debit: Column) -> Column:
    return F.when(credit > 0, SALES).when(debit > 0, PURCHASE)


def moved_amount(credit: Column, debit: Column) -> Column:
    return F.when(credit > 0, credit).when(debit > 0, debit)


def bank_keys(bank: DataFrame) -> DataFrame:
    """(statement_id, bank_idx, day, cents, direction, narration) of every bank row."""
    dated = bank.withColumn("iso", values.iso_date(F.col("transaction_date")))
    return dated.select(
        "statement_id", "bank_idx",
        values.day_number(F.col("iso")).alias("day"),
        values.cents(moved_amount(F.col("credit"), F.col("debit"))).alias("cents"),
        direction(F.col("credit"), F.col("debit")).alias("direction"),
        "narration",
    )


def with_anchor(ledger: DataFrame) -> DataFrame:
    """Ledger rows with the date and amount they are matched on.

    Each of the two falls back to the invoice's own value on its own. A blank ledger date is a
    given value, so it blocks the fallback.
    """
    anchored = ledger.withColumns({
        "anchor_date": values.iso_date(F.coalesce("ledger_date", "invoice_date")),
        "anchor_amount": F.coalesce("ledger_amount", "invoice_amount"),
    })
    return anchored.withColumns({
        "day": values.day_number(F.col("anchor_date")),
        "cents": values.cents(F.col("anchor_amount")),
        "has_anchor": F.col("anchor_date").isNotNull() & F.col("anchor_amount").isNotNull(),
    })


def ledger_keys(anchored: DataFrame) -> DataFrame:
    """Match keys of the ledger rows that have both an anchor date and an anchor amount."""
    return anchored.filter("has_anchor").select(
        "statement_id", "led_idx", "day", "cents", F.col("transaction_type").alias("direction"))
