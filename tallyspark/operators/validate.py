"""Row checks of ledger and chart rows, and whether a statement can be reconciled at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import is_blank, trimmed
from tallyspark.functions.values import iso_date
from tallyspark.options import PURCHASE, SALES, THREE_WAY

# ---- fixed values -----------------------------------------------------------
WRONG_TYPE = 'Transaction Type must be "Sales Receipt" or "Purchase Payment"'
WRONG_INVOICE_DATE, WRONG_INVOICE_AMOUNT = "Invoice Date is not a valid date", "Invoice Amount must be a non-negative number"
WRONG_LEDGER_DATE, WRONG_LEDGER_AMOUNT = "Ledger Date must be a valid date", "Ledger Amount must be a positive number"
NO_CODE, NO_NAME, NO_TYPE = "Account Code is required", "Account Name is required", "Account Type is required"
# -----------------------------------------------------------------------------


def _listed(rows: DataFrame, idx: str, problems: list) -> DataFrame:
    listed = F.array(*[F.when(bad, F.struct(F.lit(i).alias("ord"), F.lit(message).alias("error")))
                       for i, (bad, message) in enumerate(problems)])
    return rows.select("statement_id", idx, F.inline(F.array_compact(listed)))


def ledger_errors(ledger: DataFrame) -> DataFrame:
    """(statement_id, led_idx, ord, error); a blank field is never an error by itself."""
    def bad_date(name: str):
        return ~is_blank(F.col(name)) & iso_date(F.col(name)).isNull()

    invoiced, paid = F.col("invoice_amount"), F.col("ledger_amount")
    return _listed(ledger, "led_idx", [
        (~F.coalesce(F.col("transaction_type").isin(SALES, PURCHASE), F.lit(False)),
         WRONG_TYPE),
        (bad_date("invoice_date"), WRONG_INVOICE_DATE),
        (F.isnan(invoiced) | (invoiced < 0), WRONG_INVOICE_AMOUNT),
        (bad_date("ledger_date"), WRONG_LEDGER_DATE),
        (F.isnan(paid) | (paid <= 0), WRONG_LEDGER_AMOUNT)])


def coa_errors(coa: DataFrame) -> DataFrame:
    def missing(name: str):
        return F.coalesce(trimmed(F.col(name)), F.lit("")) == ""

    return _listed(coa, "coa_idx", [
        (missing("account_code"), NO_CODE), (missing("account_name"), NO_NAME),
        (missing("account_type"), NO_TYPE)])


def run_gate(bank: DataFrame, ledger: DataFrame, coa: DataFrame, mode: str) -> DataFrame:
    """Per statement with any data: which preconditions hold and whether matching may run."""
    def flag(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("statement_id").agg(F.lit(True).alias(name))

    parts = [flag(bank, "has_bank"), flag(ledger, "has_ledger"), flag(ledger_errors(ledger), "ledger_bad"),
             flag(coa, "has_coa"), flag(coa_errors(coa), "coa_bad")]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, "statement_id", "full")

    def is_set(name: str):
        return F.coalesce(F.col(name), F.lit(False))

    coa_ready = is_set("has_coa") & ~is_set("coa_bad")
    can_run = is_set("has_bank") & is_set("has_ledger") & ~is_set("ledger_bad")
    if mode == THREE_WAY:
        can_run = can_run & coa_ready
    return joined.select("statement_id", is_set("has_bank").alias("has_bank"), is_set("has_ledger").alias("has_ledger"),
                         (~is_set("ledger_bad")).alias("ledger_clean"), coa_ready.alias("coa_ready"), can_run.alias("can_run"))
