"""Bank reconciliation statement rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import shortest_float
from tallyspark.rules import TOLERANCE, check, close, emit, exact_sum, money, present

# ---- fixed values -----------------------------------------------------------
BANK_SIDE_TYPES = ["DEPOSIT_IN_TRANSIT", "OUTSTANDING_CHECK", "BANK_ERROR"]
BOOK_SIDE_TYPES = ["BANK_CHARGE", "BANK_INTEREST", "NSF_CHECK", "DIRECT_DEPOSIT", "BOOK_ERROR"]
REQUIRED = {
    "company_name": "Company Name", "account_number": "Account Number",
    "statement_period_start": "Statement Period Start", "statement_period_end": "Statement Period End",
}
# -----------------------------------------------------------------------------


def _math(section: int, side: str) -> Column:
    opening, adjusted = F.col(f"opening_balance_{side}"), F.col(f"adjusted_{side}_balance")
    computed = opening + F.col(f"{side}_effect")
    off = F.abs(computed - adjusted)
    return check(
        section, 0, f"{side}_balance_math", F.coalesce(off <= TOLERANCE, F.lit(True)),
        F.when(adjusted.isNull(), F.concat(F.lit(f"Computed adjusted {side} balance: "), money(computed),
                                           F.lit(" (not stated in document)")))
        .otherwise(F.format_string(f"opening_{side}(%s) ± items = %s, stated adjusted_{side} = %s, diff = %s",
                                   shortest_float(opening), money(computed), money(adjusted), close(off))),
        f"adjusted_{side}_balance", opening.isNotNull() & (F.col(f"n_{side}") > 0))


def run(headers: DataFrame, items: DataFrame) -> DataFrame:
    """``items``: doc_id, side ('bank' or 'book'), item_no from 0, item_type, amount, effect."""
    amount, effect = F.coalesce("amount", F.lit(0.0)), F.col("effect")

    def on(side: str, value: Column) -> Column:
        return F.when(F.col("side") == side, value)

    def signed(side: str) -> Column:
        name = side.upper()
        return on(side, F.when(effect == f"ADD_TO_{name}", amount).when(effect == f"DEDUCT_FROM_{name}", -amount).otherwise(0.0))

    sums = items.groupBy("doc_id").agg(
        *[F.count(on(s, F.lit(1))).alias(f"n_{s}") for s in ("bank", "book")],
        *[exact_sum(signed(s)).alias(f"{s}_effect") for s in ("bank", "book")])
    docs = headers.join(sums, "doc_id", "left")
    bank, book = F.col("adjusted_bank_balance"), F.col("adjusted_book_balance")
    off = F.abs(bank - book)
    stated = [
        check(1, i, f"{name}_present", present(F.col(name)),
              F.when(present(F.col(name)), f"{label} is present").otherwise(f"{label} is missing"), f"document_info.{name}")
        for i, (name, label) in enumerate(REQUIRED.items())]
    per_doc = emit(
        docs, *stated, _math(2, "bank"), _math(3, "book"),
        check(4, 0, "balances_reconcile", off <= TOLERANCE,
              F.format_string("adjusted_bank(%s) vs adjusted_book(%s), diff = %s", money(bank), money(book), close(off)),
              "adjusted_bank_balance", bank.isNotNull() & book.isNotNull()))
    side, kind, at = F.col("side"), F.col("item_type"), F.col("item_no")
    other = F.when(side == "bank", "book").otherwise("bank")
    list_name, other_name = F.concat(side, F.lit("_side_items")), F.concat(other, F.lit("_side_items"))
    misplaced = F.when(side == "bank", kind.isin(BOOK_SIDE_TYPES)).otherwise(kind.isin(BANK_SIDE_TYPES))
    order = F.when(side == "bank", at).otherwise(at + (1 << 40))
    per_item = emit(
        items,
        check(5, order, F.concat(side, F.lit("_items_side_check")), F.lit(False),
              F.format_string("Item type '%s' belongs in %s, not %s", kind, other_name, list_name), list_name, misplaced),
        check(6, order, "amounts_non_negative", F.lit(False),
              F.concat(list_name, F.format_string("[%d] has negative amount ", at), shortest_float(F.col("amount"))),
              list_name, F.col("amount") < 0))
    return per_doc.unionByName(per_item)
