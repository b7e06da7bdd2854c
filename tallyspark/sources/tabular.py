"""Uploaded sheets: header recognition, typed rows and rejected rows.

A sheet is an all-text DataFrame with a ``row_no`` column for the position of each row in the
file (the first data row is row 2); any other columns are matched to fields by their headers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import values
from tallyspark.functions.text import is_blank, trimmed
from tallyspark.options import PURCHASE, SALES

# ---- fixed values -----------------------------------------------------------
COA_FIELDS = {
    "account_code": ("Account Code", True), "account_name": ("Account Name", True),
    "account_type": ("Account Type", True), "parent_group": ("Parent Group", False),
}
LEDGER_FIELDS = {
    "transaction_type": ("Transaction Type", True), "invoice_no": ("Invoice No", True),
    "invoice_date": ("Invoice Date", False), "invoice_amount": ("Invoice Amount", False),
    "ledger_date": ("Ledger Date", False), "ledger_voucher": ("Ledger Voucher", False),
    "ledger_amount": ("Ledger Amount", False), "account_name": ("Account Name", False),
    "bank_cash_account": ("Bank/Cash Account", False),
}
TRANSACTION_TYPES = ["sales receipt", "purchase payment", "sales invoice", "purchase invoice", "journal entry"]
SALES_TYPES = ["sales receipt", "sales invoice"]
UPLOAD_MIME_TYPES = [
    "application/pdf", "image/jpeg", "image/jpg", "image/png", "image/webp", "image/tiff", "image/bmp",
    "image/heic", "image/heif", "image/heic-sequence", "image/heif-sequence",
]
MISSING_COLUMNS, REJECTED = "Missing required column(s): ", "Row %d: "
REQUIRED, UNPARSEABLE, NOT_NUMERIC = "%s is required", "%s is unparseable", "%s is not numeric"
WRONG_TYPE = 'Transaction Type must be "Sales Receipt" or "Purchase Payment"'
UNSUPPORTED_TYPE, UNKNOWN_TYPE, FAILED_STAGE = "Unsupported file type: ", "unknown", "VALIDATE"
UPLOAD_SUFFIXES = [".pdf", ".jpg", ".jpeg", ".png", ".webp", ".tiff", ".tif", ".bmp", ".heic", ".heif"]
# -----------------------------------------------------------------------------


def header_key(label: str) -> str:
    return re.sub(r"[\W_]+", "", label.lower())


def recognised(sheet: DataFrame, fields: dict) -> tuple[DataFrame, list[str]]:
    """The sheet with one column per field (null where absent), and the missing required labels.

    Headers are compared by letters and digits alone; of two equal headers the later one counts.
    """
    wanted = {header_key(label): name for name, (label, _) in fields.items()}
    at = {wanted[header_key(h)]: i for i, h in enumerate(sheet.columns) if header_key(h) in wanted}
    numbered = sheet.toDF(*[h if h == "row_no" else f"_c{i}" for i, h in enumerate(sheet.columns)])
    given = [f"_c{i}" for i, h in enumerate(sheet.columns) if h != "row_no"]
    cells = [(F.col(f"_c{at[name]}") if name in at else F.lit(None).cast("string")).alias(name) for name in fields]
    any_given = F.coalesce(*[F.col(c) for c in given]).isNotNull()
    missing = [label for name, (label, required) in fields.items() if required and name not in at]
    return numbered.filter(any_given).select("row_no", *cells), missing


def _split(rows: DataFrame, problems: list[Column]) -> tuple[DataFrame, DataFrame]:
    judged = rows.withColumn("_problems", F.array_compact(F.array(*problems)))
    rejected = judged.filter(F.size("_problems") > 0).select(
        F.col("row_no"), F.concat(F.format_string(REJECTED, "row_no"), F.array_join("_problems", "; ")).alias("error"))
    return judged.filter(F.size("_problems") == 0).drop("_problems"), rejected


def _no_rows(rows: DataFrame, missing: list[str]) -> tuple[DataFrame, DataFrame]:
    message = MISSING_COLUMNS + ", ".join(missing)
    one = rows.sparkSession.createDataFrame([(None, message)], "row_no bigint, error string")
    return rows.limit(0), one


def _text(name: str) -> Column:
    return F.when(~is_blank(F.col(name)), trimmed(F.col(name)))


def chart_of_accounts(sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a chart-of-accounts sheet."""
    rows, missing = recognised(sheet, COA_FIELDS)
    if missing:
        return _no_rows(rows, missing)
    required = [F.when(is_blank(F.col(name)), REQUIRED % label)
                for name, (label, needed) in COA_FIELDS.items() if needed]
    good, errors = _split(rows, required)
    return good.select("row_no", *[_text(name).alias(name) for name in COA_FIELDS]), errors


def ledger(sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a ledger sheet. A date or amount is wrong only if given and unreadable."""
    rows, missing = recognised(sheet, LEDGER_FIELDS)
    if missing:
        return _no_rows(rows, missing)
    kind = F.lower(_text("transaction_type"))
    parsed = rows.withColumns({
        "_kind": kind,
        **{f"_{n}": values.sheet_date(F.col(n)) for n in ("invoice_date", "ledger_date")},
        **{f"_{n}": values.sheet_amount(F.col(n)) for n in ("invoice_amount", "ledger_amount")},
    })

    def unreadable(name: str, message: str) -> Column:
        return F.when(~is_blank(F.col(name)) & F.col(f"_{name}").isNull(), message % LEDGER_FIELDS[name][0])

    good, errors = _split(parsed, [
        F.when(~F.coalesce(F.col("_kind").isin(TRANSACTION_TYPES), F.lit(False)), WRONG_TYPE),
        unreadable("invoice_date", UNPARSEABLE), unreadable("invoice_amount", NOT_NUMERIC),
        unreadable("ledger_date", UNPARSEABLE), unreadable("ledger_amount", NOT_NUMERIC)])
    return good.select(
        "row_no", F.when(F.col("_kind").isin(SALES_TYPES), SALES).otherwise(PURCHASE).alias("transaction_type"),
        F.coalesce(_text("invoice_no"), F.lit("")).alias("invoice_no"),
        F.col("_invoice_date").alias("invoice_date"), F.col("_invoice_amount").alias("invoice_amount"),
        F.col("_ledger_date").alias("ledger_date"), _text("ledger_voucher").alias("ledger_voucher"),
        F.col("_ledger_amount").alias("ledger_amount"), _text("account_name").alias("account_name"),
        _text("bank_cash_account").alias("bank_cash_account")), errors


def appended(held: DataFrame, uploaded: DataFrame, idx: str) -> DataFrame:
    """Uploaded rows after those already held, statement by statement.

    Only the order of ``idx`` matters, so the file position is added to the highest index held.
    """
    last = held.groupBy("statement_id").agg(F.max(idx).alias("_last"))
    placed = (uploaded.join(last, "statement_id", "left")
              .withColumn(idx, F.coalesce(F.col("_last"), F.lit(-1)) + F.col("row_no") - 1).drop("_last", "row_no"))
    return held.unionByName(placed, allowMissingColumns=True)


def suffix(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, "[^/](\\.[^./]+)$", 1))


def admission(files: DataFrame) -> DataFrame:
    """Accept a file by its declared type, else by its suffix; the rest fail at stage VALIDATE."""
    mime, ending = F.coalesce("content_type", F.lit("")), suffix(F.coalesce("filename", F.lit("")))
    accepted = mime.isin(UPLOAD_MIME_TYPES) | ending.isin(UPLOAD_SUFFIXES)
    shown = F.when(mime != "", mime).when(ending != "", ending).otherwise(UNKNOWN_TYPE)
    return files.withColumns({
        "accepted": accepted,
        "stage": F.when(~accepted, FAILED_STAGE),
        "error": F.when(~accepted, F.concat(F.lit(UNSUPPORTED_TYPE), shown)),
    })
