"""Tax invoice rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import shortest_float, trimmed
from tallyspark.rules import TOLERANCE, check, close, emit, money, present

# ---- fixed values -----------------------------------------------------------
GSTIN = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1}$"
IFSC = "^[A-Z]{4}0[A-Z0-9]{6}$"
ISO_DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
CODE_STATE, CODE_LABELS = "%s '%s' is %s", {"vendor_gstin": "Vendor GSTIN", "customer_gstin": "Customer GSTIN", "ifsc": "IFSC"}
NUMBER_PRESENT, NUMBER_MISSING = "Invoice number is present", "Invoice number is missing"
DATE_MISSING, DATE_VALID, DATE_INVALID = "Invoice date is missing", "Invoice date format is valid", "Invoice date '%s' is not in YYYY-MM-DD format"
LINES_FOUND, NO_LINES = "%d line item(s) found", "No line items found"
TOTALS = "subtotal(%s) + tax(%s) + round_off(%s) = %s, grand_total = %s, diff = %s"
TAX_PARTS = "CGST(%s) + SGST(%s) + IGST(%s) = %s, total_tax = %s"
BOTH_TAXES = "Both CGST and IGST are non-zero — only one should apply per invoice"
LINE_OFF = "Line %d: qty×unit_price=%s ≠ taxable_value=%s"
# -----------------------------------------------------------------------------


def _code(section: int, rule: str, column: str, field: str, pattern: str) -> Column:
    value = F.col(column)
    valid = F.upper(trimmed(value)).rlike(pattern)
    return check(section, 0, rule, valid,
                 F.format_string(CODE_STATE, F.lit(CODE_LABELS[column]), value, F.when(valid, "valid").otherwise("invalid")),
                 field, present(value))


def header_checks(headers: DataFrame, lines: DataFrame) -> DataFrame:
    counts = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    docs = headers.join(counts, "doc_id", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    number, date, n = F.col("invoice_number"), F.col("invoice_date"), F.col("n_lines")
    subtotal, tax, total = F.col("subtotal"), F.col("total_tax"), F.col("grand_total")
    round_off = F.coalesce("round_off", F.lit(0.0))
    cgst, sgst, igst = (F.coalesce(c, F.lit(0.0)) for c in ("cgst_total", "sgst_total", "igst_total"))
    expected, parts = subtotal + tax + round_off, cgst + sgst + igst
    off = F.abs(expected - total)
    return emit(
        docs,
        check(1, 0, "invoice_number_present", present(number),
              F.when(present(number), NUMBER_PRESENT).otherwise(NUMBER_MISSING),
              "invoice_number"),
        check(2, 0, "invoice_date_valid", present(date) & date.rlike(ISO_DATE),
              F.when(~present(date), DATE_MISSING)
              .when(date.rlike(ISO_DATE), DATE_VALID)
              .otherwise(F.format_string(DATE_INVALID, date)), "invoice_date"),
        _code(3, "vendor_gstin_format", "vendor_gstin", "vendor.gstin", GSTIN),
        _code(4, "customer_gstin_format", "customer_gstin", "customer.gstin", GSTIN),
        check(5, 0, "line_items_present", n > 0,
              F.when(n > 0, F.format_string(LINES_FOUND, n)).otherwise(NO_LINES), "line_items"),
        check(7, 0, "total_math_check", off <= TOLERANCE,
              F.format_string(
                  TOTALS,
                  shortest_float(subtotal), shortest_float(tax), shortest_float(round_off), money(expected),
                  money(total), close(off)),
              "tax_summary", subtotal.isNotNull() & tax.isNotNull() & total.isNotNull()),
        check(8, 0, "tax_components_sum", F.abs(parts - tax) <= TOLERANCE,
              F.format_string(TAX_PARTS, shortest_float(cgst),
                              shortest_float(sgst), shortest_float(igst), money(parts), money(tax)),
              "tax_summary.total_tax", tax.isNotNull()),
        check(9, 0, "cgst_igst_mutually_exclusive", F.lit(False),
              F.lit(BOTH_TAXES),
              "tax_summary", (cgst > 0) & (igst > 0)),
        _code(10, "ifsc_format", "ifsc", "bank_details.ifsc", IFSC),
    )


def line_checks(lines: DataFrame) -> DataFrame:
    at, taxable = F.col("line_no"), F.col("taxable_value")
    expected = F.col("quantity") * F.col("unit_price")
    off = F.abs(expected - taxable) > TOLERANCE * F.greatest(F.abs(taxable), F.lit(1.0))
    return emit(lines, check(
        6, at, F.format_string("line_item_%d_taxable_value", at), F.lit(False),
        F.format_string(LINE_OFF, at, money(expected), money(taxable)),
        F.format_string("line_items[%d].taxable_value", at - 1), off))


def run(headers: DataFrame, lines: DataFrame) -> DataFrame:
    return header_checks(headers, lines).unionByName(line_checks(lines))
