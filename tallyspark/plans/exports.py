"""Flat reports of the business documents.

A header block becomes label/value rows (doc_id, section, ord, label, value); a table becomes
one row per line with the report's column titles. Missing values are empty text in header blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import shortest_float, trimmed
from tallyspark.operators import release

# ---- fixed values -----------------------------------------------------------
INVOICE_HEADER = [
    ("Invoice Number", "invoice_number"), ("Invoice Date", "invoice_date"), ("Due Date", "due_date"),
    ("Currency", "currency"), ("Purchase Order", "purchase_order_number"), ("Vendor Name", "vendor_name"),
    ("Vendor GSTIN", "vendor_gstin"), ("Vendor PAN", "vendor_pan"), ("Vendor Address", "vendor_address"),
    ("Vendor Phone", "vendor_phone"), ("Vendor Email", "vendor_email"), ("Customer Name", "customer_name"),
    ("Customer GSTIN", "customer_gstin"), ("Customer Address", "customer_address"), ("Subtotal", "subtotal"),
    ("CGST Total", "cgst_total"), ("SGST Total", "sgst_total"), ("IGST Total", "igst_total"),
    ("Total Tax", "total_tax"), ("Round Off", "round_off"), ("Grand Total", "grand_total"),
]
INVOICE_LINES = [
    ("Description", "description"), ("HSN/SAC", "hsn_sac"), ("Quantity", "quantity"), ("Unit", "unit"),
    ("Unit Price", "unit_price"), ("Taxable Value", "taxable_value"), ("CGST Rate", "cgst_rate"),
    ("CGST Amt", "cgst_amount"), ("SGST Rate", "sgst_rate"), ("SGST Amt", "sgst_amount"),
    ("IGST Rate", "igst_rate"), ("IGST Amt", "igst_amount"), ("Total", "total"),
]
ORDER_HEADER = [
    ("PO Number", "order_number"), ("Order Date", "order_date"), ("Currency", "currency"),
    ("Payment Terms", "payment_terms"), ("Freight Terms", "freight_terms"), ("Ship Via", "ship_via"),
    ("Received By", "received_by"), ("Received At", "received_at"),
]
ORDER_PARTIES = [("Vendor", "vendor"), ("Buyer", "buyer"), ("Bill To", "bill_to"), ("Ship To", "ship_to")]
ORDER_LINES = [
    ("Line #", "line_number"), ("Part Number", "part_number"), ("Description", "description"),
    ("Quantity", "quantity"), ("UOM", "uom"), ("Due Date", "due_date"), ("Unit Cost", "unit_cost"),
    ("Ext'd Cost", "extended_cost"),
]
ORDER_TOTALS = [
    ("Subtotal", "subtotal"), ("Sales Tax", "sales_tax"), ("Freight", "freight"), ("Discount", "discount"),
    ("Grand Total", "grand_total"),
]
RELEASE_HEADER = [
    ("Release Number", "release_number"), ("Release Date", "release_date"), ("Received By", "received_by"),
    ("Received At", "received_at"),
]
SCHEDULE_HEAD, SCHEDULE_TOTAL = ["PO", "Part Number", "Description", "Std Pack"], "Total"
RELEASE_PARTIES = [("Issuer", "issuer"), ("Supplier", "supplier")]
STATEMENT_HEADER = [
    ("Company Name", "company_name"), ("Bank Name", "bank_name"), ("Account Number", "account_number"),
    ("Period Start", "statement_period_start"), ("Period End", "statement_period_end"), ("Currency", "currency"),
    ("Prepared By", "prepared_by"), ("Prepared Date", "prepared_date"),
    ("Opening Balance (Bank)", "opening_balance_bank"), ("Opening Balance (Book)", "opening_balance_book"),
    ("Closing Balance (Bank)", "closing_balance_bank"), ("Closing Balance (Book)", "closing_balance_book"),
    ("Reconciled Balance", "reconciled_balance"), ("Adjusted Bank Balance", "adjusted_bank_balance"),
    ("Adjusted Book Balance", "adjusted_book_balance"),
]
STATEMENT_ITEMS = [
    ("Type", "item_type"), ("Description", "description"), ("Reference #", "reference_number"), ("Date", "date"),
    ("Amount", "amount"), ("Effect", "effect"),
]
# -----------------------------------------------------------------------------


def _text(rows: DataFrame, column: str) -> Column:
    if column not in rows.columns:
        return F.lit("")
    number = dict(rows.dtypes)[column] == "double"
    return F.coalesce(shortest_float(F.col(column)) if number else F.col(column).cast("string"), F.lit(""))


def _entry(rows: DataFrame, section: str, at: int, label: str, column: str, when: Column | None = None) -> Column:
    made = F.struct(F.lit(section).alias("section"), F.lit(at).alias("ord"), F.lit(label).alias("label"),
                    _text(rows, column).alias("value"))
    return made if when is None else F.when(when, made)


def _block(rows: DataFrame, section: str, fields: list[tuple[str, str]], first: int = 1) -> list[Column]:
    return [_entry(rows, section, first + i, label, column) for i, (label, column) in enumerate(fields)]


def _party(rows: DataFrame, label: str, prefix: str, first: int) -> list[Column]:
    """Name, address and contact always; code and phone only where the party has them."""
    made = []
    for i, part in enumerate(("name", "code", "address", "contact", "phone")):
        column = f"{prefix}_{part}"
        optional = part in ("code", "phone")
        if optional and column not in rows.columns:
            continue
        made.append(_entry(rows, label, first + i, f"{label} {part.title()}", column,
                           F.col(column).isNotNull() if optional else None))
    return made


def _listed(rows: DataFrame, entries: list[Column]) -> DataFrame:
    return rows.select("doc_id", F.inline(F.array_compact(F.array(*entries))))


def _titled(rows: DataFrame, keys: list[str], fields: list[tuple[str, str]]) -> DataFrame:
    return rows.select(*keys, *[F.col(column).alias(title) for title, column in fields])


def invoice_header(invoices: DataFrame) -> DataFrame:
    return _listed(invoices, _block(invoices, "Invoice Header", INVOICE_HEADER))


def invoice_lines(lines: DataFrame) -> DataFrame:
    return _titled(lines, ["doc_id", "line_no"], INVOICE_LINES)


def order_header(orders: DataFrame) -> DataFrame:
    entries = _block(orders, "Purchase Order", ORDER_HEADER)
    for i, (label, prefix) in enumerate(ORDER_PARTIES):
        entries += _party(orders, label, prefix, 20 + 10 * i)
    return _listed(orders, entries + _block(orders, "Totals", ORDER_TOTALS, 60))


def order_lines(lines: DataFrame) -> DataFrame:
    return _titled(lines, ["doc_id", "line_no"], ORDER_LINES)


def release_header(releases: DataFrame) -> DataFrame:
    entries = _block(releases, "Shipping Authorization", RELEASE_HEADER)
    for i, (label, prefix) in enumerate(RELEASE_PARTIES):
        entries += _party(releases, label, prefix, 20 + 10 * i)
    return _listed(releases, entries)


def release_matrix(parts: DataFrame, columns: DataFrame, width: int | None = None) -> DataFrame:
    return release.wide_form(parts, columns, width)


def _cell(c: Column) -> Column:
    """A CSV cell: empty for a missing value, quoted where it must be."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(c.rlike('[",\r\n]'), quoted).otherwise(c), F.lit(""))


def schedule_sheet(parts: DataFrame, columns: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): the delivery schedule of each release as CSV lines, its own week labels in line 0.

    Releases of any width stand side by side, as a line is one text.
    """
    label = F.struct("col_no", "label")
    labels = release.header_labels(columns).groupBy("doc_id").agg(F.array_sort(F.collect_list(label)).alias("labels"))
    head = [F.lit(x) for x in SCHEDULE_HEAD]
    lead, tail = F.array(*head), F.array(F.lit(SCHEDULE_TOTAL))
    first = (parts.select("doc_id").distinct().join(labels, "doc_id", "left")
             .withColumn("cells", F.concat(lead, F.coalesce("labels.label", F.array().cast("array<string>")), tail)))
    rows = release.matrix(parts, columns)
    # numbers hold nothing that is quoted, so only texts are looked at for it
    own = F.array(*[_cell(F.col(c)) for c in ("po_number", "part_number", "description")])
    numbers = F.concat(F.array(F.col("std_pack").cast("double")), "cells", F.array("total"))
    body = rows.select("doc_id", "part_no", F.array_join(F.concat(own, F.transform(numbers, lambda x: F.coalesce(shortest_float(x), F.lit("")))), ",").alias("line"))
    line = F.array_join(F.transform("cells", _cell), ",").alias("line")
    return first.select("doc_id", F.lit(0).cast("bigint").alias("line_no"), line).unionByName(
        body.select("doc_id", F.col("part_no").cast("bigint").alias("line_no"), "line"))


def notes(documents: DataFrame, column: str) -> DataFrame:
    """Terms and notes, one row each."""
    return documents.select("doc_id", F.posexplode(column).alias("at", "note")).select(
        "doc_id", (F.col("at") + 1).alias("ord"), F.coalesce("note", F.lit("")).alias("note"))


def statement_header(statements: DataFrame) -> DataFrame:
    return _listed(statements, _block(statements, "BRS Header", STATEMENT_HEADER))


def statement_items(items: DataFrame) -> DataFrame:
    return _titled(items, ["doc_id", "side", "item_no"], STATEMENT_ITEMS)


def resolved_type(payload_type: Column, doc_type: Column) -> Column:
    """The reviewed payload's own type where it is SA or SO, else the one on record."""
    own = F.upper(trimmed(payload_type))
    return F.when(own.isin("SA", "SO"), own).otherwise(doc_type)


def basename(doc_type: Column) -> Column:
    return F.when(F.upper(doc_type) == "SA", "release").otherwise("order")


def stamped_json(outputs: DataFrame) -> DataFrame:
    """Corrected payloads (doc_id, corrected_json, country, doc_type) stamped with country and type."""
    payload = F.from_json("corrected_json", "map<string,variant>")
    kind = resolved_type(F.get_json_object("corrected_json", "$.invoice.document_type"), F.col("doc_type"))
    country = F.when(F.coalesce("country", F.lit("")) == "", "USA").otherwise(F.col("country"))
    rest = F.map_filter(payload, lambda k, _: ~k.isin("country", "document_type"))
    return (outputs.withColumns({"_rest": F.to_json(rest), "_kind": kind, "_country": country})
            .select("doc_id", F.col("_kind").alias("document_type"), basename(F.col("_kind")).alias("basename"),
                    F.concat(
                        F.expr("substr(_rest, 1, length(_rest) - 1)"), F.when(F.col("_rest") == "{}", "").otherwise(","),
                        F.expr("substr(to_json(struct(_country as country, _kind as document_type), map('ignoreNullFields', 'false')), 2)")
                    ).alias("json")))


def write_csv(table: DataFrame, path: str) -> None:
    """One report as CSV; missing values are empty cells."""
    table.write.mode("errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
