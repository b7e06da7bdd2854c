"""Purchase order rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import shortest_float
from tallyspark.functions.values import ISO_DATE, real_date
from tallyspark.rules import check, emit, exact_sum, line_tolerance, present


def header_checks(headers: DataFrame, lines: DataFrame) -> DataFrame:
    per_doc = lines.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), exact_sum(F.col("extended_cost")).alias("line_sum"))
    docs = headers.join(per_doc, "doc_id", "left").withColumns({
        "n_lines": F.coalesce("n_lines", F.lit(0)), "line_sum": F.coalesce("line_sum", F.lit(0.0))})
    number, date, n, total = F.col("order_number"), F.col("order_date"), F.col("n_lines"), F.col("grand_total")
    real = F.coalesce(date.rlike(ISO_DATE) & real_date(date).isNotNull(), F.lit(False))
    ship_to = present(F.col("ship_to_name")) | present(F.col("ship_to_address"))
    zero = F.lit(0.0)
    expected = (F.coalesce("subtotal", "line_sum") + F.coalesce("sales_tax", zero)
                + F.coalesce("freight", zero) - F.coalesce("discount", zero))
    adds_up = F.abs(expected - total) <= line_tolerance(expected)
    return emit(
        docs,
        check(1, 0, "so_order_number_present", present(number),
              F.when(present(number), F.format_string("PO number %s", number)).otherwise("No PO number was found"),
              "order_number"),
        check(2, 0, "so_order_date_valid", real,
              F.when(date.isNull(), "No order date was found")
              .when(real, F.format_string("Order date %s", date))
              .otherwise(F.format_string("Order date '%s' is not a valid YYYY-MM-DD date", date)), "order_date"),
        check(3, 0, "so_ship_to_present", ship_to,
              F.when(ship_to, "Ship-to address present").otherwise("No ship-to address was found"), "ship_to.address"),
        check(4, 0, "so_line_items_present", n > 0,
              F.when(n > 0, F.format_string("%d line item(s) found", n)).otherwise("No line items were extracted"),
              "line_items"),
        check(6, 0, "so_totals_math_check", adds_up,
              F.when(adds_up, F.format_string("Totals add up to %s", shortest_float(total)))
              .otherwise(F.format_string(
                  "Subtotal plus tax and freight less discount is %s, but the grand total reads %s",
                  shortest_float(F.round(expected, 2)), shortest_float(total))),
              "totals.grand_total", total.isNotNull()),
    )


def line_checks(lines: DataFrame) -> DataFrame:
    at, quantity, unit, extended = (F.col(c) for c in ("line_no", "quantity", "unit_cost", "extended_cost"))
    positive = F.coalesce(quantity > 0, F.lit(False))
    expected = quantity * unit
    within = F.abs(expected - extended) <= line_tolerance(expected)
    product = F.concat(F.format_string("Line %d: ", at), shortest_float(quantity), F.lit(" x "), shortest_float(unit))
    return emit(
        lines,
        check(5, at * 2, F.format_string("so_line_%d_quantity", at), positive,
              F.when(positive, F.concat(F.format_string("Line %d quantity ", at), shortest_float(quantity)))
              .otherwise(F.format_string("Line %d has no positive quantity", at)),
              F.format_string("line_items.%d.quantity", at - 1)),
        check(5, at * 2 + 1, F.format_string("so_line_%d_extended_cost", at), within,
              F.when(within, F.concat(product, F.lit(" = "), shortest_float(extended)))
              .otherwise(F.concat(product, F.lit(" = "), shortest_float(F.round(expected, 2)),
                                  F.lit(", but the extended cost reads "), shortest_float(extended))),
              F.format_string("line_items.%d.extended_cost", at - 1),
              quantity.isNotNull() & unit.isNotNull() & extended.isNotNull()))


def run(headers: DataFrame, lines: DataFrame) -> DataFrame:
    return header_checks(headers, lines).unionByName(line_checks(lines))
