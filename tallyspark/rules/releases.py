"""Shipping authorization rules: a parts by weeks demand schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.values import ISO_DATE, real_date
from tallyspark.rules import check, emit, present


def header_facts(columns: DataFrame) -> DataFrame:
    """(doc_id, width, ordered): number of header columns, and whether the known delivery dates strictly increase along them."""
    date = F.when(F.col("delivery_date").rlike(ISO_DATE), real_date(F.col("delivery_date")))
    before = Window.partitionBy("doc_id").orderBy("col_no").rowsBetween(Window.unboundedPreceding, -1)
    rises = F.coalesce(F.last("date", ignorenulls=True).over(before) < F.col("date"), F.lit(True))
    return (columns.select("doc_id", "col_no", date.alias("date")).withColumn("rises", rises)
            .groupBy("doc_id").agg(F.count("*").alias("width"), F.bool_and("rises").alias("ordered")))


def part_facts(parts: DataFrame, widths: DataFrame) -> DataFrame:
    """(doc_id, n_parts, ragged, negative, off_pack): the part rows counted, and the offending ones named in order, null if none.

    Every row is reduced to its offending texts before it is shuffled; a document gathers these alone. ``widths``: doc_id, width.
    """
    label = F.when(present(F.col("part_number")), F.col("part_number")).otherwise(F.concat(F.lit("row "), _digits(F.col("part_no"))))
    pack = F.when(F.col("std_pack") != 0, F.col("std_pack"))

    def texts(bad) -> Column:
        # one pass over the cells; what is not offending is null, and a join leaves nulls out
        named = F.transform("quantities", lambda q, i: F.when(bad(q), F.concat(label, F.lit(" week "), (i + 1).cast("string"))))
        return F.nullif(F.array_join(named, ", "), F.lit(""))

    rows = parts.select(
        "doc_id", "part_no", F.when(present(F.col("quantities_repaired")), F.col("quantities_repaired")).alias("repaired"),
        F.coalesce(F.size("quantities"), F.lit(0)).alias("have"), texts(lambda q: q < 0).alias("negative"), texts(lambda q: q % pack != 0).alias("off_pack"))
    width, row = F.coalesce("width", F.lit(0)), F.concat(F.lit("row "), _digits(F.col("part_no")))
    ragged = (F.when(F.col("repaired").isNotNull(), F.concat(row, F.lit(" was "), "repaired"))
              .when(F.col("have") != width, F.concat(row, F.lit(" has "), F.col("have").cast("string"), F.lit(" of "), width.cast("string"))))
    judged = rows.join(widths, "doc_id", "left").select("doc_id", "part_no", ragged.alias("ragged"), "negative", "off_pack")
    names = ("ragged", "negative", "off_pack")
    found = F.struct("part_no", *names)
    gathered = judged.groupBy("doc_id").agg(
        F.count("*").alias("n_parts"), F.sort_array(F.collect_list(F.when(F.coalesce(*names).isNotNull(), found))).alias("found"))
    return gathered.select("doc_id", "n_parts", *[F.nullif(F.array_join(f"found.{name}", ", "), F.lit("")).alias(name) for name in names])


def _digits(number: Column) -> Column:
    return F.coalesce(number.cast("string"), F.lit("null"))


def run(headers: DataFrame, columns: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts``: doc_id, part_no, part_number, std_pack, quantities, quantities_repaired.

    Columns and parts are each read and shuffled once; what they say meets at the document.
    """
    at = F.col("part_no")
    facts = header_facts(columns)
    docs = headers.join(facts, "doc_id", "left").join(part_facts(parts, facts.select("doc_id", "width")), "doc_id", "left")
    width, n = F.coalesce("width", F.lit(0)), F.coalesce("n_parts", F.lit(0))
    ordered = F.coalesce("ordered", F.lit(True))
    supplier = F.when(present(F.col("supplier_name")), F.col("supplier_name")).when(
        present(F.col("supplier_code")), F.col("supplier_code"))

    def clean(name: str) -> Column:
        return F.col(name).isNull()

    per_doc = emit(
        docs,
        check(1, 0, "sa_supplier_identified", supplier.isNotNull(),
              F.when(supplier.isNotNull(), F.concat(F.lit("Supplier identified as "), supplier))
              .otherwise("Neither a supplier name nor a supplier code was found"), "supplier.name"),
        check(2, 0, "sa_schedule_columns_present", width > 0,
              F.when(width > 0, F.format_string("%d weekly bucket(s) found", width))
              .otherwise("No weekly schedule columns were extracted"), "schedule_columns"),
        check(3, 0, "sa_delivery_dates_ordered", ordered,
              F.when(ordered, "Delivery dates increase left to right")
              .otherwise("Delivery dates are not in ascending order across the schedule"), "schedule_columns", width > 0),
        check(4, 0, "sa_parts_present", n > 0,
              F.when(n > 0, F.format_string("%d part row(s) found", n)).otherwise("No part rows were extracted"), "parts"),
        check(5, 0, "sa_schedule_width_match", clean("ragged"),
              F.when(clean("ragged"), F.format_string("All %d part row(s) span %d bucket(s)", n, width))
              .otherwise(F.concat(F.lit("Part row(s) do not line up with the schedule header: "), "ragged")),
              "parts", n > 0),
        check(7, 0, "sa_quantities_non_negative", clean("negative"),
              F.when(clean("negative"), "All scheduled quantities are zero or positive")
              .otherwise(F.concat(F.lit("Negative quantities found at: "), "negative")), "parts", n > 0),
        check(8, 0, "sa_std_pack_multiple", clean("off_pack"),
              F.when(clean("off_pack"), "Scheduled quantities are whole standard packs")
              .otherwise(F.concat(F.lit("Quantities are not a multiple of the standard pack at: "), "off_pack")),
              "parts", n > 0),
    )
    named = present(F.col("part_number"))
    # one check a row, so no list of checks is unfolded
    per_part = parts.select("doc_id", check(
        6, at, F.concat(F.lit("sa_part_"), _digits(at), F.lit("_part_number")), named,
        F.when(named, F.concat(F.lit("Part number "), "part_number"))
        .otherwise(F.concat(F.lit("Row "), _digits(at), F.lit(" has no part number"))),
        F.concat(F.lit("parts."), _digits(at - 1), F.lit(".part_number"))).alias("made")).select("doc_id", "made.*")
    return per_doc.unionByName(per_part)
