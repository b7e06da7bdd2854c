"""Shape repair and reshaping of release schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import schedule


def aligned_parts(parts: DataFrame, columns: DataFrame) -> DataFrame:
    """Every part row at the width of its header, with a note where it had to be repaired."""
    widths = columns.groupBy("doc_id").agg(F.count("*").cast("int").alias("_width"))
    width = F.coalesce("_width", F.lit(0))
    return (parts.join(widths, "doc_id", "left")
            .withColumn("quantities_repaired", schedule.repair_note(F.col("quantities"), width))
            .withColumn("quantities", schedule.aligned(F.col("quantities"), width))
            .drop("_width"))


def long_form(parts: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per part and week, joined to its header column by position.

    A document's header columns meet its parts as one list, no longer than the rows they head, and cells are unfolded after the join.
    """
    week = F.struct("col_no", "week_label", "delivery_date")
    headers = columns.groupBy("doc_id").agg(F.collect_list(week).alias("_weeks"))
    met = parts.select("doc_id", "part_no", "part_number", "quantities").join(headers, "doc_id")
    cells = met.select("doc_id", "part_no", "part_number", "quantities", F.inline("_weeks"))
    return (cells.filter(F.col("col_no").between(1, F.size("quantities")))
            .select("doc_id", F.col("col_no").cast("int").alias("col_no"), "part_no", "part_number", F.get("quantities", F.col("col_no").cast("int") - 1).alias("quantity"),
                    "week_label", "delivery_date"))


def matrix(parts: DataFrame, columns: DataFrame) -> DataFrame:
    """The schedule matrix with one ``cells`` array a row, as wide as its document's header (none without one), and a total over all cells given."""
    given = parts.withColumn("total", F.coalesce(schedule.total(F.col("quantities")), F.lit(0.0)))
    headed = columns.select("doc_id", F.lit(True).alias("headed")).distinct()
    cells = F.when(F.col("headed"), F.col("quantities")).otherwise(F.array().cast("array<double>"))
    return (aligned_parts(given, columns).join(headed, "doc_id", "left")
            .select("doc_id", "part_no", "po_number", "part_number", "description", "std_pack", cells.alias("cells"), "total"))


def widest(columns: DataFrame) -> int:
    """Week columns of the widest header."""
    return columns.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def wide_form(parts: DataFrame, columns: DataFrame, width: int | None = None) -> DataFrame:
    """The schedule matrix with a column for each week and a total over all cells given.

    The widest header of the table decides the columns, ``width`` at least; cells beyond a document's own header are null.
    """
    n = max(width or 0, widest(columns))
    return matrix(parts, columns).select(
        "doc_id", "part_no", "po_number", "part_number", "description", "std_pack",
        *[F.get("cells", F.lit(j)).alias(f"week_{j + 1}") for j in range(n)], "total")


def header_labels(columns: DataFrame) -> DataFrame:
    return columns.select("doc_id", "col_no", schedule.column_label(
        F.col("week_label"), F.col("raw_delivery_date"), F.col("delivery_date")).alias("label"))
