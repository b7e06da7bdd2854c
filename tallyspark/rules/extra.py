"""Optional checks that never change a document's status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import is_blank
from tallyspark.functions.values import iso_date
from tallyspark.rules import TOLERANCE, exact_sum


def outside_period(rows: DataFrame, headers: DataFrame, date: str = "transaction_date") -> DataFrame:
    """Dated rows that fall outside the period of their statement."""
    periods = headers.select("statement_id", "period_start", "period_end")
    return (rows.join(periods, "statement_id")
            .filter(~iso_date(F.col(date)).between(F.col("period_start"), F.col("period_end")))
            .drop("period_start", "period_end"))


def totals_check(bank: DataFrame, stated: DataFrame) -> DataFrame:
    """Counts and sums of the rows against the totals a statement prints; unprinted ones pass."""
    found = bank.groupBy("statement_id").agg(
        F.count("debit").alias("debits"), F.count("credit").alias("credits"),
        F.coalesce(exact_sum(F.col("debit")), F.lit(0.0)).alias("debit_sum"),
        F.coalesce(exact_sum(F.col("credit")), F.lit(0.0)).alias("credit_sum"))

    def agrees(given: str, off) -> object:
        return F.col(given).isNull() | off

    joined = found.join(stated, "statement_id")
    ok = (agrees("debit_count", F.col("debits") == F.col("debit_count"))
          & agrees("credit_count", F.col("credits") == F.col("credit_count"))
          & agrees("debit_total", F.abs(F.col("debit_sum") - F.col("debit_total")) <= TOLERANCE)
          & agrees("credit_total", F.abs(F.col("credit_sum") - F.col("credit_total")) <= TOLERANCE))
    return joined.select("statement_id", "debits", "credits", "debit_sum", "credit_sum", ok.alias("agrees"))


CHUNK = 1 << 16


def balance_breaks(bank: DataFrame) -> DataFrame:
    """Rows whose balance is not the previous row's balance plus the amount.

    The previous row is looked up inside a chunk of bank_idx; the first row of a chunk takes the
    last row of the chunk before it, from a table with one row per chunk.
    """
    rows = bank.select("statement_id", "bank_idx", "balance", F.floor(F.col("bank_idx") / CHUNK).alias("_chunk"),
                       (F.coalesce("credit", F.lit(0.0)) - F.coalesce("debit", F.lit(0.0))).alias("moved"))
    inside = Window.partitionBy("statement_id", "_chunk").orderBy("bank_idx")
    chunks = rows.groupBy("statement_id", "_chunk").agg(F.max_by("balance", "bank_idx").alias("_last"))
    along = Window.partitionBy("statement_id").orderBy("_chunk")
    edges = chunks.select("statement_id", "_chunk", F.lag("_last").over(along).alias("_edge"))
    first = F.row_number().over(inside) == 1
    return (rows.withColumns({"_first": first, "_prev": F.lag("balance").over(inside)})
            .join(edges, ["statement_id", "_chunk"])
            .withColumn("expected", F.when(F.col("_first"), F.col("_edge")).otherwise(F.col("_prev")) + F.col("moved"))
            .filter(F.abs(F.col("expected") - F.col("balance")) > TOLERANCE)
            .select("statement_id", "bank_idx", "expected", "balance"))


def empty_schedules(parts: DataFrame) -> DataFrame:
    """Releases without a single quantity other than zero."""
    used = F.exists("quantities", lambda q: F.coalesce(q, F.lit(0.0)) != 0)
    return parts.groupBy("doc_id").agg(F.bool_or(F.coalesce(used, F.lit(False))).alias("used")).filter("not used").select("doc_id")


def unordered_weeks(columns: DataFrame) -> DataFrame:
    """Header columns whose week number falls back without starting over from the year's end."""
    along = Window.partitionBy("doc_id").orderBy("col_no")
    week = F.regexp_extract("week_label", "([0-9]{1,2})", 1).try_cast("int")
    before = F.lag("week").over(along)
    return (columns.withColumn("week", week).filter("week is not null").withColumn("before", before)
            .filter((F.col("week") <= F.col("before")) & ~((F.col("before") >= 52) & (F.col("week") == 1)))
            .select("doc_id", "col_no", "week_label"))


def repeated_parties(headers: DataFrame) -> DataFrame:
    """Orders whose vendor is printed again as bill-to or ship-to."""
    def same(a: str, b: str):
        return ~is_blank(F.col(a)) & (F.lower(F.trim(a)) == F.lower(F.trim(b)))

    pairs = [("vendor_name", "bill_to_name"), ("vendor_name", "ship_to_name"), ("bill_to_name", "ship_to_name")]
    listed = F.array_compact(F.array(*[F.when(same(a, b), F.struct(F.lit(a).alias("party"), F.lit(b).alias("repeats"))) for a, b in pairs]))
    return headers.select("doc_id", F.inline(listed))
