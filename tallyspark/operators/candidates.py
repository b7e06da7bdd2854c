"""Candidate pools of ledger rows.

A pool is never written out pair by pair. Bank rows are first reduced to one row per day (and
amount); a range window over those days then gives every pool's size and lowest bank index. A
window partition has at most one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_totals(banks: DataFrame, rows: DataFrame, keys: list[str], tolerance: int,
                  names: tuple[str, str]) -> DataFrame:
    """Count and lowest index of bank rows within the window of each distinct day in ``rows``."""
    count_name, first_name = names
    supply = banks.filter(F.col("day").isNotNull()).select(
        *keys, "day", F.lit(1).alias("n"), F.col("bank_idx").alias("idx"))
    demand = rows.filter(F.col("day").isNotNull()).select(
        *keys, "day", F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("idx"))
    per_day = (supply.unionByName(demand).groupBy(*keys, "day")
               .agg(F.sum("n").alias("n"), F.min("idx").alias("idx"),
                    F.bool_or(F.col("n") == 0).alias("wanted")))
    span = Window.partitionBy(*keys).orderBy("day").rangeBetween(-tolerance, tolerance)
    return (per_day
            .select(*keys, "day", "wanted",
                    F.sum("n").over(span).alias(count_name), F.min("idx").over(span).alias(first_name))
            .filter("wanted").drop("wanted"))


def exact_amount_pools(ledger: DataFrame, banks: DataFrame) -> DataFrame:
    """Per ledger row: bank rows of the statement with exactly its amount, at any date."""
    supply = (banks.filter(F.col("cents").isNotNull()).groupBy("statement_id", "cents")
              .agg(F.count("*").alias("n_same_amount"), F.min("bank_idx").alias("first_same_amount")))
    return (ledger.select("statement_id", "led_idx", "cents")
            .join(supply, ["statement_id", "cents"], "left")
            .select("statement_id", "led_idx",
                    F.coalesce("n_same_amount", F.lit(0)).alias("n_same_amount"), "first_same_amount"))


def candidate_pools(ledger: DataFrame, banks: DataFrame, tolerance: int) -> DataFrame:
    """Per ledger row: its window pool, its same-amount pool, and which of them is used.

    Same-amount bank rows inside the window win as soon as there is one, whatever their
    direction; otherwise the whole window is the pool.
    """
    rows = ledger.select("statement_id", "led_idx", "day", "cents")
    window = window_totals(banks, rows, ["statement_id"], tolerance, ("n_window", "first_window"))
    exact = window_totals(
        banks.filter(F.col("cents").isNotNull()), rows.filter(F.col("cents").isNotNull()),
        ["statement_id", "cents"], tolerance, ("n_exact", "first_exact"))
    n_window = F.coalesce("n_window", F.lit(0))
    n_exact = F.coalesce("n_exact", F.lit(0))
    return (rows
            .join(window, ["statement_id", "day"], "left")
            .join(exact, ["statement_id", "cents", "day"], "left")
            .select("statement_id", "led_idx",
                    n_window.alias("n_window"), "first_window",
                    n_exact.alias("n_exact"), "first_exact",
                    F.when(n_exact > 0, "exact").when(n_window > 0, "window").otherwise("none").alias("tier"),
                    F.when(n_exact > 0, n_exact).otherwise(n_window).alias("n_candidates")))
