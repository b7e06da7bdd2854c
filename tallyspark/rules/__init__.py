"""Deterministic rule sets. Each returns long rule checks:

(doc_id, section, item, rule, passed, message, field), where (section, item) is the order in
which the checks of a document are listed.

Documents come as flat tables - one header row per document, one row per line - so a document of
any length is checked line by line where its rows happen to be; only counts and sums are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import is_blank

# ---- fixed values -----------------------------------------------------------
TOLERANCE = 0.05
RELATIVE_TOLERANCE = 0.001
# -----------------------------------------------------------------------------


def check(section: int, item: Column | int, rule: Column | str, passed: Column, message: Column,
          field: Column | str, when: Column | None = None) -> Column:
    """One rule check, left out where ``when`` does not hold."""
    def column(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    made = F.struct(
        F.lit(section).alias("section"), column(item).cast("bigint").alias("item"), column(rule).alias("rule"),
        passed.alias("passed"), message.alias("message"), column(field).alias("field"))
    return made if when is None else F.when(when, made)


def emit(rows: DataFrame, *checks: Column) -> DataFrame:
    return rows.select("doc_id", F.inline(F.array_compact(F.array(*checks))))


def present(c: Column) -> Column:
    return ~is_blank(c)


def money(c: Column) -> Column:
    return F.format_string("%.2f", c)


def close(c: Column) -> Column:
    return F.format_string("%.4f", c)


def exact_sum(c: Column) -> Column:
    """A sum that does not depend on the order of rows."""
    return F.sum(c.cast("decimal(38,6)")).cast("double")


def line_tolerance(expected: Column) -> Column:
    return F.greatest(F.lit(TOLERANCE), F.abs(expected) * RELATIVE_TOLERANCE)
