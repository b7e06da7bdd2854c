"""Which rule set applies to a document, and what its failures mean."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



@dataclass(frozen=True)
class RuleSet:
    name: str
    critical_for_messages: tuple[str, ...]
    critical_for_status: tuple[str, ...]


# ---- fixed values -----------------------------------------------------------
# The two lists of the invoice set differ on purpose: one sorts messages, one decides the status.
INDIA = RuleSet(
    "india_invoice",
    ("invoice_number_present", "invoice_date_valid", "total_math_check"),
    ("invoice_number_present", "invoice_date_valid", "total_math_check",
     "vendor_gstin_format", "customer_gstin_format", "cgst_igst_mutually_exclusive"))
RELEASE = RuleSet(
    "us_shipping_authorization",
    ("sa_parts_present", "sa_schedule_columns_present", "sa_schedule_width_match"),
    ("sa_parts_present", "sa_schedule_columns_present", "sa_schedule_width_match"))
ORDER = RuleSet(
    "us_purchase_order",
    ("so_order_number_present", "so_order_date_valid", "so_line_items_present", "so_totals_math_check"),
    ("so_order_number_present", "so_order_date_valid", "so_line_items_present", "so_totals_math_check"))
UNCLASSIFIED = RuleSet("us_unclassified", (), ())
STATEMENT = RuleSet(
    "bank_reconciliation",
    ("bank_balance_math", "book_balance_math", "balances_reconcile"),
    ("bank_balance_math", "book_balance_math", "balances_reconcile"))
INVALID, NEEDS_REVIEW, VALID = "INVALID", "NEEDS_REVIEW", "VALID"
# -----------------------------------------------------------------------------

RULESETS = [INDIA, RELEASE, ORDER, UNCLASSIFIED, STATEMENT]


def ruleset_name(country: Column, doc_type: Column) -> Column:
    """Anything but USA is an Indian invoice; a US document of unknown type has no fatal rules."""
    kind = F.upper(doc_type)
    return (F.when(F.upper(F.coalesce(country, F.lit(""))) != "USA", INDIA.name)
            .when(kind == "SA", RELEASE.name).when(kind == "SO", ORDER.name).otherwise(UNCLASSIFIED.name))


def _critical(which: str) -> Column:
    found = F.lit(False)
    for ruleset in RULESETS:
        names = getattr(ruleset, which)
        if names:
            found = found | ((F.col("ruleset") == ruleset.name) & F.col("rule").isin(*names))
    return found


def messages(checks: DataFrame, model_warnings: DataFrame | None = None) -> DataFrame:
    """Failed checks as (doc_id, kind, section, item, message); kind is error or warning.

    Warnings of the model, if given as (doc_id, ord, message), come after the rules' own.
    """
    kind = F.when(_critical("critical_for_messages"), "error").otherwise("warning")
    found = checks.filter(~F.col("passed")).select("doc_id", kind.alias("kind"), "section", "item", "message")
    if model_warnings is None:
        return found
    return found.unionByName(model_warnings.select(
        "doc_id", F.lit("warning").alias("kind"), F.lit(1000).alias("section"),
        F.col("ord").cast("bigint").alias("item"), "message"))


def statuses(checks: DataFrame, model_checks: DataFrame | None = None) -> DataFrame:
    """(doc_id, ruleset, status). ``model_checks``: (doc_id, result); only FAIL counts."""
    failed = ~F.col("passed")
    per_doc = checks.groupBy("doc_id", "ruleset").agg(
        F.bool_or(failed & _critical("critical_for_status")).alias("fatal"), F.bool_or(failed).alias("failed"))
    if model_checks is not None:
        flagged = model_checks.groupBy("doc_id").agg(F.bool_or(F.col("result") == "FAIL").alias("flagged"))
        per_doc = per_doc.join(flagged, "doc_id", "left")
    else:
        per_doc = per_doc.withColumn("flagged", F.lit(False))
    return per_doc.select(
        "doc_id", "ruleset",
        F.when(F.col("fatal"), INVALID).when(F.col("failed") | F.coalesce("flagged", F.lit(False)), NEEDS_REVIEW)
        .otherwise(VALID).alias("status"))


def stamped(checks: DataFrame, ruleset: RuleSet) -> DataFrame:
    return checks.withColumn("ruleset", F.lit(ruleset.name))


__all__ = ["RULESETS", "RuleSet", "messages", "ruleset_name", "stamped", "statuses"]
