"""Headline timings: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

import catalog

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "assigned_pairs",        # two-way reconciliation, both waves
    "vouchers_two_way",      # with split and combined settlements
    "vouchers_three_way",    # with the chart of accounts
    "candidate_pools",
    "reconciliation_report",
    "india_invoice_rules",
    "purchase_order_rules",
    "shipping_authorization_rules",
    "bank_statement_rules",
    "invoice_statuses",
    "review_assembly",
    "attachment_plan",
    "ocr_rollup",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    chosen = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{FOLDER}/orders.parquet").count()
    seconds = {}
    for name in chosen:
        start = time.time()
        queries[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    scale = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
