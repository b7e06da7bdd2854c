"""Report runs written as files."""

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import exports
from tallyspark.sources import reports
from tallyspark.sources.documents import Documents
from tallyspark.sources.reports import CSV, JSON, Report

ODD = ["plain", "a, b", 'say "so"', "two\nlines", " lead and trail ", "", None, "'", "\\", "\t", "é漢", "#", "\\N", "null", '"', ",", "\r\n"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, text, float(i) / 3 if i % 2 else None, i % 3 == 0) for i, text in enumerate(ODD * 3)]
    return spark.createDataFrame(rows, "k bigint, `a note, \"quoted\"` string, amount double, flag boolean")


def test_a_run_is_read_back_as_it_was(spark, table, tmp_path):
    root = str(tmp_path / "out")
    reports.write_run(spark, root, "r1", {"c": Report(table, ["k"]), "j": Report(table, ["k"], JSON), "none": Report(table.limit(0), ["k"])}, file_rows=7)
    assert reports.runs(spark, root) == ["r1"]
    c, j = reports.read_report(spark, root, "r1", "c"), reports.read_report(spark, root, "r1", "j")
    assert sorted(j.collect(), key=repr) == sorted(table.collect(), key=repr)
    assert sorted(c.collect(), key=repr) == sorted(reports.blank_as_null(table).collect(), key=repr)
    assert reports.read_report(spark, root, "r1", "none").count() == 0
    assert {e["report"]: e["rows"] for e in reports.manifest(spark, root, "r1")} == {"c": len(ODD) * 3, "j": len(ODD) * 3, "none": 0}
    files = sorted(tmp_path.glob("out/r1/attempt-*/j/part-*.json"))
    keys = [[r.k for r in spark.read.schema(table.schema).json(str(f)).collect()] for f in files]
    assert all(len(k) <= 7 for k in keys) and [x for k in keys for x in k] == list(range(len(ODD) * 3))  # in order from file to file


def test_a_failed_run_leaves_nothing_visible(spark, table, tmp_path):
    root = str(tmp_path / "out")
    broken = table.withColumn("amount", F.raise_error(F.lit("stop")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        reports.write_run(spark, root, "r1", {"a": Report(table, ["k"]), "b": Report(broken, ["k"])})
    assert reports.runs(spark, root) == []
    reports.write_run(spark, root, "r1", {"a": Report(table, ["k"])})
    assert reports.runs(spark, root) == ["r1"] and len(list(tmp_path.glob("out/r1/attempt-*"))) == 1
    with pytest.raises(Exception, match="stop"):
        reports.write_run(spark, root, "r1", {"a": Report(broken, ["k"])})
    assert reports.read_report(spark, root, "r1", "a").count() == len(ODD) * 3  # the earlier attempt is still there


def test_folders_by_column(spark, table, tmp_path):
    reports.write_run(spark, str(tmp_path), "r", {"a": Report(table.withColumn("part", F.col("k") % 4), ["part", "k"], JSON, ["part"])})
    assert sorted(p.name for p in tmp_path.glob("r/attempt-*/a/part=*")) == [f"part={i}" for i in range(4)]
    got = reports.read_report(spark, str(tmp_path), "r", "a")
    assert sorted((r.k, r.part) for r in got.collect()) == [(k, k % 4) for k in range(len(ODD) * 3)]


def test_schedule_sheets_of_several_widths(spark):
    columns = spark.createDataFrame([(d, c, f"W{c}", None, f"d,{c}" if c == 2 else None) for d, n in ((1, 2), (2, 36)) for c in range(1, n + 1)],
                                    "doc_id bigint, col_no bigint, week_label string, raw_delivery_date string, delivery_date string")
    parts = spark.createDataFrame([(1, 1, "P,1", None, 'x "y"', 5.0, [1.0]), (2, 1, None, "N", None, None, [float(k) for k in range(40)]), (3, 1, "Q", "", "", None, None)],
                                  "doc_id bigint, part_no bigint, po_number string, part_number string, description string, std_pack double, quantities array<double>")
    got = {(r.doc_id, r.line_no): r.line for r in exports.schedule_sheet(parts, columns).collect()}
    assert got[(1, 0)] == 'PO,Part Number,Description,Std Pack,W1,"W2 d,2",Total'
    assert got[(1, 1)] == '"P,1",,"x ""y""",5.0,1.0,,1.0'
    assert got[(2, 1)] == ",N,,," + ",".join(f"{k}.0" for k in range(36)) + f",{sum(range(40))}.0"
    assert got[(3, 0)] == "PO,Part Number,Description,Std Pack,Total" and got[(3, 1)] == "Q,,,,0.0"


def test_a_report_that_changed_on_the_way_is_found(spark, table):
    """Rows lost, repeated or changed count one by one, nulls in other columns included; equal tables are told by their marks alone."""
    rows = spark.createDataFrame([(k, "x" if k % 2 else None, None if k % 2 else "x") for k in range(50)] * 2, "k bigint, a string, b string")
    was = reports.marks(rows)
    unread = rows.withColumn("a", F.raise_error(F.lit("read")).cast("string"))
    assert reports.compare(unread, was, rows.repartition(7)) == (100, 0, 0)
    assert reports.compare(rows, was, rows.limit(0)) == (0, 100, 0)
    swapped = rows.select("k", F.when(F.col("k") == 3, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("k") == 3, F.col("a")).otherwise(F.col("b")).alias("b"))
    assert reports.compare(rows, was, swapped) == (100, 2, 2)
    assert reports.compare(rows, was, rows.union(rows.filter("k = 4").limit(1)).filter("k <> 5")) == (99, 2, 1)


def test_reports_are_made_one_at_a_time_and_packed(spark, table, tmp_path):
    seen = []

    def made():
        for name in ("a", "b"):
            yield name, Report(table, ["k"])
            seen.append(len(list(tmp_path.glob("r/attempt-*/*"))))

    reports.write_run(spark, str(tmp_path), "r", made(), file_rows=7, compression="gzip")
    assert seen == [1, 2] and len(list(tmp_path.glob("r/attempt-*/a/part-*.csv.gz"))) >= len(ODD) * 3 // 7
    for name in ("a", "b"):
        assert reports.compare(table, reports.marks(reports.as_read(table, CSV)), reports.read_report(spark, str(tmp_path), "r", name)) == (len(ODD) * 3, 0, 0)


def test_rows_of_a_json_report_are_counted_by_lines(spark, table, tmp_path, monkeypatch):
    """Line ends inside values are escaped, so a line is a row; folders by column and a report without rows included."""
    monkeypatch.setattr(reports, "_stored", None)  # not parsed
    parted = Report(table.withColumn("part", F.col("k") % 4), ["part", "k"], JSON, ["part"])
    reports.write_run(spark, str(tmp_path), "r", {"a": Report(table, ["k"], JSON), "b": parted, "none": Report(table.limit(0), ["k"], JSON)}, file_rows=7, compression="gzip")
    assert {e["report"]: e["rows"] for e in reports.manifest(spark, str(tmp_path), "r")} == {"a": len(ODD) * 3, "b": len(ODD) * 3, "none": 0}


def test_numbers_of_a_schedule_sheet_are_not_searched_for_quotes(spark):
    columns = spark.createDataFrame([(1, 1, "W1", None, None)], "doc_id bigint, col_no bigint, week_label string, raw_delivery_date string, delivery_date string")
    parts = spark.createDataFrame([(1, 1, "P,1", None, 'x "y"', 5.0, [float("inf")]), (1, 2, "P", "N", None, None, [None]), (1, 3, "", "N", "a\nb", 0.5, [1e9])],
                                  "doc_id bigint, part_no bigint, po_number string, part_number string, description string, std_pack double, quantities array<double>")
    sheet = exports.schedule_sheet(parts, columns)
    got = {r.line_no: r.line for r in sheet.collect()}
    assert got[2] == "P,N,,,,0.0" and got[3] == ',N,"a\nb",0.5,1000000000.0,1000000000.0' and got[1].startswith('"P,1",,"x ""y""",5.0,')
    plan = sheet._jdf.queryExecution().analyzed().toString()
    assert plan.count("RLIKE") == 4  # three texts of a part, and the texts of the first line


def test_headers_of_a_file_with_few_tasks_are_dealt_out(spark):
    """A header becomes many rows, so its join with the lines is shuffled and not left to the few tasks that read the file."""
    source = Documents(spark, "/root/testdata/sf0.001")
    for headers in (source.invoices(), source.orders()):
        plan = headers._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
