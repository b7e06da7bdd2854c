"""Uploaded sheets and row checks: every message, missing columns, empty files."""

from pyspark.sql import functions as F

from tallyspark.functions import values
from tallyspark.operators import validate
from tallyspark.sources import tabular

TYPE = 'Transaction Type must be "Sales Receipt" or "Purchase Payment"'


def sheet(spark, headers, rows):
    return spark.createDataFrame([(i + 2, *r) for i, r in enumerate(rows)], ", ".join(["row_no bigint", *[f"`{h}` string" for h in headers]]))


def test_a_sheet_without_a_required_column_gives_no_rows_and_one_error(spark):
    for make, headers, missing in ((tabular.chart_of_accounts, ["ACCOUNT-code", "Type"], "Account Name, Account Type"),
                                   (tabular.ledger, ["Invoice No", "Ledger Date"], "Transaction Type")):
        rows, errors = make(sheet(spark, headers, [("x", "y"), (None, None)]))
        assert rows.count() == 0
        assert [tuple(r) for r in errors.collect()] == [(None, f"Missing required column(s): {missing}")]


def test_an_empty_sheet_gives_nothing(spark):
    for make, fields in ((tabular.chart_of_accounts, tabular.COA_FIELDS), (tabular.ledger, tabular.LEDGER_FIELDS)):
        labels = [label for label, _ in fields.values()]
        for rows in ([], [(None,) * len(labels)]):
            good, errors = make(sheet(spark, labels, rows))
            assert good.count() == 0 and errors.count() == 0


def test_headers_are_compared_by_letters_and_digits_and_the_later_one_counts(spark):
    good, errors = tabular.chart_of_accounts(sheet(spark, ["account code", "ACCOUNT_CODE", " Account  Name ", "Account.Type", "colour"],
                                                   [("1", "2", " n ", "t", "red"), (None, None, None, None, "blue"), ("1", "", "n", "t", None)]))
    assert [(r.row_no, r.account_code, r.account_name, r.parent_group) for r in good.collect()] == [(2, "2", "n", None)]
    assert sorted(r.error for r in errors.collect()) == ["Row 3: Account Code is required; Account Name is required; Account Type is required",
                                                         "Row 4: Account Code is required"]


def test_every_message_of_a_ledger_sheet(spark):
    labels = [label for label, _ in tabular.LEDGER_FIELDS.values()]
    good, errors = tabular.ledger(sheet(spark, labels, [
        ("gift", "I1", "soon", "$5", "31-02-2024", "V", "five", None, None), (None, "I2", *[None] * 7), ("Journal Entry", None, "9-Apr-24", "INR 1,200.50", *[None] * 5)]))
    assert [r.error for r in errors.orderBy("row_no").collect()] == [
        f"Row 2: {TYPE}; Invoice Date is unparseable; Invoice Amount is not numeric; Ledger Date is unparseable; Ledger Amount is not numeric", f"Row 3: {TYPE}"]
    (row,) = good.collect()
    assert (row.transaction_type, row.invoice_no, row.invoice_date, row.invoice_amount) == ("Purchase Payment", "", "2024-04-09", 1200.5)


def test_every_message_of_the_row_checks(spark):
    ledger = spark.createDataFrame([
        (1, 0, "gift", "soon", -1.0, "x", 0.0), (1, 1, "Sales Receipt", "", 0.0, None, 0.01), (1, 2, None, None, float("nan"), "2024-01-01", float("nan"))],
        "statement_id bigint, led_idx bigint, transaction_type string, invoice_date string, invoice_amount double, ledger_date string, ledger_amount double")
    got = [(r.led_idx, r.ord, r.error) for r in validate.ledger_errors(ledger).orderBy("led_idx", "ord").collect()]
    assert got == [(0, 0, TYPE), (0, 1, "Invoice Date is not a valid date"), (0, 2, "Invoice Amount must be a non-negative number"),
                   (0, 3, "Ledger Date must be a valid date"), (0, 4, "Ledger Amount must be a positive number"),
                   (2, 0, TYPE), (2, 2, "Invoice Amount must be a non-negative number"), (2, 4, "Ledger Amount must be a positive number")]
    coa = spark.createDataFrame([(1, 0, " ", None, ""), (1, 1, "a", "b", "c")], "statement_id bigint, coa_idx bigint, account_code string, account_name string, account_type string")
    assert [r.error for r in validate.coa_errors(coa).orderBy("ord").collect()] == ["Account Code is required", "Account Name is required", "Account Type is required"]


def test_days_are_added_on_the_calendar(spark):
    frame = spark.createDataFrame([("2024-02-28", 2), ("2023-12-31", 1), ("2024-03-10", -10), (None, 1), ("2024-02-31", 1), ("x", 1)], "d string, n int")
    assert [r[0] for r in frame.select(values.add_days(F.col("d"), F.col("n"))).collect()] == ["2024-03-01", "2024-01-01", "2024-02-29", None, None, None]
