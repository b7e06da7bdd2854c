from email.utils import parsedate_to_datetime

from pyspark.sql import functions as F

from tallyspark.functions import schedule, text, values
from tallyspark.operators import intake, mime, release
from tallyspark.rules import releases
from tallyspark.operators.accounts import match_by_account_name
from tallyspark.operators.store import neighbours


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_dates(spark):
    raw = ["2024-04-09", "9-4-2024", "09/04/24", "9-Apr-24", " 2024-04-09T10:00:00", "31-02-2024", "x", "", None, "32/01/2024", "9-Xyz-24"]
    got = one(spark, [(r,) for r in raw], "r string", values.iso_date(F.col("r")), values.sheet_date(F.col("r")))
    assert [g[0] for g in got] == ["2024-04-09"] * 5 + ["2024-02-31"] + [None] * 5
    assert [g[1] for g in got] == ["2024-04-09"] * 4 + [None] * 7


def test_money_rounds_halves_up(spark):
    raw = [("₹1,234.50", 123450), ("INR 10", 1000), ("$5", 500), ("", None), ("abc", None), ("-0.025", -2), ("₹", 0)]
    got = one(spark, raw, "r string, want bigint", values.cents_from_text(F.col("r")), "want")
    assert all(a == b for a, b in got)


def test_statement_dates(spark):
    got = one(spark, [("2024-05-04", "2024-04-01", "2024-04-30"), ("2024-06-20", "2024-04-01", "2024-04-30"), ("2024-04-10", "2024-04-01", "2024-04-30")],
              "d string, a string, b string", values.swap_into_period(F.col("d"), F.col("a"), F.col("b")))
    assert [g[0] for g in got] == ["2024-04-05", "2024-06-20", "2024-04-10"]


def test_name_scores(spark):
    rows = [("Bank A/c", "BANK-A.C", 1.0), ("ASHA RAO", "asha rao traders", 0.95), ("", "x", 0.0), ("kitten", "sitting", 1 - 3 / 7)]
    for got, want in one(spark, rows, "a string, b string, want double", text.name_similarity(F.col("a"), F.col("b")), "want"):
        assert abs(got - want) < 1e-12
    rows = [("IMPS-40-ASHA RAO S", "ASHA RAO", 1.0), ("CHQ VM PHARMACY", "V.M. PHARMACY", 0.95), ("PAID TO RAOTRADERS", "Asha Raotraders", 0.85), ("", "a", 0.0)]
    for got, want in one(spark, rows, "a string, b string, want double", text.narration_score(F.col("a"), F.col("b")), "want"):
        assert got == want


def test_references_and_names(spark):
    got = one(spark, [("0101", "Rao & Sons Pvt. Ltd"), ("RV-0101", "A/C Co")], "r string, n string",
              text.reference_key(F.col("r")), text.account_key(F.col("n")))
    assert got == [("101", "RAO SONS"), ("RV0101", "A C")]


def test_written_numbers(spark):
    got = one(spark, [(25000.0,), (12345678.5,), (0.05,), (1e7,), (0.0,)], "x double", text.shortest_float(F.col("x")), text.shortest_number(F.col("x")))
    assert got == [("25000.0", "25000"), ("12345678.5", "12345678.5"), ("0.05", "0.05"), ("10000000.0", "10000000"), ("0.0", "0")]


def test_years_wrap_and_gaps_do_not_reset(spark):
    cells = ["22-Nov", "6 Dec", "TBD", "3-Jan", "30-Feb", "7-Mar", "1-Mar"]
    columns = spark.createDataFrame([(1, i, c, c, None, None) for i, c in enumerate(cells)],
                                    "doc_id bigint, col_no bigint, raw_ship_date string, raw_delivery_date string, ship_date string, delivery_date string")
    heads = spark.createDataFrame([(1, "2026-08-03", None)], "doc_id bigint, release_date string, received_at string")
    got = [r.ship_date for r in schedule.derive_dates(columns, heads, 2024).orderBy("col_no").collect()]
    assert got == ["2026-11-22", "2026-12-06", None, "2027-01-03", None, "2027-03-07", "2028-03-01"]


def test_inline_headers(spark):
    rows = [([("Content-Disposition", "attachment"), ("Content-ID", "<a>")], False), ([("content-id", "<a>")], True),
            ([("Content-Disposition", "INLINE; x")], True), ([], False)]
    got = one(spark, rows, "h array<struct<name:string,value:string>>, want boolean", intake.is_inline(F.col("h")), "want")
    assert all(a == b for a, b in got)


def test_nested_mail_parts_keep_reading_order(spark):
    payload = ('{"parts":[{"parts":[{"parts":[{"filename":"deep.pdf","body":{"attachmentId":"1","size":5}}]},'
               '{"filename":"b.png","mimeType":"image/png","body":{"attachmentId":"2"}}]},{"filename":"c.txt","body":{"attachmentId":"3"}},'
               '{"filename":"no-id.pdf","body":{}}]}')
    got = mime.attachments(spark.createDataFrame([("m", payload), ("bad", "{"), ("none", "{}")], "message_id string, payload string"))
    assert [(r.filename, r.part_index, r.size_bytes) for r in got.orderBy("part_index").collect()] == [
        ("deep.pdf", 0, 5), ("b.png", 1, 0), ("c.txt", 2, 0)]


def test_mail_dates_are_read_as_the_standard_library_reads_them(spark):
    raw = ["Tue, 14 Oct 2025 09:31:00 +0530", "14 Oct 2025 09:31 GMT", "1 Feb 99 7:05:09 EST", "Sat, 29 Feb 2020 23:59:59 -0000", "31 Feb 2024 10:00:00 +0000",
           "not a date", "", "Mon, 5 May 2031 00:00:00 XYZ", "Mon 5 May 2031 1:02:03 -0815 (comment)", "5 May 68 10:00:00 PDT", "5 Foo 2031 10:00:00 +0000",
           "5 May 2031 25:00:00 +0000", "05-May-2031 10:11:12 +0100", None]

    def expected(text):
        try:
            return parsedate_to_datetime(text).isoformat() if text else None
        except (TypeError, ValueError):
            return None

    got = one(spark, [(r, expected(r)) for r in raw], "r string, want string", values.mail_date(F.col("r")), "want")
    assert all(a == b for a, b in got), got


def test_messages_give_their_headers_to_every_attachment(spark):
    part = '{"filename":"a.pdf","body":{"attachmentId":"1","size":"5"}}'
    for depth in range(10):
        part = f'{{"filename":"","headers":[{{"name":"Subject","value":"inner"}}],"parts":[{part},{{"filename":"d{depth}","body":{{"attachmentId":"x"}}}}]}}'
    payload = '{"headers":[{"name":"from"},{"name":"FROM","value":"later"},{"name":"subJECT","value":"S"},{"name":"Date","value":"x"}],"parts":[' + part + "]}"
    rows = [("m", "t", payload), ("n", None, '{"filename":"z","body":{"attachmentId":"9"}}'), ("o", "t", None)]
    got = mime.attachments(spark.createDataFrame(rows, "message_id string, thread_id string, payload string")).orderBy("message_id", "part_index").collect()
    assert [(r.filename, r.part_index) for r in got] == [("a.pdf", 0), *[(f"d{k}", k + 1) for k in range(10)], ("z", 0)]
    assert {(r.thread_id, r.from_address, r.subject, r.received_at) for r in got if r.message_id == "m"} == {("t", "", "S", "")}


def test_releases_of_any_width_stand_side_by_side(spark):
    columns = spark.createDataFrame([(d, c) for d, n in ((1, 3), (2, 40)) for c in range(1, n + 1)], "doc_id bigint, col_no bigint")
    parts = spark.createDataFrame([(1, 1, [1.0, 2.0]), (2, 1, [float(k) for k in range(45)]), (3, 1, [5.0]), (1, 2, None)], "doc_id bigint, part_no bigint, quantities array<double>")
    for name in ("po_number", "part_number", "description", "std_pack"):
        parts = parts.withColumn(name, F.lit(None).cast("string"))
    got = {(r.doc_id, r.part_no): r for r in release.wide_form(parts, columns, 12).collect()}
    cells = {k: [r[f"week_{j}"] for j in range(1, 41)] for k, r in got.items()}
    assert cells[(1, 1)] == [1.0, 2.0] + [None] * 38 and cells[(3, 1)] == cells[(1, 2)] == [None] * 40
    assert cells[(2, 1)] == [float(k) for k in range(40)] and got[(2, 1)].total == sum(range(45))


def test_account_name_choices_in_several_rounds(spark):
    """Seven ledger rows, two per round, must choose as one after the other would."""
    names = ["asha rao", "ravi menon", "asha rao", "ravi menon", "asha rao", "nobody else", "ravi menon"]
    texts = ["PAY RAVI MENON", "PAY ASHA RAO", "asha r", "ASHA RAO again", "RAVI menon", "ASHA-RAO"]
    leds = spark.createDataFrame([(1, i, "Sales Receipt", n) for i, n in enumerate(names)], "statement_id bigint, led_idx bigint, direction string, account_name string")
    banks = spark.createDataFrame([(1, i, "Sales Receipt", t) for i, t in enumerate(texts)], "statement_id bigint, bank_idx bigint, direction string, narration string")
    got = {r.led_idx: r.bank_idx for r in match_by_account_name(banks, leds, per_round=2).collect()}
    assert got == {0: 1, 1: 0, 2: 3, 3: 4, 4: 5}


def test_neighbours_cross_days(spark):
    docs = spark.createDataFrame([(i, f"2024-01-0{1 + i // 2}T10:00:00") for i in range(6)], "doc_id bigint, created_at string")
    got = {r.doc_id: (r.prev_id, r.next_id) for r in neighbours(docs).collect()}
    assert got == {5: (None, 4), 4: (5, 3), 3: (4, 2), 2: (3, 1), 1: (2, 0), 0: (1, None)}


def test_attachments_are_numbered_without_a_shuffle(spark):
    """Each message is read where it is, however deep its parts nest, and sizes and names of other types are read as text and number."""
    part = '{"filename":"in.pdf","body":{"attachmentId":7,"size":"9"}},{"filename":"","body":{"attachmentId":"x"}},{"filename":"no.pdf","body":"none"},3,null'
    for _ in range(12):
        part = f'{{"filename":"w","parts":[{part}]}}'
    payload = f'{{"filename":"root.txt","mimeType":"","body":{{"attachmentId":"r"}},"parts":[{part},{{"filename":"last","mimeType":"a/b","body":{{"attachmentId":"l","size":2.0}}}},"parts"]}}'
    messages = spark.createDataFrame([(f"m{k}", payload) for k in range(3)], "message_id string, payload string")
    got = mime.attachments(messages)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = [("root.txt", "r", "application/octet-stream", 0, 0), ("in.pdf", "7", "application/octet-stream", 9, 1), ("last", "l", "a/b", 2, 2)]
    rows = got.orderBy("message_id", "part_index").collect()
    assert [(r.filename, r.attachment_id, r.mime_type, r.size_bytes, r.part_index) for r in rows] == want * 3


def test_weeks_meet_parts_as_lists(spark):
    """Gaps, repeats and columns beyond a part's cells join by position as before; cells are unfolded after the join, not shuffled."""
    columns = spark.createDataFrame([(1, c, f"W{c}", None) for c in (1, 2, 2, 4, 9)] + [(2, 1, "only", "d")] + [(5, 1, "x", "d")],
                                    "doc_id bigint, col_no bigint, week_label string, delivery_date string")
    parts = spark.createDataFrame([(1, 1, "P", [1.0, 2.0, 3.0, None]), (1, 2, None, None), (1, 3, "Q", []), (2, 1, "R", [5.0, 6.0]), (3, 1, "S", [7.0])],
                                  "doc_id bigint, part_no bigint, part_number string, quantities array<double>")
    got = release.long_form(parts, columns)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline" in plan and "posexplode" not in plan
    assert sorted((r.doc_id, r.part_no, r.col_no, r.week_label, r.quantity) for r in got.collect() if r.quantity is not None) == [
        (1, 1, 1, "W1", 1.0), (1, 1, 2, "W2", 2.0), (1, 1, 2, "W2", 2.0), (2, 1, 1, "only", 5.0)]
    assert [(r.col_no, r.week_label) for r in got.collect() if r.quantity is None] == [(4, "W4")]


def test_offending_cells_of_a_release_are_named_in_one_gathering(spark):
    parts = spark.createDataFrame([
        (1, 12, "B", 5.0, [5.0, -10.0, None, 7.0], None), (1, 2, None, 4.0, [-6.0, 4.0, 8.0], "padded from 3 to 4"), (1, 3, "C", 0.0, [1.5, 2.5, 3.5, 0.0], None),
        (2, 1, "D", None, [1.0], None), (3, 1, "", 2.0, None, None)],
        "doc_id bigint, part_no bigint, part_number string, std_pack double, quantities array<double>, quantities_repaired string")
    widths = spark.createDataFrame([(1, 4)], "doc_id bigint, width bigint")
    facts = releases.part_facts(parts, widths)
    assert {r.doc_id: tuple(r)[1:] for r in facts.collect()} == {
        1: (3, "row 2 was padded from 3 to 4", "row 2 week 1, B week 2", "row 2 week 1, B week 4"),
        2: (1, "row 1 has 1 of 0", None, None), 3: (1, None, None, None)}
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1  # the three messages share one list of a document's offending rows
    assert "format_string" not in plan  # a formatter for each cell and row took most of the time
