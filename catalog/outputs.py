"""Queries of the scalar functions, exports, response recovery, mail parsing and streams."""

from pyspark.sql import functions as F

from catalog.store import REF_TABLES, REFS_SQL, ctes
from catalog.views import sql
from tallyspark.functions import json_text, text, values
from tallyspark.operators import mime
from tallyspark.plans import exports
from tallyspark.rules import extra
from tallyspark.session import cut, discard, run_path
from tallyspark.sources import documents as d
from tallyspark.sources import records as r
from tallyspark.sources import reports
from tallyspark.sources.records import Records
from tallyspark.streaming import intake as stream

QUERIES, ORACLE = {}, {}


def register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return keep


def block(view, entries):
    """SQL of a label/value block: (section, ord, label, value expression, condition)."""
    parts = [f"select doc_id, '{s}' as section, {o} as ord, '{label}' as label, coalesce({v}, '') as value from {view} where {c}"
             for s, o, label, v, c in entries]
    return " union all ".join(parts)


def entries(section, fields, numbers, first=1):
    return [(section, first + i, label, f"cast({c} as varchar)" if c in numbers else c, "true") for i, (label, c) in enumerate(fields)]


MONEY = {"subtotal", "cgst_total", "sgst_total", "igst_total", "total_tax", "round_off", "grand_total", "sales_tax", "freight", "discount",
         "opening_balance_bank", "opening_balance_book", "closing_balance_bank", "closing_balance_book", "reconciled_balance",
         "adjusted_bank_balance", "adjusted_book_balance"}


def titled(view, keys, fields):
    return f"select {', '.join(keys)}, " + ", ".join(f'{c} as "{title}"' for title, c in fields) + f" from {view}"


def party(label, prefix, first, have):
    out = []
    for i, part in enumerate(("name", "code", "address", "contact", "phone")):
        column = f"{prefix}_{part}"
        if part in ("code", "phone"):
            if column in have:
                out.append((label, first + i, f"{label} {part.title()}", column, f"{column} is not null"))
        else:
            out.append((label, first + i, f"{label} {part.title()}", column if column in have else "''", "true"))
    return out


@register("export_invoice_header", ctes(h=d.INVOICES) + block("h", entries("Invoice Header", exports.INVOICE_HEADER, MONEY)))
def export_invoice_header(spark, folder):
    return exports.invoice_header(Records(spark, folder).invoices())


@register("export_invoice_lines", ctes(l=d.INVOICE_LINES) + titled("l", ["doc_id", "line_no"], exports.INVOICE_LINES))
def export_invoice_lines(spark, folder):
    return exports.invoice_lines(Records(spark, folder).invoice_lines())


ORDER_HAVE = {"vendor_name", "vendor_code", "buyer_name", "bill_to_name", "ship_to_name", "ship_to_address"}


@register("export_order_header", ctes(h=d.ORDERS) + block("h", entries("Purchase Order", exports.ORDER_HEADER, MONEY) + [
    e for i, (label, prefix) in enumerate(exports.ORDER_PARTIES) for e in party(label, prefix, 20 + 10 * i, ORDER_HAVE)]
    + entries("Totals", exports.ORDER_TOTALS, MONEY, 60)))
def export_order_header(spark, folder):
    return exports.order_header(Records(spark, folder).orders())


@register("export_order_lines", ctes(l=d.ORDER_LINES) + titled("l", ["doc_id", "line_no"], [(t.replace('"', ''), c) for t, c in exports.ORDER_LINES]))
def export_order_lines(spark, folder):
    return exports.order_lines(Records(spark, folder).order_lines())


@register("export_release_header", ctes(h=d.RELEASES) + block("h", entries("Shipping Authorization", exports.RELEASE_HEADER, MONEY) + [
    e for i, (label, prefix) in enumerate(exports.RELEASE_PARTIES) for e in party(label, prefix, 20 + 10 * i, {"supplier_name", "supplier_code"})]))
def export_release_header(spark, folder):
    return exports.release_header(Records(spark, folder).releases())


@register("export_notes", "select doc_id, pos as ord, note from (select doc_id, unnest(n) as note, generate_subscripts(n, 1) as pos "
          "from (select doc_id, string_split(text, chr(10)) as n from documents))")
def export_notes(spark, folder):
    docs = Records(spark, folder).raw("documents").select("doc_id", F.split("text", "\n").alias("terms_notes"))
    return exports.notes(docs, "terms_notes")


@register("export_statement_header", ctes(h=d.STATEMENTS) + block("h", entries("BRS Header", exports.STATEMENT_HEADER, MONEY)))
def export_statement_header(spark, folder):
    return exports.statement_header(Records(spark, folder).statements())


@register("export_statement_items", ctes(l=d.STATEMENT_ITEMS) + titled("l", ["doc_id", "side", "item_no"], exports.STATEMENT_ITEMS))
def export_statement_items(spark, folder):
    return exports.statement_items(Records(spark, folder).statement_items())


def written_and_read(spark, table, write, read):
    path = run_path(spark, "written")
    write(table, path)
    return read(path)


#: The reports of one run: how each is made, the columns that order its rows, and its format.
RUN = {
    "invoice_header": ("export_invoice_header", ["doc_id", "section", "ord"], reports.CSV),
    "invoice_lines": ("export_invoice_lines", ["doc_id", "line_no"], reports.CSV),
    "order_header": ("export_order_header", ["doc_id", "section", "ord"], reports.JSON),
    "order_lines": ("export_order_lines", ["doc_id", "line_no"], reports.CSV),
    "release_header": ("export_release_header", ["doc_id", "section", "ord"], reports.CSV),
    "release_schedule": ("export_schedule_sheet", ["doc_id", "line_no"], reports.CSV),
    "notes": ("export_notes", ["doc_id", "ord"], reports.JSON),
    "statement_header": ("export_statement_header", ["doc_id", "section", "ord"], reports.CSV),
    "statement_items": ("export_statement_items", ["doc_id", "side", "item_no"], reports.CSV),
    "stamped_json": ("export_stamped_json", ["doc_id"], reports.JSON),
    "reconciliation": ("reconciliation_report", ["statement_id", "bank_idx"], reports.CSV),
}


def _written_run(names):
    """Write reports as one run, read them back, and count rows that went missing or changed on the way.

    One report is made at a time, and its table goes once it is written; its marks stay for the comparison.
    """
    def query(spark, folder):
        import catalog
        marks = {}

        def table(name):
            return catalog.queries()[RUN[name][0]](spark, folder)

        def made():
            for name in names:
                _, order, kind = RUN[name]
                kept = cut(table(name))
                marks[name] = cut(reports.marks(reports.as_read(kept, kind)))
                yield name, reports.Report(kept, order, kind)
                discard(kept)

        root = run_path(spark, "reports")
        reports.write_run(spark, root, "run-1", made(), file_rows=20_000, compression="gzip")
        rows = []
        for name in names:
            back = reports.read_report(spark, root, "run-1", name)
            rows.append((name, *reports.compare(reports.as_read(table(name), RUN[name][2]), marks[name], back)))
        return spark.createDataFrame(rows, "report string, n_rows long, n_missing long, n_changed long")

    return query


DOCUMENT_REPORTS = [name for name in RUN if name != "reconciliation"]
QUERIES["reports_written"] = _written_run(DOCUMENT_REPORTS)
QUERIES["reconciliation_written"] = _written_run(["reconciliation"])


def late_oracle(every):
    """SQL of the written runs: the rows of each report's own SQL, none of them missing or changed."""
    def counted(names):
        return " union all ".join(
            f"select '{name}' as report, (select count(*) from ({every[RUN[name][0]]}) t) as n_rows, 0 as n_missing, 0 as n_changed" for name in names)

    return {"reports_written": counted(DOCUMENT_REPORTS), "reconciliation_written": counted(["reconciliation"])}


WRITTEN = "select c_custkey as k, case when c_custkey % 3 <> 0 then 'a, \"b\" ' || c_custkey end as note, case when c_custkey % 5 <> 0 then c_acctbal end as amount"


@register("report_csv", WRITTEN + " from customer")
def report_csv(spark, folder):
    """A report written as CSV and read back: missing values are empty cells, and quotes and commas survive."""
    table = spark.read.parquet(f"{folder}/customer.parquet").selectExpr(
        "c_custkey as k", "case when c_custkey % 3 <> 0 then 'a, \"b\" ' || c_custkey end as note", "case when c_custkey % 5 <> 0 then c_acctbal end as amount")
    read = spark.read.schema(table.schema).option("header", True).option("escape", '"').csv
    return written_and_read(spark, table, exports.write_csv, read)


@register("report_json", WRITTEN + " from customer")
def report_json(spark, folder):
    """The same as JSON lines, nulls written out."""
    table = spark.read.parquet(f"{folder}/customer.parquet").selectExpr(
        "c_custkey as k", "case when c_custkey % 3 <> 0 then 'a, \"b\" ' || c_custkey end as note", "case when c_custkey % 5 <> 0 then c_acctbal end as amount")
    return written_and_read(spark, table, exports.write_json, spark.read.schema(table.schema).json)


PAYLOADS = """select o_orderkey as doc_id, case when o_orderkey % 3 = 0 then '{{"invoice":{{"document_type":" sa "}},"confidence":{{}}}}'
  when o_orderkey % 3 = 1 then '{{"invoice":{{"order_number":"A"}}}}' else '{{}}' end as corrected_json,
  case when o_orderkey % 2 = 0 then 'USA' end as country, case when o_orderkey % 5 <> 0 then 'SO' end as doc_type from {orders}"""


@register("export_stamped_json", ctes(x=PAYLOADS) + """select doc_id, k as document_type, case when k = 'SA' then 'release' else 'order' end as basename,
  case when doc_id % 3 = 0 then '{"invoice":{"document_type":" sa "},"confidence":{},' when doc_id % 3 = 1 then '{"invoice":{"order_number":"A"},' else '{' end ||
  '"country":"USA","document_type":' || coalesce('"' || k || '"', 'null') || '}' as json
from (select *, case when doc_id % 3 = 0 then 'SA' else doc_type end as k from x)""")
def export_stamped_json(spark, folder):
    return exports.stamped_json(Records(spark, folder).records(PAYLOADS, "orders"))


# ---- scalar functions over whole tables ------------------------------------
RAW_DATES = """select o_orderkey as k, case o_orderkey % 9 when 0 then cast(cast(o_orderdate as date) as string) when 1 then '7-8-1998' when 2 then ' 07/08/98 '
  when 3 then '7-Aug-98' when 4 then '7-aug-1998' when 5 then '31-02-1998' when 6 then '32/01/1998' when 7 then 'soon' end as raw from {orders}"""


@register("normalised_dates", ctes(x=RAW_DATES) + """select k, raw, case k % 9 when 0 then raw when 2 then '2098-08-07' when 3 then '2098-08-07' when 5 then '1998-02-31' when 6 then null when 7 then null
  when 8 then null else '1998-08-07' end as iso, case k % 9 when 0 then raw when 5 then null when 6 then null when 7 then null when 8 then null else '1998-08-07' end as sheet,
  case k % 9 when 1 then '1998-08-07' when 2 then '1998-08-07' when 8 then null else trim(raw) end as statement,
  abs(datediff('day', try_cast(case when k % 9 = 0 then raw when k % 9 in (2, 3) then '2098-08-07' when k % 9 in (1, 4) then '1998-08-07' end as date), date '1998-01-01')) as days from x""")
def normalised_dates(spark, folder):
    raw = F.col("raw")
    rows = Records(spark, folder).records(RAW_DATES, "orders").withColumn("iso", values.iso_date(raw))
    return rows.withColumns({"sheet": values.sheet_date(raw), "statement": values.statement_date(raw),
                             "days": values.days_between(F.col("iso"), F.lit("1998-01-01")).cast("bigint")})


@register("normalised_money", """select o_orderkey as k, case o_orderkey % 5 when 0 then cast(floor(o_totalprice*100+0.5) as bigint) when 1 then 123450 when 2 then 500
  when 3 then case o_orderkey % 25 when 18 then 1600 when 23 then 100000 end when 4 then -2 end as cents,
  case o_orderkey % 5 when 0 then o_totalprice when 1 then 1234.5 when 3 then case o_orderkey % 25 when 23 then 1000.0 end when 4 then -0.025 end as sheet from orders""")
def normalised_money(spark, folder):
    k = F.col("o_orderkey") % 5
    raw = (F.when(k == 0, text.shortest_float(F.col("o_totalprice"))).when(k == 1, "INR 1,234.50").when(k == 2, "$5")
           .when(k == 3, F.element_at(F.array(*map(F.lit, ("none", "1200D", "12f", "0x10", "1e3"))), F.floor(F.col("o_orderkey") % 25 / 5).cast("int") + 1))
           .otherwise("-0.025"))
    return Records(spark, folder).raw("orders").select(
        F.col("o_orderkey").alias("k"), values.cents_from_text(raw).alias("cents"), values.sheet_amount(raw).alias("sheet"))


@register("normalised_names", r"""select c_custkey, lower(trim(c_name)) as plain, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') as alnum,
  regexp_replace(c_name, '[^0-9]', '', 'g') as digits,
  array_to_string(list_filter(string_split_regex(lower(c_name || ' of ' || c_mktsegment), '[^a-z0-9]+'), lambda w: length(w) >= 4), '|') as tokens,
  upper(regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g')) as reference, regexp_replace(regexp_replace(c_name, '[^0-9]', '', 'g'), '^0+(?=[0-9])', '') as number_reference,
  'CUSTOMER ' || regexp_extract(c_name, '[0-9]+') || ' ' || c_mktsegment as account_key from customer""".replace(
    "regexp_replace(regexp_replace(c_name, '[^0-9]', '', 'g'), '^0+(?=[0-9])', '')", "cast(cast(regexp_replace(c_name, '[^0-9]', '', 'g') as bigint) as varchar)"))
def normalised_names(spark, folder):
    name = F.col("c_name")
    return Records(spark, folder).raw("customer").select(
        "c_custkey", text.plain_text(name).alias("plain"), text.alnum(name).alias("alnum"), text.digits(name).alias("digits"),
        F.array_join(text.tokens(F.concat(name, F.lit(" of "), "c_mktsegment")), "|").alias("tokens"),
        text.reference_key(name).alias("reference"), text.reference_key(text.digits(name)).alias("number_reference"),
        text.account_key(F.concat(name, F.lit(" Pvt. Ltd - "), "c_mktsegment", F.lit(" Co"))).alias("account_key"))


@register("bank_directions", sql("""select statement_id, bank_idx, direction, cents, cast(cents as double) / 100 as amount from bk"""))
def bank_directions(spark, folder):
    from tallyspark.operators.prepare import bank_keys
    return bank_keys(Records(spark, folder).bank()).select("statement_id", "bank_idx", "direction", "cents", values.amount(F.col("cents")).alias("amount"))


@register("ledger_anchors", sql("""select statement_id, led_idx, anchor_date, anchor_amount, anchor_date is not null and anchor_amount is not null as has_anchor from lk"""))
def ledger_anchors(spark, folder):
    from tallyspark.operators.prepare import with_anchor
    return with_anchor(Records(spark, folder).ledger()).select("statement_id", "led_idx", "anchor_date", "anchor_amount", "has_anchor")


@register("bank_or_cash_accounts", sql("select statement_id, coa_idx from coa where account_type in ('Bank Account', 'Cash-in-Hand')"))
def bank_or_cash_accounts(spark, folder):
    return Records(spark, folder).coa().filter(text.is_bank_or_cash(F.col("account_type"))).select("statement_id", "coa_idx")


@register("utc_timestamps", """select event_id, strftime(case event_id % 3 when 1 then date_trunc('second', ts) - interval 2 hour when 2 then date_trunc('second', ts) else date_trunc('second', ts) end,
  '%Y-%m-%d %H:%M:%S') as utc from events""")
def utc_timestamps(spark, folder):
    stamp = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("event_id") % 3 == 1, F.concat(stamp, F.lit("+02:00"))).when(F.col("event_id") % 3 == 2, F.concat(stamp, F.lit("Z"))).otherwise(stamp)
    return Records(spark, folder).raw("events").select("event_id", F.date_format(values.utc_timestamp(raw), "yyyy-MM-dd HH:mm:ss").alias("utc"))


# ---- optional document checks ----------------------------------------------
REL = dict(rp=d.RELEASE_PARTS, rc=d.RELEASE_COLUMNS)


@register("empty_release_schedules", ctes(**REL) + "select doc_id from rp group by 1 having not bool_or(" + " or ".join(f"q{j} <> 0" for j in range(12)) + " or n_given > 12)")
def empty_release_schedules(spark, folder):
    return extra.empty_schedules(Records(spark, folder).release_parts())


@register("unordered_release_weeks", ctes(**REL) + "select doc_id, col_no, 'W' || ((col_no * 7) % 12 + 1) as week_label from rc where col_no > 1 and (col_no * 7) % 12 < ((col_no - 1) * 7) % 12")
def unordered_release_weeks(spark, folder):
    shuffled = Records(spark, folder).release_columns().withColumn("week_label", F.concat(F.lit("W"), ((F.col("col_no") * 7) % 12 + 1).cast("string")))
    return extra.unordered_weeks(shuffled)


@register("repeated_order_parties", ctes(h=d.ORDERS) + """select doc_id, 'vendor_name' as party, 'bill_to_name' as repeats from h where vendor_name = bill_to_name
  union all select doc_id, 'vendor_name', 'ship_to_name' from h where vendor_name = ship_to_name
  union all select doc_id, 'bill_to_name', 'ship_to_name' from h where bill_to_name = ship_to_name""")
def repeated_order_parties(spark, folder):
    return extra.repeated_parties(Records(spark, folder).orders())


# ---- responses and mail -----------------------------------------------------
def responses(spark, folder):
    body = F.to_json(F.struct(F.col("conv_id"), F.col("turn"), F.col("text")))
    return Records(spark, folder).raw("conversations").select("conv_id", "turn", (
        F.when(F.col("conv_id") % 4 == 0, body).when(F.col("conv_id") % 4 == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone")))
        .when(F.col("conv_id") % 4 == 2, F.concat(F.lit("The answer is "), body, F.lit(" as asked."))).otherwise(F.concat("text", F.lit("{broken")))).alias("answer"))


@register("responses_recovered", """select conv_id, turn, case when conv_id % 4 <> 3 then conv_id end as found_conv, case when conv_id % 4 <> 3 then length(text) end as found_length
  from conversations""")
def responses_recovered(spark, folder):
    found = responses(spark, folder).withColumn("v", json_text.recovered(F.col("answer")))
    return found.select("conv_id", "turn", F.try_variant_get("v", "$.conv_id", "bigint").alias("found_conv"),
                        F.length(F.try_variant_get("v", "$.text", "string")).cast("bigint").alias("found_length"))


@register("response_texts", """select conv_id, turn, case conv_id % 4 when 0 then text when 1 then text when 2 then text else '' end as said from conversations""")
def response_texts(spark, folder):
    t, k = F.col("text"), F.col("conv_id") % 4
    empty = F.struct(F.lit("").alias("content"))
    spoken = F.to_json(F.struct(F.array(F.struct(F.lit("earlier").alias("content")), F.struct(t.alias("content")), empty).alias("messages")))
    listed = F.to_json(F.struct(F.array(F.struct(F.array(
        F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), t.alias("text"))).alias("content"))).alias("messages")))
    envelope = F.when(k == 0, F.to_json(F.struct("text"))).when(k == 1, spoken).when(k == 2, listed).otherwise('{"messages":[]}')
    return Records(spark, folder).raw("conversations").select("conv_id", "turn", json_text.answer_text(envelope).alias("said"))


ENVELOPES = """select o_orderkey as k, case o_orderkey % 5 when 0 then '{{"invoice":{{"a":' || cast(o_orderkey as string) || ',"document_type":"SA"}},"confidence":{{}}}}'
  when 1 then '{{"document":5,"so":{{"a":' || cast(o_orderkey as string) || '}}}}' when 2 then '{{"a":' || cast(o_orderkey as string) || ',"metadata":{{}},"confidence":{{}}}}'
  when 3 then '{{"us_document":{{"a":' || cast(o_orderkey as string) || '}},"sa":{{"a":-1}}}}' else '{{}}' end as payload from {orders}"""


@register("payload_envelopes", """select o_orderkey as k, case when o_orderkey % 5 <> 4 then o_orderkey end as a, case o_orderkey % 5 when 0 then 'SA' else 'SO' end as document_type,
  case o_orderkey % 5 when 0 then 2 when 4 then 0 else 1 end as n_fields from orders""")
def payload_envelopes(spark, folder):
    rows = Records(spark, folder).records(ENVELOPES, "orders").withColumn("doc", json_text.envelope_document(F.col("payload")))
    return rows.select("k", F.try_variant_get(F.try_element_at("doc", F.lit("a")), "$", "bigint").alias("a"),
                       json_text.document_type(F.col("doc"), F.lit("SO")).alias("document_type"), F.size("doc").alias("n_fields"))


#: Parts nested one to ten levels deep, and headers in several spellings.
MAIL = """select 'm' || cast(event_id as string) as message_id, 't' || cast(event_id div 3 as string) as thread_id,
  '{{"mimeType":"multipart/mixed",' || case when event_id % 7 <> 6 then '"headers":[{{"name":"FROM","value":"u' || cast(event_id % 50 as string)
  || '@x.example"}},{{"name":"Subject","value":"Bill ' || cast(event_id as string) || '"}},{{"name":"Date","value":"'
  || case event_id % 7 when 0 then 'Tue, 14 Oct 2025 09:31:00 +0530' when 1 then '1 Feb 99 7:05 EST' when 2 then 'not a date' when 3 then '31 Feb 2024 10:00:00 +0000'
     when 4 then 'Sat, 29 Feb 2020 23:59:59 -0000 (x)' else '14 Oct 2025 09:31:00 GMT' end || '"}}],' else '' end
  || '"parts":[' || repeat('{{"mimeType":"multipart/related","filename":"","parts":[', cast(event_id % 10 as int))
  || '{{"mimeType":"text/html","filename":"","body":{{"size":10}}}},{{"mimeType":"image/png","filename":"logo.png","headers":[{{"name":"Content-ID","value":"<x>"}}],"body":{{"attachmentId":"A'
  || cast(event_id as string) || '","size":4000}}}}' || repeat(']}}', cast(event_id % 10 as int))
  || ',{{"filename":"inv.pdf","headers":[{{"name":"Content-Disposition","value":"ATTACHMENT; x"}},{{"name":"Content-ID","value":"<f>"}}],"body":{{'
  || case when event_id % 3 <> 0 then '"attachmentId":"B' || cast(event_id as string) || '",' else '' end || '"size":' || cast(event_id as string) || '}}}},{{"mimeType":"text/plain","filename":"n.txt","body":{{"attachmentId":"C","size":0}}}}]}}' as payload
from {events}"""

MESSAGE = """'m' || event_id as message_id, 't' || event_id // 3 as thread_id, case when event_id % 7 <> 6 then 'u' || event_id % 50 || '@x.example' else '' end as from_address,
  case when event_id % 7 <> 6 then 'Bill ' || event_id else '' end as subject, case event_id % 7 when 0 then '2025-10-14T09:31:00+05:30' when 1 then '1999-02-01T07:05:00-05:00'
  when 4 then '2020-02-29T23:59:59' when 5 then '2025-10-14T09:31:00+00:00' else '' end as received_at"""


@register("mail_attachments", f"""select {MESSAGE}, 'logo.png' as filename, 'A' || event_id as attachment_id, 'image/png' as mime_type, 4000 as size_bytes, true as is_inline, 0 as part_index from events
union all select {MESSAGE}, 'inv.pdf', 'B' || event_id, 'application/octet-stream', event_id, false, 1 from events where event_id % 3 <> 0
union all select {MESSAGE}, 'n.txt', 'C', 'text/plain', 0, false, case when event_id % 3 <> 0 then 2 else 1 end from events""")
def mail_attachments(spark, folder):
    return mime.attachments(spark.sql(MAIL, events=Records(spark, folder).spread("events", "event_id")))


# ---- streams ----------------------------------------------------------------
def arriving(spark, folder, name, order, files=4):
    """A stream over a table that arrives in several files, one micro-batch each, in the order of a column."""
    table, source = spark.read.parquet(f"{folder}/{name}.parquet"), run_path(spark, "arriving")
    low, high = table.agg(F.min(order), F.max(order)).first()
    step = (high - low) // files + 1 if low is not None else 1
    for k in range(files):
        part = table.filter(F.floor((F.col(order) - F.lit(low)) / F.lit(step)) == k)
        part.coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source)


@register("intake_stream", ctes(**REF_TABLES) + "," + REFS_SQL + "select connection_id, ord, source_ref, action from planned")
def intake_stream(spark, folder):
    t = Records(spark, folder)
    refs = spark.sql(r.REFS, events=arriving(spark, folder, "events", "event_id"))
    work = run_path(spark, "intake")
    known = stream.known_documents(spark, f"{work}/known")
    stream.start(refs, t.records(r.INGESTED, "events"), f"{work}/items", f"{work}/checkpoint", known).awaitTermination()
    return stream.item_log(spark, f"{work}/items").select("connection_id", "ord", "source_ref", "action")


@register("document_state_stream", ctes(x=r.LOG) + "select document_id, step, status, id from x qualify row_number() over (partition by document_id order by created_at desc, id desc) = 1")
def document_state_stream(spark, folder):
    log = spark.sql(r.LOG, events=arriving(spark, folder, "events", "event_id"))
    work = run_path(spark, "state")
    states = stream.state_table(log, f"{work}/table")
    stream.track(log, states, f"{work}/checkpoint").awaitTermination()
    return states.read().select("document_id", "step", "status", "id")
