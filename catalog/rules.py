"""Queries of the rule sets over derived documents."""

from pyspark.sql import functions as F

from tallyspark.functions import schedule
from tallyspark.operators import release
from tallyspark.plans import exports
from tallyspark.rules import india, orders, registry, releases, statements
from tallyspark.sources import documents as d
from tallyspark.sources.documents import Documents

QUERIES, ORACLE = {}, {}
DEFAULT_YEAR = 2024
NAMES = dict(orders="orders", lineitem="lineitem", customer="customer")


def ctes(**parts):
    return "with " + ",\n".join(f"{name} as ({text})" for name, text in parts.items()) + "\n"


INV = dict(h=d.INVOICES.format(**NAMES), l=d.INVOICE_LINES.format(**NAMES))
ORD = dict(h=d.ORDERS.format(**NAMES), l=d.ORDER_LINES.format(**NAMES))
BRS = dict(h=d.STATEMENTS.format(**NAMES), i=d.STATEMENT_ITEMS.format(**NAMES))


def india_checks(spark, folder):
    t = Documents(spark, folder)
    return india.run(t.invoices(), t.invoice_lines())


QUERIES["india_invoice_rules"] = india_checks
INDIA_SQL = """
docs as (select h.*, coalesce(n, 0) as n, coalesce(round_off, 0.0) as ro, coalesce(cgst_total, 0.0) as cg,
    coalesce(sgst_total, 0.0) as sg, coalesce(igst_total, 0.0) as ig
  from h left join (select doc_id, count(*) as n from l group by 1) c using (doc_id)),
codes as (
  select doc_id, 3 as section, 'vendor_gstin_format' as rule, 'Vendor GSTIN' as label, vendor_gstin as v, 'vendor.gstin' as field,
    '^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$' as pattern from docs
  union all select doc_id, 4, 'customer_gstin_format', 'Customer GSTIN', customer_gstin, 'customer.gstin',
    '^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$' from docs
  union all select doc_id, 10, 'ifsc_format', 'IFSC', ifsc, 'bank_details.ifsc', '^[A-Z]{4}0[A-Z0-9]{6}$' from docs),
checks as (
  select doc_id, 1 as section, 0 as item, 'invoice_number_present' as rule, coalesce(invoice_number, '') <> '' as passed,
    case when coalesce(invoice_number, '') <> '' then 'Invoice number is present' else 'Invoice number is missing' end as message,
    'invoice_number' as field from docs
  union all select doc_id, 2, 0, 'invoice_date_valid', coalesce(regexp_full_match(invoice_date, '\\d{4}-\\d{2}-\\d{2}'), false),
    case when coalesce(invoice_date, '') = '' then 'Invoice date is missing'
         when regexp_full_match(invoice_date, '\\d{4}-\\d{2}-\\d{2}') then 'Invoice date format is valid'
         else 'Invoice date ''' || invoice_date || ''' is not in YYYY-MM-DD format' end, 'invoice_date' from docs
  union all select doc_id, section, 0, rule, regexp_full_match(upper(trim(v)), pattern),
    label || ' ''' || v || ''' is ' || case when regexp_full_match(upper(trim(v)), pattern) then 'valid' else 'invalid' end, field
    from codes where coalesce(v, '') <> ''
  union all select doc_id, 5, 0, 'line_items_present', n > 0,
    case when n > 0 then n || ' line item(s) found' else 'No line items found' end, 'line_items' from docs
  union all select doc_id, 6, line_no, 'line_item_' || line_no || '_taxable_value', false,
    'Line ' || line_no || ': qty×unit_price=' || printf('%.2f', quantity*unit_price) || ' ≠ taxable_value=' || printf('%.2f', taxable_value),
    'line_items[' || (line_no - 1) || '].taxable_value'
    from l where abs(quantity*unit_price - taxable_value) > 0.05e0*greatest(abs(taxable_value), 1.0e0)
  union all select doc_id, 7, 0, 'total_math_check', abs(subtotal + total_tax + ro - grand_total) <= 0.05e0,
    'subtotal(' || cast(subtotal as varchar) || ') + tax(' || cast(total_tax as varchar) || ') + round_off(' || cast(cast(ro as double) as varchar)
      || ') = ' || printf('%.2f', subtotal + total_tax + ro) || ', grand_total = ' || printf('%.2f', grand_total) || ', diff = '
      || printf('%.4f', abs(subtotal + total_tax + ro - grand_total)), 'tax_summary'
    from docs where subtotal is not null and total_tax is not null and grand_total is not null
  union all select doc_id, 8, 0, 'tax_components_sum', abs(cg + sg + ig - total_tax) <= 0.05e0,
    'CGST(' || cast(cast(cg as double) as varchar) || ') + SGST(' || cast(cast(sg as double) as varchar) || ') + IGST('
      || cast(cast(ig as double) as varchar) || ') = ' || printf('%.2f', cg + sg + ig) || ', total_tax = ' || printf('%.2f', total_tax),
    'tax_summary.total_tax' from docs where total_tax is not null
  union all select doc_id, 9, 0, 'cgst_igst_mutually_exclusive', false,
    'Both CGST and IGST are non-zero — only one should apply per invoice', 'tax_summary' from docs where cg > 0 and ig > 0)
"""
ORACLE["india_invoice_rules"] = ctes(**INV) + "," + INDIA_SQL + "select * from checks"


def invoice_statuses(spark, folder):
    t = Documents(spark, folder)
    model = t.raw("labels").select("doc_id", F.when(F.col("toxic") == 1, "FAIL").when(
        F.col("quality") == 1, "PASS").otherwise("UNCERTAIN").alias("result"))
    return registry.statuses(registry.stamped(india_checks(spark, folder), registry.INDIA), model)


QUERIES["invoice_statuses"] = invoice_statuses
ORACLE["invoice_statuses"] = ctes(**INV) + "," + INDIA_SQL + """
select doc_id, 'india_invoice' as ruleset, case when fatal then 'INVALID' when failed or coalesce(flagged, false) then 'NEEDS_REVIEW'
  else 'VALID' end as status
from (select doc_id, bool_or(not passed and rule in ('invoice_number_present', 'invoice_date_valid', 'total_math_check',
        'vendor_gstin_format', 'customer_gstin_format', 'cgst_igst_mutually_exclusive')) as fatal, bool_or(not passed) as failed
      from checks group by 1) c
left join (select doc_id, bool_or(toxic = 1) as flagged from labels group by 1) f using (doc_id)"""


def invoice_messages(spark, folder):
    t = Documents(spark, folder)
    warnings = t.raw("labels").filter("quality = 0").select(
        "doc_id", F.lit(0).alias("ord"), F.lit("Low extraction quality").alias("message"))
    return registry.messages(registry.stamped(india_checks(spark, folder), registry.INDIA), warnings)


QUERIES["invoice_messages"] = invoice_messages
ORACLE["invoice_messages"] = ctes(**INV) + "," + INDIA_SQL + """
select doc_id, case when rule in ('invoice_number_present', 'invoice_date_valid', 'total_math_check') then 'error' else 'warning' end as kind,
  section, item, message from checks where not passed
union all select doc_id, 'warning', 1000, 0, 'Low extraction quality' from labels where quality = 0"""


def order_checks(spark, folder):
    t = Documents(spark, folder)
    return orders.run(t.orders(), t.order_lines())


QUERIES["purchase_order_rules"] = order_checks
TOL = "greatest(0.05e0, abs({e})*0.001e0)"
ORDER_SQL = """
docs as (select h.*, coalesce(n, 0) as n,
    coalesce(subtotal, line_sum, 0.0e0) + coalesce(sales_tax, 0.0e0) + coalesce(freight, 0.0e0) - coalesce(discount, 0.0e0) as e,
    regexp_full_match(order_date, '\\d{4}-\\d{2}-\\d{2}') and try_cast(order_date as date) is not null as real_date
  from h left join (select doc_id, count(*) as n, cast(sum(cast(extended_cost as decimal(38,6))) as double) as line_sum
                    from l group by 1) c using (doc_id)),
checks as (
  select doc_id, 1 as section, 0 as item, 'so_order_number_present' as rule, order_number is not null as passed,
    coalesce('PO number ' || order_number, 'No PO number was found') as message, 'order_number' as field from docs
  union all select doc_id, 2, 0, 'so_order_date_valid', coalesce(real_date, false),
    case when order_date is null then 'No order date was found' when real_date then 'Order date ' || order_date
         else 'Order date ''' || order_date || ''' is not a valid YYYY-MM-DD date' end, 'order_date' from docs
  union all select doc_id, 3, 0, 'so_ship_to_present', coalesce(ship_to_name, ship_to_address) is not null,
    case when coalesce(ship_to_name, ship_to_address) is not null then 'Ship-to address present' else 'No ship-to address was found' end,
    'ship_to.address' from docs
  union all select doc_id, 4, 0, 'so_line_items_present', n > 0,
    case when n > 0 then n || ' line item(s) found' else 'No line items were extracted' end, 'line_items' from docs
  union all select doc_id, 5, line_no*2, 'so_line_' || line_no || '_quantity', coalesce(quantity > 0, false),
    case when quantity > 0 then 'Line ' || line_no || ' quantity ' || cast(quantity as varchar)
         else 'Line ' || line_no || ' has no positive quantity' end, 'line_items.' || (line_no-1) || '.quantity' from l
  union all select doc_id, 5, line_no*2+1, 'so_line_' || line_no || '_extended_cost',
    abs(quantity*unit_cost - extended_cost) <= greatest(0.05e0, abs(quantity*unit_cost)*0.001e0),
    'Line ' || line_no || ': ' || cast(quantity as varchar) || ' x ' || cast(unit_cost as varchar) || ' = ' ||
      case when abs(quantity*unit_cost - extended_cost) <= greatest(0.05e0, abs(quantity*unit_cost)*0.001e0) then cast(extended_cost as varchar)
      else cast(round(quantity*unit_cost, 2) as varchar) || ', but the extended cost reads ' || cast(extended_cost as varchar) end,
    'line_items.' || (line_no-1) || '.extended_cost' from l
    where quantity is not null and unit_cost is not null and extended_cost is not null
  union all select doc_id, 6, 0, 'so_totals_math_check', abs(e - grand_total) <= greatest(0.05e0, abs(e)*0.001e0),
    case when abs(e - grand_total) <= greatest(0.05e0, abs(e)*0.001e0) then 'Totals add up to ' || cast(grand_total as varchar)
    else 'Subtotal plus tax and freight less discount is ' || cast(round(e, 2) as varchar) || ', but the grand total reads '
      || cast(grand_total as varchar) end, 'totals.grand_total' from docs where grand_total is not null)
"""
ORACLE["purchase_order_rules"] = ctes(**ORD) + "," + ORDER_SQL + "select * from checks"


def order_statuses(spark, folder):
    t = Documents(spark, folder)
    kind = F.when(F.col("doc_id") % 10 == 0, "UNKNOWN").otherwise("SO")
    which = registry.ruleset_name(F.lit("USA"), kind)
    return registry.statuses(order_checks(spark, folder).withColumn("ruleset", which))


QUERIES["order_statuses"] = order_statuses
ORACLE["order_statuses"] = ctes(**ORD) + "," + ORDER_SQL + """
select doc_id, case when doc_id % 10 = 0 then 'us_unclassified' else 'us_purchase_order' end as ruleset,
  case when doc_id % 10 <> 0 and bool_or(not passed and rule in ('so_order_number_present', 'so_order_date_valid',
    'so_line_items_present', 'so_totals_math_check')) then 'INVALID' when bool_or(not passed) then 'NEEDS_REVIEW' else 'VALID' end as status
from checks group by 1"""


def ruleset_of(spark, folder):
    t = Documents(spark, folder)
    country = F.when(F.col("o_orderkey") % 3 == 0, "usa").when(F.col("o_orderkey") % 3 == 1, "INDIA")
    kind = F.when(F.col("o_orderkey") % 4 == 0, "sa").when(F.col("o_orderkey") % 4 == 1, "SO").when(F.col("o_orderkey") % 4 == 2, "OTHER")
    return t.raw("orders").select(F.col("o_orderkey").alias("doc_id"), registry.ruleset_name(country, kind).alias("ruleset"))


QUERIES["ruleset_of_document"] = ruleset_of
ORACLE["ruleset_of_document"] = """select o_orderkey as doc_id, case when o_orderkey % 3 <> 0 then 'india_invoice'
  when o_orderkey % 4 = 0 then 'us_shipping_authorization' when o_orderkey % 4 = 1 then 'us_purchase_order' else 'us_unclassified' end as ruleset
from orders"""


def statement_checks(spark, folder):
    t = Documents(spark, folder)
    return statements.run(t.statements(), t.statement_items())


QUERIES["bank_statement_rules"] = statement_checks
BRS_SQL = """
docs as (select h.*, nb, nk, opening_balance_bank + cast(eb as double) as cb, opening_balance_book + cast(ek as double) as ck
  from h left join (select doc_id, count_if(side = 'bank') as nb, count_if(side = 'book') as nk,
      sum(case when effect = 'ADD_TO_BANK' then a when effect = 'DEDUCT_FROM_BANK' then -a else 0 end) as eb,
      sum(case when effect = 'ADD_TO_BOOK' then a when effect = 'DEDUCT_FROM_BOOK' then -a else 0 end) as ek
    from (select *, cast(coalesce(amount, 0.0) as decimal(38,6)) as a from i) group by 1) s using (doc_id)),
req as (select doc_id, unnest([0,1,2,3]) as item, unnest(['company_name','account_number','statement_period_start','statement_period_end']) as name,
    unnest(['Company Name','Account Number','Statement Period Start','Statement Period End']) as label,
    unnest([company_name, account_number, statement_period_start, statement_period_end]) as v from docs),
checks as (
  select doc_id, 1 as section, item, name || '_present' as rule, coalesce(v, '') <> '' as passed,
    label || case when coalesce(v, '') <> '' then ' is present' else ' is missing' end as message, 'document_info.' || name as field from req
  union all select doc_id, 2, 0, 'bank_balance_math', coalesce(abs(cb - adjusted_bank_balance) <= 0.05e0, true),
    case when adjusted_bank_balance is null then 'Computed adjusted bank balance: ' || printf('%.2f', cb) || ' (not stated in document)'
    else 'opening_bank(' || cast(opening_balance_bank as varchar) || ') ± items = ' || printf('%.2f', cb) || ', stated adjusted_bank = '
      || printf('%.2f', adjusted_bank_balance) || ', diff = ' || printf('%.4f', abs(cb - adjusted_bank_balance)) end, 'adjusted_bank_balance'
    from docs where opening_balance_bank is not null and nb > 0
  union all select doc_id, 3, 0, 'book_balance_math', coalesce(abs(ck - adjusted_book_balance) <= 0.05e0, true),
    case when adjusted_book_balance is null then 'Computed adjusted book balance: ' || printf('%.2f', ck) || ' (not stated in document)'
    else 'opening_book(' || cast(opening_balance_book as varchar) || ') ± items = ' || printf('%.2f', ck) || ', stated adjusted_book = '
      || printf('%.2f', adjusted_book_balance) || ', diff = ' || printf('%.4f', abs(ck - adjusted_book_balance)) end, 'adjusted_book_balance'
    from docs where opening_balance_book is not null and nk > 0
  union all select doc_id, 4, 0, 'balances_reconcile', abs(adjusted_bank_balance - adjusted_book_balance) <= 0.05e0,
    'adjusted_bank(' || printf('%.2f', adjusted_bank_balance) || ') vs adjusted_book(' || printf('%.2f', adjusted_book_balance) || '), diff = '
      || printf('%.4f', abs(adjusted_bank_balance - adjusted_book_balance)), 'adjusted_bank_balance'
    from docs where adjusted_bank_balance is not null and adjusted_book_balance is not null
  union all select doc_id, 5, item_no + case side when 'bank' then 0 else 1099511627776 end, side || '_items_side_check', false,
    'Item type ''' || item_type || ''' belongs in ' || case side when 'bank' then 'book' else 'bank' end || '_side_items, not ' || side || '_side_items',
    side || '_side_items' from i
    where case side when 'bank' then item_type in ('BANK_CHARGE', 'BANK_INTEREST', 'NSF_CHECK', 'DIRECT_DEPOSIT', 'BOOK_ERROR')
      else item_type in ('DEPOSIT_IN_TRANSIT', 'OUTSTANDING_CHECK', 'BANK_ERROR') end
  union all select doc_id, 6, item_no + case side when 'bank' then 0 else 1099511627776 end, 'amounts_non_negative', false,
    side || '_side_items[' || item_no || '] has negative amount ' || cast(amount as varchar), side || '_side_items' from i where amount < 0)
"""
ORACLE["bank_statement_rules"] = ctes(**BRS) + "," + BRS_SQL + "select * from checks"


def statement_statuses(spark, folder):
    return registry.statuses(registry.stamped(statement_checks(spark, folder), registry.STATEMENT))


QUERIES["statement_statuses"] = statement_statuses
ORACLE["statement_statuses"] = ctes(**BRS) + "," + BRS_SQL + """
select doc_id, 'bank_reconciliation' as ruleset, case when bool_or(not passed and rule in ('bank_balance_math', 'book_balance_math',
  'balances_reconcile')) then 'INVALID' when bool_or(not passed) then 'NEEDS_REVIEW' else 'VALID' end as status from checks group by 1"""

REL = dict(
    h=d.RELEASES.format(**NAMES), rc=d.RELEASE_COLUMNS.format(**NAMES), rp=d.RELEASE_PARTS.format(**NAMES),
    p="select *, list_slice([q0,q1,q2,q3,q4,q5,q6,q7,q8,q9,q10,q11,7.0::double], 1, n_given) as quantities from rp",
    w="select doc_id, count(*) as width from rc group by 1",
    ap="""select p.doc_id, part_no, part_number, po_number, description, std_pack, width, quantities as given,
  case when width > 0 and len(quantities) < width then 'padded from ' || len(quantities) || ' to ' || width
       when width > 0 and len(quantities) > width then 'trimmed from ' || len(quantities) || ' to ' || width end as quantities_repaired,
  case when coalesce(width, 0) = 0 then quantities else
    list_slice(list_concat(quantities, [null,null,null,null,null,null,null,null,null,null,null,null]::double[]), 1, width) end as quantities
from p left join w using (doc_id)""",
    months="select * from (values ('jan',1),('feb',2),('mar',3),('apr',4),('may',5),('jun',6),('jul',7),('aug',8),('sep',9),('oct',10),('nov',11),('dec',12)) as m(name, mon)",
    seeds="select doc_id, cast(coalesce(substr(release_date, 1, 4), substr(received_at, 1, 4)) as int) as seed from h",
    raw="""select doc_id, col_no, 'ship' as what, raw_ship_date as r from rc union all select doc_id, col_no, 'delivery', raw_delivery_date from rc""",
    dm="""select doc_id, col_no, what, mon * 100 + cast(regexp_extract(r, '^\\s*(\\d{1,2})[-/\\s]*([A-Za-z]{3,})', 1) as int) as md
from raw join months on name = lower(substr(regexp_extract(r, '^\\s*(\\d{1,2})[-/\\s]*([A-Za-z]{3,})', 2), 1, 3))""",
    wraps="""select *, case when md < lag(md) over (partition by doc_id, what order by col_no) then 1 else 0 end as wrap from dm""",
    dated="""select doc_id, col_no, what, cast(try_cast(printf('%04d-%02d-%02d', seed + cast(sum(wrap) over (partition by doc_id, what order by col_no) as int),
  md // 100, md % 100) as date) as varchar) as dt from wraps join seeds using (doc_id)""",
    cols="""select rc.doc_id, rc.col_no, week_label, raw_ship_date, raw_delivery_date, coalesce(ship_date, s.dt) as ship_date,
  coalesce(delivery_date, v.dt) as delivery_date
from rc left join dated s on s.doc_id = rc.doc_id and s.col_no = rc.col_no and s.what = 'ship'
left join dated v on v.doc_id = rc.doc_id and v.col_no = rc.col_no and v.what = 'delivery'""")


def release_tables(spark, folder):
    t = Documents(spark, folder)
    headers = t.releases()
    columns = schedule.derive_dates(t.release_columns(), headers, DEFAULT_YEAR)
    return headers, columns, release.aligned_parts(t.release_parts(), columns)


def schedule_dates(spark, folder):
    return release_tables(spark, folder)[1]


QUERIES["schedule_dates"] = schedule_dates
ORACLE["schedule_dates"] = ctes(**REL) + "select * from cols"


def aligned_parts(spark, folder):
    return release_tables(spark, folder)[2].select(
        "doc_id", "part_no", "quantities_repaired", F.size("quantities").alias("width"),
        schedule.total(F.col("quantities")).alias("total"))


QUERIES["aligned_part_rows"] = aligned_parts
ORACLE["aligned_part_rows"] = ctes(**REL) + """select doc_id, part_no, quantities_repaired, len(quantities) as width,
  list_sum(quantities) as total from ap"""


def schedule_long(spark, folder):
    _, columns, parts = release_tables(spark, folder)
    return release.long_form(parts, columns)


QUERIES["schedule_long_form"] = schedule_long
ORACLE["schedule_long_form"] = ctes(**REL) + """select c.doc_id, part_no, part_number, c.col_no, week_label, delivery_date, quantity
from (select doc_id, part_no, part_number, unnest(quantities) as quantity, generate_subscripts(quantities, 1) as col_no from ap) c
join cols on cols.doc_id = c.doc_id and cols.col_no = c.col_no"""


def schedule_wide(spark, folder):
    t = Documents(spark, folder)
    return release.wide_form(t.release_parts(), t.release_columns(), 12)


QUERIES["schedule_wide_form"] = schedule_wide
ORACLE["schedule_wide_form"] = ctes(**REL) + "select doc_id, part_no, po_number, part_number, description, std_pack, " + ", ".join(
    f"case when width > 0 then quantities[{j}] end as week_{j}" for j in range(1, 13)) + ", list_sum(given) as total from ap"


#: Every tenth release has 35 week columns: its own ones and as many more as it takes, with the quantities to go with them.
LONG_WEEKS = 35


def long_releases(spark, folder):
    t = Documents(spark, folder)
    columns, parts = t.release_columns(), t.release_parts()
    long = columns.filter("doc_id % 10 = 0").select("doc_id").distinct()
    every = long.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(LONG_WEEKS))).alias("col_no"))
    more = every.join(columns.select("doc_id", "col_no"), ["doc_id", "col_no"], "left_anti")
    cells = F.when(F.col("doc_id") % 10 == 0, F.concat("quantities", F.transform(
        F.sequence(F.lit(1), LONG_WEEKS - F.size("quantities") - F.col("part_no") % 2), lambda k: (F.col("part_no") * 100 + k).cast("double"))))
    return columns.unionByName(more, allowMissingColumns=True), parts.withColumn("quantities", F.coalesce(cells, "quantities"))


def schedule_wide_long(spark, folder):
    columns, parts = long_releases(spark, folder)
    return release.wide_form(parts, columns)


QUERIES["schedule_wide_form_35"] = schedule_wide_long
ORACLE["schedule_wide_form_35"] = ctes(**REL) + f""", lw as (select doc_id, case when doc_id % 10 = 0 then greatest(width, {LONG_WEEKS}) else width end as width from w),
lp as (select p.*, lw.width as w2, case when p.doc_id % 10 = 0 then list_concat(quantities, list_transform(range(1, {LONG_WEEKS} - len(quantities) - part_no % 2 + 1),
    lambda k: (part_no * 100 + k)::double)) else quantities end as cells from (select * from p) p left join lw using (doc_id))
select doc_id, part_no, po_number, part_number, description, std_pack, """ + ", ".join(
    f"case when w2 >= {j} then cells[{j}] end as week_{j}" for j in range(1, LONG_WEEKS + 1)) + ", list_sum(cells) as total from lp"


def schedule_labels(spark, folder):
    return release.header_labels(release_tables(spark, folder)[1])


QUERIES["schedule_header_labels"] = schedule_labels
ORACLE["schedule_header_labels"] = ctes(**REL) + """select doc_id, col_no,
  concat_ws(' ', nullif(week_label, ''), coalesce(nullif(raw_delivery_date, ''), delivery_date)) as label from cols"""


def schedule_sheets(spark, folder):
    t = Documents(spark, folder)
    return exports.schedule_sheet(t.release_parts(), schedule.derive_dates(t.release_columns(), t.releases(), DEFAULT_YEAR))


def _csv(cell):
    return f"""coalesce(case when regexp_matches({cell}, '[",\r\n]') then '"' || replace({cell}, '"', '""') || '"' else {cell} end, '')"""


QUERIES["export_schedule_sheet"] = schedule_sheets
ORACLE["export_schedule_sheet"] = ctes(**REL) + f""", labelled as (select doc_id, list(concat_ws(' ', nullif(week_label, ''), coalesce(nullif(raw_delivery_date, ''), delivery_date))
    order by col_no) as labels from cols group by 1)
select p.doc_id, 0::bigint as line_no, array_to_string(list_transform(list_concat(list_concat(['PO', 'Part Number', 'Description', 'Std Pack'], coalesce(labels, []::varchar[])), ['Total']),
  lambda c: {_csv("c")}), ',') as line from (select distinct doc_id from p) p left join labelled using (doc_id)
union all select doc_id, part_no, {_csv("po_number")} || ',' || {_csv("part_number")} || ',' || {_csv("description")} || ',' || coalesce(std_pack::varchar, '') || ',' ||
  array_to_string(list_concat(list_transform(case when width > 0 then quantities else []::double[] end, lambda q: coalesce(q::varchar, '')),
    [coalesce(list_sum(given), 0.0)::double::varchar]), ',') from ap"""


def release_checks(spark, folder):
    return releases.run(*release_tables(spark, folder))


QUERIES["shipping_authorization_rules"] = release_checks
SA_SQL = """,
ordered as (select doc_id, bool_and(up) as ordered from (
    select doc_id, coalesce(lag(delivery_date) over (partition by doc_id order by col_no) < delivery_date, true) as up
    from cols where delivery_date is not null) group by 1),
cells as (select doc_id, part_no, coalesce(nullif(part_number, ''), 'row ' || part_no) as label, std_pack, unnest(quantities) as q,
    generate_subscripts(quantities, 1) as wk from ap),
neg as (select doc_id, string_agg(label || ' week ' || wk, ', ' order by part_no, wk) as bad from cells where q < 0 group by 1),
off as (select doc_id, string_agg(label || ' week ' || wk, ', ' order by part_no, wk) as bad from cells
  where std_pack <> 0 and q % std_pack <> 0 group by 1),
ragged as (select doc_id, string_agg(t, ', ' order by part_no) as bad from (
    select doc_id, part_no, case when quantities_repaired is not null then 'row ' || part_no || ' was ' || quantities_repaired
      when len(quantities) <> coalesce(width, 0) then 'row ' || part_no || ' has ' || len(quantities) || ' of ' || coalesce(width, 0) end as t
    from ap) where t is not null group by 1),
docs as (select h.doc_id, supplier_name, supplier_code, coalesce(width, 0) as width, coalesce(ordered, true) as ordered, coalesce(n, 0) as n,
    neg.bad as neg, off.bad as off, ragged.bad as ragged
  from h left join w using (doc_id) left join ordered using (doc_id) left join (select doc_id, count(*) as n from ap group by 1) c using (doc_id)
  left join neg using (doc_id) left join off using (doc_id) left join ragged using (doc_id)),
checks as (
  select doc_id, 1 as section, 0 as item, 'sa_supplier_identified' as rule, coalesce(supplier_name, supplier_code) is not null as passed,
    coalesce('Supplier identified as ' || coalesce(supplier_name, supplier_code), 'Neither a supplier name nor a supplier code was found') as message,
    'supplier.name' as field from docs
  union all select doc_id, 2, 0, 'sa_schedule_columns_present', width > 0, case when width > 0 then width || ' weekly bucket(s) found'
    else 'No weekly schedule columns were extracted' end, 'schedule_columns' from docs
  union all select doc_id, 3, 0, 'sa_delivery_dates_ordered', ordered, case when ordered then 'Delivery dates increase left to right'
    else 'Delivery dates are not in ascending order across the schedule' end, 'schedule_columns' from docs where width > 0
  union all select doc_id, 4, 0, 'sa_parts_present', n > 0, case when n > 0 then n || ' part row(s) found' else 'No part rows were extracted' end, 'parts' from docs
  union all select doc_id, 5, 0, 'sa_schedule_width_match', ragged is null, case when ragged is null
    then 'All ' || n || ' part row(s) span ' || width || ' bucket(s)' else 'Part row(s) do not line up with the schedule header: ' || ragged end, 'parts'
    from docs where n > 0
  union all select doc_id, 6, part_no, 'sa_part_' || part_no || '_part_number', part_number is not null,
    coalesce('Part number ' || part_number, 'Row ' || part_no || ' has no part number'), 'parts.' || (part_no - 1) || '.part_number' from ap
  union all select doc_id, 7, 0, 'sa_quantities_non_negative', neg is null, coalesce('Negative quantities found at: ' || neg,
    'All scheduled quantities are zero or positive'), 'parts' from docs where n > 0
  union all select doc_id, 8, 0, 'sa_std_pack_multiple', off is null, coalesce('Quantities are not a multiple of the standard pack at: ' || off,
    'Scheduled quantities are whole standard packs'), 'parts' from docs where n > 0)
"""
ORACLE["shipping_authorization_rules"] = ctes(**REL) + SA_SQL + "select * from checks"
