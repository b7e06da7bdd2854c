"""Business documents derived from the order-management tables, as flat tables.

The SQL is plain enough to run on other engines as well, so the checks reuse it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import shuffled
from tallyspark.sources.derive import Tables

INVOICE_LINES = """
select l_orderkey as doc_id, cast(l_linenumber as bigint) as line_no,
  'Part ' || cast(l_partkey as string) as description, cast(1000 + l_partkey % 9000 as string) as hsn_sac,
  case when l_partkey % 97 <> 0 then l_quantity end as quantity, 'NOS' as unit,
  case when (l_orderkey + l_linenumber) % 13 = 0 then 2.0e0 else 1.0e0 end * (l_extendedprice / l_quantity) as unit_price,
  l_extendedprice as taxable_value,
  case when l_orderkey % 3 <> 0 then l_tax / 2 end as cgst_rate,
  case when l_orderkey % 3 <> 0 then l_extendedprice * l_tax / 2 end as cgst_amount,
  case when l_orderkey % 3 <> 0 then l_tax / 2 end as sgst_rate,
  case when l_orderkey % 3 <> 0 then l_extendedprice * l_tax / 2 end as sgst_amount,
  case when l_orderkey % 3 = 0 then l_tax end as igst_rate,
  case when l_orderkey % 3 = 0 then l_extendedprice * l_tax end as igst_amount,
  l_extendedprice * (1 + l_tax) as total
from {lineitem}
"""

INVOICES = """
select o_orderkey as doc_id,
  case when o_orderkey % 37 = 0 then null when o_orderkey % 41 = 0 then '' else 'INV-' || cast(o_orderkey as string) end
    as invoice_number,
  case when o_orderkey % 31 = 0 then null when o_orderkey % 29 = 0 then '05/06/2024'
       else cast(cast(o_orderdate as date) as string) end as invoice_date,
  cast(cast(o_orderdate as date) + 30 as string) as due_date, 'INR' as currency,
  'Clerk ' || cast(o_orderkey % 1000 as string) as vendor_name,
  case when o_orderkey % 23 = 0 then 'BAD-' || cast(o_orderkey as string)
       else '29abcde' || cast(1000 + o_orderkey % 9000 as string) || 'F1Z5 ' end as vendor_gstin,
  'ABCDE' || cast(1000 + o_orderkey % 9000 as string) || 'F' as vendor_pan,
  case when o_orderkey % 6 <> 0 then 'Street ' || cast(o_orderkey % 100 as string) end as vendor_address,
  cast(null as string) as vendor_phone, cast(null as string) as vendor_email,
  'Customer ' || cast(o_custkey as string) as customer_name,
  case when o_orderkey % 4 = 0 then null when o_orderkey % 25 = 1 then '27XYZ'
       else '27PQRST' || cast(1000 + o_custkey % 9000 as string) || 'A1ZQ' end as customer_gstin,
  cast(null as string) as customer_address,
  case when o_orderkey % 5 = 0 then 'PO-' || cast(o_orderkey as string) end as purchase_order_number,
  case when o_orderkey % 5 = 0 then null when o_orderkey % 19 = 0 then 'HDFC123'
       else 'HDFC0' || cast(100000 + o_orderkey % 900000 as string) end as ifsc,
  cast(taxable_c as double) / 100 as subtotal,
  case when o_orderkey % 3 <> 0 then cast(floor(tax_c / 2) as double) / 100 end as cgst_total,
  case when o_orderkey % 3 <> 0 then cast(tax_c - floor(tax_c / 2) as double) / 100 end as sgst_total,
  case when o_orderkey % 3 = 0 then cast(tax_c as double) / 100 when o_orderkey % 17 = 0 then 5.0e0 end as igst_total,
  case when o_orderkey % 14 <> 0 then cast(tax_c as double) / 100 end as total_tax,
  case when o_orderkey % 10 = 0 then 0.0e0 end as round_off,
  cast(taxable_c + tax_c + case when o_orderkey % 11 = 0 then 100 else 0 end as double) / 100 as grand_total
from {orders} left join (
  select l_orderkey, sum(cast(floor(l_extendedprice * 100 + 0.5) as bigint)) as taxable_c,
    sum(cast(floor(l_extendedprice * l_tax * 100 + 0.5) as bigint)) as tax_c
  from {lineitem} group by l_orderkey) t on l_orderkey = o_orderkey
"""

ORDER_LINES = """
select l_orderkey as doc_id, cast(l_linenumber as bigint) as line_no, cast(l_linenumber as string) as line_number,
  'P' || cast(l_partkey as string) as part_number, case when l_partkey % 4 <> 0 then 'Item ' || cast(l_partkey as string) end
    as description,
  case when l_partkey % 89 = 0 then null when l_partkey % 61 = 0 then 0.0e0 else l_quantity end as quantity, 'EA' as uom,
  cast(cast(l_shipdate as date) as string) as due_date,
  case when l_partkey % 71 <> 0 then floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000 end as unit_cost,
  case when (l_orderkey + l_linenumber) % 13 = 0 then l_extendedprice + 500 else l_extendedprice end as extended_cost
from {lineitem}
"""

ORDERS = """
select o_orderkey as doc_id,
  case when o_orderkey % 43 = 0 then null else 'PO' || cast(o_orderkey as string) end as order_number,
  case when o_orderkey % 47 = 0 then null when o_orderkey % 19 = 0 then '1998-02-30' when o_orderkey % 53 = 0 then '3/4/98'
       else cast(cast(o_orderdate as date) as string) end as order_date,
  'USD' as currency, case when o_orderkey % 2 = 0 then 'NET 30' end as payment_terms, cast(null as string) as freight_terms,
  'Truck' as ship_via, cast(null as string) as received_by, cast(null as string) as received_at,
  'Vendor ' || cast(o_orderkey % 100 as string) as vendor_name, case when o_orderkey % 3 = 0 then 'V' || cast(o_orderkey % 100 as string) end
    as vendor_code,
  'Buyer ' || cast(o_custkey as string) as buyer_name,
  case when o_orderkey % 12 = 0 then 'Vendor ' || cast(o_orderkey % 100 as string) else 'Buyer ' || cast(o_custkey as string) end
    as bill_to_name,
  case when o_orderkey % 7 = 0 then null when o_orderkey % 24 = 0 then 'Vendor ' || cast(o_orderkey % 100 as string)
       else 'Dock ' || cast(o_orderkey % 10 as string) end as ship_to_name,
  case when o_orderkey % 21 = 0 then null else 'Road ' || cast(o_custkey % 50 as string) end as ship_to_address,
  case when o_orderkey % 4 = 0 then cast(line_c as double) / 100 end as subtotal,
  case when o_orderkey % 2 = 0 then 12.5e0 end as sales_tax, case when o_orderkey % 6 = 0 then 30.0e0 end as freight,
  case when o_orderkey % 10 = 0 then 5.0e0 end as discount,
  case when o_orderkey % 2 = 0 then cast(line_c as double) / 100 + 12.5e0
    + case when o_orderkey % 6 = 0 then 30.0e0 else 0.0e0 end - case when o_orderkey % 10 = 0 then 5.0e0 else 0.0e0 end end
    as grand_total
from {orders} left join (
  select l_orderkey, sum(cast(floor(l_extendedprice * 100 + 0.5) as bigint)) as line_c from {lineitem} group by l_orderkey) t
  on l_orderkey = o_orderkey
"""

MONTH_NAMES = "case {m} when 0 then 'Jan' when 1 then 'Feb' when 2 then 'Mar' when 3 then 'Apr' when 4 then 'May' " \
    "when 5 then 'Jun' when 6 then 'Jul' when 7 then 'Aug' when 8 then 'Sep' when 9 then 'Oct' when 10 then 'Nov' else 'Dec' end"

RELEASES = """
select doc_id, case when doc_id % 9 <> 0 then 'Supplier ' || cast(cast(floor(doc_id / 100) as bigint) as string) end as supplier_name,
  case when doc_id % 27 <> 0 then 'S' || cast(doc_id as string) end as supplier_code,
  'R' || cast(doc_id as string) as release_number,
  case when doc_id % 5 <> 0 then cast(1900 + doc_id % 100 + case when doc_id % 100 < 50 then 100 else 0 end as string) || '-01-15' end
    as release_date,
  '2003-02-01T08:00:00' as received_at, cast(null as string) as received_by
from (select distinct l_suppkey * 100 + cast(extract(year from l_shipdate) as int) % 100 as doc_id from {lineitem}) d
"""

RELEASE_COLUMNS = """
select doc_id, cast(j + 1 as bigint) as col_no, 'W' || cast(j + 1 as string) as week_label,
  case when (doc_id + j) % 17 = 0 then 'TBD' else cast(1 + doc_id % 28 as string) || '-' || MONTH(j) end as raw_ship_date,
  case when (doc_id + j) % 13 = 0 then null else cast(3 + doc_id % 28 as string) || ' ' || MONTH(j) end as raw_delivery_date,
  cast(null as string) as ship_date,
  case when doc_id % 23 = 0 and j = 5 then '1990-01-01' end as delivery_date
from (select doc_id, j, (doc_id + j) % 12 as m
      from (select distinct l_suppkey * 100 + cast(extract(year from l_shipdate) as int) % 100 as doc_id from {lineitem}) d
      cross join (select * from (values (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11)) as t(j)) c
      where doc_id % 31 <> 0) x
""".replace("MONTH(j)", "(" + MONTH_NAMES.format(m="m") + ")")

RELEASE_PARTS = """
select doc_id, part + 1 as part_no, case when part % 29 <> 0 then 'PN' || cast(part as string) end as part_number,
  'PO' || cast(part % 10 as string) as po_number, case when part % 8 <> 0 then 'Part ' || cast(part as string) end as description,
  case part % 3 when 1 then 1.0e0 when 2 then 5.0e0 end as std_pack,
  case when part % 7 = 0 then 10 when part % 11 = 0 then 13 else 12 end as n_given, QUANTITIES
from (select *, l_suppkey * 100 + cast(extract(year from l_shipdate) as int) % 100 as doc_id, l_partkey as part,
        cast(extract(month from l_shipdate) as int) - 1 as mo,
        case when l_partkey % 19 = 0 then -l_quantity else l_quantity end as q from {lineitem}) x
group by doc_id, part
""".replace("QUANTITIES", ", ".join(f"coalesce(sum(case when mo = {j} then q end), 0.0e0) as q{j}" for j in range(12)))

STATEMENT_ITEMS = """
select o_custkey as doc_id, case when o_orderkey % 2 = 0 then 'bank' else 'book' end as side, o_orderkey as item_no,
  case o_orderkey % 9 when 0 then 'DEPOSIT_IN_TRANSIT' when 2 then 'OUTSTANDING_CHECK' when 4 then 'BANK_ERROR'
    when 1 then 'BANK_CHARGE' when 3 then 'BANK_INTEREST' when 5 then 'NSF_CHECK' when 7 then 'DIRECT_DEPOSIT'
    when 6 then 'BOOK_ERROR' end as item_type,
  'Order ' || cast(o_orderkey as string) as description, cast(o_orderkey as string) as reference_number,
  cast(cast(o_orderdate as date) as string) as date,
  case when o_orderkey % 59 = 0 then null when o_orderkey % 53 = 0 then -o_totalprice else o_totalprice end as amount,
  case when o_orderkey % 2 = 0 then case when o_orderkey % 4 < 2 then 'ADD_TO_BANK' else 'DEDUCT_FROM_BANK' end
       when o_orderkey % 4 < 2 then 'ADD_TO_BOOK' else 'DEDUCT_FROM_BOOK' end as effect
from {orders}
"""

STATEMENTS = """
select c_custkey as doc_id, case when c_custkey % 13 <> 0 then 'Company ' || cast(c_custkey as string) end as company_name,
  'Bank ' || cast(c_nationkey as string) as bank_name,
  case when c_custkey % 17 <> 0 then cast(100000 + c_custkey as string) else '' end as account_number,
  '1993-01-01' as statement_period_start, case when c_custkey % 19 <> 0 then '1998-12-31' end as statement_period_end,
  'USD' as currency, cast(null as string) as prepared_by, cast(null as string) as prepared_date,
  case when c_custkey % 11 <> 0 then c_acctbal end as opening_balance_bank,
  c_acctbal as opening_balance_book, cast(null as double) as closing_balance_bank, cast(null as double) as closing_balance_book,
  cast(null as double) as reconciled_balance,
  case when c_custkey % 7 <> 0 then cast(floor(c_acctbal * 100 + 0.5) + coalesce(bank_c, 0)
    + case when c_custkey % 5 = 0 then 700 else 0 end as double) / 100 end as adjusted_bank_balance,
  case when c_custkey % 3 = 0 then cast(floor(c_acctbal * 100 + 0.5) + coalesce(bank_c, 0) as double) / 100
       else cast(floor(c_acctbal * 100 + 0.5) + coalesce(book_c, 0) as double) / 100 end as adjusted_book_balance
from {customer} left join (
  select o_custkey,
    sum(case when o_orderkey % 2 = 0 then s * c else 0 end) as bank_c, sum(case when o_orderkey % 2 = 1 then s * c else 0 end) as book_c
  from (select o_custkey, o_orderkey, case when o_orderkey % 4 < 2 then 1 else -1 end as s,
          case when o_orderkey % 59 = 0 then 0 when o_orderkey % 53 = 0 then -cast(floor(o_totalprice * 100 + 0.5) as bigint)
               else cast(floor(o_totalprice * 100 + 0.5) as bigint) end as c from {orders}) i
  group by o_custkey) t on o_custkey = c_custkey
"""


class Documents(Tables):
    def _sql(self, text: str, *names: str) -> DataFrame:
        return self.spark.sql(text, **{n: self.raw(n) for n in names})

    def _with_lines(self, text: str) -> DataFrame:
        """Headers next to sums of their lines: shuffled, as a header becomes many rows and a broadcast leaves it to the tasks that read the file."""
        return self.spark.sql(text, orders=shuffled(self.raw("orders")), lineitem=self.raw("lineitem"))

    def invoices(self) -> DataFrame:
        return self._with_lines(INVOICES)

    def invoice_lines(self) -> DataFrame:
        return self._sql(INVOICE_LINES, "lineitem")

    def orders(self) -> DataFrame:
        return self._with_lines(ORDERS)

    def order_lines(self) -> DataFrame:
        return self._sql(ORDER_LINES, "lineitem")

    def releases(self) -> DataFrame:
        return self._sql(RELEASES, "lineitem")

    def release_columns(self) -> DataFrame:
        return self._sql(RELEASE_COLUMNS, "lineitem")

    def release_parts(self) -> DataFrame:
        """Part rows as extracted: some rows too short, some too long."""
        parts = self._sql(RELEASE_PARTS, "lineitem")
        cells = F.concat(F.array(*[f"q{j}" for j in range(12)]), F.array(F.lit(7.0)))
        return parts.withColumn("quantities", F.slice(cells, 1, F.col("n_given"))).drop(
            "n_given", *[f"q{j}" for j in range(12)])

    def statements(self) -> DataFrame:
        return self._sql(STATEMENTS, "customer", "orders")

    def statement_items(self) -> DataFrame:
        return self._sql(STATEMENT_ITEMS, "orders")
