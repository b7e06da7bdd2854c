"""Finance tables derived from the order-management tables.

Everything is a deterministic function of the input rows, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATEMENTS = 50

_BASE = """
select o_custkey % 50 as statement_id, o_orderkey as ok, o_orderkey % 20 as k, o_custkey as ck,
  case when o_orderkey % 20 = 19 then date_add(date'1998-01-01', cast(o_orderkey % 200 div 20 as int))
       else cast(o_orderdate as date) end as d,
  case when o_orderkey % 20 = 19 then cast(floor(o_totalprice/50000+0.5) as bigint)*5000000 + 100
       else cast(floor(o_totalprice*100+0.5) as bigint) end as cents,
  o_orderkey % 2 = 0 as is_credit
from {orders}
"""

_BANK = """
select statement_id, 2*ok+leg as bank_idx, cast(d as string) as transaction_date,
  'NEFT-' || cast(ok as string) || '-CUSTOMER ' || cast(ck as string) as narration,
  cast(ok as string) as reference_number,
  case when not is_credit then cast(amt as double)/100 end as debit,
  case when is_credit then cast(amt as double)/100 end as credit
from (select b.*, leg,
        case when k <> 17 then cents
             when leg = 0 then cents - cast(floor(cents/3) as bigint)
             else cast(floor(cents/3) as bigint) end as amt
      from {base} b lateral view explode(case when k = 17 then array(0, 1) else array(0) end) l as leg
      where k <> 14)
"""

_LEDGER = """
select statement_id, 2*ok+leg as led_idx, 'L' || cast(2*ok+leg as string) as id,
  case when is_credit <> (k = 15) then 'Sales Receipt' else 'Purchase Payment' end as transaction_type,
  'INV-' || cast(ok as string) as invoice_no,
  case when k = 18 and ok div 20 % 3 = 0 then null else cast(d as string) end as invoice_date,
  case when k = 18 and ok div 20 % 3 = 0 then null else cast(cents as double)/100 end as invoice_amount,
  case when k <> 18 then cast(date_add(d, cast(case when k < 13 then ok % 7 else ok % 3 end as int)) as string)
       end as ledger_date,
  case when k <> 18 then 'V-' || cast(2*ok+leg as string) end as ledger_voucher,
  case when k = 18 then null
       when k <> 16 then cast(cents as double)/100
       when leg = 0 then cast(cents - cast(floor(cents/3) as bigint) as double)/100
       else cast(cast(floor(cents/3) as bigint) as double)/100 end as ledger_amount,
  case ok % 9 when 4 then null when 5 then 'Walk-in ' || cast(ck as string)
       when 6 then 'CUSTOMER-' || cast(ck as string) else 'Customer ' || cast(ck as string) end as account_name,
  case ok div 20 % 5 when 0 then 'NATION_' || cast(statement_id % 25 as string) || ' Bank'
       when 1 then 'Cash in Hand' when 2 then 'Unlisted Exchange 77' end as bank_cash_account
from {base} lateral view explode(case when k = 16 then array(0, 1) else array(0) end) l as leg
where k <> 13
"""

_COA = """
select c_custkey % 50 as statement_id, 2 * (c_custkey div 50) as coa_idx,
  'C' || cast(c_custkey as string) as account_code, 'Customer ' || cast(c_custkey as string) as account_name,
  c_mktsegment || ' Debtors' as account_type, cast(null as string) as parent_group
from {customer} where c_custkey div 50 % 10 <> 0 and c_custkey % 50 <> 7
union all
select s_suppkey % 50, 2 * (s_suppkey div 50) + 1, 'B' || cast(s_suppkey as string),
  case when s_suppkey div 50 % 2 = 0 then 'NATION_' || cast(s_nationkey as string) || ' Bank'
       else 'Petty Cash ' || cast(s_suppkey as string) end,
  case when s_suppkey div 50 % 2 = 0 then 'Bank Account' else 'Cash-in-Hand' end, 'Current Assets'
from {supplier} where s_suppkey % 3 <> 0
"""


class Tables:
    """The derived tables over one folder of input tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """A table dealt out by a key, for work that takes long for a row: a small file with many rows gives too few tasks."""
        return self.raw(name).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key)

    def _base(self) -> DataFrame:
        return self.spark.sql(_BASE, orders=self.raw("orders"))

    def bank(self) -> DataFrame:
        return self.spark.sql(_BANK, base=self._base())

    def ledger(self) -> DataFrame:
        return self.spark.sql(_LEDGER, base=self._base())

    def coa(self) -> DataFrame:
        return self.spark.sql(_COA, customer=self.raw("customer"), supplier=self.raw("supplier"))

    def statement_header(self) -> DataFrame:
        """One row per statement: its bank, and the period its bank rows span."""
        return (self.bank().groupBy("statement_id")
                .agg(F.min("transaction_date").alias("period_start"), F.max("transaction_date").alias("period_end"))
                .withColumn("bank_name", F.concat(
                    F.lit("NATION_"), (F.col("statement_id") % 25).cast("string"), F.lit(" Bank"))))
