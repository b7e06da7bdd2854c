"""Queries over bank and ledger rows."""

from pyspark.sql import functions as F

from catalog import views
from catalog.views import matched, settled, sql, vouchers
from tallyspark.operators import accounts, assign, candidates, combine, prepare, settle, validate
from tallyspark.options import MatchOptions
from tallyspark.plans import report
from tallyspark.plans.reconcile import reconcile
from tallyspark.rules import extra
from tallyspark.session import cut
from tallyspark.sources.derive import Tables

OPTIONS = MatchOptions()
QUERIES, ORACLE = {}, {}


def keys(spark, folder):
    t = Tables(spark, folder)
    return prepare.bank_keys(t.bank()), prepare.ledger_keys(prepare.with_anchor(t.ledger()))


def bank_rows(spark, folder):
    return Tables(spark, folder).bank()


def ledger_rows(spark, folder):
    return Tables(spark, folder).ledger()


def coa_rows(spark, folder):
    return Tables(spark, folder).coa()


QUERIES["bank_rows"] = bank_rows
ORACLE["bank_rows"] = sql("select * from bank")
QUERIES["ledger_rows"] = ledger_rows
ORACLE["ledger_rows"] = sql("select * from led")
QUERIES["coa_rows"] = coa_rows
ORACLE["coa_rows"] = sql("select * from coa")


def exact_amount_pools(spark, folder):
    banks, leds = keys(spark, folder)
    return candidates.exact_amount_pools(leds, banks)


QUERIES["exact_amount_pools"] = exact_amount_pools
ORACLE["exact_amount_pools"] = sql("""
select l.statement_id, l.led_idx, count(b.bank_idx) as n_same_amount, min(b.bank_idx) as first_same_amount
from lk l left join bk b on l.statement_id = b.statement_id and l.cents = b.cents
where l.anchor_date is not null and l.anchor_amount is not null
group by 1, 2""")


def candidate_pools(spark, folder):
    banks, leds = keys(spark, folder)
    return candidates.candidate_pools(leds, banks, OPTIONS.tolerance_days)


QUERIES["candidate_pools"] = candidate_pools
ORACLE["candidate_pools"] = sql("""
select *, case when n_exact > 0 then 'exact' when n_window > 0 then 'window' else 'none' end as tier,
  case when n_exact > 0 then n_exact else n_window end as n_candidates
from (select l.statement_id, l.led_idx, count(b.bank_idx) as n_window, min(b.bank_idx) as first_window,
        count(case when b.cents = l.cents then 1 end) as n_exact,
        min(case when b.cents = l.cents then b.bank_idx end) as first_exact
      from lk l left join bk b on l.statement_id = b.statement_id and abs(l.day - b.day) <= 5
      where l.anchor_date is not null and l.anchor_amount is not null
      group by 1, 2)""")


def assigned_pairs(spark, folder):
    banks, leds = keys(spark, folder)
    pairs = assign.two_wave_assignment(banks, leds, OPTIONS)
    raw = assign.score(OPTIONS, F.col("exact"), F.col("days"), F.col("same_direction"))
    return pairs.select("statement_id", "led_idx", "bank_idx", F.col("days").cast("bigint").alias("days"),
                        "same_direction", raw.alias("raw_score"))


QUERIES["assigned_pairs"] = assigned_pairs
ORACLE["assigned_pairs"] = matched("select * from assigned")


def _assigned_with(options, silent):
    def query(spark, folder):
        banks, leds = keys(spark, folder)
        known = F.col("bank_idx") % silent != 0
        banks = banks.withColumns({"cents": F.when(known, F.col("cents")), "direction": F.when(known, F.col("direction"))})
        return assign.two_wave_assignment(banks, leds, options).select(
            "statement_id", "led_idx", "bank_idx", F.col("days").cast("bigint").alias("days"), "exact", "same_direction")

    return query


#: Unequal amounts may match, and some bank rows state neither debit nor credit.
QUERIES["assigned_any_amount"] = _assigned_with(MatchOptions(min_score=30.0), 11)
ORACLE["assigned_any_amount"] = views.assigned_with(30, 50, 40, 10, 11)
#: An equal amount weighs as much as two days, so kinds of pair tie.
QUERIES["assigned_tied_weights"] = _assigned_with(MatchOptions(min_score=20.0, amount_weight=16.0), 13)
ORACLE["assigned_tied_weights"] = views.assigned_with(20, 16, 40, 10, 13)


def _flat(rows):
    return rows.select(
        "statement_id", "led_idx", "id", "invoice_no", F.array_join("bank_rows", ",").alias("bank_rows"), "score",
        "status", F.array_join("failed_criteria", "|").alias("failed_criteria"),
        F.array_join("reasons", " | ").alias("reasons"))


def combined_settlements(spark, folder):
    banks, leds = keys(spark, folder)
    pairs = cut(assign.two_wave_assignment(banks, leds, OPTIONS))
    free_banks = banks.join(pairs.select("statement_id", "bank_idx"), ["statement_id", "bank_idx"], "left_anti")
    free_leds = leds.join(pairs.select("statement_id", "led_idx"), ["statement_id", "led_idx"], "left_anti")
    found = combine.combined_settlements(free_banks, free_leds, OPTIONS)
    return found.select("statement_id", "led_idx", F.array_join("bank_rows", ",").alias("bank_rows"),
                        "n_bank", "n_led", "score")


QUERIES["combined_settlements"] = combined_settlements
ORACLE["combined_settlements"] = settled("select * from combined")


def two_way(spark, folder):
    t = Tables(spark, folder)
    return t, reconcile(t.bank(), t.ledger())


def vouchers_two_way(spark, folder):
    return _flat(two_way(spark, folder)[1].vouchers)


QUERIES["vouchers_two_way"] = vouchers_two_way
ORACLE["vouchers_two_way"] = vouchers("""select statement_id, led_idx, id, invoice_no, bank_rows, score, status,
  failed_criteria, reasons from two_way""")


def invoice_rollup(spark, folder):
    return two_way(spark, folder)[1].invoices


QUERIES["invoice_rollup"] = invoice_rollup
ORACLE["invoice_rollup"] = vouchers("""
select statement_id, invoice_no, invoice_date, cast(oc as double)/100 as invoice_amount,
  cast(sc as double)/100 as total_settled, cast(greatest(0, oc - sc) as double)/100 as outstanding,
  case when sc > oc then cast(sc - oc as double)/100 else 0.0 end as mismatch_amount, status, n_vouchers
from rollup""".replace("greatest(0, oc - sc)", "case when oc is null then null else greatest(0, oc - sc) end"))


def voucher_refs(spark, folder):
    return settle.voucher_refs(two_way(spark, folder)[1].vouchers)


QUERIES["voucher_refs"] = voucher_refs
ORACLE["voucher_refs"] = sql("select statement_id, invoice_no, led_idx, id as voucher_ref from led")


def matching_stats(spark, folder):
    return two_way(spark, folder)[1].stats


QUERIES["matching_stats"] = matching_stats
ORACLE["matching_stats"] = vouchers("""
select statement_id, total_invoices, fully_settled, partially_settled, not_settled, mismatched, needs_review,
  total_bank_txns, matched_bank_txns
from (select statement_id, count(*) as total_invoices, count_if(status = 'Fully Settled') as fully_settled,
        count_if(status = 'Partially Settled') as partially_settled, count_if(status = 'Not Settled') as not_settled,
        count_if(status = 'Overpaid/Mismatch') as mismatched, count_if(status = 'Needs Review') as needs_review
      from rollup group by 1) i
full join (select statement_id, count(*) as total_bank_txns, count_if(n_vouchers > 0) as matched_bank_txns
      from results group by 1) b using (statement_id)""")


def unmatched_bank_rows(spark, folder):
    return two_way(spark, folder)[1].unmatched_bank


QUERIES["unmatched_bank_rows"] = unmatched_bank_rows
ORACLE["unmatched_bank_rows"] = vouchers("select statement_id, bank_idx from results where n_vouchers = 0")


def results_two_way(spark, folder):
    t, done = two_way(spark, folder)
    return report.bank_results(t.bank(), done.vouchers)


def bank_result_rows(spark, folder):
    return report.ordered(results_two_way(spark, folder)).select(
        "statement_id", "bank_idx", "status", "score", "n_vouchers", "rank")


QUERIES["bank_result_rows"] = bank_result_rows
ORACLE["bank_result_rows"] = vouchers(
    "select statement_id, bank_idx, status, score, n_vouchers, rank from results order by statement_id, rank, bank_idx")


def partial_bank_results(spark, folder):
    return report.only(results_two_way(spark, folder), "partial").select("statement_id", "bank_idx", "score")


QUERIES["partial_bank_results"] = partial_bank_results
ORACLE["partial_bank_results"] = vouchers("select statement_id, bank_idx, score from results where rank = 1")


def bank_stats(spark, folder):
    return report.bank_stats(results_two_way(spark, folder))


QUERIES["bank_stats"] = bank_stats
ORACLE["bank_stats"] = vouchers("""
select statement_id, count(*) as total, count_if(rank = 0) as matched, count_if(rank = 1) as partially_matched,
  count_if(rank = 2) as unmatched, floor(count_if(rank = 0) / count(*) * 1000 + 0.5) / 10 as match_percent
from results group by 1""")


def reconciliation_report(spark, folder):
    return report.report(results_two_way(spark, folder), "2-way")


QUERIES["reconciliation_report"] = reconciliation_report
ORACLE["reconciliation_report"] = vouchers("""
select statement_id, bank_idx, coalesce(transaction_date, '') as date, coalesce(narration, '') as narration,
  coalesce(reference_number, '') as reference, coalesce(credit, debit) as amount,
  case when credit > 0 then 'Credit' else 'Debit' end as direction,
  coalesce(array_to_string([v.n || case when coalesce(v.v, '') = '' then '' else ' (' || v.v || ')' end for v in vs], ' + '), '')
    as matched_invoices,
  status, score, '' as coa_validated,
  coalesce(vs[1].r, 'No settlement found for this bank transaction') as reasons
from results""")


def statement_date_range(spark, folder):
    return Tables(spark, folder).statement_header()


QUERIES["statement_date_range"] = statement_date_range
ORACLE["statement_date_range"] = sql("""
select statement_id, min(transaction_date) as period_start, max(transaction_date) as period_end,
  'NATION_' || cast(statement_id % 25 as varchar) || ' Bank' as bank_name from bank group by 1""")


# ---- three-way --------------------------------------------------------------
def three_way(spark, folder):
    t = Tables(spark, folder)
    return t, reconcile(t.bank(), t.ledger(), t.coa(), t.statement_header(), "3-way")


def vouchers_three_way(spark, folder):
    rows = three_way(spark, folder)[1].vouchers
    return rows.select(
        "statement_id", "led_idx", "id", "invoice_no", F.array_join("bank_rows", ",").alias("bank_rows"), "score", "status",
        F.array_join("failed_criteria", "|").alias("failed_criteria"), F.array_join("reasons", " | ").alias("reasons"),
        F.col("party_account.name").alias("party_account"), "party_match", F.col("till_account.name").alias("till_account"),
        "till_match", "accounts_ok")


QUERIES["vouchers_three_way"] = vouchers_three_way
ORACLE["vouchers_three_way"] = views.three_way("select * from three_way")


def gap_flags(spark, folder):
    t, done = three_way(spark, folder)
    return report.bank_results(t.bank(), done.vouchers).select("statement_id", "bank_idx", "has_gap")


QUERIES["gap_flags"] = gap_flags
ORACLE["gap_flags"] = views.three_way("""select b.statement_id, b.bank_idx, coalesce(v.gap, false) as has_gap from bank b left join (
  select statement_id, bank_idx, arg_min(contains(reasons, 'Receipt / Payment Ledger is missing') or contains(reasons, 'Invoice details missing')
    or contains(reasons, 'Account Matched, Missing Invoice & Ledger'), coalesce(led_idx, 9223372036854775807)) as gap
  from (select *, cast(unnest(string_split(bank_rows, ',')) as bigint) as bank_idx from three_way where bank_rows <> '') group by 1, 2) v
on v.statement_id = b.statement_id and v.bank_idx = b.bank_idx""")


def names_resolved(spark, folder):
    t = Tables(spark, folder)
    names = t.ledger().select("statement_id", F.col("account_name").alias("name"))
    return accounts.match_by_name(names, t.coa(), OPTIONS).select("statement_id", "name", F.col("account.code").alias("account_code"), "score")


QUERIES["accounts_by_name"] = names_resolved
ORACLE["accounts_by_name"] = sql("""
select b.statement_id, b.name, c.account_code, b.score from nm b join coa c on c.statement_id = b.statement_id and c.coa_idx = b.idx""",
    views.CHART, "asked as (select statement_id, account_name as name from led)", views.best_by_name("nm", "asked", "true"))


def narrations_resolved(spark, folder):
    t = Tables(spark, folder)
    return accounts.match_by_narration(t.bank(), t.coa(), OPTIONS).select(
        "statement_id", "narration", F.col("account.code").alias("account_code"), "score")


QUERIES["accounts_by_narration"] = narrations_resolved
ORACLE["accounts_by_narration"] = sql("""
select b.statement_id, b.narration, c.account_code, b.score from nm b join coa c on c.statement_id = b.statement_id and c.coa_idx = b.idx""",
    views.CHART, views.best_by_narration("nm", "bank", "true"))


# ---- row checks and the run gate -------------------------------------------
def ledger_row_errors(spark, folder):
    return validate.ledger_errors(Tables(spark, folder).ledger().withColumn(
        "ledger_amount", F.when(F.col("led_idx") % 31 == 0, -F.col("ledger_amount")).otherwise(F.col("ledger_amount"))).withColumn(
        "invoice_date", F.when(F.col("led_idx") % 37 == 0, "soon").otherwise(F.col("invoice_date"))))


BROKEN = """broken as (select statement_id, led_idx, invoice_amount, case when led_idx % 31 = 0 then -ledger_amount else ledger_amount end as ledger_amount,
  case when led_idx % 37 = 0 then 'soon' else invoice_date end as invoice_date from led),
bad as (select * from (select statement_id, led_idx, 1 as ord, case when invoice_date = 'soon' then 'Invoice Date is not a valid date' end as error from broken
  union all select statement_id, led_idx, 4, case when ledger_amount <= 0 then 'Ledger Amount must be a positive number' end from broken) where error is not null)"""
QUERIES["ledger_row_errors"] = ledger_row_errors
ORACLE["ledger_row_errors"] = sql("select statement_id, led_idx, ord, error from bad", BROKEN)


def coa_row_errors(spark, folder):
    t = Tables(spark, folder)
    return validate.coa_errors(t.coa().withColumn("account_type", F.when(F.col("coa_idx") % 9 == 0, " ").otherwise(F.col("account_type"))))


QUERIES["coa_row_errors"] = coa_row_errors
ORACLE["coa_row_errors"] = sql("select statement_id, coa_idx, 2 as ord, 'Account Type is required' as error from coa where coa_idx % 9 = 0")


def run_gate(spark, folder):
    t = Tables(spark, folder)
    return validate.run_gate(t.bank(), t.ledger(), t.coa(), "3-way")


QUERIES["run_gate"] = run_gate
ORACLE["run_gate"] = sql("""select statement_id, true as has_bank, true as has_ledger, true as ledger_clean,
  count(c.coa_idx) > 0 as coa_ready, count(c.coa_idx) > 0 as can_run
from (select distinct statement_id from bank) b left join coa c using (statement_id) group by 1""")


# ---- optional statement checks ----------------------------------------------
def statement_period_check(spark, folder):
    t = Tables(spark, folder)
    short = t.statement_header().withColumn("period_start", F.lit("1998-06-01"))
    return extra.outside_period(t.bank(), short).select("statement_id", "bank_idx", "transaction_date")


QUERIES["rows_outside_period"] = statement_period_check
ORACLE["rows_outside_period"] = sql("select statement_id, bank_idx, transaction_date from bank where transaction_date < '1998-06-01'")


def statement_totals_check(spark, folder):
    t = Tables(spark, folder)
    stated = t.raw("customer").select((F.col("c_custkey") % 50).alias("statement_id")).groupBy("statement_id").agg(
        F.count("*").alias("debit_count")).withColumns({"credit_count": F.lit(None).cast("bigint"), "debit_total": F.lit(0.0),
                                                        "credit_total": F.lit(None).cast("double")})
    return extra.totals_check(t.bank(), stated)


QUERIES["statement_totals_check"] = statement_totals_check
ORACLE["statement_totals_check"] = sql("""select statement_id, debits, credits, debit_sum, credit_sum, debits = s.n and debit_sum <= 0.05 as agrees
from (select statement_id, count(debit) as debits, count(credit) as credits, coalesce(cast(sum(cast(debit as decimal(38,6))) as double), 0) as debit_sum,
        coalesce(cast(sum(cast(credit as decimal(38,6))) as double), 0) as credit_sum from bank group by 1)
join (select c_custkey % 50 as statement_id, count(*) as n from customer group by 1) s using (statement_id)""")


def running_balance_check(spark, folder):
    bank = Tables(spark, folder).bank()
    signed = F.coalesce("credit", F.lit(0.0)) - F.coalesce("debit", F.lit(0.0))
    rows = bank.withColumn("balance", F.when(F.col("bank_idx") % 5 != 0, signed + F.col("bank_idx")))
    return extra.balance_breaks(rows)


QUERIES["running_balance_breaks"] = running_balance_check
ORACLE["running_balance_breaks"] = sql("""select statement_id, bank_idx, expected, balance from (
  select *, lag(balance) over (partition by statement_id order by bank_idx) + moved as expected
  from (select statement_id, bank_idx, coalesce(credit, 0) - coalesce(debit, 0) as moved,
          case when bank_idx % 5 <> 0 then coalesce(credit, 0) - coalesce(debit, 0) + bank_idx end as balance from bank))
where abs(expected - balance) > 0.05""")
