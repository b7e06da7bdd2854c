"""Statement reconciliation: bank rows against ledger rows, optionally against the chart of accounts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text, values
from tallyspark.operators import accounts, assign, combine, prepare, settle
from tallyspark.options import COMBINED, MATCHED, PARTIAL, THREE_WAY, TWO_WAY, UNMATCHED, MatchOptions
from tallyspark.session import cut, shuffled

# ---- fixed values -----------------------------------------------------------
AMOUNT_EXACT, AMOUNT_OFF = "Amount matched exactly", "Amount did not match"
DATE_EXACT, DATE_NEAR = "Date matched exactly", "Date within tolerance (partial credit)"
DATE_FAR, WRONG_WAY = "Date outside tolerance window", "Transaction type/direction mismatch"
LEDGER_MISSING, INVOICE_MISSING = "Receipt / Payment Ledger is missing", "Invoice details missing"
ACCOUNT_ONLY = "Account Matched, Missing Invoice & Ledger"
GAP_REASONS = [INVOICE_MISSING, LEDGER_MISSING, ACCOUNT_ONLY]
NOT_RECORDED = "No settlement recorded for this invoice yet"
NO_DETAILS = ("No Invoice or Ledger details provided, and Account Name did not match any bank "
              "transaction narration")
NO_NAME = "No account name provided for 3-way validation"
# -----------------------------------------------------------------------------

_KEY = ["statement_id", "led_idx"]
ACCOUNT = "struct<code:string,name:string,type:string>"


@dataclass
class Reconciliation:
    vouchers: DataFrame
    invoices: DataFrame
    unmatched_bank: DataFrame
    stats: DataFrame


def kept(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def failed_criteria(options: MatchOptions, exact: Column, days: Column, same: Column) -> Column:
    return kept(F.when(~exact, "amount_mismatch"), F.when(days >= options.tolerance_days, "date_out_of_range"),
                F.when(~same, "direction_mismatch"))


def pair_reasons(options: MatchOptions, exact: Column, days: Column, same: Column) -> Column:
    close = options.date_weight * (1 - days / float(options.tolerance_days))
    return kept(
        F.when(exact, AMOUNT_EXACT).otherwise(AMOUNT_OFF),
        F.when((days < options.tolerance_days) & (close >= options.date_weight - 0.01), DATE_EXACT)
        .when(days < options.tolerance_days, DATE_NEAR).otherwise(DATE_FAR),
        F.when(~same, WRONG_WAY))


def pair_status(options: MatchOptions, same: Column, score: Column) -> Column:
    return F.when(same & (score >= options.matched_score), MATCHED).otherwise(PARTIAL)


def _outcomes(bank: DataFrame, ledger: DataFrame, mode: str, options: MatchOptions) -> DataFrame:
    """One row per ledger row that got bank rows: which, with score, status, criteria, reasons."""
    leds = cut(prepare.ledger_keys(ledger))
    pairs = cut(assign.two_wave_assignment(bank, leds, options))
    used = shuffled(pairs.select("statement_id", "bank_idx"))
    free_banks = bank.join(used, ["statement_id", "bank_idx"], "left_anti")
    free_leds = leds.join(shuffled(pairs.select(*_KEY)), _KEY, "left_anti")
    combined = cut(combine.combined_settlements(free_banks, free_leds, options))

    score = assign.score(options, F.col("exact"), F.col("days"), F.col("same_direction"))
    by_pair = (pairs.withColumn("raw", score).select(
        *_KEY, F.array("bank_idx").alias("bank_rows"), values.half_up(F.col("raw")).alias("score"),
        pair_status(options, F.col("same_direction"), F.col("raw")).alias("status"),
        failed_criteria(options, F.col("exact"), F.col("days"), F.col("same_direction")).alias("failed_criteria"),
        pair_reasons(options, F.col("exact"), F.col("days"), F.col("same_direction")).alias("reasons"),
        F.lit("pair").alias("route"), F.lit(None).cast("double").alias("name_score")))
    by_sum = combined.select(
        *_KEY, "bank_rows", values.half_up(F.col("score")).alias("score"), F.lit(COMBINED).alias("status"),
        F.array().cast("array<string>").alias("failed_criteria"),
        F.array(F.format_string("Matched via a combined settlement across %d bank transaction(s) / "
                                "%d invoice voucher(s)", "n_bank", "n_led")).alias("reasons"),
        F.lit("sum").alias("route"), F.lit(None).cast("double").alias("name_score"))
    found = by_pair.unionByName(by_sum)
    if mode == TWO_WAY:
        return found
    still_free = free_banks.join(
        combined.select("statement_id", F.explode("bank_rows").alias("bank_idx")), ["statement_id", "bank_idx"],
        "left_anti")
    nameless = ledger.filter(~F.col("has_anchor") & (F.col("account_name") != "")).withColumn(
        "direction", F.col("transaction_type"))
    by_name = cut(accounts.match_by_account_name(still_free, nameless, options)).select(
        *_KEY, F.array("bank_idx").alias("bank_rows"), values.half_up(F.col("score") * 100).alias("score"),
        F.lit(PARTIAL).alias("status"), F.array(F.lit("amount_date_unavailable")).alias("failed_criteria"),
        F.array().cast("array<string>").alias("reasons"), F.lit("name").alias("route"),
        F.col("score").alias("name_score"))
    return found.unionByName(by_name)


def vouchers(ledger: DataFrame, outcomes: DataFrame, mode: str, options: MatchOptions) -> DataFrame:
    """Every ledger row with its outcome, or with the reason it has none."""
    no_ledger = F.col("ledger_date").isNull() & F.col("ledger_voucher").isNull() & F.col("ledger_amount").isNull()
    no_invoice = F.col("invoice_date").isNull() & F.col("invoice_amount").isNull()
    three_way = F.lit(mode == THREE_WAY)
    missing_side = kept(F.when(no_ledger & ~no_invoice, LEDGER_MISSING),
                        F.when(no_invoice & ~no_ledger, INVOICE_MISSING))
    looked_for_name = three_way & ~F.col("has_anchor") & (F.coalesce("account_name", F.lit("")) != "")
    unmatched = (
        F.when(looked_for_name, NO_DETAILS).when(~F.col("has_anchor"), NOT_RECORDED)
        .otherwise(F.concat(
            F.lit("No bank transaction found for Amount "), text.shortest_number(F.col("anchor_amount")),
            F.lit(" around "), F.col("anchor_date"),
            F.lit(f" within the {options.tolerance_days}-day tolerance window"))))
    hit = F.col("status").isNotNull()
    by_rule = F.col("route").isin("pair", "sum")
    return ledger.join(outcomes, _KEY, "left").select(
        *_KEY, "id", "transaction_type", "invoice_no", "invoice_date", "invoice_amount", "ledger_voucher",
        "account_name", "bank_cash_account",
        F.col("anchor_amount").alias("matched_amount"), F.col("anchor_date").alias("matched_date"),
        F.coalesce("bank_rows", F.array().cast("array<bigint>")).alias("bank_rows"),
        F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("status", F.lit(UNMATCHED)).alias("status"),
        F.when(hit, F.col("failed_criteria"))
        .when(F.col("has_anchor"), F.array(F.lit("no_candidate")))
        .otherwise(F.array().cast("array<string>")).alias("failed_criteria"),
        F.when(~hit, F.array(unmatched))
        .when(three_way & by_rule, F.concat("reasons", missing_side)).otherwise(F.col("reasons")).alias("reasons"),
        "route", "name_score")


def _percent(score: Column) -> Column:
    return values.half_up(score * 100).cast("string")


def _coded(account: Column) -> Column:
    code = F.coalesce(account["code"], F.lit(""))
    return F.concat(account["name"], F.when(code == "", "").otherwise(F.concat(F.lit(" ("), code, F.lit(")"))))


def check_accounts(rows: DataFrame, ledger: DataFrame, outcomes: DataFrame, bank: DataFrame, coa: DataFrame, headers: DataFrame,
                   options: MatchOptions) -> DataFrame:
    """Both account checks of the 3-way mode; a Matched voucher that fails them becomes partial.

    ``rows`` are the vouchers of ``ledger`` with ``outcomes``. Accounts are found for the keys, names and narrations alone, which meet
    the rows by their key.
    """
    asked = ledger.select(*_KEY, "account_name", "bank_cash_account")
    first_bank = bank.select("statement_id", F.col("bank_idx").alias("first_bank"), "narration")
    told_by = outcomes.select(*_KEY, F.get("bank_rows", F.lit(0)).alias("first_bank")).join(shuffled(first_bank), ["statement_id", "first_bank"])
    # both checks in one pass: each row asks for its party in the whole chart, and for its till among bank and cash accounts
    pool, keys = F.col("pool"), ["statement_id", "pool"]
    pools = F.when(text.is_bank_or_cash(F.col("account_type")), F.array(F.lit("party"), F.lit("till"))).otherwise(F.array(F.lit("party")))
    charts = cut(coa.withColumn("pool", F.explode(pools)))
    columns = {"party": "account_name", "till": "bank_cash_account"}
    names = reduce(DataFrame.union, [asked.select("statement_id", F.lit(which).alias("pool"), F.col(column).alias("name")) for which, column in columns.items()])
    named = cut(accounts.match_by_name(names, charts, options, keys))
    base = asked.join(shuffled(told_by.select(*_KEY, "narration")), _KEY, "left")
    for which, column in columns.items():
        hit = named.filter(pool == which).select("statement_id", F.col("name").alias(column), F.struct("account", "score").alias(f"{which}_named"))
        base = base.join(shuffled(hit), ["statement_id", column], "left")
    base = cut(base)
    # only rows whose name is not found ask by their narration; one without a till asks for none
    asks = {"party": F.col("party_named").isNull(), "till": F.col("till_named").isNull() & (F.coalesce("bank_cash_account", F.lit("")) != "")}
    narrations = reduce(DataFrame.union, [base.filter(ask).select("statement_id", F.lit(which).alias("pool"), "narration") for which, ask in asks.items()])
    told = accounts.match_by_narration(narrations, charts, options, keys).groupBy("statement_id", "narration").agg(
        *[F.max(F.when(pool == which, F.struct("account", "score"))).alias(f"{which}_told") for which in columns])
    found = cut(base.join(shuffled(told), ["statement_id", "narration"], "left"))
    joined = (rows.join(shuffled(found.drop("account_name", "bank_cash_account")), _KEY, "left")
              .join(headers.select("statement_id", "bank_name"), "statement_id", "left"))
    for which, ask in asks.items():
        by_name, by_told = F.col(f"{which}_named"), F.when(ask, F.col(f"{which}_told"))
        joined = joined.withColumns({
            which: F.coalesce(by_name["account"], by_told["account"]), f"{which}_score": F.coalesce(by_name["score"], by_told["score"]),
            f"{which}_kind": F.when(by_name.isNotNull(), "name").when(by_told.isNotNull(), "fuzzy")})
    has_name = F.coalesce("account_name", F.lit("")) != ""
    has_till = F.coalesce("bank_cash_account", F.lit("")) != ""
    in_text = F.when(has_name & F.col("party").isNull(),
                     text.narration_score(F.col("narration"), F.col("account_name"), options.fuzzy_threshold))
    scored = joined.withColumns({
        "text_score": in_text,
        "bank_score": F.when(has_till & F.col("till").isNull() & (F.coalesce("bank_name", F.lit("")) != ""),
                             text.name_similarity(F.col("bank_cash_account"), F.col("bank_name"))),
    })
    by_text = F.coalesce(F.col("text_score") >= options.fuzzy_threshold, F.lit(False))
    by_bank = F.coalesce(F.col("bank_score") >= options.name_threshold, F.lit(False))
    name, till_name = F.col("account_name"), F.col("bank_cash_account")
    party_note = (
        F.when(F.col("party_kind") == "name", F.concat(F.lit("Account Name Matched from COA: "), _coded(F.col("party"))))
        .when(F.col("party_kind") == "fuzzy", F.concat(
            F.lit("Account Name Matched via narration fuzzy match against COA: "), F.col("party.name"),
            F.lit(" ("), _percent(F.col("party_score")), F.lit("% similar)")))
        .when(~has_name, NO_NAME)
        .when(by_text, F.concat(F.lit('Account Name Matched: "'), name, F.lit('" found directly in bank narration (~'),
                                _percent(F.col("text_score")), F.lit("% similar)")))
        .when(F.coalesce("narration", F.lit("")) == "", F.concat(
            F.lit('Account Name "'), name,
            F.lit('" not found in Chart of Accounts (no matched bank transaction to check narration against)')))
        .otherwise(F.concat(F.lit('Account Name "'), name, F.lit('" not found in Chart of Accounts or bank narration'))))
    till_note = (
        F.when(~has_till, F.lit(None).cast("string"))
        .when(F.col("till_kind") == "name", F.concat(
            F.lit("Bank/Cash Account matched from COA: "), _coded(F.col("till"))))
        .when(F.col("till_kind") == "fuzzy", F.concat(
            F.lit("Bank/Cash Account inferred via narration fuzzy match against COA: "), F.col("till.name"),
            F.lit(" ("), _percent(F.col("till_score")), F.lit("% similar)")))
        .when(by_bank, F.concat(F.lit("Bank/Cash Account matched to the uploaded statement's bank: "), F.col("bank_name")))
        .otherwise(F.concat(F.lit('Bank/Cash Account "'), till_name,
                            F.lit("\" not found in Chart of Accounts or the uploaded statement's bank"))))
    name_percent = _percent(F.col("name_score"))
    name_reasons = F.when(F.col("party").isNotNull(), F.array(
        F.lit(ACCOUNT_ONLY),
        F.concat(F.lit('Account Name "'), name, F.lit(
            '" confirmed against both the Chart of Accounts and the bank statement narration (~'),
            name_percent, F.lit("% similar)")))).otherwise(F.array(F.concat(
                F.lit('Account Name Matched: "'), name, F.lit('" found in bank narration (~'), name_percent,
                F.lit("% similar) — no Invoice or Ledger amount/date provided to verify further"))))
    party_ok = F.col("party").isNotNull() | by_text
    till_ok = ~has_till | F.col("till").isNotNull() | by_bank
    own = F.when(F.col("route") == "name", name_reasons).otherwise(F.col("reasons"))
    return scored.select(
        *[c for c in rows.columns if c not in ("reasons", "status")],
        F.when((F.col("status") == MATCHED) & ~(party_ok & till_ok), PARTIAL).otherwise(F.col("status")).alias("status"),
        F.concat(own, kept(party_note, till_note)).alias("reasons"),
        F.coalesce("party", F.when(by_text, F.struct(F.lit("").alias("code"), name.alias("name"), F.lit("").alias("type"))))
        .alias("party_account"),
        F.coalesce("party_kind", F.when(by_text, "narration")).alias("party_match"),
        F.coalesce("till", F.when(by_bank, F.struct(F.lit("").alias("code"), F.col("bank_name").alias("name"),
                                                    F.lit("Bank").alias("type")))).alias("till_account"),
        F.coalesce("till_kind", F.when(by_bank, "statement")).alias("till_match"),
        (party_ok & till_ok).alias("accounts_ok"))


def _account_only_vouchers(found: DataFrame, like: DataFrame) -> DataFrame:
    label = F.concat(F.lit('Account "'), F.col("account.name"), F.lit('"'),
                     F.when(F.coalesce("account.code", F.lit("")) == "", "").otherwise(
                         F.concat(F.lit(" ("), F.col("account.code"), F.lit(")"))),
                     F.lit(" found in Chart of Accounts and matched to this bank statement narration — "
                           "no Invoice or Ledger entry exists for it"))
    given = {
        "statement_id": F.col("statement_id"),
        "id": F.concat(F.lit("coa-only:"), F.col("bank_idx").cast("string")),
        "invoice_no": F.lit(""),
        "bank_rows": F.array("bank_idx"),
        "score": values.half_up(F.col("score") * 100),
        "status": F.lit(PARTIAL),
        "failed_criteria": F.array(F.lit("amount_date_unavailable"), F.lit("no_ledger_row")),
        "reasons": F.array(F.lit(ACCOUNT_ONLY), label),
        "party_account": F.col("account"),
        "party_match": F.lit("fuzzy"),
        "route": F.lit("account"),
    }
    return found.select(*[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in like.schema])


def reconcile(bank: DataFrame, ledger: DataFrame, coa: DataFrame | None = None, headers: DataFrame | None = None,
              mode: str = TWO_WAY, options: MatchOptions = MatchOptions()) -> Reconciliation:
    """Reconcile all statements at once. 3-way mode needs ``coa`` and ``headers``.

    ``bank``: statement_id, bank_idx, transaction_date, narration, debit, credit.
    ``ledger``: statement_id, led_idx, id, transaction_type, invoice_*, ledger_*, account_name,
    bank_cash_account. ``headers``: statement_id, bank_name.
    """
    keyed_bank = cut(prepare.bank_keys(bank))
    anchored = prepare.with_anchor(ledger)
    outcomes = _outcomes(keyed_bank, anchored, mode, options)
    rows = vouchers(anchored, outcomes, mode, options)
    if mode == THREE_WAY:
        rows = check_accounts(rows, anchored, outcomes, keyed_bank, coa, headers, options)
    else:
        nothing = F.lit(None)
        rows = cut(rows.withColumns({
            "party_account": nothing.cast(ACCOUNT), "party_match": nothing.cast("string"),
            "till_account": nothing.cast(ACCOUNT), "till_match": nothing.cast("string"),
            "accounts_ok": nothing.cast("boolean")}))
    invoices = settle.invoice_rollup(rows)
    taken = outcomes.select("statement_id", F.explode("bank_rows").alias("bank_idx")).distinct()
    free = keyed_bank.join(taken, ["statement_id", "bank_idx"], "left_anti")
    if mode == THREE_WAY:
        free = cut(free)
        extra = cut(accounts.unclaimed_accounts(free, coa, options))
        rows = rows.unionByName(_account_only_vouchers(extra, rows))
        free = free.join(extra.select("statement_id", "bank_idx"), ["statement_id", "bank_idx"], "left_anti")
    unmatched = free.select("statement_id", "bank_idx")
    return Reconciliation(rows, invoices, unmatched, settle.matching_stats(invoices, keyed_bank, unmatched))
