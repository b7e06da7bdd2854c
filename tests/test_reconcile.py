"""Reconciliation of small statements. Expected results follow from the rules and the default options, stated next to each case."""

from datetime import date, timedelta

import pytest

from tallyspark.options import FULLY, MATCHED, NEEDS_REVIEW, NOT_SETTLED, OVERPAID, PARTIAL, PARTLY, PURCHASE, SALES, UNMATCHED, MatchOptions
from tallyspark.plans import report
from tallyspark.plans.reconcile import reconcile

RULES = MatchOptions()
DAY = date(2031, 8, 20)
COLUMNS = {
    "bank": "statement_id bigint, bank_idx bigint, transaction_date string, narration string, reference_number string, debit double, credit double",
    "ledger": "statement_id bigint, led_idx bigint, id string, transaction_type string, invoice_no string, invoice_date string, invoice_amount double, "
              "ledger_date string, ledger_voucher string, ledger_amount double, account_name string, bank_cash_account string",
    "coa": "statement_id bigint, coa_idx bigint, account_code string, account_name string, account_type string, parent_group string",
    "head": "statement_id bigint, bank_name string",
}
FERRY = ("7400", "QUILLON FERRYWORKS", "Sundry Debtors", None)
TIDE = ("5100", "Tidewater Mutual Operating A/c", "Bank", None)


def after(days):
    return str(DAY + timedelta(days=days))


def paid_in(value, days=0, text="TRF 0457 QUILLON FERRYWORKS"):
    return after(days), text, "0457", None, value


def paid_out(value, days=0, text="TRF 0458 QUILLON FERRYWORKS"):
    return after(days), text, "0458", value, None


def voucher(value, days=0, kind=SALES, bill="F/77", billed=None, billed_days=-9, party=None, till=None):
    """A voucher of `value`; None is a bill that nothing has been booked for yet."""
    booked = (after(days), f"V{days}", value) if value is not None else (None, None, None)
    return (kind, bill, after(billed_days) if billed_days is not None else None, billed, *booked, party, till)


class Statements:
    """Several statements reconciled in one run; results are looked up by name."""

    def __init__(self, spark, mode):
        self.spark, self.mode, self.names, self.rows = spark, mode, [], {k: [] for k in COLUMNS}

    def add(self, name, bank=(), ledger=(), coa=(), bank_name=None):
        s = len(self.names)
        self.names.append(name)
        self.rows["bank"] += [(s, i, *b) for i, b in enumerate(bank)]
        self.rows["ledger"] += [(s, i, f"{name}-{i}", *v) for i, v in enumerate(ledger)]
        self.rows["coa"] += [(s, i, *c) for i, c in enumerate(coa)]
        self.rows["head"].append((s, bank_name))

    def run(self):
        self.frames = {k: self.spark.createDataFrame(v, COLUMNS[k]) for k, v in self.rows.items()}
        self.done = reconcile(*(self.frames[k] for k in ("bank", "ledger", "coa", "head")), self.mode)
        by_order = sorted(self.done.vouchers.collect(), key=lambda v: (v.led_idx is None, v.led_idx))
        self.found = {n: [v for v in by_order if v.statement_id == s] for s, n in enumerate(self.names)}
        self.bills = {(self.names[i.statement_id], i.invoice_no): i for i in self.done.invoices.collect()}
        self.free = {(self.names[u.statement_id], u.bank_idx) for u in self.done.unmatched_bank.collect()}
        self.counts = {self.names[x.statement_id]: x for x in self.done.stats.collect()}
        return self


@pytest.fixture(scope="module")
def two_way(spark):
    s = Statements(spark, "2-way")
    for d in range(8):
        s.add(f"later {d}", [paid_in(612.4, d)], [voucher(612.4, billed=612.4)])
        s.add(f"earlier {d}", [paid_out(88.0, -d)], [voucher(88.0, kind=PURCHASE, billed=88.0)])
        s.add(f"wrong way {d}", [paid_out(455.5, d)], [voucher(455.5, billed=455.5)])
    # the nearer day wins whatever the index; on one day the lower index wins
    s.add("nearer", [paid_in(70.0, 3), paid_in(70.0, 1), paid_in(70.0, 1)], [voucher(70.0)] * 2)
    s.add("too many", [paid_in(70.0)], [voucher(70.0)] * 3)
    for legs in (2, 3, 4):
        parts = [100.0 + 7 * k for k in range(legs)]
        s.add(f"split {legs}", [paid_in(p, k) for k, p in enumerate(parts)], [voucher(sum(parts), billed=sum(parts))])
        s.add(f"pooled {legs}", [paid_in(sum(parts))], [voucher(p, billed=sum(parts)) for p in parts])
    s.add("sum crosses directions", [paid_in(40.0), paid_out(60.0)], [voucher(100.0)])
    # what a bill is worth against what was settled for it
    s.add("bills", [paid_in(30.0), paid_in(20.5), paid_in(900.0), paid_in(64.0)], [
        voucher(30.0, bill="half", billed=75.0), voucher(20.5, bill="worthless", billed=None), voucher(900.0, bill="too much", billed=890.0),
        voucher(64.0, bill="whole", billed=64.0), voucher(None, bill="open", billed=51.0), voucher(17.0, bill="whole", billed=64.0, days=400)])
    s.add("no numbers", [paid_in(5.5)], [voucher(5.5, bill="", billed=5.5), voucher(6.5, bill="", billed=9.0, days=90)])
    # a bill without a booking is looked for by its own date and amount; without these there is nothing to look for
    s.add("bill only", [paid_out(321.0, -9)], [voucher(None, kind=PURCHASE, billed=321.0)])
    s.add("nothing", [], [voucher(None, bill="", billed_days=None)])
    s.add("empty date", [paid_in(2.0)], [(SALES, "F/77", after(-9), 2.0, "", "V", 2.0, None, None)])
    return s.run()


@pytest.mark.parametrize("name, sign", [("later", 1), ("earlier", 1), ("wrong way", 0)])
@pytest.mark.parametrize("days", range(8))
def test_distance_and_direction(two_way, name, sign, days):
    score = 50 + RULES.date_score(days) + 10 * sign
    case, (got,) = f"{name} {days}", two_way.found[f"{name} {days}"]
    if days > RULES.tolerance_days or score < RULES.min_score:
        assert (got.status, got.bank_rows) == (UNMATCHED, []) and (case, 0) in two_way.free
        return
    whole = sign and score >= RULES.matched_score
    assert (got.status, got.score, got.bank_rows) == (MATCHED if whole else PARTIAL, score, [0])
    assert set(got.failed_criteria) == {c for c, bad in (("date_out_of_range", days >= 5), ("direction_mismatch", not sign)) if bad}
    assert two_way.bills[case, "F/77"].status == (FULLY if whole else NOT_SETTLED)


def test_order_of_choice(two_way):
    assert [v.bank_rows for v in two_way.found["nearer"]] == [[1], [2]] and ("nearer", 0) in two_way.free
    assert [v.bank_rows for v in two_way.found["too many"]] == [[0], [], []]
    assert two_way.found["too many"][2].reasons == [
        f"No bank transaction found for Amount 70 around {DAY} within the 5-day tolerance window"]


@pytest.mark.parametrize("legs", [2, 3, 4])
def test_sums_of_up_to_three(two_way, legs):
    split, pooled = two_way.found[f"split {legs}"], two_way.found[f"pooled {legs}"]
    if legs > RULES.max_combination:
        assert [v.status for v in split + pooled] == [UNMATCHED] * (1 + legs)
        return
    assert split[0].bank_rows == list(range(legs)) and {v.status for v in split + pooled} == {"Matched (combined)"}
    assert [v.bank_rows for v in pooled] == [[0]] * legs
    assert two_way.bills[f"split {legs}", "F/77"].status == two_way.bills[f"pooled {legs}", "F/77"].status == FULLY


def test_sums_keep_to_one_direction(two_way):
    assert two_way.found["sum crosses directions"][0].status == UNMATCHED


def test_bills(two_way):
    def bill(number):
        b = two_way.bills["bills", number]
        return b.status, b.total_settled, b.outstanding

    assert bill("half") == (PARTLY, 30.0, 45.0)
    assert bill("worthless")[0] == NEEDS_REVIEW
    assert bill("too much")[0] == OVERPAID and two_way.bills["bills", "too much"].mismatch_amount == 10.0
    assert bill("whole") == (FULLY, 64.0, 0.0)
    assert bill("open") == (NOT_SETTLED, 0.0, 51.0)
    assert two_way.bills["no numbers", ""].n_vouchers == 2
    assert two_way.counts["later 0"].matched_bank_txns == 1 and two_way.counts["later 0"].fully_settled == 1


def test_rows_without_a_booking(two_way):
    (only,), (nothing,), (blank,) = (two_way.found[n] for n in ("bill only", "nothing", "empty date"))
    assert (only.status, only.matched_amount) == (MATCHED, 321.0)
    assert nothing.reasons == ["No settlement recorded for this invoice yet"] and nothing.failed_criteria == []
    assert blank.status == UNMATCHED and ("empty date", 0) in two_way.free


def test_every_bank_row_is_used_once_and_sums_hold(two_way):
    bank, done = two_way.frames["bank"], two_way.done
    used = [(v.statement_id, b) for v in done.vouchers.filter("status != 'Matched (combined)'").collect() for b in v.bank_rows]
    assert len(used) == len(set(used))
    for i in done.invoices.filter("invoice_amount is not null").collect():
        assert i.total_settled + i.outstanding - i.mismatch_amount == pytest.approx(i.invoice_amount)
    results = report.bank_results(bank, done.vouchers)
    assert results.count() == bank.count()
    assert results.filter("rank = 2").count() == done.unmatched_bank.count()


@pytest.fixture(scope="module")
def three_way(spark):
    s = Statements(spark, "3-way")
    ferry, tide = FERRY[1], TIDE[1]

    def pair(party=ferry, till=None, value=19.75, **kw):
        return [paid_in(value)], [voucher(value, billed=value, party=party, till=till, **kw)]

    # both accounts must be found: the party's, and the bank's in the chart or on the statement
    s.add("both", *pair(till=tide), [FERRY, TIDE])
    s.add("till missing", *pair(till=tide), [FERRY])
    s.add("till of the statement", *pair(till="Tidewater"), [FERRY], "Tidewater")
    s.add("other till", *pair(till="Granite Savings"), [FERRY], "Tidewater")
    # a party that no chart has counts if the narration spells it, punctuation aside
    s.add("party in the text", [paid_out(63.2, text="CLG/OS TANNERY/991")],
          [voucher(63.2, kind=PURCHASE, billed=99.0, party="O.S.TANNERY", till="TM")], (), "TM")
    # rows with a name alone take the bank row that names them best, in index order, as long as there are any
    s.add("name alone", [paid_out(500.0, text="NEFT-12-QUILLON FERRYWORKS LTD")], [voucher(None, kind=PURCHASE, bill="", billed_days=None, party=ferry)])
    s.add("name in chart", [paid_out(500.0, text="NEFT-12-QUILLON FERRYWORKS LTD")],
          [voucher(None, kind=PURCHASE, bill="", billed_days=None, party=ferry)], [FERRY])
    s.add("names in turn", [paid_in(8.0, text=f"{ferry} {k}") for k in range(2)], [voucher(None, bill="", billed_days=None, party=ferry)] * 3)
    # bank rows that nobody claims are named by the chart
    s.add("chart alone", [paid_in(44.0, text="NEFT/QUILLON FERRYWORKS/3")], (), [FERRY])
    s.add("chart silent", [paid_in(44.0, text="NEFT/PERIWINKLE/3")], (), [FERRY])
    s.add("not booked", [paid_in(27.0, -9)], [voucher(None, billed=27.0, party=ferry)])
    s.add("not billed", *pair(billed_days=None)[:1], [(SALES, "F/77", None, None, after(0), "V", 19.75, ferry, None)])
    return s.run()


def test_accounts(three_way):
    got = {name: rows[0] if rows else None for name, rows in three_way.found.items()}
    assert {n: (got[n].status, got[n].accounts_ok) for n in ("both", "till missing")} == {"both": (MATCHED, True), "till missing": (PARTIAL, False)}
    assert any("Bank/Cash Account" in r for r in got["till missing"].reasons)
    assert (got["till of the statement"].till_match, got["till of the statement"].till_account.name) == ("statement", "Tidewater")
    assert got["other till"].status == PARTIAL
    spelt = got["party in the text"]
    assert (spelt.status, spelt.party_match, spelt.party_account.name, spelt.till_match) == (MATCHED, "narration", "O.S.TANNERY", "statement")
    assert three_way.bills["party in the text", "F/77"].status == PARTLY


def test_names_and_missing_sides(three_way):
    got = {name: rows[0] if rows else None for name, rows in three_way.found.items()}
    alone = got["name alone"]
    assert (alone.status, alone.failed_criteria, alone.score) == (PARTIAL, ["amount_date_unavailable"], 100)
    assert any("Account Name Matched" in r and "%" in r for r in alone.reasons)
    assert "Account Matched, Missing Invoice & Ledger" in got["name in chart"].reasons
    assert [v.bank_rows for v in three_way.found["names in turn"]] == [[0], [1], []]
    chart = got["chart alone"]
    assert (chart.id, chart.status, chart.bank_rows, chart.party_account.name) == ("coa-only:0", PARTIAL, [0], FERRY[1])
    assert got["chart silent"] is None and ("chart silent", 0) in three_way.free and ("chart alone", 0) not in three_way.free
    assert "Receipt / Payment Ledger is missing" in got["not booked"].reasons
    assert "Invoice details missing" in got["not billed"].reasons
