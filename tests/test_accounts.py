"""Similarity joins and account resolution against all pairs."""

import random
import re

import pytest

from tallyspark.operators import accounts, similar
from tallyspark.options import MatchOptions


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def alike(a, b):
    return 1.0 - distance(a, b) / max(len(a), len(b)) if a and b else 0.0


def alnum(s):
    return re.sub("[^a-z0-9]", "", s.lower())


def name_score(a, b):
    a, b = a.lower().strip(), b.lower().strip()
    if not a or not b:
        return 0.0
    x, y = alnum(a), alnum(b)
    if a == b or (x and x == y):
        return 1.0
    if x and y:
        return 0.95 if min(len(x), len(y)) >= 4 and (x in y or y in x) else alike(x, y)
    return alike(a, b)


def narration_score(n, a):
    n, a = n.lower().strip(), a.lower().strip()
    if not n or not a:
        return 0.0
    if a in n:
        return 1.0
    if len(alnum(a)) >= 4 and alnum(a) in alnum(n):
        return 0.95
    best = 0.0
    for w in a.split():
        if len(w) >= 4:
            best = max(best, 0.85 if w in n else max([alike(w, x) for x in n.split() if len(x) >= 4], default=0.0))
    return best


def best_of(chart, score, least):
    """Index and score of the best account, the first on ties."""
    top = max(((score(name), -i) for i, name in chart), default=(0.0, 0))
    return (-top[1], top[0]) if top[0] >= least else None


def words_of(rnd, n, letters="abcd", low=1, high=12):
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(low, high))) for _ in range(n)]


@pytest.mark.parametrize("least", [0.6, 0.75, 0.9])
def test_near_against_all_pairs(spark, least):
    rnd = random.Random(int(least * 100))
    left, right = words_of(rnd, 150) + ["", "abcdabcdabcdabcdabcdabcdabcd"], words_of(rnd, 150) + ["", "abcdabcdabcdabcdabcxabcdabcd"]
    a = spark.createDataFrame([(i % 2, x) for i, x in enumerate(left)], "g long, a string")
    b = spark.createDataFrame([(i % 2, x) for i, x in enumerate(right)], "g long, b string")
    want = {(g, x, y, alike(x, y)) for g in (0, 1) for x in set(left[g::2]) for y in set(right[g::2]) if alike(x, y) >= least}
    got = [tuple(r) for r in similar.near(a, b, ["g"], least).collect()]
    assert len(got) == len(set(got)) and {(g, x, y) for g, x, y, _ in got} == {w[:3] for w in want}
    assert {r[:3]: pytest.approx(r[3]) for r in want} == {r[:3]: r[3] for r in got}


def test_containment_against_all_pairs(spark):
    rnd = random.Random(8)
    texts, patterns = words_of(rnd, 120, "ab c", 0, 30), words_of(rnd, 120, "ab c", 0, 7) + [" ", "é"]
    t = spark.createDataFrame([(i % 2, x) for i, x in enumerate(texts)], "g long, text string")
    p = spark.createDataFrame([(i % 2, x) for i, x in enumerate(patterns)], "g long, pattern string")
    want = {(g, x, y) for g in (0, 1) for x in texts[g::2] for y in patterns[g::2] if x and y and y in x}
    got = [tuple(r) for r in similar.containing(t, p, ["g"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want


PARTS = ["Customer", "Custmer", "Acme", "ACME Ltd", "acme-ltd", "Petty Cash", "petty", "Cash in Hand", "Bank", "NATION_3", "Tidewater Mutual Operating",
         "Tidewatr", "hp", "é", "日本", "日本語", "-", "12", "Incomprehensibilities Unlimited", "incomprehensibilitie", "x1"]


def phrase(rnd, most=3):
    return rnd.choice([" ", "-", "  "]).join(rnd.choice(PARTS) + (str(rnd.randint(1, 30)) if rnd.random() < 0.4 else "") for _ in range(rnd.randint(1, most)))


@pytest.mark.parametrize("seed, name_least, fuzzy_least", [(1, 0.75, 0.6), (2, 0.5, 0.9), (3, 0.97, 0.96)])
def test_resolution_against_all_pairs(spark, seed, name_least, fuzzy_least):
    rnd = random.Random(seed)
    options = MatchOptions(name_threshold=name_least, fuzzy_threshold=fuzzy_least)
    charts = {s: [(i, phrase(rnd, 2)) for i in range(25)] + [(30, ""), (31, None)] for s in range(3)}
    asked = {s: {phrase(rnd) for _ in range(60)} | {"", "   "} for s in range(4)}
    texts = {s: {f"neft-{rnd.randint(1, 99)}-{phrase(rnd)}".upper() if rnd.random() < 0.5 else phrase(rnd, 4) for _ in range(60)} | {""} for s in range(4)}
    coa = spark.createDataFrame([(s, i, f"C{i}", n, "Asset", None) for s, c in charts.items() for i, n in c],
                                "statement_id long, coa_idx long, account_code string, account_name string, account_type string, parent_group string")
    names = spark.createDataFrame([(s, n) for s, a in asked.items() for n in [*a, None]], "statement_id long, name string")
    narrations = spark.createDataFrame([(s, n) for s, a in texts.items() for n in [*a, None]], "statement_id long, narration string")
    chart = {s: [(i, n or "") for i, n in c] for s, c in charts.items()}
    want = {(s, n): best_of(chart.get(s, []), lambda a: name_score(n, a), name_least) for s, a in asked.items() for n in a if n}
    got = {(r["statement_id"], r["name"]): (int(r["account"]["code"][1:]), r["score"]) for r in accounts.match_by_name(names, coa, options).collect()}
    assert got == {k: (v[0], pytest.approx(v[1])) for k, v in want.items() if v}
    want = {(s, n): best_of(chart.get(s, []), lambda a: narration_score(n, a), fuzzy_least) for s, a in texts.items() for n in a if n}
    found = accounts.match_by_narration(narrations, coa, options).collect()
    got = {(r["statement_id"], r["narration"]): (int(r["account"]["code"][1:]), r["score"]) for r in found}
    assert got == {k: (v[0], pytest.approx(v[1])) for k, v in want.items() if v}


@pytest.mark.parametrize("seed, per_round, least", [(1, 1000, 0.6), (2, 7, 0.6), (3, 5, 0.8), (4, 6, 0.96)])
def test_rows_with_only_a_name_choose_in_order(spark, seed, per_round, least):
    rnd = random.Random(seed)
    ways = ["Sales Receipt", "Purchase Payment"]
    bank = [(s, i, rnd.choice([*ways, None]), rnd.choice([phrase(rnd, 2), "neft customer", "NEFT-Acme Ltd", None, ""])) for s in range(3) for i in range(40)]
    leds = [(s, i, rnd.choice(ways), rnd.choice([phrase(rnd, 2), "Customer", "Acme", "acme-ltd", "", None])) for s in range(4) for i in range(40)]
    want = {}
    for s in range(4):
        used = set()
        for _, led, way, name in [r for r in leds if r[0] == s]:
            pool = [(narration_score(n or "", name or ""), -i) for x, i, w, n in bank if x == s and w == way and i not in used]
            top = max(pool, default=(0.0, 0))
            if name and top[0] >= least:
                want[(s, led)] = (-top[1], pytest.approx(top[0]))
                used.add(-top[1])
    banks = spark.createDataFrame(bank, "statement_id long, bank_idx long, direction string, narration string")
    rows = spark.createDataFrame(leds, "statement_id long, led_idx long, direction string, account_name string")
    found = accounts.match_by_account_name(banks, rows, MatchOptions(fuzzy_threshold=least), per_round).collect()
    assert {(r["statement_id"], r["led_idx"]): (r["bank_idx"], r["score"]) for r in found} == want and len(found) == len(want)
    assert accounts.match_by_account_name(banks, rows.limit(0)).count() == 0


def test_one_edit_equals_all_pairs(spark):
    rng = random.Random(8)
    texts = sorted({"".join(rng.choice("ab1") for _ in range(rng.randint(1, 7))) for _ in range(160)})
    left, right = texts[::2], texts[1::2] + texts[:20:2]
    frames = [spark.createDataFrame([(1, t) for t in side], f"statement_id int, {name} string") for side, name in ((left, "a"), (right, "b"))]
    got = {(r.a, r.b): r.score for r in similar.one_edit(*frames, ["statement_id"], 0.5).collect()}
    assert got == pytest.approx({(a, b): alike(a, b) for a in left for b in right if distance(a, b) <= 1 and alike(a, b) >= 0.5})


def test_names_with_an_account_at_one_edit_ask_for_no_others(spark, monkeypatch):
    """Numbered names resemble a large part of the chart; only names without a nearer account meet that part."""
    asked, near = [], similar.near
    monkeypatch.setattr(similar, "near", lambda left, *more: asked.append({r.a for r in left.collect()}) or near(left, *more))
    coa = spark.createDataFrame([(1, i, f"C{i}", f"Customer {10_000 + 10 * i}", "Debtors") for i in range(200)],
                                "statement_id int, coa_idx int, account_code string, account_name string, account_type string")
    names = spark.createDataFrame([(1, f"Customer {10_005 + 10 * i}") for i in range(200)] + [(1, "Custmer 10007")], "statement_id int, name string")
    found = {r.name: (r.account.code, r.score) for r in accounts.match_by_name(names, coa).collect()}
    assert set().union(*asked) == {"custmer10007"}
    for name, (code, score) in found.items():
        best = max((alike(alnum(name), alnum(f"Customer {10_000 + 10 * i}")), -i) for i in range(200))
        assert (code, score) == (f"C{-best[1]}", pytest.approx(best[0]))
    assert len(found) == 201


def test_charts_are_not_gathered_in_the_driver(spark):
    """A written chart is a small part of its rows in memory: joins with it are shuffled, however few bytes it has."""
    coa = spark.createDataFrame([(1, i, f"C{i}", f"Customer {i}", "Debtors") for i in range(20)],
                                "statement_id int, coa_idx int, account_code string, account_name string, account_type string")
    best = accounts._best_account(coa.selectExpr("statement_id", "account_name as name", "1D as score", "coa_idx"), coa, "name", ["statement_id"])
    assert "BroadcastHashJoin" not in best._jdf.queryExecution().executedPlan().toString() and best.count() == 20


def test_words_that_only_resemble_are_looked_up_for_names_that_need_them(spark, monkeypatch):
    """Numbers resemble a large part of all numbers; a name whose held word is free on enough bank rows does not ask for them."""
    asked, near = [], similar.near
    monkeypatch.setattr(similar, "near", lambda left, right, keys, least: asked.append((least, {r.b for r in right.collect()})) or near(left, right, keys, least))
    banks = spark.createDataFrame([(1, i, "Sales Receipt", f"neft customer {10_000 + 10 * i}") for i in range(30)] + [(1, 30, "Sales Receipt", "Acme Tidewatr")],
                                  "statement_id long, bank_idx long, direction string, narration string")
    names = [f"Customer {20_005 + 10 * i}" for i in range(20)] + ["Tidewater"] * 2 + ["Customer 10290"]
    leds = spark.createDataFrame([(1, i, "Sales Receipt", n) for i, n in enumerate(names)], "statement_id long, led_idx long, direction string, account_name string")
    found = {r.led_idx: (r.bank_idx, r.score) for r in accounts.match_by_account_name(banks, leds).collect()}
    assert found == {**{i: (i, 0.85) for i in range(20)}, 20: (30, pytest.approx(alike("tidewater", "tidewatr"))), 22: (29, 1.0)}
    low = [words for least, words in asked if least < accounts.WORD_HELD]
    assert low and all(words == {"tidewater"} for words in low)
