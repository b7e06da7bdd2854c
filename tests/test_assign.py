import random

import pytest

from tallyspark.operators import levels
from tallyspark.operators.assign import two_wave_assignment
from tallyspark.options import PURCHASE, SALES, MatchOptions
from tests.sequential import greedy

LED = "statement_id bigint, led_idx bigint, day int, cents bigint, direction string"
BANK = "statement_id bigint, bank_idx bigint, day int, cents bigint, direction string"


def make(seed, n, days, amounts):
    rng = random.Random(seed)

    def rows():
        return [dict(idx=i, day=rng.randrange(days), cents=rng.choice(amounts),
                     direction=rng.choice([SALES, SALES, PURCHASE])) for i in range(n)]
    return rows(), rows()


def run(spark, cases, options, limit):
    leds = [(s, r["idx"], r["day"], r["cents"], r["direction"]) for s, (ls, _) in enumerate(cases) for r in ls]
    banks = [(s, r["idx"], r["day"], r["cents"], r["direction"]) for s, (_, bs) in enumerate(cases) for r in bs]
    out = two_wave_assignment(spark.createDataFrame(banks, BANK), spark.createDataFrame(leds, LED),
                              options, group_limit=limit).collect()
    got = {}
    for r in out:
        assert (r.statement_id, r.led_idx) not in got
        got[(r.statement_id, r.led_idx)] = (r.bank_idx, r.same_direction)
    want = {(s, led): v for s, (ls, bs) in enumerate(cases) for led, v in greedy(ls, bs, options).items()}
    assert got == want


@pytest.mark.parametrize("limit", [10_000, 20])
def test_equal_amounts(spark, limit):
    cases = [make(seed, 40, 25, [100, 200, 300]) for seed in range(3)]
    run(spark, cases, MatchOptions(), limit)


def test_dense_group_by_position(spark):
    run(spark, [make(7, 20, 6, [100])], MatchOptions(), 0)


def test_low_minimum_score_lets_unequal_amounts_match(spark):
    cases = [make(20, 14, 12, [100, 200, 300, 400, 500])]
    run(spark, cases, MatchOptions(min_score=30.0), 64)


@pytest.mark.parametrize("options, limit", [
    (MatchOptions(min_score=1.0, amount_weight=8.0), 64),  # equal amounts score as much as one day less
    (MatchOptions(min_score=20.0, amount_weight=16.0, date_weight=40.0), 64),
    (MatchOptions(min_score=5.0, amount_weight=0.0), 64),  # amounts count for nothing
    (MatchOptions(min_score=30.0, date_weight=0.0), 0),  # all days score the same, large groups
    (MatchOptions(min_score=30.0, date_weight=0.0), 10_000),
    (MatchOptions(min_score=0.0, amount_weight=10.0, direction_weight=0.0, tolerance_days=2), 64),
])
def test_kinds_of_pair_with_the_same_score(spark, options, limit):
    run(spark, [make(30 + k, 16, 12, [100, 200, 300]) for k in range(3)], options, limit)


@pytest.mark.parametrize("options", [MatchOptions(min_score=30.0), MatchOptions(min_score=1.0, amount_weight=8.0), MatchOptions()])
def test_bank_rows_without_a_direction_are_left_to_the_second_wave(spark, options):
    cases = []
    for k in range(3):
        leds, banks = make(40 + k, 16, 10, [100, 200, 300, 400])
        for b in banks[::3]:
            b.update(direction=None, cents=None)
        leds[0]["cents"] = banks[1]["cents"] = None
        banks[4]["day"] = None
        cases.append((leds, banks))
    run(spark, cases, options, 64)


def test_rounds_of_a_level_do_not_grow_with_the_rows_of_a_day(spark, monkeypatch):
    rounds = []
    plain = levels._round
    monkeypatch.setattr(levels, "_round", lambda *a: rounds.append(1) or plain(*a))
    n = 300
    leds = [dict(idx=i, day=i % 2, cents=1000 + i, direction=SALES) for i in range(n)]
    banks = [dict(idx=i, day=i % 2, cents=5000 + i, direction=SALES if i % 3 else None) for i in range(n)]
    run(spark, [(leds, banks)], MatchOptions(min_score=30.0, tolerance_days=3), 64)
    assert len(rounds) < 40
