import random
from itertools import combinations

import pytest

from tallyspark.operators.combine import first_sum, settle_by_sum
from tallyspark.options import PURCHASE, SALES, MatchOptions
from tests import sequential

ROW = "statement_id bigint, direction string, day int, idx bigint, cents bigint"


def run(spark, cases, options, segment=512):
    def frame(side):
        return spark.createDataFrame(
            [(s, r["direction"], r["day"], r["idx"], r["cents"]) for s, c in enumerate(cases) for r in c[side]], ROW)
    got = {(r.statement_id, r.idx): tuple(r.rows) for r in settle_by_sum(frame(0), frame(1), options, segment).collect()}
    want = {(s, i): combo for s, c in enumerate(cases)
            for i, combo in sequential.settle_by_sum(c[0], c[1], options).items()}
    assert got == want
    return want


def make(seed, n_targets, n_pool, days):
    rng = random.Random(seed)

    def rows(n, low, high):
        return [dict(idx=i, day=rng.randrange(days), cents=rng.randrange(low, high) * 100,
                     direction=rng.choice([SALES, PURCHASE])) for i in range(n)]
    return rows(n_targets, 2, 14), rows(n_pool, 1, 8)


@pytest.mark.parametrize("segment", [512, 3, 0])
def test_conflicting_pools(spark, segment):
    assert run(spark, [make(s, 12, 14, 20) for s in range(6)], MatchOptions(), segment)


def test_segments_do_not_touch(spark):
    """Many far apart days in one lane are one pass, whatever their number, and equal the sequential order."""
    case = make(9, 80, 260, 500)
    assert run(spark, [case], MatchOptions())
    assert run(spark, [case], MatchOptions(), 2)


def test_first_sums_are_those_of_all_combinations():
    rng = random.Random(4)
    for _ in range(400):
        amounts, target = [rng.randint(-3, 9) for _ in range(rng.randint(0, 9))], rng.randint(0, 20)
        for most in (2, 3):
            want = next((c for n in range(2, most + 1) for c in combinations(range(len(amounts)), n) if sum(amounts[i] for i in c) == target), None)
            assert first_sum(amounts, target, most) == want


def test_pools_that_only_become_small_enough_at_their_turn(spark):
    assert run(spark, [make(s, 14, 30, 16) for s in range(30, 34)], MatchOptions(max_pool=7))


def test_pairs_only(spark):
    assert run(spark, [make(s, 8, 12, 15) for s in range(60, 63)], MatchOptions(max_combination=2))


def test_nothing_fits(spark):
    assert run(spark, [make(5, 5, 200, 3)], MatchOptions()) == {}


def test_many_targets_of_a_small_pool_do_not_let_a_large_day_in(spark):
    """Takers cannot take more rows than their pools hold: two here, whatever their number."""
    from tallyspark.operators.combine import _contenders

    targets = [(0, SALES, 100, i, 900) for i in range(300)] + [(0, SALES, 108, 300 + i, 900) for i in range(3)]
    pool = [(0, SALES, 103, 0, 400), (0, SALES, 104, 1, 500)] + [(0, SALES, 110, 2 + i, 400 + i % 3) for i in range(400)]
    frames = [spark.createDataFrame(rows, ROW) for rows in (targets, pool)]
    gathered = _contenders(*frames, MatchOptions()).collect()
    assert len(gathered) == 300 and {len(r.pool) for r in gathered} == {2}
    settled = settle_by_sum(*frames, MatchOptions()).collect()
    assert [(r.idx, list(r.rows)) for r in settled] == [(0, [0, 1])]


@pytest.mark.parametrize("segment", [512, 3, 0])
def test_lanes_over_the_limit_go_by_segments(spark, segment):
    cases = [make(s, 12, 14, 20) for s in range(70, 74)]
    frames = [spark.createDataFrame([(s, r["direction"], r["day"], r["idx"], r["cents"]) for s, c in enumerate(cases) for r in c[side]], ROW)
              for side in (0, 1)]
    by_limit = [{(r.statement_id, r.idx): tuple(r.rows) for r in settle_by_sum(*frames, MatchOptions(), segment, lane).collect()} for lane in (0, 9, 1 << 20)]
    assert by_limit[0] == by_limit[1] == by_limit[2] and by_limit[0]


def test_dense_lanes_need_no_search_of_contenders(spark, monkeypatch):
    """Pools around the limit on every day: what earlier targets may take is not bounded first, the lane is replayed."""
    from tallyspark.operators import combine

    monkeypatch.setattr(combine, "_contenders", lambda *_: pytest.fail("a lane of this size is replayed in one task"))
    assert run(spark, [make(s, 300, 420, 150) for s in range(80, 82)], MatchOptions())


def test_targets_whose_pool_never_fits_are_not_looked_at(monkeypatch):
    """A dense lane costs array work alone: only targets whose pool is, or becomes, small enough take a turn."""
    import numpy as np

    from tallyspark.operators import combine

    looked = []
    pop = combine.heapq.heappop
    monkeypatch.setattr(combine.heapq, "heappop", lambda heap: looked.append(1) or pop(heap))
    rng = np.random.default_rng(1)
    dense = rng.integers(0, 200, 40_000)
    day, is_target = np.concatenate([dense, [900] * 18]).astype(np.int32), np.concatenate([dense % 2 == 0, [True, True] + [False] * 16])
    cents = np.concatenate([rng.integers(1, 9, 40_000), [30, 30], [10, 20] * 8]).astype(np.int64)
    options = MatchOptions(max_pool=16)
    assert combine._turns(day, np.arange(len(day)), cents, is_target, options, 3) == [(40_000, [40_002, 40_003]), (40_001, [40_004, 40_005])]
    assert len(looked) == 2
