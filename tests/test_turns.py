import random

import pyarrow as pa
import pytest

from tallyspark.operators import assign
from tallyspark.operators.turns import whole_groups
from tallyspark.options import MatchOptions
from tests.test_assign import make, run


def no_rounds(*_):
    raise AssertionError("a group of this size is settled inside one task")


@pytest.mark.parametrize("options", [MatchOptions(), MatchOptions(min_score=30.0), MatchOptions(min_score=20.0, amount_weight=16.0)])
def test_groups_of_hundreds_of_rows_need_no_rounds(spark, monkeypatch, options):
    monkeypatch.setattr(assign, "_waves_by_position", no_rounds)
    monkeypatch.setattr(assign, "waves_by_level", no_rounds)
    cases = [make(50 + k, 180, 40, [100, 200]) for k in range(2)]
    for _, banks in cases:
        for b in banks[::9]:
            b.update(direction=None, cents=None)
    run(spark, cases, options, assign.GROUP_LIMIT)


def test_statements_over_the_limit_go_through_rounds(spark):
    run(spark, [make(61, 14, 9, [100, 200, 300])], MatchOptions(min_score=30.0), 0)


@pytest.mark.parametrize("together", [1, 4, 1000])
def test_tables_hold_whole_groups(together):
    rng = random.Random(together)
    rows = sorted((rng.randrange(9), rng.randrange(3)) for _ in range(200))
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    batches = [pa.RecordBatch.from_pydict({"a": [a for a, _ in part], "b": [b or None for _, b in part]}, kinds)
               for part in (rows[i:i + 7] for i in range(0, 200, 7))]
    tables = [[tuple(r.values()) for r in t.to_pylist()] for t in whole_groups(iter(batches), ["a", "b"], together)]
    assert [row for t in tables for row in t] == [(a, b or None) for a, b in rows]
    assert all(set(x).isdisjoint(y) for k, x in enumerate(tables) for y in tables[:k])
    assert len(tables) > 20 if together == 1 else len(tables) >= 1
