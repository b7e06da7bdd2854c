"""Groups whose rows take their turn: whole groups as Arrow tables, and the greedy assignment inside them.

Rows are dealt by their group and sorted by it, so a task streams its groups and holds a few of them, or one large one. The
callers bound the rows of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.levels import levels
from tallyspark.options import MatchOptions

#: Rows of small groups that are settled together.
TOGETHER = 1 << 17


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with equal keys side by side. The number of tasks is fixed, as the work of a row exceeds its bytes by far."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], together: int = TOGETHER) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that come sorted by ``keys``: ``together`` rows of them, or one larger group."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        end = [c[-1].as_py() for c in columns]
        same = np.ones(batch.num_rows, bool)
        for column, value in zip(columns, end):
            same &= (pc.is_null(column) if value is None else pc.fill_null(pc.equal(column, value), False)).to_numpy(zero_copy_only=False)
        start = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
        if n + start >= together and (start or last != end):
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held, n, batch = [], 0, batch.slice(start)
        held.append(batch)
        n, last = n + batch.num_rows, end
    if held:
        yield pa.Table.from_batches(held)


def codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


class _Queues:
    """Places of bank rows by a key, the lowest first, and how many of each key are free at the start of a level."""

    def __init__(self, keys: np.ndarray, places: np.ndarray):
        by_key = np.lexsort((places, keys))
        self.keys, self.starts = np.unique(keys[by_key], return_index=True)
        self.rows = places[by_key]
        self.head, self.end = self.starts.copy(), np.append(self.starts[1:], len(keys)).astype(np.int64)

    def refresh(self, taken: np.ndarray) -> None:
        self.left = np.add.reduceat(~taken[self.rows], self.starts, dtype=np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The queue of each key, -1 where none has free rows."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (self.left[at] > 0), at, -1)

    def take(self, wanting: np.ndarray, sees: np.ndarray, taken: np.ndarray) -> tuple[list[int], list[int]]:
        """Ledger rows in turn, each with the lowest free bank row of the queues it sees."""
        rows, head, end, used = (memoryview(x) for x in (self.rows, self.head, self.end, taken.view(np.uint8)))
        leds, banks = [], []
        for led, seen in zip(wanting.tolist(), sees.tolist()):
            best = -1
            for q in seen:
                if q < 0:
                    continue
                at, stop = head[q], end[q]
                while at < stop and used[rows[at]]:
                    at += 1
                head[q] = at
                if at < stop and (best < 0 or rows[at] < best):
                    best = rows[at]
            if best >= 0:
                used[best] = 1
                leds.append(led)
                banks.append(best)
        return leds, banks


def assigned(rows: pa.Table, options: MatchOptions) -> pa.Table:
    """Both waves in whole statements, or in whole (statement, amount) groups where only equal amounts can match.

    At one score level every ledger row in turn takes the first free bank row it sees: at the level's day distances, of its
    amount if its window holds that amount at the start of the wave, else of any amount.
    """
    rows = rows.combine_chunks()
    tolerance, waves = options.tolerance_days, {same: levels(options, same) for same in (True, False)}
    statement, direction, amount = (codes(rows[c]) for c in ("statement_id", "direction", "cents"))
    unknown, no_way = (pc.is_null(rows[c]).to_numpy() for c in ("cents", "direction"))
    idx, day = rows["idx"].to_numpy(), rows["day"].to_numpy().astype(np.int64)
    in_turn = np.lexsort((idx, statement))
    is_led = rows["is_led"].to_numpy()[in_turn]
    led, bank = in_turn[is_led & ~no_way[in_turn]], in_turn[~is_led]
    day = day - day.min() + tolerance
    span, ways = int(day.max()) + tolerance + 1, int(direction.max()) + 1
    pool = np.unique(statement * (int(amount.max()) + 1) + amount, return_inverse=True)[1]
    any_amount = (int(pool.max()) + 1) * ways * span  # keys from here on are those of bank rows of any amount

    def key(exact: bool, who: np.ndarray, way, on: np.ndarray) -> np.ndarray:
        return (0 if exact else any_amount) + ((pool if exact else statement)[who] * ways + way) * span + on

    places = np.arange(len(bank))
    priced = places[~unknown[bank]]
    listed = {True: priced, False: places}
    used = [e for e in (True, False) if any(e == exact for kinds in (*waves[True], *waves[False]) for exact, _ in kinds)]
    taken, free, parts = np.zeros(len(bank), bool), np.ones(len(led), bool), []
    if len(led) and sum(len(listed[e]) for e in used):
        queues = _Queues(np.concatenate([key(e, bank[listed[e]], direction[bank[listed[e]]], day[bank[listed[e]]]) for e in used]),
                         np.concatenate([listed[e] for e in used]))
        for same, wave in waves.items():
            there = bank[priced[~taken[priced]]]
            supply, wanted = np.sort(pool[there] * span + day[there]), pool[led] * span + day[led]
            has_amount = ~unknown[led] & (np.searchsorted(supply, wanted - tolerance) < np.searchsorted(supply, wanted + tolerance, "right"))
            for kinds in wave:
                queues.refresh(taken)
                seen = [(np.zeros(0, int), np.zeros((0, 1), int))]
                for exact in used:
                    away = sorted({x for e, d in kinds if e == exact for x in (d, -d)})
                    wanting = np.flatnonzero(free & (has_amount == exact))
                    who, sees = led[wanting], []
                    for way in range(ways):
                        facing = (direction[who] == way) == same
                        for x in away if facing.any() else []:
                            sees.append(np.full(len(who), -1))
                            sees[-1][facing] = queues.find(key(exact, who[facing], way, day[who[facing]] + x))
                    if sees:
                        seen.append((wanting, np.stack(sees, axis=1)))
                wide = max(s.shape[1] for _, s in seen)
                wanting = np.concatenate([w for w, _ in seen])
                sees = np.concatenate([np.pad(s, ((0, 0), (0, wide - s.shape[1])), constant_values=-1) for _, s in seen])
                turn = np.argsort(wanting, kind="stable")
                turn = turn[(sees[turn] >= 0).any(axis=1)]
                leds, banks = (np.array(x, int) for x in queues.take(wanting[turn], sees[turn], taken))
                free[leds] = False
                parts.append((led[leds], bank[banks], has_amount[leds], np.full(len(leds), same)))
    parts.append((np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool), np.zeros(0, bool)))
    who, whom, exact, same = (np.concatenate([p[k] for p in parts]) for k in range(4))
    return pa.table({"statement_id": rows["statement_id"].take(pa.array(who)), "led_idx": pa.array(idx[who], pa.int64()),
                     "bank_idx": pa.array(idx[whom], pa.int64()), "days": pa.array(np.abs(day[who] - day[whom]), pa.int32()),
                     "exact": pa.array(exact), "same_direction": pa.array(same)})


def assignment(rows: DataFrame, keys: list[str], options: MatchOptions) -> DataFrame:
    """statement_id, led_idx, bank_idx, days, exact, same_direction of rows (statement_id, cents, day, direction, idx, is_led)."""
    kind = rows.schema["statement_id"].dataType.simpleString()

    def run(batches):
        for table in whole_groups(batches, keys):
            yield from assigned(table, options).to_batches()

    return dealt(rows, keys).mapInArrow(
        run, f"statement_id {kind}, led_idx bigint, bank_idx bigint, days int, exact boolean, same_direction boolean")
