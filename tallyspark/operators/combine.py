"""Exact-sum settlements: several rows of one side against one row of the other.

Target rows take their turn in index order. At its turn a target looks at the free rows of its
direction inside the date window; with 1 to ``max_pool`` of them it takes the first pair, else the
first triple, that adds up to its amount. Pool sizes depend on (statement, direction, day) only,
so they come from per-day counts, and only pools small enough to be searched are gathered.

A lane (statement, direction) of up to ``LANE`` rows is replayed in one task, its targets in their order over the free rows of
each day. In larger lanes, targets further apart than two windows share no pool row, so their days fall into segments that do
not touch. A segment of up to ``SEGMENT`` targets is replayed in its order in one task, all such segments in one pass; only
larger ones go through rounds.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.turns import codes, dealt, whole_groups
from tallyspark.options import MatchOptions
from tallyspark.session import cut, has_rows

#: Rows of a lane, targets and pool, that are replayed in one task.
LANE = 1 << 20
#: Targets of a segment that is replayed in one task.
SEGMENT = 512
_LANE = ["statement_id", "direction"]
_DAY = [*_LANE, "day"]


def _per_day_window(supply: DataFrame, wanted: DataFrame, reach: int, name: str) -> DataFrame:
    """Sum of ``n`` over ``reach`` days either way, for the days in ``wanted``."""
    days = (supply.select(*_DAY, "n", F.lit(False).alias("wanted"))
            .unionByName(wanted.select(*_DAY, F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("wanted")))
            .groupBy(*_DAY).agg(F.sum("n").alias("n"), F.bool_or("wanted").alias("wanted")))
    span = Window.partitionBy(*_LANE).orderBy("day").rangeBetween(-reach, reach)
    return days.select(*_DAY, "wanted", F.sum("n").over(span).alias(name)).filter("wanted").drop("wanted")


def _gathered(pool: DataFrame, days: DataFrame, tolerance: int) -> DataFrame:
    """The pool rows of each listed day as one array, by index; the days are known to be small."""
    reach = F.explode(F.sequence(F.col("day") - tolerance, F.col("day") + tolerance)).alias("at")
    rows = pool.select(*_LANE, F.struct("idx", "day", "cents").alias("row"), reach).withColumnRenamed("at", "day")
    return (rows.join(days.select(*_DAY), _DAY, "left_semi")
            .groupBy(*_DAY).agg(F.array_sort(F.collect_list("row")).alias("pool")))


def combinations(pool: Column, target: Column, largest: int) -> Column:
    """All pairs, then all triples, of ``pool`` that sum to ``target``, in index order."""
    amounts = pool["cents"]

    def adding(a: Column) -> Column:
        return F.filter(pool, lambda b: (b.idx > a.idx) & (a.cents + b.cents == target))

    pairs = F.flatten(F.transform(
        F.filter(pool, lambda a: F.array_contains(amounts, target - a.cents)),
        lambda a: F.transform(adding(a), lambda b: F.array(a, b))))
    if largest < 3:
        return pairs

    def completed(a: Column, b: Column) -> Column:
        third = F.filter(pool, lambda c: (c.idx > b.idx) & (a.cents + b.cents + c.cents == target))
        return F.transform(third, lambda c: F.array(a, b, c))

    def started(a: Column) -> Column:
        second = F.filter(pool, lambda b: (b.idx > a.idx) & F.array_contains(amounts, target - a.cents - b.cents))
        return F.flatten(F.transform(second, lambda b: completed(a, b)))

    return F.concat(pairs, F.flatten(F.transform(pool, started)))


def _contenders(targets: DataFrame, pool: DataFrame, options: MatchOptions) -> DataFrame:
    """Targets that may consume something, with their full pool.

    A target whose pool is too large at the start counts only if earlier targets could shrink it enough. They can take no
    more rows than three each, and no others than those in their own pools: a day is out once its pool exceeds the limit by
    more than both. Starting from the small pools and adding the days the bounds let in until nothing changes leaves
    out only targets that can never take a turn.
    """
    most = min(options.max_combination, 3) if options.max_combination >= 2 else 2
    supply = cut(pool.groupBy(*_DAY).agg(F.count("*").alias("n")))
    days = cut(_per_day_window(supply, targets.select(*_DAY).distinct(), options.tolerance_days, "size")
               .filter("size >= 2"))

    def searched(chosen: DataFrame) -> DataFrame:
        gathered = _gathered(pool, chosen, options.tolerance_days)
        return (targets.join(gathered, _DAY)
                .filter(F.size(combinations(F.col("pool"), F.col("cents"), most)) > 0))

    small = F.col("size") <= options.max_pool
    active = cut(searched(days.filter(small)))
    open_days = days.filter(~small)
    while has_rows(open_days):
        takers = active.groupBy(*_DAY).agg(F.count("*").alias("n"))
        near = _per_day_window(takers, supply, options.tolerance_days, "near").filter("near > 0")
        in_reach = supply.join(near.select(*_DAY), _DAY, "left_semi")
        reached = cut(
            open_days.join(_per_day_window(takers, open_days, 2 * options.tolerance_days, "takers"), _DAY)
            .join(_per_day_window(in_reach, open_days, options.tolerance_days, "rows"), _DAY)
            .filter(F.col("size") - F.least(most * F.col("takers"), "rows") <= options.max_pool))
        if not has_rows(reached):
            break
        active = cut(active.unionByName(searched(reached)))
        open_days = open_days.join(reached.select(*_DAY), _DAY, "left_anti")
    return active


def settle_by_sum(targets: DataFrame, pool: DataFrame, options: MatchOptions = MatchOptions(), segment: int = SEGMENT,
                  lane: int = LANE) -> DataFrame:
    """(statement_id, idx, rows, proximity): each settled target with the rows it consumes.

    Both sides have statement_id, direction, day, idx, cents.
    """
    most = min(options.max_combination, 3) if options.max_combination >= 2 else 2
    targets, pool = targets.dropna(), pool.dropna()
    fields = [*_LANE, "day", "idx", "cents"]
    both = targets.select(*fields, F.lit(True).alias("is_target")).unionByName(pool.select(*fields, F.lit(False).alias("is_target")))
    oversized = cut(both.groupBy(*_LANE).agg(F.count("*").alias("n")).filter(F.col("n") > lane).select(*_LANE))
    any_oversized = has_rows(oversized)
    pairs = _by_lane(both.join(oversized, _LANE, "left_anti") if any_oversized else both, options, most)
    if any_oversized:
        targets, pool = targets.join(oversized, _LANE, "left_semi"), pool.join(oversized, _LANE, "left_semi")
        pairs = pairs.unionByName(_by_segment(targets, pool, options, most, segment))
    tolerance = float(options.tolerance_days)

    def proximity(row: Column) -> Column:
        away = F.abs(row.day - F.col("day"))
        return F.when(away >= options.tolerance_days, 0.0).otherwise(options.date_weight * (1 - away / tolerance))

    total = F.reduce(F.transform("first", proximity), F.lit(0.0), lambda acc, x: acc + x)
    return pairs.select("statement_id", "idx", F.col("first.idx").alias("rows"),
                        (total / F.size("first")).alias("proximity"))


def _by_segment(targets: DataFrame, pool: DataFrame, options: MatchOptions, most: int, segment: int) -> DataFrame:
    """lane, idx, day, first of large lanes."""
    contenders = segments(_contenders(targets, pool, options), 2 * options.tolerance_days)
    small = F.col("targets") <= segment
    pairs = _replayed(contenders.filter(small), options.max_pool, most)
    large = contenders.filter(~small).drop("segment", "targets")
    return pairs.unionByName(_in_rounds(large, options, most)) if has_rows(large) else pairs


def _turns(day: np.ndarray, idx: np.ndarray, cents: np.ndarray, is_target: np.ndarray, options: MatchOptions,
           most: int) -> list[tuple[int, list[int]]]:
    """One lane: the place of every settled target with the places of the pool rows it takes, in turn.

    Sizes of pools are kept by day. They only shrink, so a target waits until its pool is small enough, and one whose turn
    comes before that is passed over without being looked at.
    """
    days, on = np.unique(day, return_inverse=True)
    low = np.searchsorted(days, days.astype(np.int64) - options.tolerance_days)
    high = np.searchsorted(days, days.astype(np.int64) + options.tolerance_days, "right")
    pool, targets = np.flatnonzero(~is_target), np.flatnonzero(is_target)
    pool, targets = pool[np.lexsort((idx[pool], on[pool]))], targets[np.argsort(idx[targets], kind="stable")]
    begins = np.searchsorted(on[pool], np.arange(len(days) + 1))
    size = begins[high] - begins[low]
    turn = np.argsort(on[targets], kind="stable")  # turns of targets, day by day
    first = np.searchsorted(on[targets][turn], np.arange(len(days) + 1))
    waiting = np.flatnonzero((size[on[targets]] >= 2) & (size[on[targets]] <= options.max_pool)).tolist()  # in order, so a heap
    free: dict[int, list[int]] = {}
    done = []
    while waiting:
        now = heapq.heappop(waiting)
        t = int(targets[now])
        d = on[t]
        if size[d] < 2:
            continue
        near = []
        for x in range(low[d], high[d]):
            if x not in free:
                free[x] = pool[begins[x]:begins[x + 1]].tolist()
            near += free[x]
        near.sort(key=idx.__getitem__)
        found = first_sum(cents[near].tolist(), int(cents[t]), most)
        for p in [near[i] for i in found or ()]:
            x = int(on[p])
            free[x].remove(p)
            size[low[x]:high[x]] -= 1
            for open_ in np.flatnonzero(size[low[x]:high[x]] == options.max_pool) + low[x]:
                theirs = turn[first[open_]:first[open_ + 1]]
                for later in theirs[np.searchsorted(theirs, now, "right"):].tolist():
                    heapq.heappush(waiting, later)
        if found:
            done.append((t, [near[i] for i in found]))
    return done


def _by_lane(rows: DataFrame, options: MatchOptions, most: int) -> DataFrame:
    """lane, idx, day, first: whole lanes in the order of their targets."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for table in whole_groups(batches, _LANE):
            day, idx, cents, is_target = (table[c].to_numpy() for c in ("day", "idx", "cents", "is_target"))
            statement, direction = (codes(table[c]) for c in _LANE)
            lane = statement * (direction.max() + 1) + direction
            by_lane = np.argsort(lane, kind="stable")
            done = []
            for places in np.split(by_lane, np.flatnonzero(np.diff(lane[by_lane])) + 1):
                done += [(places[t], places[taken]) for t, taken in
                         _turns(day[places], idx[places], cents[places], is_target[places], options, most)]
            held = [table.schema.field(c) for c in ("idx", "day", "cents")]
            of_target = table.take(pa.array([t for t, _ in done], pa.int64())).combine_chunks()
            taken = pa.array(np.concatenate([np.zeros(0, np.int64), *[p for _, p in done]]))
            ends = np.cumsum([0, *[len(p) for _, p in done]])
            struct = pa.StructArray.from_arrays([table[c.name].take(taken).combine_chunks() for c in held], fields=held)
            first = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)
            yield from pa.table([*[of_target[c] for c in (*_LANE, "idx", "day")], first], names=[*_LANE, "idx", "day", "first"]).to_batches()

    first = f"array<struct<idx: {kinds['idx']}, day: {kinds['day']}, cents: {kinds['cents']}>>"
    return dealt(rows, _LANE).mapInArrow(
        run, f"statement_id {kinds['statement_id']}, direction string, idx {kinds['idx']}, day {kinds['day']}, first {first}")


def segments(targets: DataFrame, reach: int) -> DataFrame:
    """Targets with the number of their segment in the lane, and how many targets it has.

    Days of targets belong together while the next one is within ``reach``; a lane has one row a day here.
    """
    days = targets.groupBy(*_DAY).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*_LANE).orderBy("day")
    starts = F.coalesce(F.col("day") - F.lag("day").over(order) > reach, F.lit(True))
    numbered = days.withColumn("starts", starts).withColumn("segment", F.sum(F.col("starts").cast("int")).over(order))
    sized = numbered.withColumn("targets", F.sum("n").over(Window.partitionBy(*_LANE, "segment")))
    return cut(targets.join(sized.select(*_DAY, "segment", "targets"), _DAY))


def first_sum(amounts: list[int], target: int, most: int) -> tuple[int, ...] | None:
    """Places of the first pair, else of the first triple, that adds up to the target, in order of places."""
    last: dict[int, int] = {}
    places: dict[int, list[int]] = {}
    for k, cents in enumerate(amounts):
        last[cents] = k
        places.setdefault(cents, []).append(k)
    for i, cents in enumerate(amounts):
        if last.get(target - cents, -1) > i:
            return i, next(j for j in places[target - cents] if j > i)
    if most >= 3:
        for i, one in enumerate(amounts):
            for j in range(i + 1, len(amounts)):
                third = target - one - amounts[j]
                if last.get(third, -1) > j:
                    return i, j, next(k for k in places[third] if k > j)
    return None


def _replayed(targets: DataFrame, max_pool: int, most: int) -> DataFrame:
    """lane, idx, day, first: whole segments in the order of their targets, one row a segment."""
    row = F.struct("idx", "day", "cents", "pool")
    gathered = targets.groupBy(*_LANE, "segment").agg(F.collect_list(row).alias("rows"))
    kinds = {f.name: f.dataType.simpleString() for f in targets.schema}

    def run(batches):
        for batch in batches:
            at, idx, day, first = [], [], [], []
            for k, rows in enumerate(batch.column("rows")):
                used: set[int] = set()
                for t in sorted(rows.as_py(), key=lambda r: r["idx"]):
                    near = [p for p in t["pool"] if p["idx"] not in used]
                    found = first_sum([p["cents"] for p in near], t["cents"], most) if 1 <= len(near) <= max_pool else None
                    if found:
                        used.update(near[i]["idx"] for i in found)
                        at.append(k)
                        idx.append(t["idx"])
                        day.append(t["day"])
                        first.append([near[i] for i in found])
            inner = batch.schema.field("rows").type.value_type
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("statement_id").take(take), batch.column("direction").take(take), pa.array(idx, inner.field("idx").type),
                 pa.array(day, inner.field("day").type), pa.array(first, inner.field("pool").type)], names=[*_LANE, "idx", "day", "first"])

    return gathered.select(*_LANE, "rows").mapInArrow(
        run, f"statement_id {kinds['statement_id']}, direction string, idx {kinds['idx']}, day {kinds['day']}, first {kinds['pool']}")


def _in_rounds(open_targets: DataFrame, options: MatchOptions, most: int) -> DataFrame:
    """lane, idx, day, first of large segments. A target is final once no earlier open target has a use for any row of its
    first combination, and one with too many rows is passed over once no earlier open target can take any of them.
    """
    settled: list[DataFrame] = []
    while has_rows(open_targets):
        options_now = combinations(F.col("pool"), F.col("cents"), most)
        fits = F.size("pool") <= options.max_pool
        state = cut(
            open_targets.withColumn("combos", options_now).filter(F.size("combos") > 0)
            .withColumns({"fits": fits, "first": F.get("combos", F.lit(0))})
            .withColumn("wanted", F.when(F.col("fits"), F.array_distinct(F.flatten("combos"))).otherwise(F.col("pool")))
            .withColumn("needed", F.when(F.col("fits"), F.col("first")).otherwise(F.col("pool")))
            .drop("combos"))
        claims = state.select(*_LANE, "idx", F.explode("wanted.idx").alias("row"))
        earliest = claims.groupBy(*_LANE, "row").agg(F.min("idx").alias("earliest"))
        blocked = (state.select(*_LANE, "idx", F.explode("needed.idx").alias("row"))
                   .join(earliest, [*_LANE, "row"]).filter(F.col("earliest") < F.col("idx"))
                   .select(*_LANE, "idx").distinct())
        ready = cut(state.join(blocked, [*_LANE, "idx"], "left_anti")
                    .select(*_LANE, "idx", "day", "first", "fits"))
        done = ready.filter("fits")
        settled.append(done)
        gone = done.select(*_LANE, F.explode("first.idx").alias("row"))
        rest = state.join(ready.select(*_LANE, "idx"), [*_LANE, "idx"], "left_anti")
        lost = (rest.select(*_LANE, "idx", F.explode("pool.idx").alias("row"))
                .join(gone, [*_LANE, "row"]).groupBy(*_LANE, "idx").agg(F.collect_set("row").alias("lost")))
        open_targets = cut(
            rest.join(lost, [*_LANE, "idx"], "left")
            .withColumn("pool", F.when(F.col("lost").isNull(), F.col("pool")).otherwise(
                F.filter("pool", lambda p: ~F.array_contains("lost", p.idx))))
            .select(*open_targets.columns))
    return reduce(DataFrame.unionByName, [s.select(*_LANE, "idx", "day", "first") for s in settled])


def combined_score(options: MatchOptions, legs: Column, proximity: Column) -> Column:
    raw = (options.amount_weight + proximity + options.direction_weight
           - 5 * F.greatest(F.lit(0), legs - 2))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


def combined_settlements(banks: DataFrame, leds: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """Leftover rows settled by sums: several bank rows per ledger row first, then the reverse.

    One row per ledger row: (statement_id, led_idx, bank_rows, n_bank, n_led, score).
    """
    bank_side = cut(banks.select(*_LANE, "day", F.col("bank_idx").alias("idx"), "cents").dropna())
    led_side = cut(leds.select(*_LANE, "day", F.col("led_idx").alias("idx"), "cents").dropna())
    split = cut(settle_by_sum(led_side, bank_side, options))
    used_banks = split.select("statement_id", F.explode("rows").alias("idx"))
    left_banks = bank_side.join(used_banks, ["statement_id", "idx"], "left_anti")
    left_leds = led_side.join(split.select("statement_id", "idx"), ["statement_id", "idx"], "left_anti")
    pooled = settle_by_sum(left_banks, left_leds, options)
    score = combined_score(options, F.size("rows"), F.col("proximity")).alias("score")
    by_ledger = split.select("statement_id", F.col("idx").alias("led_idx"), F.col("rows").alias("bank_rows"),
                             F.size("rows").alias("n_bank"), F.lit(1).alias("n_led"), score)
    by_bank = pooled.select("statement_id", F.explode("rows").alias("led_idx"), F.array("idx").alias("bank_rows"),
                            F.lit(1).alias("n_bank"), F.size("rows").alias("n_led"), score)
    return by_ledger.unionByName(by_bank)
