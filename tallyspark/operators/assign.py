"""Greedy one-to-one assignment of ledger rows to bank rows, in two waves.

The order is fixed: score downwards, then led_idx, then bank_idx; wave A takes pairs of the same
direction, wave B the rest among what wave A left. With the default options only pairs of equal
amount reach the minimum score, so every (statement, amount) group is settled by itself; options that let
unequal amounts match settle every statement by itself:

* groups of up to ``GROUP_LIMIT`` rows take their turns inside one task (``turns``) - one shuffle for both waves;
* larger groups go through rounds that pair rows by *position* instead of writing out pairs.
  All pairs at one day distance have the same score, so the n-th free ledger row of a day is
  offered the n-th free bank row of the days at that distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.candidates import window_totals
from tallyspark.operators.levels import levels, waves_by_level
from tallyspark.operators.ranking import ranked
from tallyspark.operators.turns import assignment
from tallyspark.options import PURCHASE, SALES, MatchOptions
from tallyspark.session import cut, has_rows

#: Rows of a group that is settled inside one task.
GROUP_LIMIT = 1 << 22
_EDGE = ["statement_id", "led_idx", "bank_idx", "days", "exact", "same_direction"]


def score(options: MatchOptions, exact: Column, days: Column, same_direction: Column) -> Column:
    date = F.when(days >= options.tolerance_days, 0.0).otherwise(
        options.date_weight * (1 - days / F.lit(float(options.tolerance_days))))
    return (F.when(exact, options.amount_weight).otherwise(0.0) + F.coalesce(date, F.lit(0.0))
            + F.when(same_direction, options.direction_weight).otherwise(0.0))


def _tied(options: MatchOptions) -> bool:
    """Whether several kinds of pair of one wave have the same score."""
    return any(len(kinds) > 1 for same in (True, False) for kinds in levels(options, same))


def _runs(options: MatchOptions, same_direction: bool) -> list[tuple[bool, list[int]]]:
    """Score levels of a wave, highest first, cut into runs of equal and unequal amounts; for weights without ties."""
    runs: list[tuple[bool, list[int]]] = []
    for ((exact, days),) in levels(options, same_direction):
        if runs and runs[-1][0] == exact:
            runs[-1][1].append(days)
        else:
            runs.append((exact, [days]))
    return runs


def _mutual_round(leds: DataFrame, banks: DataFrame, keys: list[str], distance: int) -> DataFrame | None:
    """Pairs at one day distance that the greedy order is certain to take.

    After distance 0 a day of a group holds free rows of one side only. Days that alternate
    sides at this distance form a chain, and chains do not touch each other. A pair is certain
    when both sides offer it to each other and it comes, on both sides, before the first row of
    its chain without such an offer; the first rows of two days that offer each other are
    certain as well, so every round makes progress. Returns None once no chain is left.
    """
    days = (leds.groupBy(*keys, "day").agg(F.lit("L").alias("side"))
            .unionByName(banks.groupBy(*keys, "day").agg(F.lit("B").alias("side"))))
    step = Window.partitionBy(*keys, "residue").orderBy("day")
    starts = ((F.lag("day").over(step) != F.col("day") - distance)
              | (F.lag("side").over(step) == F.col("side")))
    chained = (days.withColumn("residue", F.pmod("day", F.lit(distance)))
               .withColumn("starts", F.coalesce(starts, F.lit(True)))
               .withColumn("chain", F.sum(F.col("starts").cast("int")).over(
                   step.rowsBetween(Window.unboundedPreceding, 0)))
               .withColumn("links", F.count("*").over(Window.partitionBy(*keys, "residue", "chain")))
               .filter("links > 1"))
    chained = cut(chained)
    if not has_rows(chained):
        return None

    def on_chain(rows: DataFrame, side: str) -> DataFrame:
        return rows.join(chained.filter(F.col("side") == side).select(*keys, "day", "residue", "chain"),
                         [*keys, "day"])

    free_leds, free_banks = on_chain(leds, "L"), on_chain(banks, "B")
    shifted = F.explode(F.array(F.col("day") - distance, F.col("day") + distance)).alias("day")

    def offers(own: DataFrame, idx: str, other: DataFrame, other_idx: str, rank: str) -> DataFrame:
        mine = ranked(own, [*keys, "day"], idx, "at").select(*keys, "residue", "chain", "day", idx, "at")
        reach = ranked(other.select(*keys, other_idx, shifted), [*keys, "day"], other_idx, "at")
        return mine.join(reach, [*keys, "day", "at"]).withColumnRenamed("at", rank).drop("day")

    by_led = offers(free_leds, "led_idx", free_banks, "bank_idx", "led_rank")
    by_bank = offers(free_banks, "bank_idx", free_leds, "led_idx", "bank_rank")
    chain = [*keys, "residue", "chain"]
    mutual = cut(by_led.join(by_bank.drop("residue", "chain"), [*keys, "led_idx", "bank_idx"]))

    def first_without(rows: DataFrame, idx: str, name: str) -> DataFrame:
        return (rows.join(mutual.select(*keys, idx), [*keys, idx], "left_anti")
                .groupBy(*chain).agg(F.min(idx).alias(name)))

    return (mutual
            .join(first_without(free_leds, "led_idx", "led_stop"), chain, "left")
            .join(first_without(free_banks, "bank_idx", "bank_stop"), chain, "left")
            .filter((F.coalesce(F.col("led_idx") < F.col("led_stop"), F.lit(True))
                     & F.coalesce(F.col("bank_idx") < F.col("bank_stop"), F.lit(True)))
                    | ((F.col("led_rank") == 1) & (F.col("bank_rank") == 1)))
            .select(*keys, "led_idx", "bank_idx"))


def _by_position(leds: DataFrame, banks: DataFrame, keys: list[str], distances: list[int]) -> list[DataFrame]:
    """Greedy order of one run of score tiers, one day distance after the other."""
    found = []
    for distance in distances:
        while True:
            if distance == 0:
                pairs = (ranked(leds, [*keys, "day"], "led_idx", "at")
                         .join(ranked(banks, [*keys, "day"], "bank_idx", "at"), [*keys, "day", "at"])
                         .select(*keys, "led_idx", "bank_idx"))
            else:
                pairs = _mutual_round(leds, banks, keys, distance)
                if pairs is None:
                    break
            pairs = cut(pairs)
            if not has_rows(pairs):
                break
            found.append(pairs.select("statement_id", "led_idx", "bank_idx", F.lit(distance).alias("days")))
            leds = cut(leds.join(pairs.select(*keys, "led_idx"), [*keys, "led_idx"], "left_anti"))
            banks = cut(banks.join(pairs.select(*keys, "bank_idx"), [*keys, "bank_idx"], "left_anti"))
            if distance == 0:
                break
    return found


def _without(rows: DataFrame, taken: list[DataFrame], idx: str) -> DataFrame:
    for part in taken:
        rows = rows.join(part.select("statement_id", idx), ["statement_id", idx], "left_anti")
    return rows


def _waves_by_position(leds: DataFrame, banks: DataFrame, options: MatchOptions) -> list[DataFrame]:
    """Both waves of the full rule, amounts equal or not, without writing out pairs."""
    found: list[DataFrame] = []
    flipped = F.when(F.col("direction") == SALES, PURCHASE).when(F.col("direction") == PURCHASE, SALES)
    for same in (True, False):
        runs = _runs(options, same)
        wave_leds, wave_banks = _without(leds, found, "led_idx"), _without(banks, found, "bank_idx")
        tiers = {True: wave_leds}
        if any(not exact for exact, _ in runs):
            amounts = window_totals(wave_banks.filter("cents is not null"), wave_leds.filter("cents is not null"),
                                    ["statement_id", "cents"], options.tolerance_days, ("n", "first"))
            has_exact = amounts.filter("n > 0").select("statement_id", "cents", "day")
            tiers[False] = wave_leds.join(has_exact, ["statement_id", "cents", "day"], "left_anti")
        facing = wave_banks if same else wave_banks.withColumn("direction", flipped)
        wave: list[DataFrame] = []
        for exact, distances in runs:
            keys = ["statement_id", "direction"] + (["cents"] if exact else [])
            left = _without(tiers[exact], wave, "led_idx").select(*keys, "day", "led_idx")
            right = _without(facing, wave, "bank_idx").select(*keys, "day", "bank_idx")
            pairs = _by_position(left.dropna(), right.dropna(), keys, distances)
            wave += [p.withColumns({"exact": F.lit(exact), "same_direction": F.lit(same)}) for p in pairs]
        found += wave
    return found


def two_wave_assignment(banks: DataFrame, leds: DataFrame, options: MatchOptions = MatchOptions(),
                        group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(statement_id, led_idx, bank_idx, days, exact, same_direction) of every assigned pair."""
    bank_side = banks.select("statement_id", "cents", "day", "direction", "bank_idx")
    led_side = leds.select("statement_id", "cents", "day", "direction", "led_idx")
    tied = _tied(options)
    any_amount = bool(options.distances(False, True) or options.distances(False, False))
    usable = "day is not null" if any_amount else "cents is not null and day is not null and direction is not null"
    bank_side, led_side = bank_side.filter(usable), led_side.filter(usable)
    group = ["statement_id"] if any_amount else ["statement_id", "cents"]
    row = ["statement_id", "cents", "day", "direction"]
    both = (led_side.select(*row, F.col("led_idx").cast("bigint").alias("idx"), F.lit(True).alias("is_led"))
            .unionByName(bank_side.select(*row, F.col("bank_idx").cast("bigint").alias("idx"), F.lit(False).alias("is_led"))))
    oversized = cut(both.groupBy(*group)
                    .agg(F.count("*").alias("n"), F.count_if("is_led").alias("n_leds"))
                    .filter(F.col("n") > group_limit))
    any_oversized = has_rows(oversized)
    if any_oversized:
        both = both.join(oversized.select(*group), group, "left_anti")
    settled = assignment(both, group, options)
    if not any_oversized:
        return settled.select(*_EDGE)
    two_sided = oversized.filter(F.col("n_leds").between(1, F.col("n") - 1)).select(*group)
    led_side, bank_side = led_side.join(two_sided, group, "left_semi"), bank_side.join(two_sided, group, "left_semi")
    by_level = tied or any_amount and has_rows(bank_side.filter("direction is null"))
    waves = waves_by_level if by_level else _waves_by_position
    return _collected([settled, *waves(led_side, bank_side, options)], bank_side)


def _collected(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    if not parts:
        empty = like.limit(0)
        return empty.select("statement_id", F.lit(0).cast("bigint").alias("led_idx"), "bank_idx",
                            F.lit(0).alias("days"), F.lit(True).alias("exact"), F.lit(True).alias("same_direction"))
    return reduce(DataFrame.unionByName, [p.select(*_EDGE) for p in parts])
