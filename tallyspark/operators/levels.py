"""The two waves of the assignment for any weights, one score level after the other.

At one score level the order is led_idx, then bank_idx: every ledger row in turn takes the first free bank row it sees. What it
sees are bank rows at the level's day distances, of its amount if its window holds that amount at all, else of any amount;
several kinds of pair may share a level. Ledger rows that see the same form a group, and the n-th row of a group asks for the
n-th bank row the group sees. Pairs are never written out: a bank row is listed once per group that sees it, which is a few times.

Rows that share no day within reach cannot meet; the others form chains. A chain's rows are final up to its first ledger row that
asks for a bank row which an earlier one asks for. A row that gets the first bank row of its group, and is the first of all that see
it, is final as well. So every round settles at least the first row of each chain.
"""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.candidates import window_totals
from tallyspark.operators.ranking import ranked
from tallyspark.options import PURCHASE, SALES, MatchOptions
from tallyspark.session import cut, has_rows

#: Bank rows that state neither debit nor credit.
NEITHER = "-"
_GROUP = ["statement_id", "direction", "day", "amount"]


def levels(options: MatchOptions, same_direction: bool) -> list[list[tuple[bool, int]]]:
    """Kinds of pair (equal amounts, days apart) of a wave by score, the highest first."""
    by_score: dict[float, list[tuple[bool, int]]] = {}
    for exact in (True, False):
        for days in options.distances(exact, same_direction):
            by_score.setdefault(options.pair_score(exact, days, same_direction), []).append((exact, days))
    return [by_score[s] for s in sorted(by_score, reverse=True)]


def _days_in_reach(distances: list[int]) -> Column:
    days = sorted({x for d in distances for x in (d, -d)})
    return F.array(*[F.col("day") + F.lit(x) for x in days]) if days else F.array().cast("array<int>")


def _seen(leds: DataFrame, banks: DataFrame, kinds: list[tuple[bool, int]], same_direction: bool) -> DataFrame:
    """Group columns and bank_idx: the bank rows each group of ledger rows sees at a level."""
    every = F.array(F.lit(SALES), F.lit(PURCHASE), F.lit(NEITHER))
    ways = F.array("direction") if same_direction else F.filter(every, lambda w: w != F.col("direction"))
    groups = leds.select(*_GROUP).distinct().withColumn("bank_direction", F.explode(ways))
    parts = []
    for exact in (True, False):
        distances = [d for e, d in kinds if e == exact]
        if not distances:
            continue
        mine = groups.filter(F.col("amount") != "*") if exact else groups.filter(F.col("amount") == "*")
        looks = mine.withColumn("bank_day", F.explode(_days_in_reach(distances)))
        on = ["statement_id", "bank_direction", "bank_day"] + (["amount"] if exact else [])
        there = banks.select("statement_id", F.col("direction").alias("bank_direction"), F.col("day").alias("bank_day"), "bank_idx",
                             *([F.col("cents").cast("string").alias("amount")] if exact else []))
        parts.append(looks.join(there, on).select(*_GROUP, "bank_day", "bank_idx"))
    return reduce(DataFrame.union, parts)


def _chains(seen: DataFrame, kinds: list[tuple[bool, int]], same_direction: bool) -> DataFrame:
    """Group columns and chain of every group that sees something."""
    farthest, step = max(d for _, d in kinds), reduce(gcd, [d for _, d in kinds])
    lane = F.col("direction") if same_direction else F.lit("")
    residue = F.pmod("day", F.lit(step)) if step else F.col("day")
    groups = seen.select(*_GROUP).distinct().withColumns({"lane": lane, "residue": residue})
    days = groups.select("statement_id", "lane", "residue", "day").union(
        seen.select("statement_id", lane.alias("lane"), (F.pmod("bank_day", F.lit(step)) if step else F.col("bank_day")).alias("residue"), "bank_day")).distinct()
    order = Window.partitionBy("statement_id", "lane", "residue").orderBy("day")
    starts = F.coalesce(F.col("day") - F.lag("day").over(order) > farthest, F.lit(True))
    chained = days.withColumn("starts", starts).withColumn("chain", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return groups.join(chained.drop("starts"), ["statement_id", "lane", "residue", "day"])


def _round(leds: DataFrame, banks: DataFrame, kinds: list[tuple[bool, int]], same_direction: bool) -> DataFrame | None:
    """statement_id, led_idx, bank_idx that are final at this level, and the days of both; None once nobody sees anything."""
    seen = cut(_seen(leds, banks, kinds, same_direction))
    if not has_rows(seen):
        return None
    wanting = leds.join(seen.select(*_GROUP).distinct(), _GROUP, "left_semi").select(*_GROUP, "led_idx")
    asked = cut(ranked(wanting, _GROUP, "led_idx", "at").join(ranked(seen, _GROUP, "bank_idx", "at"), [*_GROUP, "at"]))
    one = ["statement_id", "bank_idx"]
    winners = asked.groupBy(*one).agg(F.min("led_idx").alias("winner"))
    first_of = wanting.groupBy(*_GROUP).agg(F.min("led_idx").alias("first"))
    first_seer = seen.join(first_of, _GROUP).groupBy(*one).agg(F.min("first").alias("first_seer"))
    chain = ["statement_id", "lane", "residue", "chain"]
    judged = cut(asked.join(winners, one).join(first_seer, one).join(_chains(seen, kinds, same_direction), _GROUP))
    stops = judged.filter(F.col("led_idx") != F.col("winner")).groupBy(*chain).agg(F.min("led_idx").alias("stop"))
    certain = (F.coalesce(F.col("led_idx") < F.col("stop"), F.lit(True))
               | ((F.col("at") == 1) & (F.col("led_idx") == F.col("first_seer"))))
    return judged.join(stops, chain, "left").filter(certain).select(
        "statement_id", "led_idx", "bank_idx", F.abs(F.col("day") - F.col("bank_day")).alias("days"), (F.col("amount") != "*").alias("exact"))


def waves_by_level(leds: DataFrame, banks: DataFrame, options: MatchOptions) -> list[DataFrame]:
    """Both waves, as parts of (statement_id, led_idx, bank_idx, days, exact, same_direction).

    A bank row without a direction is never in the direction of a ledger row, so it can only be taken in the second wave.
    """
    found: list[DataFrame] = []
    leds, banks = leds.filter("day is not null"), banks.filter("day is not null")
    banks = cut(banks.withColumn("direction", F.coalesce("direction", F.lit(NEITHER))))
    for same in (True, False):
        here = window_totals(banks.filter("cents is not null"), leds.filter("cents is not null"),
                             ["statement_id", "cents"], options.tolerance_days, ("n", "first"))
        has_exact = here.filter("n > 0").select("statement_id", "cents", "day", F.lit(True).alias("has"))
        leds = cut(leds.drop("amount").join(has_exact, ["statement_id", "cents", "day"], "left")
                   .withColumn("amount", F.when(F.col("has"), F.col("cents").cast("string")).otherwise("*")).drop("has"))
        for kinds in levels(options, same):
            while (pairs := _round(leds, banks, kinds, same)) is not None:
                pairs = cut(pairs.withColumn("same_direction", F.lit(same)))
                found.append(pairs)
                leds = cut(leds.join(pairs.select("statement_id", "led_idx"), ["statement_id", "led_idx"], "left_anti"))
                banks = cut(banks.join(pairs.select("statement_id", "bank_idx"), ["statement_id", "bank_idx"], "left_anti"))
    return found
