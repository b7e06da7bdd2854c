"""Connected components of links between long ids, by alternating large-star and small-star rounds.

Every round replaces links by links to smaller ids and never adds any; a node with very many neighbours is handled by partial
minimums and joins that Spark can split, never gathered. Rounds write to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyspark.session import cut, discard


def _towards_least(directed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """directed: (u, v). Every row with the least id that u or its v have, and the table of these to discard.

    The minimums are written first: joined from a table, a node with very many rows can be split.
    """
    least = cut(directed.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")))
    return directed.join(least, "u"), least


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    to_least, least = _towards_least(both)
    out = cut(to_least.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v")).distinct())
    discard(least)
    return out


def _small_star(links: DataFrame) -> DataFrame:
    to_least, least = _towards_least(links)
    moved = to_least.where(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    out = cut(moved.union(to_least.select("u", F.col("least").alias("v"))).distinct())
    discard(least)
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in `links` (a, b): component is the smallest id reachable.

    Defined results: self links, repeated links and links with a null are ignored; without links there are no rows.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    current = cut(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not state[0] or tuple(state) == mark:
            break
        mark = tuple(state)
        large = _large_star(current)
        discard(current)
        current = _small_star(large)
        discard(large)
    roots = current.select(F.col("v").alias("id")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
