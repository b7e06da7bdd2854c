"""Mixing sources to target weights by hash-threshold histograms (operator 7).

Every document gets a hash of its id and text. A source's budget is a number of whole copies of all its documents plus a rest;
the rest is met by the documents whose hash lies under a threshold. The threshold comes from a histogram of word counts over
the top bits of the hash: buckets under the budget are taken, those above are not, and only the bucket that holds the boundary
is split by its next bits, until a single hash is left there, which is taken if that comes nearer to the budget. Thresholds
of a smaller budget lie under those of a larger one. Nothing is sorted, and a histogram has at most BUCKETS rows a source.

Defined results: null and empty texts have size 0 and take 0; a null source is a source of its own, ordered last; rows that
repeat both id and text share a hash and are taken together; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspark.llm.text import NOT_SPACE, Chunk, each_chunk, kind_of, table_of, words
from tallyspark.session import cut, discard

#: Bits of the hash that one histogram tells apart, and the number of histograms until the hash is used up.
BITS, LEVELS = 12, 5
WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE, MOST_COPIES = 1.5, 2.0


def row_hash(inside: str = "") -> Column:
    """The hash of a row's doc_id and text that thresholds refer to (`inside`: the struct that holds them, with a dot)."""
    return F.shiftrightunsigned(F.xxhash64(f"{inside}doc_id", f"{inside}text"), 64 - BITS * LEVELS)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, hash, size: words of every text."""
    hashed = docs.select("doc_id", "text", "source", row_hash().alias("hash"))

    def kernel(chunk: Chunk) -> pa.RecordBatch:
        _, _, first = words(chunk, NOT_SPACE)
        return table_of(["doc_id", "source", "hash", "size"], [None, None, None, pa.int64()],
                        [chunk.ids, chunk.kept["source"], chunk.kept["hash"], np.diff(first)])

    return each_chunk(hashed, kernel, f"doc_id {kind_of(docs)}, source string, hash long, size long", keep=["source", "hash"])


def targets(sized: DataFrame, weights: tuple[float, ...], total_share: float, most_copies: float) -> DataFrame:
    """One row per source: source, source_size, target. Weights go round in code point order of the sources.

    What a source cannot take is shared out again by weight until no target is above its limit. In the order of limit by weight the
    sources that reach their limits come first, so running sums over one row per source give the final share in one pass.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    sources = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
                  .withColumn("limit", F.col("source_size") * F.lit(most_copies)))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    held = F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy())
    shares = sources.select("limit", "weight", F.row_number().over(by_limit).alias("at"), ((F.lit(total_share) * everything - held) / free).alias("share"))
    first = shares.where(F.col("limit") >= F.col("weight") * F.col("share")).agg(F.min(F.struct("at", "share"))["share"]).first()[0]
    target = F.col("limit") if first is None else F.least("limit", F.col("weight") * F.lit(first))
    return sources.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source of `budgets` (source, rest): the hash from which on nothing more is taken for the rest."""
    open_ = budgets.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    spare = None
    for level in range(1, LEVELS + 1):
        down = BITS * (LEVELS - level)
        prefix = F.shiftright("hash", down)
        inside = F.col("s.source").eqNullSafe(F.col("o.source"))
        rows = sized.alias("s").where(F.col("size") > 0).join(open_.alias("o"), inside)
        if level > 1:
            rows = rows.where(F.shiftright("hash", down + BITS) == F.col("prefix"))
        histogram = rows.groupBy("s.source", "rest", "below", prefix.alias("bucket")).agg(
            F.sum("size").alias("size"), F.min("hash").alias("least"), F.max("hash").alias("most"))
        upto = Window.partitionBy("source").orderBy("bucket")
        running = histogram.withColumn("upto", F.col("below") + F.sum("size").over(upto))
        boundary = (running.where(F.col("upto") > F.col("rest"))
                    .groupBy("source", "rest").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("size")).alias("below"), "upto", "least", "most")).alias("b"))
                    .select("source", "rest", F.col("b.bucket").alias("prefix"), F.col("b.below").alias("below"), "b.upto", "b.least", "b.most"))
        boundary = cut(boundary)
        if spare is not None:
            discard(spare)
        open_ = spare = boundary
        if level == LEVELS or boundary.where(F.col("least") < F.col("most")).isEmpty():
            break
    nearer = F.abs(F.col("upto") - F.col("rest")) < F.abs(F.col("below") - F.col("rest"))
    # All documents of the boundary bucket share one hash now. A source has no boundary only if its rest is 0 or it has no words.
    return open_.select("source", F.when(nearer, F.col("most") + 1).otherwise(F.col("least")).alias("threshold"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE,
        most_copies: float = MOST_COPIES) -> DataFrame:
    """doc_id, source, hash, size, source_size, target, copies, taken: how many times the mix takes each document."""
    sized = cut(sizes(docs))
    goal = cut(targets(sized, weights, total_share, most_copies)
               .withColumn("whole", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
               .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    limit = thresholds(sized, goal.where(F.col("rest") > 0).select("source", "rest"))
    plan = goal.alias("g").join(limit.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source")), "left").select(
        F.col("g.source").alias("of"), "source_size", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    copies = F.col("whole") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return (sized.join(plan, F.col("source").eqNullSafe(F.col("of")))
            .select("doc_id", "source", "hash", "size", "source_size", "target", copies.cast("int").alias("copies"), (F.col("size") * copies).alias("taken")))
