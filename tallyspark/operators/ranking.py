"""Row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16


def ranked(df: DataFrame, keys: list[str], idx: str, name: str) -> DataFrame:
    """Position (from 1) of each row by ``idx`` within ``keys``.

    ``idx`` is unique within a statement, so one chunk of it holds at most ``CHUNK`` rows. Rows
    are numbered inside their chunk and shifted by the count of all earlier chunks; no task ever
    sorts more than one chunk of a group.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(idx) / CHUNK))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = (chunked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
             .select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(idx)
    return (chunked.withColumn("_at", F.row_number().over(inside))
            .join(shift, [*keys, "_chunk"])
            .withColumn(name, F.col("_shift") + F.col("_at"))
            .drop("_chunk", "_at", "_shift"))
