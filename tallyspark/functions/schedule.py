"""Weekly demand schedules: positional quantities, header labels, year-less dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.values import month_number

DAY_MONTH = "^\\s*([0-9]{1,2})[-/\\s]*([A-Za-z]{3,})"


def aligned(quantities: Column, width: Column) -> Column:
    """Padded with null or cut to the header's width; unchanged when there is no header."""
    cells = F.coalesce(quantities, F.array().cast("array<double>"))
    filler = F.array_repeat(F.lit(None).cast("double"), width)
    return F.when(width > 0, F.slice(F.concat(cells, filler), 1, width)).otherwise(quantities)


def repair_note(quantities: Column, width: Column) -> Column:
    n = F.coalesce(F.size(quantities), F.lit(0))
    sizes = F.concat(n.cast("string"), F.lit(" to "), width.cast("string"))
    return (F.when((width > 0) & (n < width), F.concat(F.lit("padded from "), sizes))
            .when((width > 0) & (n > width), F.concat(F.lit("trimmed from "), sizes)))


def total(quantities: Column) -> Column:
    return F.reduce(F.filter(quantities, lambda q: q.isNotNull()), F.lit(0.0), lambda acc, q: acc + q)


def column_label(week: Column, raw_date: Column, date: Column) -> Column:
    when = F.when(raw_date != "", raw_date).otherwise(date)
    return F.array_join(F.filter(F.array(week, when), lambda x: x != ""), " ")


def day_month(raw: Column) -> Column:
    """struct(month, day) of a date printed without a year, null if it cannot be read."""
    day = F.regexp_extract(raw, DAY_MONTH, 1).try_cast("int")
    month = month_number(F.regexp_extract(raw, DAY_MONTH, 2))
    return F.when(day.isNotNull() & month.isNotNull(), F.struct(month.alias("month"), day.alias("day")))


def seed_year(*candidates: Column, default: int) -> Column:
    found = [F.when(c.rlike("^[0-9]{4}"), F.substring(c, 1, 4).cast("int")) for c in candidates]
    return F.coalesce(*found, F.lit(default))


def with_years(columns: DataFrame, raw: str, derived: str, seed: str) -> DataFrame:
    """Give each year-less date its year: one more whenever the calendar runs backwards.

    Cells that cannot be read do not take part; a day that does not exist does, but stays null.
    """
    along = Window.partitionBy("doc_id").orderBy("col_no")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    parsed = day_month(F.col(raw))
    marked = columns.withColumn("_dm", parsed)
    marked = marked.withColumn("_wrap", F.coalesce(
        F.col("_dm") < F.last("_dm", ignorenulls=True).over(earlier), F.lit(False)).cast("int"))
    year = F.col(seed) + F.sum("_wrap").over(along.rowsBetween(Window.unboundedPreceding, 0))
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", year, F.col("_dm.month"), F.col("_dm.day")), "yyyy-MM-dd")
    return (marked.withColumn("_date", F.when(F.col("_dm").isNotNull(), F.date_format(date, "yyyy-MM-dd")))
            .withColumn(derived, F.coalesce(F.col(derived), "_date")).drop("_dm", "_wrap", "_date"))


def derive_dates(columns: DataFrame, headers: DataFrame, default_year: int) -> DataFrame:
    """Ship and delivery dates of a release's header; dates given in full are kept."""
    seeds = headers.select("doc_id", seed_year(
        F.col("release_date"), F.col("received_at"), default=default_year).alias("_seed"))
    seeded = columns.join(seeds, "doc_id", "left").withColumn("_seed", F.coalesce("_seed", F.lit(default_year)))
    shipped = with_years(seeded, "raw_ship_date", "ship_date", "_seed")
    return with_years(shipped, "raw_delivery_date", "delivery_date", "_seed").drop("_seed")
