"""Money and date normalisation as column expressions.

Spark runs in ANSI mode, so every parse of outside text goes through a ``try_`` function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.text import trimmed

# ---- fixed values -----------------------------------------------------------
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
ISO_DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DAY_FIRST_DATE = ("^([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}"
                  "|[0-9]{1,2}-[A-Za-z]{3}-[0-9]{2,4})$")
SHEET_DAY_FIRST_DATE = ("^([0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/([0-9]{2}|[0-9]{4})"
                        "|[0-9]{1,2}-[A-Za-z]{3}-([0-9]{2}|[0-9]{4}))$")
STATEMENT_DATE = "^[0-9]{1,2}([-/])[0-9]{1,2}\\1([0-9]{4}|[0-9]{2})$"
NUMBER = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
HEXADECIMAL = "^0[xX][0-9a-fA-F]{1,15}$"
GROUPED_NUMBER = ("^(?i)[+-]?(([0-9](_?[0-9])*[.]?([0-9](_?[0-9])*)?|[.][0-9](_?[0-9])*)(e[+-]?[0-9](_?[0-9])*)?"
                  "|inf|infinity|nan)$")
MAIL_DATE = ("^\\s*(?:[A-Za-z]+\\s*,?\\s+)?([0-9]{1,2})[\\s-]+([A-Za-z]{3})[a-z]*[\\s-]+([0-9]{4}|[0-9]{2})\\s+"
             "([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?\\s*([+-][0-9]{4}|[A-Za-z]+)?\\s*(?:[(].*)?$")
MAIL_ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "AST": "-0400", "ADT": "-0300", "EST": "-0500", "EDT": "-0400",
    "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}
OTHER_TIMESTAMP_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd", "MMM d, yyyy", "d MMM yyyy",
]
# -----------------------------------------------------------------------------


def half_up(c: Column) -> Column:
    """floor(x + 0.5), so -2.5 becomes -2."""
    return F.floor(c + 0.5).cast("bigint")


def month_number(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.substring(name, 1, 3)))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def cents(amount: Column) -> Column:
    """Integer cents of a numeric amount."""
    return half_up(finite(amount) * 100)


def cents_from_text(raw: Column) -> Column:
    cleaned = trimmed(F.regexp_replace(F.regexp_replace(trimmed(raw), "[₹$,]", ""), "(?i)INR", ""))
    hexadecimal = F.conv(F.substring(cleaned, 3, 16), 16, 10).try_cast("double")
    number = (F.when(cleaned == "", F.lit(0.0)).when(cleaned.rlike(NUMBER), cleaned.try_cast("double"))
              .when(cleaned.rlike(HEXADECIMAL), hexadecimal))
    return F.when(raw != "", cents(number))


def amount(cents_: Column) -> Column:
    return cents_.cast("double") / 100


def sheet_amount(raw: Column) -> Column:
    """Amount cell of an uploaded sheet; a dollar sign is not accepted here."""
    cleaned = trimmed(F.regexp_replace(F.regexp_replace(trimmed(raw), "[₹,]", ""), "INR", ""))
    return F.when(cleaned.rlike(GROUPED_NUMBER), F.replace(cleaned, F.lit("_"), F.lit("")).try_cast("double"))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _day_month_year(s: Column) -> tuple[Column, Column, Column]:
    """The three numbers of a day-first date, whatever separates them; the year as text."""
    parts = F.split(s, "[-/]")
    month = F.get(parts, F.lit(1))
    return _int(F.get(parts, F.lit(0))), F.coalesce(_int(month), month_number(month)), F.get(parts, F.lit(2))


def iso_date(raw: Column) -> Column:
    """Canonical ``YYYY-MM-DD`` text; day 1-31 and month 1-12 are the only range checks.

    Text in none of these layouts is read by OTHER_TIMESTAMP_FORMATS, and by nothing else: the free forms that a browser's own
    date parser guesses at (``Apr 9`` without a year, say) are null here.
    """
    s = trimmed(raw)
    day, month, year = _day_month_year(s)
    full_year = F.when(F.length(year) == 2, 2000 + _int(year)).otherwise(_int(year))
    day_first = F.when(month.between(1, 12) & day.between(1, 31),
                       F.format_string("%d-%02d-%02d", full_year, month, day))
    other = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in OTHER_TIMESTAMP_FORMATS])
    return (F.when(s.rlike(ISO_DATE), s)
            .when(s.rlike(DAY_FIRST_DATE), day_first)
            .otherwise(F.date_format(other, "yyyy-MM-dd")))


def real_date(iso: Column) -> Column:
    """The calendar date of ISO text, null for days that do not exist."""
    return F.try_to_date(iso, "yyyy-MM-dd")


def day_number(iso: Column) -> Column:
    return F.unix_date(real_date(iso))


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(real_date(a), real_date(b)))


def add_days(iso: Column, days: int) -> Column:
    return F.date_format(F.date_add(real_date(iso), days), "yyyy-MM-dd")


def _calendar(year: Column, month: Column, day: Column) -> Column:
    return F.date_format(
        F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd"), "yyyy-MM-dd")


def _pivot_year(two_digits: Column) -> Column:
    return F.when(two_digits >= 69, 1900 + two_digits).otherwise(2000 + two_digits)


def sheet_date(raw: Column) -> Column:
    """Date cell of an uploaded sheet: six day-first or ISO layouts, real calendar days only."""
    s = trimmed(raw)
    day, month, year = _day_month_year(s)
    full_year = F.when(F.length(year) == 2, _pivot_year(_int(year))).otherwise(_int(year))
    return (F.when(s.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"),
                   F.date_format(F.try_to_date(s, "yyyy-M-d"), "yyyy-MM-dd"))
            .when(s.rlike(SHEET_DAY_FIRST_DATE), _calendar(full_year, month, day)))


def statement_date(raw: Column) -> Column:
    """Transaction date as printed on a statement; text in no known layout stays as it is."""
    s = trimmed(raw)
    day, month, year = _day_month_year(s)
    full_year = F.when(F.length(year) == 2, _pivot_year(_int(year))).otherwise(_int(year))
    parsed = F.when(s.rlike(STATEMENT_DATE), _calendar(full_year, month, day))
    return F.when(s == "", raw).otherwise(F.coalesce(parsed, s))


def swap_into_period(date: Column, start: Column, end: Column) -> Column:
    """Swap day and month when only the swapped date falls inside the statement period."""
    d, lo, hi = real_date(date), real_date(start), real_date(end)
    swapped = F.try_to_date(
        F.format_string("%04d-%02d-%02d", F.year(d), F.dayofmonth(d), F.month(d)), "yyyy-MM-dd")
    usable = d.isNotNull() & lo.isNotNull() & hi.isNotNull()
    swap = usable & ~d.between(lo, hi) & (F.dayofmonth(d) <= 12) & swapped.between(lo, hi)
    return F.when(swap, F.date_format(swapped, "yyyy-MM-dd")).otherwise(date)


def utc_timestamp(raw: Column) -> Column:
    """Zone-less text is UTC; an explicit zone is honoured. Returned zone-less, in UTC."""
    zoned = raw.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$")
    text = F.when(zoned, raw).otherwise(F.concat(raw, F.lit("Z")))
    parsed = text.try_cast("timestamp")
    return F.to_utc_timestamp(parsed, F.current_timezone()).cast("timestamp_ntz")


def mail_date(raw: Column) -> Column:
    """The date of a mail header (RFC 2822) in ISO form with its offset; null if it cannot be read.

    An unknown zone, none, or -0000 gives a time without an offset.
    """
    # the groups are taken apart once, and what is read from them stands inside a function of them
    split = F.split(F.regexp_replace(raw, MAIL_DATE, "$1 $2 $3 $4 $5 $6 $7 "), " ")
    return F.get(F.transform(F.array(split), lambda groups: _mail_date(raw, groups)), F.lit(0))


def _mail_date(raw: Column, groups: Column) -> Column:
    def part(k: int) -> Column:
        return F.get(groups, F.lit(k - 1))

    month = F.element_at(F.create_map(*[F.lit(x) for item in MONTHS.items() for x in item]), F.lower(part(2)))
    year = F.when(F.length(part(3)) == 2, _pivot_year(_int(part(3)))).otherwise(_int(part(3)))
    second = F.when(part(6) == "", "00").otherwise(part(6))
    time = F.try_to_timestamp(F.format_string("%04d-%02d-%02d %02d:%s:%s", year, month, _int(part(1)), _int(part(4)), part(5), second),
                              F.lit("yyyy-MM-dd HH:mm:ss"))
    zones = F.create_map(*[F.lit(x) for item in MAIL_ZONES.items() for x in item])
    zone = F.when(part(7).rlike("^[+-]"), part(7)).otherwise(F.try_element_at(zones, F.upper(part(7))))
    offset = F.when(zone.isNull() | (zone == "-0000"), "").otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2)))
    return F.when(raw.rlike(MAIL_DATE) & month.isNotNull() & time.isNotNull(), F.concat(
        F.format_string("%04d-%02d-%02dT%02d:%s:%s", year, month, _int(part(1)), _int(part(4)), part(5), second), offset))
