"""Text normalisation and similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
MIN_WORD_LENGTH = 4
NAME_NOISE_WORDS = [
    "LTD", "LIMITED", "PVT", "PRIVATE", "INC", "LLC", "CO", "COMPANY", "AC", "ACCOUNT",
]
SOURCES = ["MANUAL", "API", "CONNECTOR"]
COUNTRIES = ["INDIA", "USA"]
# -----------------------------------------------------------------------------

_BLANKS = " \t\n\r\f\u000b "


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def is_blank(c: Column) -> Column:
    """Null or the empty string: what the rules treat as "not given"."""
    return c.isNull() | (c == "")


def plain_text(c: Column) -> Column:
    return F.lower(trimmed(F.coalesce(c, F.lit(""))))


def alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def tokens(c: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")
    return F.filter(parts, lambda w: F.length(w) >= MIN_WORD_LENGTH)


def reference_key(c: Column) -> Column:
    code = F.upper(alnum(c))
    return F.when(code.rlike("^[0-9]+$"), F.regexp_replace(code, "^0+(?=[0-9])", "")).otherwise(code)


def account_key(c: Column) -> Column:
    words = F.split(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", " "), " ")
    noise = F.array(*[F.lit(w) for w in NAME_NOISE_WORDS])
    return F.array_join(
        F.filter(words, lambda w: (w != "") & ~F.array_contains(noise, w)), " ")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 when either side is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(
        1.0 - F.levenshtein(a, b) / longest)


def may_reach(a: Column, b: Column, least: float) -> Column:
    """Whether two texts are close enough in length for this similarity; costs next to nothing."""
    return F.least(F.length(a), F.length(b)) >= F.greatest(F.length(a), F.length(b)) * least


def name_similarity(a: Column, b: Column) -> Column:
    return name_similarity_of(plain_text(a), alnum(a), plain_text(b), alnum(b))


def name_similarity_of(a: Column, a_alnum: Column, b: Column, b_alnum: Column) -> Column:
    """Same score from forms that were normalised once, ahead of a loop."""
    both = (a_alnum != "") & (b_alnum != "")
    long_enough = (F.length(a_alnum) >= MIN_WORD_LENGTH) & (F.length(b_alnum) >= MIN_WORD_LENGTH)
    contained = long_enough & (a_alnum.contains(b_alnum) | b_alnum.contains(a_alnum))
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when((a == b) | (both & (a_alnum == b_alnum)), F.lit(1.0))
        .when(both & contained, F.lit(0.95))
        .when(both, similarity(a_alnum, b_alnum))
        .otherwise(similarity(a, b))
    )


def long_words(c: Column) -> Column:
    return F.filter(F.split(c, "\\s+"), lambda w: F.length(w) >= MIN_WORD_LENGTH)


def narration_score(narration: Column, account: Column, least: float = 0.0) -> Column:
    """How well a narration names an account. Scores below ``least`` may come out as 0."""
    n, a = plain_text(narration), plain_text(account)
    return narration_score_of(n, alnum(narration), long_words(n), a, alnum(account), long_words(a), least)


def word_score(n: Column, n_words: Column, word: Column, least: float = 0.0) -> Column:
    near = F.filter(n_words, lambda other: may_reach(word, other, least))
    closest = F.array_max(F.transform(near, lambda other: similarity(word, other)))
    return F.when(n.contains(word), F.lit(0.85)).otherwise(F.coalesce(closest, F.lit(0.0)))


def named_score(n: Column, n_alnum: Column, a: Column, a_alnum: Column) -> Column:
    """1 or 0.95 where the whole account name is in the narration, else null."""
    return (F.when((n == "") | (a == ""), F.lit(None).cast("double"))
            .when(n.contains(a), F.lit(1.0))
            .when((F.length(a_alnum) >= MIN_WORD_LENGTH) & n_alnum.contains(a_alnum), F.lit(0.95)))


def narration_score_of(n: Column, n_alnum: Column, n_words: Column, a: Column, a_alnum: Column,
                       a_words: Column, least: float = 0.0) -> Column:
    by_word = F.array_max(F.transform(a_words, lambda word: word_score(n, n_words, word, least)))
    return F.coalesce(named_score(n, n_alnum, a, a_alnum), F.when(n != "", by_word), F.lit(0.0))


def is_bank_or_cash(account_type: Column) -> Column:
    t = plain_text(account_type)
    return t.contains("bank") | t.contains("cash")


def source_code(c: Column) -> Column:
    code = F.upper(trimmed(c))
    return F.when(code.isin(SOURCES), code).otherwise("MANUAL")


def country_code(c: Column) -> Column:
    code = F.upper(trimmed(c))
    return F.when(code.isin(COUNTRIES), code).otherwise("INDIA")


def shortest_float(c: Column) -> Column:
    """A double written out plainly with at least one decimal: 25000.0, 12345678.5."""
    plain = F.regexp_replace(
        c.cast("string").try_cast("decimal(38,12)").cast("string"), "0+$", "")
    written = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    small = (F.abs(c) >= 1e-3) & (F.abs(c) < 1e7)
    return F.when(small | (c == 0), c.cast("string")).otherwise(written)


def shortest_number(c: Column) -> Column:
    """A double written without a trailing ``.0``: 25000, 12345678.5."""
    return F.regexp_replace(shortest_float(c), "\\.0$", "")
