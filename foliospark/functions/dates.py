"""Dates in texts and names. Found dates stay (year, month, day) structs: 31 February is kept as written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# French month names without accents, in order.
MONTHS = ("janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre")


def _groups(c: Column, pattern: str, year: int, month: int, day: int) -> Column:
    """(y, m, d) of all matches: one pass over the text, the groups are taken from the matches."""
    part = lambda x, k: F.regexp_extract(x, pattern, k)
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), 0), lambda x: F.struct(part(x, year).alias("y"), part(x, month).alias("m"), part(x, day).alias("d")))


def _month_number(m: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), m).cast("int")


def dates(c: Column, folded: Column) -> Column:
    """Distinct (y, m, d) of day/month/year, ISO, compact and French forms; two-digit years turn at 50.

    Only months up to 12 and days up to 31 count.
    """
    a = _groups(c, "\\b(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{4}|\\d{2})\\b", 3, 2, 1)
    b = _groups(c, "\\b(\\d{4})-(\\d{1,2})-(\\d{1,2})\\b", 1, 2, 3)
    e = _groups(c, "(?<!\\d)((?:19|20)\\d{2})([01]\\d)([0-3]\\d)(?!\\d)", 1, 2, 3)
    f = _groups(folded, "\\b(\\d{1,2})(?:er)? (" + "|".join(MONTHS) + ") (\\d{4})\\b", 3, 2, 1)
    number = lambda x: x.cast("int")
    full = lambda y: F.when(F.length(y) == 2, F.when(number(y) < 50, number(y) + 2000).otherwise(number(y) + 1900)).otherwise(number(y))
    plain = F.transform(F.concat(a, b, e), lambda x: F.struct(full(x["y"]).alias("y"), number(x["m"]).alias("m"), number(x["d"]).alias("d")))
    named = F.transform(f, lambda x: F.struct(number(x["y"]).alias("y"), _month_number(x["m"]).alias("m"), number(x["d"]).alias("d")))
    return F.sort_array(F.array_distinct(F.filter(F.concat(plain, named), lambda x: x["m"].between(1, 12) & x["d"].between(1, 31))))


def padded(c: Column) -> Column:
    """A date of YYYY, YYYY-MM or YYYY-MM-DD; missing parts are 01, what is no date of the calendar is null."""
    s = F.trim(c)
    whole = F.when(s.rlike("^\\d{4}$"), F.concat(s, F.lit("-01-01"))).when(s.rlike("^\\d{4}-\\d{2}$"), F.concat(s, F.lit("-01"))).when(s.rlike("^\\d{4}-\\d{1,2}-\\d{1,2}$"), s)
    return F.try_to_date(whole, "yyyy-M-d")


def padded_text(c: Column) -> Column:
    """The looser form for case files: YYYY, YYYY-M or YYYY-M-D as YYYY-MM-DD, whether or not there is such a day; else null."""
    s = F.trim(c)
    part = lambda k: F.lpad(F.coalesce(F.nullif(F.regexp_extract(s, "^(\\d{4})(?:-(\\d{1,2}))?(?:-(\\d{1,2}))?$", k), F.lit("")), F.lit("1")), 2, "0")
    return F.when(s.rlike("^\\d{4}(-\\d{1,2})?(-\\d{1,2})?$"), F.concat_ws("-", F.substring(s, 1, 4), part(2), part(3)))


def periods(folded: Column) -> Column:
    """Distinct (kind, year, n) of a folded file name: months in either order (YM), quarters (T), years (Y, 0)."""
    number = lambda x: x.cast("int")

    def of(kind: str, pattern: str, year: int, n: int) -> Column:
        found = [F.regexp_extract_all(folded, F.lit(pattern), k) for k in (year, n)]
        return F.zip_with(*found, lambda y, k: F.struct(F.lit(kind).alias("kind"), number(y).alias("y"), number(k).alias("n")))

    # How months, quarters and years stand in names.
    months = [of("YM", "(?<!\\d)(19\\d{2}|20\\d{2})[/.\\-_ ](0?[1-9]|1[0-2])(?!\\d)", 1, 2), of("YM", "(?<!\\d)(0?[1-9]|1[0-2])[/.\\-_ ](19\\d{2}|20\\d{2})(?!\\d)", 2, 1)]
    quarters = [of("T", "(?<!\\w)([1-4])\\s?t[- ]?(19\\d{2}|20\\d{2})(?!\\d)", 2, 1), of("T", "(?<!\\w)t\\s?([1-4])[- ]?(19\\d{2}|20\\d{2})(?!\\d)", 2, 1)]
    alone = F.transform(F.regexp_extract_all(folded, F.lit("(?<!\\d)(19\\d{2}|20\\d{2})(?!\\d)"), 1), lambda y: F.struct(F.lit("Y").alias("kind"), number(y).alias("y"), F.lit(0).alias("n")))
    return F.sort_array(F.array_distinct(F.concat(*months, *quarters, alone)))


def years(first: Column, last: Column) -> Column:
    """All years of a span; none if it is empty."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
