"""Months, years and date ranges in free text, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_line, coerce, let

MONTHS = "January February March April May June July August September October November December".split()
MONTH = (
    r"(?i)\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?|0?[1-9]|1[0-2])\b"
)
YEAR, RANGE = r"\b(?:19|20)\d{2}\b", r"\b((?:19|20)\d{2})\s*[-/]\s*((?:19|20)\d{2}|\d{2})\b"
CURRENT = r"(?i)\b(?:present|current|ongoing|now|till\s+date)\b"


def month(x: Column) -> Column:
    """English name of the month from its name, first letters or number, empty if it is none."""
    token = F.replace(F.lower(coerce(x)), F.lit("."), F.lit(""))
    spelt = lambda n, m: (m.lower(), m.lower()[:3], *(["sept"] if m == "September" else []), str(n), f"{n:02d}")
    return let(token, lambda t: F.coalesce(*[F.when(t.isin(*spelt(n, m)), m) for n, m in enumerate(MONTHS, 1)], F.lit("")))


def _dashes(x: Column) -> Column:
    return F.regexp_replace(clean_line(x), "[–—−]", "-")


def _end(first: Column, second: Column) -> Column:
    """Second year of a range; two digits take the first one's century, or are a month if 12 at most (then null)."""
    return F.when(F.length(second) == 4, second).when(second.cast("int") > 12, F.concat(F.substring(first, 1, 2), second)).otherwise(F.lit(None))


def _plausible(year: Column) -> Column:
    return F.when(year.rlike(r"^(?:19|20)\d{2}$"), year)


def year(x: Column) -> Column:
    """The last year of the first range, else the first year, empty without one."""

    def find(t: Column) -> Column:
        a, b = F.regexp_extract(t, RANGE, 1), F.regexp_extract(t, RANGE, 2)
        one = F.regexp_extract(t, YEAR, 0)
        return F.when(b == "", one).when((F.length(b) == 2) & (b.rlike("^(?:0.|1[0-2])$")), a).otherwise(F.coalesce(_plausible(_end(a, b)), one))

    return let(_dashes(x), find)


def date_range(x: Column) -> Column:
    """struct(start_month, start_year, end_month, end_year, current, issues)."""

    def find(t: Column) -> Column:
        now = t.rlike(CURRENT)
        months, years = F.regexp_extract_all(t, F.lit(MONTH), F.lit(1)), F.regexp_extract_all(t, F.lit(YEAR), F.lit(0))
        a, b = F.regexp_extract(t, RANGE, 1), F.regexp_extract(t, RANGE, 2)
        nth = lambda arr, n: F.coalesce(F.get(arr, F.lit(n)), F.lit(""))
        start_month, start_year = month(nth(months, 0)), F.when(a != "", a).otherwise(nth(years, 0))
        end_month = F.when(now, "").otherwise(month(nth(months, 1)))
        end_year = F.when(now, "").when(a != "", F.coalesce(_plausible(_end(a, b)), F.lit(""))).otherwise(nth(years, 1))
        nothing = (t != "") & (start_year == "") & (end_year == "") & (start_month == "") & (end_month == "") & ~now
        issues = F.when(nothing, F.array(F.lit("no parseable date tokens found"))).otherwise(F.array().cast("array<string>"))
        return F.struct(
            start_month.alias("start_month"), start_year.alias("start_year"), end_month.alias("end_month"), end_year.alias("end_year"), now.alias("current"), issues.alias("issues")
        )

    return let(_dashes(x), find)


def achieved_date(x: Column) -> Column:
    """``Month YYYY``, ``YYYY`` or empty."""

    def find(t: Column) -> Column:
        m, y = month(F.regexp_extract(t, MONTH, 1)), F.regexp_extract(t, YEAR, 0)
        return F.when((m != "") & (y != ""), F.concat_ws(" ", m, y)).otherwise(y)

    return let(clean_line(x), find)


def years_of_experience(ranges: Column, this_year: Column) -> Column:
    """Latest end less earliest start of an array of date ranges; a current one ends this year. 0 without a start."""
    starts = F.filter(F.transform(ranges, lambda r: F.try_to_number(r["start_year"], F.lit("9999")).cast("int")), lambda v: v.isNotNull())
    ends = F.filter(F.transform(ranges, lambda r: F.when(r["current"], this_year).otherwise(F.try_to_number(r["end_year"], F.lit("9999")).cast("int"))), lambda v: v.isNotNull())
    return F.greatest(F.coalesce(F.array_max(ends) - F.array_min(starts), F.lit(0)), F.lit(0))
