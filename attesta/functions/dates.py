"""Conservative date functions. Each parser is its own: 5/8/2026 is May in some and August in another.

None reads a clock; `today` is always an argument.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import let, normalize_evidence, text

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
YEAR = r"(?<!\d)(20\d{2})(?!\d)"
EXCEL_EPOCH = dt.date(1899, 12, 30)


def day(value: dt.date | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def make_date(y: Column, m: Column, d: Column) -> Column:
    """A date, or null if there is no such day."""
    return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def _parts(c: Column, pattern: str, y: int, m: int, d: int) -> Column:
    part = lambda i: F.regexp_extract(c, pattern, i)
    return F.when(c.rlike(pattern), make_date(part(y), part(m), part(d)))


def parse_loose(c: Column | str) -> Column:
    """month/day/year, or text that starts with an ISO date; anything vaguer is null."""
    s = F.trim(text(c))
    return F.coalesce(_parts(s, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 1, 2), _parts(s, r"^(\d{4})-(\d{1,2})-(\d{1,2})", 1, 2, 3))


def month_number(word: Column) -> Column:
    """1 to 12 by the first three letters of a month's name, as text; null otherwise."""
    at = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(F.lower(word), 1, 3))
    return F.when(at > 0, at.cast("string"))


def parse_deadline(c: Column | str) -> Column:
    """ISO, then 15 May 2026, then May 15, 2026, then day/month/year and at last month/day/year."""
    s = F.trim(text(c))
    low = F.lower(s)
    day_first, month_first, slashes = r"(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]{3,9})\.?\s+(\d{4})", r"([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})", r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
    get = lambda p, i, t=low: F.regexp_extract(t, p, i)
    named = lambda p, d, m: F.when(low.rlike(p) & month_number(get(p, m)).isNotNull(), F.struct(make_date(get(p, 3), month_number(get(p, m)), get(p, d)).alias("d")))
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.struct(_parts(s, r"^(\d{4})-(\d{2})-(\d{2})", 1, 2, 3).alias("d")))
    both = F.struct(F.coalesce(_parts(s, slashes, 3, 2, 1), _parts(s, slashes, 3, 1, 2)).alias("d"))
    return F.coalesce(iso, named(day_first, 1, 2), named(month_first, 2, 1), both)["d"]


def parse_iso(c: Column | str) -> Column:
    """T31d: text that starts with an ISO date."""
    return _parts(F.trim(text(c)), r"^(\d{4})-(\d{2})-(\d{2})", 1, 2, 3)


def parse_for_matching(c: Column | str) -> Column:
    """T31e: four numeric forms in order, else 1 July of a year that is named, else null."""
    s = F.trim(text(c))
    first = F.substring_index(s, " ", 1)
    short = r"^(\d{1,2})/(\d{1,2})/(\d{2})$"
    get = lambda i: F.regexp_extract(first, short, i)
    year = F.when(get(3).cast("int") < 69, F.concat(F.lit("20"), get(3))).otherwise(F.concat(F.lit("19"), get(3)))
    slashes = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    named = F.regexp_extract(s, r"\b(20\d{2})\b", 1)
    return F.coalesce(
        _parts(first, r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 1, 2, 3),
        _parts(first, slashes, 3, 1, 2),
        _parts(first, slashes, 3, 2, 1),
        F.when(first.rlike(short), make_date(year, get(1), get(2))),
        F.when(named != "", make_date(named, F.lit("7"), F.lit("1"))),
    )


def years_in(c: Column | str) -> Column:
    """Isolated years 20xx of a text, in order."""
    return F.regexp_extract_all(text(c), F.lit(YEAR))


def edition_year(*columns: Column | str) -> Column:
    """The latest year of the first text that names one."""
    return F.coalesce(*[F.array_max(years_in(c)) for c in columns])


def lone_year(c: Column | str) -> Column:
    """The year of a text that names exactly one."""
    years = F.array_distinct(years_in(c))
    return F.when(F.size(years) == 1, F.element_at(years, 1).cast("int"))


def first_year(c: Column | str) -> Column:
    """T29"""
    return F.nullif(F.regexp_extract(text(c), YEAR, 1), F.lit("")).cast("int")


def event_past(c: Column | str, today: dt.date | Column) -> Column:
    """Whether the dates in a text lie before today; null if no year is named.

    The latest year, and the latest month that stands as a word (December if none does).
    """
    low = F.lower(text(c))
    year = F.array_max(F.regexp_extract_all(low, F.lit(r"\b(20\d{2})\b")))
    month = F.greatest(*[F.when(low.rlike(rf"\b{m[:3]}"), F.lit(i)).otherwise(F.lit(0)) for i, m in enumerate(MONTHS, 1)])
    end = make_date(year, F.when(month == 0, 12).otherwise(month).cast("string"), F.lit("28"))
    return F.when(year.isNotNull(), end < day(today))


def days_until(d: Column, today: dt.date | Column) -> Column:
    return F.datediff(d, day(today))


def closing_within(d: Column, n: int, today: dt.date | Column) -> Column:
    """A deadline from today up to n days ahead; unknown dates are not."""
    return F.coalesce(days_until(d, today).between(0, n), F.lit(False))


def excel_serial(d: Column) -> Column:
    return F.datediff(d, F.lit(EXCEL_EPOCH))


def from_excel_serial(n: Column) -> Column:
    """The date of a serial day from 1 to 80000."""
    return F.when(n.between(1, 80_000), F.date_add(F.lit(EXCEL_EPOCH), n.cast("int")))


def date_signature(c: Column | str) -> Column:
    """struct(year, month): month by name, or by an ISO date; null without a year."""
    low = F.lower(text(c))
    year = F.nullif(F.regexp_extract(low, r"(20\d{2})", 1), F.lit(""))
    named = F.coalesce(*[F.when(low.rlike(rf"\b{m[:3]}"), F.lit(i)) for i, m in enumerate(MONTHS, 1)])
    iso = F.nullif(F.regexp_extract(low, r"20\d{2}-(\d{2})", 1), F.lit(""))
    return F.when(year.isNotNull(), F.struct(year.cast("int").alias("year"), F.coalesce(named, iso.cast("int")).alias("month")))


def date_variants(d: Column) -> Column:
    """Common renderings of a date, normalized like evidence text."""
    month, year = F.lower(F.date_format(d, "MMMM")), F.date_format(d, "yyyy")
    names = [month, F.substring(month, 1, 3), F.when(F.month(d) == 9, "sept").otherwise(F.substring(month, 1, 3))]
    found = []
    for n in (F.date_format(d, "d"), F.date_format(d, "dd")):
        found += [x for m in names for x in (F.concat_ws(" ", m, n, year), F.concat_ws(" ", n, m, year))]
        m = F.date_format(d, "M")
        found += [F.concat_ws("/", m, n, year), F.concat_ws("/", n, m, year), F.concat_ws("/", m, n, F.date_format(d, "yy"))]
    return F.array_distinct(F.array(*found, F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "MM/dd/yyyy")))


def find_date(page: Column | str, d: Column) -> Column:
    """Whether a date stands in a text in any common rendering."""
    return F.coalesce(let(normalize_evidence(page), lambda hay: F.exists(date_variants(d), lambda v: F.contains(hay, v))), F.lit(False))


def rival_dates(page: Column | str, exclude: Column, today: dt.date) -> Column:
    """Dates up to 80 characters after a deadline word, sorted, of this cycle and not the excluded one."""
    hay = normalize_evidence(page)
    near = F.regexp_extract_all(hay, F.lit(r"((?:deadline|closes?|due|submit by|submissions? close)[^.]{0,80})"))
    pattern = r"((?:" + "|".join(MONTHS) + r")\s+\d{1,2},?\s+20\d{2}|20\d{2}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/20\d{2})"
    found = F.flatten(F.transform(near, lambda s: F.regexp_extract_all(s, F.lit(pattern))))
    low, high = dt.date(today.year - 1, 1, 1), dt.date(today.year + 3, 12, 31)
    fits = lambda t, own: F.coalesce(parse_deadline(t).between(F.lit(low), F.lit(high)), F.lit(False)) & ~F.coalesce(F.array_contains(own, t), F.lit(False))
    none = F.array().cast("array<string>")
    kept = let(F.coalesce(date_variants(exclude), none), lambda own: F.filter(found, lambda t: fits(t, own)))
    return F.when(F.size(near) > 0, F.array_sort(F.array_distinct(kept))).otherwise(none)


def version_parts(c: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(text(c), F.lit(r"(\d+)")), lambda p: p.cast("int"))


def version_lt(a: Column | str, b: Column | str) -> Column:
    """Dotted versions compared number by number, the shorter padded with zeros."""
    pa, pb = version_parts(a), version_parts(b)
    width = F.greatest(F.size(pa), F.size(pb), F.lit(1))
    pad = lambda p: F.concat(p, F.array_repeat(F.lit(0), width - F.size(p)))
    return pad(pa) < pad(pb)
