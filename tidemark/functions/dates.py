"""Dates as ISO strings: parsing, plausibility and provenance, all as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The window's floor, the bands of years in other calendars, and residues of failed conversions.
EARLIEST = "1900-01-01"
OTHER_CALENDARS = ((1300, 1450), (2400, 2600))
SENTINELS = ("1969-12-31", "1970-01-01", "1970-01-02", "1901-12-13", "1901-12-14")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
# Fixed patterns: machine-readable publication dates in a page, from the most to the least explicit.
PAGE_DATES = (
    ("jsonld", r'(?i)"datePublished"\s*:\s*"([^"]{4,40})"'),
    ("meta_published", r"""(?i)<meta[^>]+(?:article:published_time|datePublished|pubdate)[^>]+content=["']([^"']{4,40})"""),
    ("meta_published", r"""(?i)<meta[^>]+content=["']([^"']{4,40})["'][^>]*(?:article:published_time|datePublished)"""),
    ("meta_published", r"""(?i)<time[^>]+datetime=["']([^"']{4,40})"""),
)


def verdict(date: Column, today: str) -> Column:
    """ok, non_gregorian, sentinel or out_of_window; an absent date is ok, being somebody else's case."""
    year = F.substring(date, 1, 4).try_cast("int")
    other = F.lit(False)
    for low, high in OTHER_CALENDARS:
        other = other | year.between(low, high)
    return (
        F.when(date.isNull() | (date == ""), "ok").when(year.isNull(), "out_of_window").when(other, "non_gregorian")
        .when(date.isin(*SENTINELS), "sentinel").when((date < EARLIEST) | (date > today), "out_of_window").otherwise("ok")
    )


def kept_date(date: Column, today: str) -> Column:
    """The date, or null where its verdict refuses it."""
    return F.when(verdict(date, today).isin("ok", "non_gregorian") & (date != ""), date)


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.date_format(F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")


def iso_date(value: Column) -> Column:
    """An explicit value as YYYY-MM-DD, or null.

    An ISO date anywhere decides alone, valid or not.  Else "17 March 2023",
    then a whole value "25-8-2020" (day first), then Unix seconds.
    """
    text = F.trim(value)
    iso = r"\b(\d{4})-(\d{2})-(\d{2})(?!\d)"
    words = r"(?U)\b(\d{1,2})\s+(\w+)\s+(\d{4})\b"
    numeric = r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, words, 2)))
    named = F.when(month > 0, _date(_part(text, words, 3), month.cast("string"), _part(text, words, 1)))
    first = F.when(text.rlike(numeric), _date(_part(text, numeric, 3), _part(text, numeric, 2), _part(text, numeric, 1)))
    seconds = F.when(text.rlike(r"^[0-9.]*[0-9][0-9.]*$"), text.try_cast("double"))
    unix = F.when((seconds > 1e8) & (seconds < 4e9), F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd"))
    found = F.when(text.rlike(iso), _date(*(_part(text, iso, g) for g in (1, 2, 3)))).otherwise(F.coalesce(named, first, unix))
    return F.when(~F.lower(text).isin("", "none", "nan", "null", "-"), found)


def _url_part(url: Column, pattern: str) -> Column:
    return F.when(url.rlike(pattern), _date(*(_part(url, pattern, g) for g in (1, 2, 3))))


def url_path_date(url: Column) -> Column:
    """The date of a publisher's path, /2019-05-03/ before /2019/05/03/."""
    return F.coalesce(_url_part(url, r"/(\d{4})-(\d{2})-(\d{2})(?:/|\b)"), _url_part(url, r"/(\d{4})/(\d{2})/(\d{2})(?:/|\b)"))


def url_date(url: Column) -> Column:
    """struct(date, source): the path's date, else an archive's capture stamp, else (null, none)."""
    path = url_path_date(url)
    capture = _url_part(url, r"/web/(\d{4})(\d{2})(\d{2})\d*/")
    source = F.when(path.isNotNull(), "url_path").when(capture.isNotNull(), "wayback_capture").otherwise("none")
    return F.struct(F.coalesce(path, capture).alias("date"), source.alias("source"))


def page_date(html: Column, last_modified: Column, url: Column) -> Column:
    """struct(date, source, confidence) of a page.

    What its publisher states is of high confidence, what its URL suggests of
    low.  A file's time of change is noted as a source but gives no date.
    """
    found = [(source, iso_date(F.regexp_extract(html, pattern, 1))) for source, pattern in PAGE_DATES]
    by_url = url_date(url)
    choice = F.lit(None)
    choice = F.coalesce(
        *[F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(s).alias("source"), F.lit("high").alias("confidence"))) for s, d in found],
        F.when(by_url["date"].isNotNull(), F.struct(by_url["date"].alias("date"), by_url["source"].alias("source"), F.lit("low").alias("confidence"))),
        F.struct(F.lit(None).cast("string").alias("date"), F.when(F.coalesce(last_modified, F.lit("")) != "", "http_last_modified").otherwise("none").alias("source"), F.lit("none").alias("confidence")),
    )
    return choice


def wiki_date(markup: Column) -> Column:
    """The date of an article's date template, else of its date category; "May 3, 2019" or what ``iso_date`` reads."""
    found = []
    for pattern in (r"(?i)\{\{\s*date\s*\|\s*([^}|]+?)\s*\}\}", r"(?i)\[\[Category:(\w+ \d{1,2}, \d{4})\]\]"):
        raw = F.trim(_part(markup, pattern, 1))
        words = r"(?U)^(\w+)\s+(\d{1,2}),?\s+(\d{4})"
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(raw, words, 1)))
        named = _date(_part(raw, words, 3), month.cast("string"), _part(raw, words, 2))
        # a named month decides alone, valid or not
        found.append((month > 0, named, iso_date(raw)))
    (a, by_a, iso_a), (b, by_b, iso_b) = found
    return F.when(a, by_a).when(iso_a.isNotNull(), iso_a).when(b, by_b).otherwise(iso_b)
