"""Row filters of a search: site, URL words, file type and age."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_UP, _LOW = string.ascii_uppercase, string.ascii_lowercase


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UP, _LOW)


def url_like(url: Column, value: str) -> Column:
    """``value`` somewhere in the URL; ASCII letters in any case, ``%`` and ``_`` are wildcards."""
    word = value.translate(str.maketrans(_UP, _LOW))
    if set(word) & set("%_\\"):
        return ascii_lower(url).like("%" + word.replace("\\", "\\\\") + "%")
    return ascii_lower(url).contains(word)


def needle(value: Column) -> Column:
    """A value to look for in URLs, prepared once: ``struct<word, pattern>``. ``pattern`` is null without
    wildcards: a pattern column is compiled anew for each row."""
    word = ascii_lower(value)
    pattern = F.concat(F.lit("%"), F.replace(word, F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return F.when(value.isNotNull(), F.struct(word.alias("word"),
                                              F.when(value.rlike(r"[%_\\]"), pattern).alias("pattern")))


def holds(low_url: Column, n: Column) -> Column:
    """``url_like`` for a URL already in ``ascii_lower`` and a ``needle`` column."""
    return F.when(n["pattern"].isNotNull(), F.like(low_url, n["pattern"])).otherwise(low_url.contains(n["word"]))


def url_has_type(url: Column, extension: str) -> Column:
    """Opt-in file type filter: the lower-case path ends in the extension."""
    bare = F.regexp_replace(F.lower(url), "[?#].*$", "")
    return bare.endswith("." + extension.lower())


def since(now: Column, time_filter: Column) -> Column:
    """The moment after which a page must have been fetched; null for an unknown filter.

    A month or a year back keeps the day number: 31 March less one month is 31 days after 1 February.
    """
    def back(start: Column, kept_days: Column) -> Column:
        seconds = F.make_dt_interval(kept_days, F.hour(now), F.minute(now), F.second(now))
        return start.cast("timestamp_ntz") + seconds
    day = F.dayofmonth(now) - 1
    month = back(F.add_months(F.trunc(now, "month"), -1), day)
    first = F.make_date(F.year(now) - 1, F.month(now), F.lit(1))
    return (F.when(time_filter == "day", now - F.make_dt_interval(F.lit(1)))
            .when(time_filter == "week", now - F.make_dt_interval(F.lit(7)))
            .when(time_filter == "month", month)
            .when(time_filter == "year", back(first, day)))


def young_enough(crawled_at: Column, since_: Column) -> Column:
    """A null ``since`` does not filter."""
    return since_.isNull() | F.coalesce(crawled_at > since_, F.lit(False))


def conditions(low_url: Column, crawled_at: Column, site: Column, inurl: Column, since_: Column) -> Column:
    """All filters of a search that is a row itself. ``site`` is a needle, ``inurl`` an array of needles; a
    null site does not filter."""
    return (F.coalesce(holds(low_url, site), F.lit(True)) & F.forall(inurl, lambda n: holds(low_url, n))
            & young_enough(crawled_at, since_))
