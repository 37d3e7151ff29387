"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is never crawled, and which words raise a URL's priority.
SKIP_SUFFIXES = [".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".zip", ".exe", ".dmg", ".iso",
                 ".mp4", ".avi", ".mp3", ".wav", ".doc", ".docx", ".xls", ".xlsx"]
SKIP_DOMAINS = ["facebook.com", "twitter.com", "instagram.com", "linkedin.com", "pinterest.com",
                "youtube.com"]
HIGH_WORDS = ["news", "blog", "article", "2024", "2023"]
MEDIUM_WORDS = ["docs", "tutorial", "guide", "learn"]


def _plain(url: Column) -> Column:
    """As the URL standard reads it: leading blanks and inner tabs and newlines do not count."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_plain(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def domain(url: Column) -> Column:
    """Host part with user and port, case kept; '' if there is none."""
    return F.regexp_extract(_plain(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    """Path with query; '/' if empty."""
    p = F.regexp_extract(_plain(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^#]*)", 1)
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def normalize_url(url: Column) -> Column:
    """Trailing slashes, fragment, tracking parameters and one dangling ``?`` or ``&`` removed.

    The order is part of the meaning: ``a/#top`` keeps its slash, ``a?utm_source=x&b=1`` gives ``a&b=1``.
    """
    x = F.rtrim(url, F.lit("/"))
    x = F.regexp_replace(x, "(?d)#.*$", "")
    x = F.regexp_replace(x, "[?&]utm_(?:source|medium|campaign|content|term)=[^&]*", "")
    return F.regexp_replace(x, "(?d)[?&]$", "")


def is_valid_url(url: Column) -> Column:
    """Crawlable: http or https, a host, no skipped suffix, no skipped domain; false for null."""
    host = domain(url)
    low = F.lower(host)
    whole_brackets = host.rlike(r"^[^\[\]]*$|^[^\[\]]*\[[0-9A-Fa-f:.]+\](?::\d*)?$")
    ok = scheme(url).isin("http", "https") & (host != "") & whole_brackets
    ok = ok & ~F.lower(url).rlike("(?:" + "|".join("\\" + s for s in SKIP_SUFFIXES) + r")\z")
    for d in SKIP_DOMAINS:
        ok = ok & ~low.contains(d)
    return F.coalesce(ok, F.lit(False))


def url_priority(url: Column) -> Column:
    low = F.lower(url)
    return (F.when(low.rlike("|".join(HIGH_WORDS)), "high")
            .when(low.rlike("|".join(MEDIUM_WORDS)), "medium")
            .otherwise("low"))


def priority_order(p: Column) -> Column:
    return F.when(p == "high", 1).when(p == "medium", 2).otherwise(3)
