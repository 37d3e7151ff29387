"""Relevance (BM25), authority score and badges as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Authority of well-known sites, in the order they are tried.
AUTHORITY = {"youtube.com": 100, "google.com": 95, "facebook.com": 90, "twitter.com": 85,
             "instagram.com": 80, "wikipedia.org": 75, "github.com": 70, "stackoverflow.com": 65,
             "reddit.com": 60}
TOP_LEVEL = [".com", ".org", ".net"]

K1, B = 1.2, 0.75


def idf(n_docs: Column, df: Column) -> Column:
    """Inverse document frequency, never zero or less."""
    raw = F.log((n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))
    return F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)


def bm25_part(idf_: Column, f: Column, doc_len: Column, avg_len: Column) -> Column:
    """One phrase's share of a page's relevance; more negative is better."""
    return -idf_ * (f * F.lit(K1 + 1.0)) / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * doc_len / avg_len))


def website_rank(domain: Column, url: Column, title: Column, content_length: Column, terms: Column) -> Column:
    """Authority of the site, hits of the terms in title and URL, and length of the page.

    ``domain`` should be a column of its own: it is looked at for each site.
    """
    host = F.lower(domain)
    site = F.lit(0)
    for name, bonus in reversed(AUTHORITY.items()):
        site = F.when(host.contains(name), bonus).otherwise(site)
    tld = F.lit(False)
    for t in TOP_LEVEL:
        tld = tld | host.contains(t)
    low_title, low_url = F.lower(F.coalesce(title, F.lit(""))), F.lower(url)
    in_title = F.size(F.filter(terms, lambda t: low_title.contains(F.lower(t)) & (low_title != "")))
    in_url = F.size(F.filter(terms, lambda t: low_url.contains(F.lower(t))))
    length = (F.when(content_length > 1000, 10).when(content_length > 500, 5).otherwise(0))
    return (site + F.when(tld, 20).otherwise(0) + in_title * 30 + in_url * 15 + length).cast("int")


def badge(custom_rank: Column) -> Column:
    return F.when(custom_rank > 80, "Original Site").when(custom_rank > 50, "High Quality")
