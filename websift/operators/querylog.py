"""Search strings to search conditions, as columns over a table of queries.

A search string mixes plain terms with "phrases", -exclusions, site:, filetype:, intitle: and inurl:.
Each step takes its matches out of the string before the next one looks at it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from websift.functions import text as X

_W = f"[{X.WORD}]"
_S = f"[^{X.BLANK}]"

# The operators in the order they are taken out.
_TAKE = [
    ("exact_phrase", '"([^"]*)"'),
    ("exclude", f"-({_W}+)"),
    ("site", f"site:({_S}+)"),
    ("filetype", f"filetype:({_W}+)"),
    ("intitle", f"intitle:({_W}+)"),
    ("inurl", f"inurl:({_W}+)"),
]
_FIRST_ONLY = ("site", "filetype")


def with_conditions(queries: DataFrame, q: str = "q") -> DataFrame:
    """``queries`` plus exact_phrase, exclude, site, filetype, intitle, inurl, before, after, terms."""
    df = queries.withColumn("_rest", F.col(q))
    for name, pattern in _TAKE:
        found = F.regexp_extract_all("_rest", F.lit(pattern), F.lit(1))
        if name in _FIRST_ONLY:
            found = F.try_element_at(found, F.lit(1))
        df = df.select(*df.columns, found.alias(name))
        df = df.withColumn("_rest", F.regexp_replace("_rest", pattern, ""))
    df = df.withColumn("before", F.lit(None).cast("string")).withColumn("after", F.lit(None).cast("string"))
    terms = F.filter(F.split("_rest", f"[{X.BLANK}]+"), lambda t: t != "")
    return df.withColumn("terms", terms).drop("_rest")


def rank_terms() -> Column:
    """The strings the authority score looks for in title and URL."""
    return F.concat("terms", "exact_phrase")


def phrases() -> Column:
    """What the index must match: ``array<struct<title_only, tokens>>``, all of them.

    A term is a phrase too, of one token or of the several it splits into.
    """
    def part(column: str, title_only: bool) -> Column:
        return F.transform(column, lambda t: F.struct(F.lit(title_only).alias("title_only"),
                                                      X.tokens(t).alias("tokens")))
    return F.concat(part("exact_phrase", False), part("terms", False), part("intitle", True))


def searchable(queries: DataFrame) -> DataFrame:
    """Queries that ask for anything at all."""
    return queries.filter(F.col("q") != "")
