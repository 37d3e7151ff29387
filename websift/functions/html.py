"""HTML to title, text and links.

The parser is the one step that leaves the JVM: the standard library's, in an Arrow worker, once per
page for all three results. A chain of regular expressions in the JVM was tried; on the same pages it
took three times as long and needed the parser anyway for irregular markup.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from websift.functions import reader
from websift.functions import text as X
from websift.functions import urls as U

# The reader travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(reader)

PARTS = T.StructType([
    T.StructField("readable", T.BooleanType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("links", T.ArrayType(T.StringType())),
])


@lru_cache(maxsize=1)
def _parser_udf():
    read_page = reader.read_page
    arrow = pa.struct([("readable", pa.bool_()), ("title", pa.string()), ("text", pa.string()),
                       ("links", pa.list_(pa.string()))])

    def parse(html: pa.Array, url: pa.Array) -> pa.Array:
        return pa.array([None if h is None else read_page(h, u)
                         for h, u in zip(html.to_pylist(), url.to_pylist())], arrow)

    udf = F.arrow_udf(parse, PARTS)
    parse.__module__ = "__main__"       # pickled by value as well
    return udf


def with_parts(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` plus ``readable``, ``raw_title``, ``raw_text`` and ``raw_links``."""
    df = pages.withColumn("_p", _parser_udf()(F.coalesce(F.col(html), F.lit("")), F.col(url)))
    return df.select(*pages.columns, F.col("_p.readable").alias("readable"),
                     F.col("_p.title").alias("raw_title"), F.col("_p.text").alias("raw_text"),
                     F.col("_p.links").alias("raw_links"))


def with_content(pages: DataFrame, html: str = "html", url: str = "url",
                 want: tuple[str, ...] = ("title", "content", "links"), max_title: int | None = None) -> DataFrame:
    """``pages`` plus ``readable`` and, of cleaned ``title`` and ``content`` and the page's valid ``links`` in
    order, what ``want`` names. Titles are whole unless a maximum of characters is given.

    A page that cannot be read has null title and content and no links.
    """
    df = with_parts(pages, html, url)
    title = X.tidy(F.col("raw_title"))
    title = F.nullif(title if max_title is None else F.substr(title, F.lit(1), F.lit(max_title)), F.lit(""))
    made = {
        "title": F.when(F.col("readable"), F.coalesce(title, F.lit("Untitled"))),
        "content": F.when(F.col("readable"), X.tidy(F.col("raw_text"))),
        "links": F.filter(F.transform("raw_links", U.normalize_url), U.is_valid_url),
    }
    # A one-row generator instead of a projection: filters on what it makes stay above it, where they see
    # finished values. Moved below, they would parse and clean every page once more. Filters on other
    # columns still reach the scan.
    one = F.array(F.struct("readable", *[made[w].alias(w) for w in want]))
    return df.select(*pages.columns, F.inline(one))
