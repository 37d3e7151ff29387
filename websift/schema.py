"""Table schemas shared by every module."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Raw fetches as they arrive: one HTML document per URL.
RAW_PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

# The page store.
PAGES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("crawled_at", T.TimestampNTZType()),
    T.StructField("status_code", T.IntegerType()),
])

# The search index: one row for each token.
POSTINGS = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("doc_len", T.IntegerType()),
])

DOC_STATS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_tokens", T.IntegerType()),
])

QUERIES = T.StructType([
    T.StructField("query_id", T.LongType(), False),
    T.StructField("q", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("time_filter", T.StringType()),
    T.StructField("sort_by", T.StringType()),
])

# One row per host: its robots rules, in file order.
ROBOTS = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("rules", T.ArrayType(T.StructType([
        T.StructField("rule_no", T.IntegerType()),
        T.StructField("allow", T.BooleanType()),
        T.StructField("path", T.StringType()),
    ]))),
])

FETCH_LOG = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("url", T.StringType()),
    T.StructField("outcome", T.StringType()),
])

FRONTIER = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("seq", T.LongType()),
])


def require(df: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    """Select the columns of ``schema`` from ``df``; fail early if one is missing or of another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in schema.fields:
        if f.name not in have:
            raise ValueError(f"{what}: column {f.name} is missing")
        if have[f.name].simpleString() != f.dataType.simpleString():
            raise ValueError(f"{what}: column {f.name} is {have[f.name].simpleString()}, "
                             f"expected {f.dataType.simpleString()}")
    return df.select(*[f.name for f in schema.fields])
