"""Postings and statistics of pages, one row for each token: what streams append. ``segments`` stores them to be asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from websift.functions import text as X


def build_postings(pages: DataFrame) -> DataFrame:
    """``term, field, doc_id, pos, doc_len`` of ``pages``. No shuffle."""
    t = pages.select(F.col("id").alias("doc_id"), X.tokens(F.col("title")).alias("title"),
                     X.tokens(F.col("content")).alias("content"))
    t = t.withColumn("doc_len", F.size("title") + F.size("content"))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("toks")) for f in ("title", "content")])
    t = t.select("doc_id", "doc_len", F.explode(fields).alias("x"))
    return (t.select("doc_id", "doc_len", F.col("x.field").alias("field"), F.posexplode("x.toks").alias("pos", "term"))
            .select("term", "field", "doc_id", "pos", "doc_len"))


def build_doc_stats(pages: DataFrame) -> DataFrame:
    """``doc_id, n_tokens`` of every page, pages without tokens included. No shuffle."""
    n = sum(X.n_tokens(X.token_string(F.col(f))) for f in ("title", "content"))
    return pages.select(F.col("id").alias("doc_id"), n.cast("int").alias("n_tokens"))


def corpus_stats(doc_stats: DataFrame) -> DataFrame:
    """One row: ``n_docs, avg_tokens``."""
    return doc_stats.agg(F.count(F.lit(1)).alias("n_docs"),
                         (F.sum("n_tokens") / F.count(F.lit(1))).alias("avg_tokens"))


def term_stats(postings: DataFrame) -> DataFrame:
    """``term, n_docs, n_hits``: documents and occurrences of each term.

    Occurrences are first counted for each document, so a term that is everywhere is spread over all
    tasks before one row per task and term is left. Postings of pages dealt by id are counted where they are made.
    """
    per_doc = postings.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("hits"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("hits").alias("n_hits"))
