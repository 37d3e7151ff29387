"""Scans: raw pages, stored pages, seed lists, and documents seen as pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from websift import schema as S
from websift.functions import urls as U
from websift.functions.html import with_content


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched HTML documents: ``page_id, url, html``."""
    return S.require(spark.read.parquet(path), S.RAW_PAGES, path)


def stored_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the store: ``id, url, title, content, crawled_at, status_code``."""
    return S.require(spark.read.schema(S.PAGES).parquet(path), S.PAGES, path)


def seed_file(spark: SparkSession, path: str) -> DataFrame:
    """Seed URLs from text files, one URL a line: ``seq, url``; ``seq`` keeps the order of the lines."""
    lines = spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> ''")
    return lines.select(F.monotonically_increasing_id().alias("seq"), "url")


def clean_seeds(seeds: DataFrame) -> DataFrame:
    """Seeds normalised like links; the first of equal ones stays. ``seeds``: ``seq, url``."""
    n = seeds.select("seq", U.normalize_url(F.col("url")).alias("url"))
    return n.groupBy("url").agg(F.min("seq").alias("seq")).select("seq", "url")


def arrival(key: Column) -> Column:
    """A crawl time derived from a key: seven hours apart, from the start of 2024."""
    return (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(F.floor(key * 7 / 24).cast("int"), (key * 7 % 24).cast("int")))


def as_store(pages: DataFrame) -> DataFrame:
    """Raw pages read, cleaned and given the store's columns.

    Pages are parsed whatever columns are taken; for id and URL alone ask the raw pages.
    """
    c = with_content(pages, want=("title", "content"))
    return c.select(F.col("page_id").alias("id"), "url", "title", "content",
                    arrival(F.col("page_id")).alias("crawled_at"),
                    F.lit(200).alias("status_code"))


def documents_as_store(documents: DataFrame, max_title: int | None = None) -> DataFrame:
    """Plain documents as stored pages: the first line is the title, whole unless a maximum of characters is given."""
    first = F.substring_index(F.col("text"), "\n", 1)
    return documents.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"),
                 F.col("doc_id").cast("string")).alias("url"),
        (first if max_title is None else F.substr(first, F.lit(1), F.lit(max_title))).alias("title"),
        F.col("text").alias("content"),
        arrival(F.col("doc_id")).alias("crawled_at"),
        F.lit(200).alias("status_code"))
