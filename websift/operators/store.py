"""The page store: which rows are new, how they are written, and what the store holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from websift import schema as S
from websift.functions import text as X
from websift.session import stored as written

# Fixed values of the store.
MIN_CONTENT = 100


class DuplicateUrl(ValueError):
    """A bulk insert brings a URL twice, or one the store has."""


def long_enough(content: Column) -> Column:
    return F.length(X.strip(content)) >= MIN_CONTENT


def first_of_url(rows: DataFrame) -> DataFrame:
    """The row with the smallest ``seq`` of each URL.

    Every task keeps one row of a URL before the shuffle, so many copies of one page meet nowhere.
    """
    w = Window.partitionBy("url").orderBy("seq")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def not_stored(rows: DataFrame, stored: DataFrame) -> DataFrame:
    return rows.join(stored.select("url"), "url", "left_anti").select(*rows.columns)


def savable(rows: DataFrame) -> DataFrame:
    """Rows worth a place in the store: a title, and enough content."""
    return rows.filter((F.col("title") != "") & (F.col("content") != "") & long_enough(F.col("content")))


def new_pages(candidates: DataFrame, stored: DataFrame, max_title: int | None = None,
              max_content: int | None = None) -> DataFrame:
    """What saving ``candidates`` (``seq, url, title, content, status_code``) adds to ``stored``.

    Too little content or a known URL is no error; such rows are left out. Titles and contents are kept whole
    unless a maximum of characters is given.
    """
    def first(column: str, most: int | None) -> Column:
        return F.col(column) if most is None else F.substr(column, F.lit(1), F.lit(most)).alias(column)
    rows = savable(candidates).select("seq", "url", first("title", max_title), first("content", max_content), "status_code")
    return not_stored(first_of_url(rows), stored)


def insert_or_ignore(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``rows`` without URLs that repeat or are stored."""
    return not_stored(first_of_url(rows), stored)


def load_if_empty(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Sample rows for an empty store; none for one that has pages."""
    return insert_or_ignore(rows, stored) if stored.isEmpty() else rows.limit(0)


def repeated_urls(rows: DataFrame) -> DataFrame:
    """``url, n`` of URLs that occur more than once."""
    return rows.groupBy("url").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def strict_insert(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``rows``, or ``DuplicateUrl`` if a URL repeats or is stored."""
    twice = repeated_urls(rows.select("url").unionByName(
        stored.select("url").join(rows.select("url").distinct(), "url", "left_semi")))
    example = twice.select("url").head(1)
    if example:
        raise DuplicateUrl(example[0][0])
    return rows


def with_ids(rows: DataFrame, stored: DataFrame | int, now: Column | None = None) -> DataFrame:
    """The store's columns for new ``rows``. Ids follow ``seq`` (unique, from 0) above the largest in use, which ``stored``
    has, or is; they need no total order of the rows in one task, and may leave gaps."""
    top = F.lit(stored) if isinstance(stored, int) else stored.agg(F.coalesce(F.max("id"), F.lit(-1))).scalar()
    return rows.select(
        (top + 1 + F.col("seq")).cast("long").alias("id"), "url", "title", "content",
        (F.localtimestamp() if now is None else now).alias("crawled_at"),
        F.coalesce(F.col("status_code"), F.lit(200)).cast("int").alias("status_code"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``seq`` replaced by 0, 1, 2 ... in ``order``: sorted over the cluster and written once; a row's number
    is its place in its range after the sizes of the ranges before."""
    ranges = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))          # one row for each range
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranges.join(sizes, "_part").withColumn("seq", place + F.col("_before")).select(*rows.columns)


def append(pages: DataFrame, path: str) -> None:
    """Append to the store, each file in order of crawl time for pruning by age."""
    S.require(pages, S.PAGES, path).sortWithinPartitions("crawled_at").write.mode("append").parquet(path)


def clear(spark: SparkSession, new_path: str) -> DataFrame:
    """An empty store at a new path. The old one stays for those who still read it."""
    spark.createDataFrame([], S.PAGES).write.mode("errorifexists").parquet(new_path)
    return spark.read.schema(S.PAGES).parquet(new_path)


def store_stats(pages: DataFrame, doc_stats: DataFrame) -> DataFrame:
    """One row: ``total_pages, index_entries``."""
    n = doc_stats.agg(F.count(F.lit(1)).alias("n")).scalar()
    return pages.agg(F.count(F.lit(1)).alias("total_pages")).withColumn("index_entries", n)


def bytes_on_disk(spark: SparkSession, path: str) -> DataFrame:
    """One row: ``bytes`` of the table's files. Only their lengths are looked up."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.parquet").load(path))
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
