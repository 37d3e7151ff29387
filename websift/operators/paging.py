"""Result pages: the slice of each search's ranked hits, summaries and page bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the result page and its bar.
PAGE_SIZE = 20
BAR_BEFORE, BAR_LENGTH = 5, 9

# Parts in which a group's leading hits are found before they meet.
SLICES = 64


def page_of(pos: Column) -> Column:
    return (F.floor((pos - 1) / PAGE_SIZE) + 1).cast("int")


def top(hits: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` hits of each group, numbered in ``pos``.

    ``order`` must leave no ties; ``hits`` should be narrow. Hits are cut in every task, then in each of SLICES parts of
    their group, and only then do SLICES times ``k`` rows at most meet, however many tasks there were.
    """
    part = F.pmod(F.xxhash64(*hits.columns), F.lit(SLICES)).cast("int")
    first = Window.partitionBy(group, "_slice").orderBy(*order)
    some = hits.withColumn("_slice", part).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k)
    last = Window.partitionBy(group).orderBy(*order)
    return (some.drop("_n", "_slice").withColumn("pos", F.row_number().over(last)).filter(F.col("pos") <= k))


def depth_class(page: Column) -> Column:
    """The power of two that a page number is not above: searches of like depth are cut together."""
    return F.ceil(F.log2(F.greatest(page, F.lit(1)))).cast("int")


def top_by_depth(hits: DataFrame, group: str, order: list[Column], classes: list[int]) -> DataFrame:
    """``top`` for groups that go to different depths: each class of depths (``depth_class``, a column of ``hits``) is cut at its own, so
    a deep search does not widen the others. ``hits`` should be a stored table; each class reads its own rows."""
    parts = [top(hits.where(F.col("depth_class") == c).drop("depth_class"), group, order, PAGE_SIZE << c) for c in classes]
    out = parts[0] if parts else top(hits.drop("depth_class"), group, order, PAGE_SIZE)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_summary(df: DataFrame, total: str = "total_results", page: str = "page") -> DataFrame:
    """``df`` plus total_pages, current_page, has_next and has_prev. No page is page 1."""
    pages = F.ceil(F.col(total) / PAGE_SIZE).cast("long")
    return (df.withColumn("total_pages", pages).withColumn("current_page", F.coalesce(F.col(page), F.lit(1)).cast("int"))
            .withColumn("has_next", F.col("current_page") < F.col("total_pages"))
            .withColumn("has_prev", F.col("current_page") > 1))


def page_bar(summary: DataFrame) -> DataFrame:
    """Which page numbers to show, for summaries of more than one page."""
    s = summary.filter("total_pages > 1")
    s = s.withColumn("start_page", F.greatest(F.lit(1), F.col("current_page") - BAR_BEFORE).cast("long"))
    s = s.withColumn("end_page", F.least(F.col("total_pages"), F.col("start_page") + BAR_LENGTH))
    start, end, total = F.col("start_page"), F.col("end_page"), F.col("total_pages")
    return (s.withColumn("first_link", start > 1).withColumn("first_dots", start > 2)
            .withColumn("numbers", F.when(start <= end, F.sequence(start, F.greatest(end, start)))
                        .otherwise(F.array().cast("array<bigint>")))
            .withColumn("last_dots", end < total - 1).withColumn("last_link", end < total))
