"""Crawl decisions as table operators: what to fetch, what may be fetched, what a fetch is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from websift.functions import urls as U
from websift.operators import paging
from websift.operators.salt import salted_join

# Fixed values.
MAX_BYTES = 5 * 1024 * 1024
OUTCOMES = ["crawled", "failed", "duplicate", "robots_blocked"]


def acceptable(status="status", content_type="content_type", n_bytes="n_bytes"):
    """A fetch whose body is worth reading."""
    s = F.col(status)
    return (~s.between(400, 599) & F.lower(F.col(content_type)).contains("text/html")
            & (F.col(n_bytes) <= MAX_BYTES))


def plain_path(path: Column) -> Column:
    """``path`` without percent signs, as robots rules compare paths. What is no valid code stays as it is."""
    safe = F.regexp_replace(F.replace(path, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), path)


def robots_for(rules: DataFrame, agent: str) -> DataFrame:
    """The rules that hold for ``agent``, one row for each host.

    ``rules``: ``domain, agent, rule_no, allow, path``. A host's first section whose agent name is part of
    ours counts, and only that one; without any, the section for ``*``. What is gathered for a host is its
    robots file, a small document.
    """
    name = agent.split("/")[0].lower()
    ours = (F.col("agent") != "*") & F.lit(name).contains(F.lower("agent"))
    rule = F.struct("rule_no", "allow", "path", "agent")
    rules = rules.withColumn("path", plain_path(F.col("path")))
    sets = rules.groupBy("domain").agg(F.array_sort(F.collect_list(F.when(ours, rule))).alias("own"),
                                       F.array_sort(F.collect_list(F.when(F.col("agent") == "*", rule))).alias("any"))
    first = F.get("own", F.lit(0))["agent"]
    own = F.filter("own", lambda r: r.agent == first)
    chosen = F.when(F.size("own") > 0, own).otherwise(F.col("any"))
    return sets.select("domain", F.transform(chosen, lambda r: F.struct(r.rule_no, r.allow, r.path)).alias("rules"))


def with_robots(urls: DataFrame, robots: DataFrame) -> DataFrame:
    """``urls`` plus ``allowed``: the first rule of the host whose path begins the URL's path decides. Paths and
    rules are compared without their percent codes.

    ``robots``: one row for each host. Hosts without rules allow everything. A host may own a third of
    all URLs, so URLs are salted and the rules repeated.
    """
    df = urls.withColumn("domain", U.domain(F.col("url"))).withColumn("_path", plain_path(U.path(F.col("url"))))
    df = salted_join(df, robots, ["domain"], "url", "left")
    first = F.get(F.filter(F.array_sort("rules"),
                           lambda r: F.col("_path").startswith(r.path)), F.lit(0))
    allowed = F.coalesce(first.allow | (first.path == ""), F.lit(True))
    return df.select(*urls.columns, allowed.alias("allowed"))


def unseen(urls: DataFrame, visited: DataFrame) -> DataFrame:
    """URLs not visited yet, each once, with the smallest ``seq`` and its priority."""
    new = urls.groupBy("url").agg(F.min("seq").alias("seq")).join(visited.select("url"), "url", "left_anti")
    return new.select("url", U.url_priority(F.col("url")).alias("priority"), "seq")


def count_seen(urls: DataFrame, visited: DataFrame) -> DataFrame:
    """One row: ``duplicates``, the number of offers of visited URLs."""
    offers = urls.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    seen = offers.join(visited.select("url").distinct(), "url", "left_semi")
    return seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"))


def next_batch(frontier: DataFrame, n: int) -> DataFrame:
    """The next ``n`` URLs: high before medium before low, first come first served inside."""
    order = [U.priority_order(F.col("priority")).asc(), F.col("seq").asc(), F.col("url").asc()]
    return paging.top(frontier.withColumn("_all", F.lit(0)), "_all", order, n).drop("_all", "pos")


def batch_size(visited: DataFrame, workers: int, max_pages: int) -> int:
    """How many URLs to fetch next: two for each worker, but no more than the budget of pages leaves."""
    return max(min(2 * workers, max_pages - visited.count()), 0)


def frontier_sizes(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


def page_links(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """``src_url, pos, dst_url``: the links of each page (``url, links``), in document order; the first ``limit`` if given."""
    some = F.col("links") if limit is None else F.slice("links", 1, limit)
    return pages.select(F.col("url").alias("src_url"), F.posexplode(some).alias("pos", "dst_url"))


def crawl_stats(log: DataFrame) -> DataFrame:
    """One row: a counter for each outcome, and pages saved each second."""
    n = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    rate = F.coalesce(F.count_if(F.col("outcome") == "crawled") / F.nullif(span, F.lit(0.0)), F.lit(0.0))
    return log.agg(*n, rate.alias("rate"))


def crawl_progress(log: DataFrame, every: str = "1 hour") -> DataFrame:
    """The same counters for each window of time; works on a stream with a watermark on ``ts`` too."""
    n = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return (log.groupBy(F.window("ts", every).alias("w")).agg(*n)
            .select(F.col("w.start").alias("window_start"), *OUTCOMES))
