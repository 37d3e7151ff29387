"""Searches: one string over a page table, or a table of strings over an indexed page table."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from websift.functions import rank as R
from websift.functions import urls as U
from websift.functions.snippet import cut, snippet, without_marks
from websift.operators import filters, lookup, match, paging, segments
from websift.operators import querylog as Q
from websift.operators.salt import salted_join, small_join
from websift.session import stored


def parse(spark: SparkSession, q: str) -> dict:
    """The conditions of one search string."""
    one = Q.with_conditions(spark.range(1).select(F.lit(q).alias("q")))
    return one.withColumn("phrases", Q.phrases()).first().asDict(recursive=True)


def _moment(now) -> Column:
    if now is None:
        return F.localtimestamp()
    return F.lit(now).cast("timestamp_ntz") if isinstance(now, (str, dt.datetime)) else now


def _where(spec: dict, time_filter: str | None, now, filetype: bool) -> Column | None:
    tests = []
    if spec["site"]:
        tests.append(filters.url_like(F.col("url"), spec["site"]))
    tests += [filters.url_like(F.col("url"), w) for w in spec["inurl"]]
    if time_filter in ("day", "week", "month", "year"):
        tests.append(F.col("crawled_at") > filters.since(_moment(now), F.lit(time_filter)))
    if filetype and spec["filetype"]:
        tests.append(filters.url_has_type(F.col("url"), spec["filetype"]))
    return reduce(lambda a, b: a & b, tests) if tests else None


def _phrases(spec: dict) -> list[match.Phrase]:
    return [(p["title_only"], p["tokens"]) for p in spec["phrases"]]


def hits(pages: DataFrame, q: str, time_filter: str | None = None, now=None,
         filetype: bool = False, index: segments.Index | None = None) -> DataFrame:
    """Every page that answers ``q``, with its BM25 ``rank``. ``filetype`` turns that operator on.

    With the ``index`` of the pages, statistics of single words come from its counters, and text is read once.
    """
    return _hits(pages, parse(pages.sparkSession, q), time_filter, now, filetype, index)


def _hits(pages: DataFrame, spec: dict, time_filter, now, filetype: bool, index: segments.Index | None = None) -> DataFrame:
    if spec["q"] == "":
        return pages.filter(F.lit(False)).withColumn("rank", F.lit(0.0))
    phrases = _phrases(spec)
    kept = None
    if index is not None and all(len(tokens) == 1 for _, tokens in phrases):
        words = [{"term": tokens[0]} for _, tokens in phrases]
        counts = {r["term"]: r for r in segments.counts_of(index, None, words).collect()}      # a row for each word of the search
        none = {"n_docs": 0, "n_title_docs": 0}
        kept = (index.n_docs, index.avg_tokens, [counts.get(t[0], none)["n_title_docs" if title_only else "n_docs"] for title_only, t in phrases])
    return match.scored(pages, phrases, _where(spec, time_filter, now, filetype), kept)


def _order(sort_by: str) -> list[Column]:
    return [F.col("crawled_at").desc() if sort_by == "date" else F.col("rank").asc(), F.col("id").asc()]


def _decorated(df: DataFrame) -> DataFrame:
    """Result columns that need no snippet."""
    return (df.withColumn("content_length", F.length("content"))
            .withColumn("domain", U.domain(F.col("url")))      # before the rank, which reads it often
            .withColumn("crawled_date", F.coalesce(F.date_format("crawled_at", "yyyy-MM-dd"), F.lit("")))
            .withColumn("custom_rank", R.website_rank(F.col("domain"), F.col("url"), F.col("title"),
                                                      F.coalesce("content_length", F.lit(0)),
                                                      F.col("rank_terms")))
            .withColumn("badge", R.badge(F.col("custom_rank"))))


def _with_snippet(rows: DataFrame, phrases: Column) -> DataFrame:
    # through a one-row generator, so that the exclusion test does not have it made twice
    made = rows.withColumn("_snippet", snippet(F.col("content"), phrases))
    return made.select(*rows.columns, F.explode(F.array(cut(F.col("_snippet")))).alias("snippet"))


def _is_excluded() -> Column:
    seen = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), without_marks(F.col("snippet"))))
    return F.exists("exclude", lambda w: seen.contains(F.lower(w)))


def _displayed(df: DataFrame) -> DataFrame:
    return (df.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")))
            .withColumn("snippet", F.coalesce(F.nullif("snippet", F.lit("")),
                                              F.lit("No description available."))))


RESULT = ["pos", "id", "url", "title", "snippet", "rank", "crawled_at", "content_length", "domain",
          "crawled_date", "custom_rank", "badge"]


def result_page(pages: DataFrame, q: str, page: int = 1, time_filter: str | None = None,
                sort_by: str = "relevance", now=None, filetype: bool = False) -> DataFrame:
    """One page of results in its final order, before exclusions and without snippets.

    Ids are ranked first, by a top-k in each task over rows without text; the text is then read for the ids of
    the page alone, by a filter that reaches the scan. The ranking runs when the page is asked for. Within
    the page, the relevance order puts authoritative sites first.
    """
    return _result_page(pages, parse(pages.sparkSession, q), page, time_filter, sort_by, now, filetype)


def _result_page(pages: DataFrame, spec: dict, page: int, time_filter, sort_by: str, now,
                 filetype: bool) -> DataFrame:
    order = _order(sort_by)
    before = max((page - 1) * paging.PAGE_SIZE, 0)
    found = _hits(pages, spec, time_filter, now, filetype).select("id", "rank", "crawled_at").withColumn("_all", F.lit(0))
    ranked = paging.top(found, "_all", order, before + paging.PAGE_SIZE).filter(F.col("pos") > before)
    # a result page of ids: what it shows is then read for these pages alone
    ids = [(r["id"], r["rank"]) for r in ranked.select("id", "rank").collect()]
    ranks = pages.sparkSession.createDataFrame(ids, f"id {pages.schema['id'].dataType.simpleString()}, rank double")
    cut_ = pages.filter(F.col("id").isin([i for i, _ in ids])).join(F.broadcast(ranks), "id")

    def strings(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")
    cut_ = (cut_.withColumn("rank_terms", strings(spec["terms"] + spec["exact_phrase"]))
            .withColumn("exclude", strings(spec["exclude"])))
    rows = _decorated(cut_)
    final = [F.col("custom_rank").desc(), *order] if sort_by == "relevance" else order
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*final)))     # 20 rows at most


def search(pages: DataFrame, q: str, page: int = 1, time_filter: str | None = None,
           sort_by: str = "relevance", now=None, filetype: bool = False) -> DataFrame:
    """One page of results with marked snippets, as shown: columns ``RESULT``.

    ``pages``: the store's columns. Exclusions act on the page's rows; totals do not know of them.
    """
    spec = parse(pages.sparkSession, q)
    rows = _result_page(pages, spec, page, time_filter, sort_by, now, filetype)
    phrases = [p["tokens"] for p in spec["phrases"] if not p["title_only"]]
    lits = F.array(*[F.array(*[F.lit(t) for t in p]).cast("array<string>") for p in phrases])
    rows = _with_snippet(rows, lits.cast("array<array<string>>"))
    return _displayed(rows.filter(~_is_excluded())).select(*RESULT)


def summary(pages: DataFrame, q: str, page: int = 1, time_filter: str | None = None, now=None,
            filetype: bool = False) -> DataFrame:
    """One row: total_results, total_pages, current_page, has_next, has_prev."""
    spec = parse(pages.sparkSession, q)
    found = match.matching(pages.select("url", "title", "content", "crawled_at"), _phrases(spec))
    where = _where(spec, time_filter, now, filetype)
    if where is not None:
        found = found.filter(where)
    if q == "":
        found = found.filter(F.lit(False))
    one = found.agg(F.count(F.lit(1)).alias("total_results")).withColumn("page", F.lit(page))
    return paging.with_summary(one).drop("page")


# ---------------------------------------------------------------------------------------------
# tables of searches

# Searches that name no phrase and nothing of three letters to look for in URLs are compared with each page; so many share one scan.
BARE_AT_ONCE = 500


def _searches(queries: DataFrame) -> DataFrame:
    """The distinct searches behind a query table, parsed. Repeated queries are answered once."""
    s = Q.searchable(queries).select("q", "time_filter", F.coalesce("sort_by", F.lit("relevance")).alias("sort_by"))
    s = Q.with_conditions(s.distinct()).withColumn("phrases", Q.phrases())
    return s.withColumn("sid", _sid())


def _sid() -> Column:
    return F.sha1(F.concat_ws("\x1f", "q", F.coalesce("time_filter", F.lit("")),
                              F.coalesce("sort_by", F.lit("relevance"))))


def _grams() -> Column:
    """The trigrams that a URL must hold for all of a search's needles; what stands for any letter parts them."""
    words = F.filter(F.concat(F.array("site.word"), F.transform("inurl", lambda n: n.word)), lambda w: w.isNotNull())
    pieces = F.flatten(F.transform(words, lambda w: F.split(w, r"[%_\\]")))
    return F.array_distinct(F.flatten(F.transform(pieces, segments.grams_of)))


def _bare(searches: DataFrame, facts: DataFrame, n: int) -> list[DataFrame]:
    """Hits of the ``n`` searches that no index helps with: pages are tested in place, and only matches leave
    the scan. Groups of searches bound what one scan holds in memory."""
    of_search = ["sid", "site", "inurl", "since", "by_date"]
    only = searches.filter((F.size("phrases") == 0) & (F.size("grams") == 0)).select(*of_search)
    groups = math.ceil(n / BARE_AT_ONCE)
    out = []
    for g in range(groups):
        part = only.filter(F.pmod(F.xxhash64("sid"), F.lit(groups)) == g)
        table = part.agg(F.collect_list(F.struct(*of_search))).scalar()
        met = F.filter("_searches", lambda s: filters.conditions(
            F.col("low_url"), F.col("crawled_at"), s.site, s.inurl, s.since))
        found = facts.withColumn("_searches", table).select("doc_id", "crawled_at", F.explode(
            F.transform(met, lambda s: F.struct(s.sid.alias("sid"), s.by_date.alias("by_date")))).alias("s"))
        out.append(found.select("s.sid", "doc_id", F.lit(0.0).alias("rank"), "s.by_date", "crawled_at"))
    return out


@dataclass
class Survey:
    """What a query table asks for; one small job over it."""

    bare: int               # searches that no index helps with
    by_url: int             # searches that name no phrase, but parts of URLs
    need_pages: int         # searches that filter by URL or age, or sort by date
    searches: int           # all of them
    classes: list[int]      # of the depths that are asked for; there are as many as the deepest has binary digits


def _survey(searches: DataFrame) -> Survey:
    """Of searches as ``_parsed`` makes them."""
    no_phrase, no_grams = F.size("phrases") == 0, F.size("grams") == 0
    filtered = F.col("site").isNotNull() | (F.size("inurl") > 0) | F.col("time_filter").isNotNull() | F.col("by_date")
    row = searches.agg(F.count_if(no_phrase & no_grams), F.count_if(no_phrase & ~no_grams), F.count_if(filtered), F.sum("n_asked"), F.collect_set("depth_class")).first()
    return Survey(*row[:3], row[3] or 0, sorted(row[4]))


def _parsed(queries: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """The distinct searches behind a query table with all they ask for, parsed once; and ``query_id, sid, page, page_no`` of each query."""
    asked = Q.searchable(queries).withColumn("sid", _sid()).withColumn("page_no", F.greatest(F.coalesce("page", F.lit(1)), F.lit(1)))
    asked, _ = segments.held(asked.select("query_id", "sid", "page", "page_no"), "asked")
    deepest = asked.groupBy("sid").agg(F.max("page_no").alias("deepest"), F.count(F.lit(1)).alias("n_asked"))
    searches = _conditions(_searches(queries), now).withColumn("rank_terms", Q.rank_terms()).join(deepest, "sid")
    searches = searches.withColumn("depth", F.col("deepest") * paging.PAGE_SIZE).withColumn("depth_class", paging.depth_class(F.col("deepest")))
    return segments.held(searches, "searches")[0], asked


def _conditions(searches: DataFrame, now) -> DataFrame:
    """Parsed searches with what their filters need."""
    return (searches.withColumn("since", filters.since(_moment(now), F.col("time_filter")))
            .withColumn("by_date", F.coalesce(F.col("sort_by") == "date", F.lit(False)))
            .withColumn("site", filters.needle(F.col("site"))).withColumn("inurl", F.transform("inurl", filters.needle))
            .withColumn("grams", _grams()))


def batch_hits(queries: DataFrame, pages: DataFrame, index: segments.Index, now=None) -> DataFrame:
    """``sid, doc_id, rank, by_date, crawled_at``: every page that answers each distinct search.

    ``crawled_at`` is filled in where a search of the table filters or sorts by what only pages know;
    otherwise the index alone answers.
    """
    searches, _ = _parsed(queries, now)
    return _batch_hits(searches, pages, index, _survey(searches), False)


def _batch_hits(searches: DataFrame, pages: DataFrame, index: segments.Index, survey: Survey, best: bool) -> DataFrame:
    """With ``best``, a search that only its rank decides may lack hits beyond its depth."""
    facts = pages.select(F.col("id").alias("doc_id"), filters.ascii_lower(F.col("url")).alias("low_url"), "crawled_at")
    named = searches.filter(F.size("phrases") > 0)
    by_rank = F.col("site").isNull() & (F.size("inurl") == 0) & F.col("since").isNull() & ~F.col("by_date")
    depths = named.select("sid", F.when(by_rank, F.col("depth")).otherwise(F.lit(2**31 - 1)).alias("depth")) if best else None
    found, members = lookup.score_sets(index, named, depths)
    cols = ["sid", "doc_id", "rank", "by_date", "crawled_at"]
    if survey.by_url:
        unnamed = searches.filter((F.size("phrases") == 0) & (F.size("grams") > 0)).select("sid", F.col("grams").alias("terms"))
        more, more_members = lookup.sets_with_all(index, unnamed)
        found, members = found.unionByName(more.withColumn("rank", F.lit(0.0))), members.unionByName(more_members)
    if survey.need_pages:      # a hit meets its page before it is dealt out to the searches that share it
        tests = searches.select("sid", "site", "inurl", "since", "by_date").join(members, "sid")
        found = salted_join(found.join(facts, "doc_id"), tests, ["set"], "doc_id")
        found = found.filter(filters.conditions(F.col("low_url"), F.col("crawled_at"), F.col("site"),
                                                F.col("inurl"), F.col("since"))).select(*cols)
    else:
        found = salted_join(found, members, ["set"], "doc_id")
        found = found.select("sid", "doc_id", "rank", F.lit(False).alias("by_date"),
                             F.lit(None).cast("timestamp_ntz").alias("crawled_at"))
    for some in _bare(searches, facts, survey.bare):
        found = found.unionByName(some.select(*cols))
    return found


def search_batch(queries: DataFrame, pages: DataFrame, index: segments.Index, now=None, snippets: bool = True) -> DataFrame:
    """Result pages for a table of searches: ``query_id`` and the columns ``RESULT``.

    ``queries``: ``query_id, q, page, time_filter, sort_by``. ``index``: the stored index of ``pages``. ``snippets=False`` leaves out
    the snippet and with it the exclusions.
    """
    searches, asked = _parsed(queries, now)
    survey = _survey(searches)
    found = _batch_hits(searches, pages, index, survey, True)
    found = stored(found.join(searches.select("sid", "depth_class"), "sid"), "found")
    order = [F.when(F.col("by_date"), F.col("crawled_at")).desc(), F.when(~F.col("by_date"), F.col("rank")).asc(),
             F.col("doc_id").asc()]
    ranked = paging.top_by_depth(found, "sid", order, survey.classes)
    searches = searches.select("sid", "sort_by", "exclude", "rank_terms", "phrases")
    rows = ranked.withColumn("page_no", paging.page_of(F.col("pos")))
    rows = rows.join(asked.select("sid", "page_no").distinct(), ["sid", "page_no"])
    rows = rows.select("sid", "page_no", "pos", "rank", F.col("doc_id").alias("id")).join(searches, "sid")
    rows = _decorated(small_join(pages, rows, "id", survey.searches * paging.PAGE_SIZE))
    lead = F.when(F.col("sort_by") == "relevance", F.col("custom_rank")).desc()
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("sid", "page_no").orderBy(lead, "pos")))
    columns = RESULT
    if snippets:
        words = F.transform(F.filter("phrases", lambda p: ~p.title_only), lambda p: p.tokens)
        rows = _displayed(_with_snippet(rows, words).filter(~_is_excluded()))
    else:
        columns = [c for c in RESULT if c != "snippet"]
    return (rows.select("sid", "page_no", *columns)
            .join(asked.select("query_id", "sid", "page_no"), ["sid", "page_no"])
            .select("query_id", *columns))


def batch_summary(queries: DataFrame, pages: DataFrame, index: segments.Index, now=None) -> DataFrame:
    """One row for each searchable query, queries without hits included."""
    searches, asked = _parsed(queries.withColumn("sort_by", F.lit("relevance")), now)      # totals are the same in any order
    totals = _batch_hits(searches, pages, index, _survey(searches), False).groupBy("sid").agg(F.count(F.lit(1)).alias("total_results"))
    rows = asked.join(totals, "sid", "left").fillna(0, ["total_results"])
    return (paging.with_summary(rows)
            .select("query_id", "total_results", "total_pages", "current_page", "has_next", "has_prev"))
