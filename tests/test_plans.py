"""What the plans must look like to hold at scale."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from websift.operators import paging
from websift.plans import catalog, search


def plan(spark, name):
    return catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cross_joins(spark, name):
    if name.startswith("stream"):
        pytest.skip("runs when built")
    assert not re.search("CartesianProduct|NestedLoop", plan(spark, name))


def test_one_parse_of_each_page(spark):
    for name in ("page_text", "page_links", "match_phrase", "min_content", "save_pages", "website_rank"):
        p = plan(spark, name)
        assert p.count("ArrowEvalPython") == 1, name


def test_scans_read_what_they_need(spark):
    assert "ReadSchema: struct<url:string>" in plan(spark, "save_pages")
    assert re.search(r"ReadSchema: struct<page_id:bigint,url:string>", plan(spark, "normalize_url"))
    assert re.search(r"ReadSchema: struct<doc_id:bigint>", plan(spark, "filter_time_week"))


@pytest.mark.parametrize("name", ["save_pages", "insert_or_ignore", "frontier_new", "frontier_duplicates"])
def test_known_urls_stay_where_they_are(spark, name):
    """Between the join and the scan of the kept set there is no exchange, and the candidates are shuffled once."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(spark, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    kept = p[p.index("SortMergeJoin"):]
    right = kept[kept.rindex("\n", 0, kept.index("Bucketed: true")) - 600:kept.index("Bucketed: true")]
    assert "Exchange" not in right.split("+- Sort")[-1]
    assert p.count("Exchange hashpartitioning") == 1


def test_batches_are_cut_in_every_task(spark):
    assert "WindowGroupLimit" in plan(spark, "search_batch")


SEARCHES = [n for n in catalog.QUERIES if n.startswith("search_") and "batch" not in n and "summary" not in n]


@pytest.mark.parametrize("name", SEARCHES)
def test_a_search_reads_text_for_its_page_alone(spark, name):
    """The shown rows come from a scan filtered by id; nothing is range-sorted, and no text is in an exchange but theirs."""
    p = plan(spark, name)
    assert "rangepartitioning" not in p
    assert re.search(r"PushedFilters: \[[^]]*(In|EqualTo)\((page|doc)_id", p) or "LocalTableScan" in p


def test_snippets_need_no_worker(spark):
    assert "EvalPython" not in plan(spark, "search_snippet")
    p = plan(spark, "search_exclude")
    assert p.count("EvalPython") == 1           # the page's parser


def test_a_ranking_moves_no_text(spark):
    pages = catalog._corpus(spark, SMALL)
    found = search._hits(pages, search.parse(spark, "the"), None, None, False).select("id", "rank", "crawled_at").withColumn("_all", F.lit(0))
    ranked = paging.top(found, "_all", search._order("relevance"), 20)
    p = ranked._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p and "rangepartitioning" not in p
    for line in p.splitlines():
        assert not ("Exchange" in line and re.search("content|title", line))


def test_a_lookup_names_its_terms_to_the_scan(spark):
    """Text is not read; blocks are read by folder and term, first without their arrays of pages."""
    p = plan(spark, "match_terms_indexed")
    assert "documents.parquet" not in p and "hits-" not in p
    scans = re.findall(r"FileScan parquet \[term[^\n]*", p)
    assert scans and all("PartitionFilters: [" in x and "bucket" in x and re.search(r"PushedFilters: \[(Or\()*In\(term", x) for x in scans)
    assert any("ids:" not in x.split("ReadSchema")[1] for x in scans) and not any("pos:" in x.split("ReadSchema")[1] for x in scans)


def test_kept_statistics_leave_one_scan_of_text(spark):
    assert len(re.findall(r"documents\.parquet", plan(spark, "bm25_scores"))) == 1


def test_filters_on_the_url_come_before_parsing(spark):
    pages = catalog._corpus(spark, SMALL)
    p = search.hits(pages, "the site:example.org inurl:en")._jdf.queryExecution().executedPlan().toString()
    assert p.rindex("example.org") > p.rindex("ArrowEvalPython")
