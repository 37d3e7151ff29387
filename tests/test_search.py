import random

import pytest
from helpers import sqlite_index, sqlite_search, store
from pyspark.sql import functions as F

from websift import schema as S
from websift.functions.snippet import snippet
from websift.operators import paging, segments
from websift.plans import search

WORDS = "the of a cat cats été Été blue blog news data-set x_y Straße don't 42 one. Two: end! the of of".split()


def make_pages(n=120, seed=5):
    rnd = random.Random(seed)
    hosts = ["a.example.com", "blog.b.org", "www.youtube.com", "notgoogle.com", "h_x.net"]
    rows = []
    for i in range(n):
        text = " ".join(rnd.choice(WORDS) for _ in range(rnd.choice([0, 3, 12, 40, 300])))
        title = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 5)))
        rows.append((i, f"https://{rnd.choice(hosts)}/en/{i}?q", title, text, f"2024-{1 + i % 12:02d}-{1 + i % 28:02d} 10:00:00"))
    return rows


ROWS = make_pages()
NOW = "2024-12-31 12:00:00"
# search string: the same as a MATCH expression
MATCHES = {
    "the": '"the"', "THE cat": '"the" AND "cat"', '"of the"': '"of the"', '"of of" the': '"of of" AND "the"',
    "the the": '"the" AND "the"', "été": '"été"', "intitle:the cat": '"cat" AND title:"the"', "don't": '"don\'t"',
    "x_y": '"x_y"', "straße": '"straße"', "42 data-set": '"42" AND "data"', "nothing": '"nothing"',
}


@pytest.fixture(scope="module")
def pages(spark):
    return store(spark, ROWS).cache()


@pytest.fixture(scope="module")
def indexed(pages, tmp_path_factory):
    return segments.create(pages, f"{tmp_path_factory.mktemp('index')}/i", slice_docs=8)


@pytest.fixture(scope="module")
def judge():
    return sqlite_index([(r[0], r[2], r[3]) for r in ROWS])


def test_matches_and_ranks_are_sqlites(spark, pages, judge):
    for q, expression in MATCHES.items():
        want = {k: v[0] for k, v in sqlite_search(judge, expression).items()}
        got = {r.id: r["rank"] for r in search.hits(pages, q).select("id", "rank").collect()}
        assert got == pytest.approx(want, rel=1e-9), q


def test_an_empty_phrase_finds_nothing_and_no_phrase_finds_all(pages):
    assert [search.hits(pages, q).count() for q in ('""', "+++", "the +++", "", "-cat", "site:example.com")] == [
        0, 0, 0, 0, len(ROWS), sum("example.com" in r[1] for r in ROWS)]


def test_snippets_of_any_text_are_sqlites(spark):
    rnd = random.Random(3)
    words = "the of a cat cats blue one. two: end! of of of the x".split()
    rows = [(i, "", " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 12, 15, 16, 40, 300, 3000])))) for i in range(300)]
    judge = sqlite_index(rows)
    df = spark.createDataFrame([(i, t) for i, _, t in rows], "id int, t string").repartition(4)
    for phrases in ([["the"]], [["of", "of"]], [["of", "of"], ["the", "cat"], ["blue"]], [["of", "of", "of"], ["of", "the"]]):
        want = sqlite_search(judge, " AND ".join(f'"{" ".join(p)}"' for p in phrases))
        made = snippet(F.col("t"), F.array(*[F.array(*map(F.lit, p)) for p in phrases]))
        got = {r.id: r.s for r in df.select("id", made.alias("s")).collect()}
        assert want and {i: got[i] for i in want} == {i: s for i, (_, s) in want.items()}, phrases
    none = df.filter("t = ''").select(snippet(F.col("t"), F.lit([["the"]])).alias("s")).first()
    assert none.s == "" and df.limit(1).select(snippet(F.lit(None).cast("string"), F.lit([["the"]]))).first()[0] == ""


def test_snippets_are_sqlites(pages, judge):
    for q in ("the", '"of the"', "THE cat", '"of of" the', "été"):
        want = sqlite_search(judge, MATCHES[q])
        rows = search.search(pages, q, sort_by="bm25").collect()
        assert rows
        for r in rows:
            snip = want[r.id][1]
            snip = snip[:300] + "..." if len(snip) > 300 else snip
            assert r.snippet == (snip or "No description available."), (q, r.id)


def batch(spark, pages, indexed, rows, **kw):
    queries = spark.createDataFrame(rows, S.QUERIES)
    return search.search_batch(queries, pages, indexed, now=NOW, **kw)


BATCH = [(i, q, page, time, sort) for i, (q, page, time, sort) in enumerate([
    ("the", 1, None, "relevance"), ("the", 2, None, "relevance"), ("the", 1, None, "relevance"), ("the", 0, None, "date"),
    ('"of the"', 1, "month", "relevance"), ("the site:example.com", 1, "year", "bm25"), ("the -cat", 1, None, "relevance"),
    ("site:BLOG", 1, None, "relevance"), ("-cat", 3, "decade", "date"), ("inurl:en inurl:example cat", 1, "day", None),
    ("", 1, None, "relevance"), ("nothing", 1, None, "relevance"), ("the", 99, None, "relevance"), ("the +++", 1, None, "date"),
    ("the the", 1, "week", "relevance"), ("intitle:the site:h_x", 1, None, "relevance"), ("-mark the", 1, None, "relevance")])]


def comparable(rows):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]


def test_a_batch_equals_its_single_searches(spark, pages, indexed):
    got = batch(spark, pages, indexed, BATCH).orderBy("query_id", "pos").collect()
    found = 0
    for i, q, page, time, sort in BATCH:
        one = search.search(pages, q, page, time, sort or "relevance", NOW).orderBy("pos").collect()
        assert comparable(r[1:] for r in got if r.query_id == i) == comparable(one), q
        found += len(one) > 0
    assert found >= 12


def test_batch_summaries_equal_single_ones(spark, pages, indexed):
    queries = spark.createDataFrame(BATCH, S.QUERIES)
    got = {r.query_id: tuple(r[1:]) for r in search.batch_summary(queries, pages, indexed, now=NOW).collect()}
    for i, q, page, time, _ in BATCH:
        if q:
            assert got.pop(i) == tuple(search.summary(pages, q, page, time, NOW).first()), q
    assert not got


def test_filter_only_searches_in_several_groups(spark, pages, indexed, monkeypatch):
    monkeypatch.setattr(search, "BARE_AT_ONCE", 1)
    test_batch_summaries_equal_single_ones(spark, pages, indexed)


def test_pages_of_one_search_follow_on(pages):
    """Pages at any depth are cut from one order."""
    for sort_by in ("relevance", "date"):
        order = [F.col("crawled_at").desc() if sort_by == "date" else F.col("rank"), F.col("id")]
        all_ids = [r.id for r in search.hits(pages, "the -cat").orderBy(*order).collect()]
        for p in (1, 2, 9):
            got = search.result_page(pages, "the -cat", p, sort_by=sort_by).collect()
            assert sorted(r.id for r in got) == sorted(all_ids[(p - 1) * 20:p * 20])


def test_no_page_is_the_first(spark, pages, indexed):
    queries = spark.createDataFrame([(1, "the", None, None, "date"), (2, "the", 1, None, "date")], S.QUERIES)
    one, two = (tuple(r)[1:] for r in search.batch_summary(queries, pages, indexed, now=NOW).orderBy("query_id").collect())
    assert one == two and one[2] == 1
    got = search.search_batch(queries, pages, indexed, now=NOW, snippets=False).groupBy("query_id").count().collect()
    assert {r["count"] for r in got} == {20}


def test_exclusions_act_after_paging_and_ignore_the_marks(pages):
    plain = search.search(pages, "the", sort_by="date").collect()
    dropped = search.search(pages, "the -cat", sort_by="date").collect()
    seen = [r for r in plain if "cat" not in (r.title + " " + r.snippet).lower()]
    assert [r.id for r in dropped] == [r.id for r in seen] and len(seen) < len(plain)
    assert len(search.search(pages, "the -mark").collect()) == 20
    assert search.summary(pages, "the -cat").first() == search.summary(pages, "the").first()


def test_file_type_is_opt_in(spark):
    p = store(spark, [(1, "http://a/x.pdf", "the", ""), (2, "http://a/y", "the", "")])
    assert search.hits(p, "the filetype:pdf").count() == 2
    assert [r.id for r in search.hits(p, "the filetype:pdf", filetype=True).collect()] == [1]


def test_rank_badge_and_defaults(spark):
    long = "word " * 250
    p = store(spark, [(1, "https://m.youtube.com/the", "The the", long), (2, "https://notgoogle.com/", None, "the " + "x" * 600),
                      (3, "https://x.company/", "", "the")])
    rows = {r.id: r for r in search.search(p, "the word").collect()} | {
        r.id: r for r in search.search(p, "the").collect()}
    assert (rows[1].custom_rank, rows[1].badge) == (100 + 20 + 30 + 15 + 10, "Original Site")
    assert (rows[2].custom_rank, rows[2].badge, rows[2].title) == (95 + 20 + 5, "Original Site", "Untitled")
    assert (rows[3].custom_rank, rows[3].badge, rows[3].title) == (20, None, "Untitled")
    assert rows[1].domain == "m.youtube.com" and rows[1].crawled_date == "2024-01-01"


def test_page_bar(spark):
    df = spark.createDataFrame([(0, 1), (20, 1), (21, 2), (500, 1), (500, 9), (500, 25), (500, 40)], "total_results long, page int")
    rows = paging.page_bar(paging.with_summary(df)).orderBy("total_pages", "current_page").collect()
    got = [(r.start_page, r.end_page, r.first_link, r.first_dots, len(r.numbers), r.last_dots, r.last_link) for r in rows]
    assert got == [(1, 2, False, False, 2, False, False), (1, 10, False, False, 10, True, True),
                   (4, 13, True, True, 10, True, True), (20, 25, True, True, 6, False, False),
                   (35, 25, True, True, 0, False, False)]


def test_a_term_on_a_third_of_all_postings(spark, tmp_path):
    """One hot term, and one search asked by a third of all users."""
    rows = [(i, f"http://h{i}.com/", "hot hot hot", f"hot w{i % 50} w{i % 7}") for i in range(900)]
    p = store(spark, rows)
    queries = [(i, "hot" if i % 3 else f"w{i % 50} hot", 1, None, "date") for i in range(90)]
    got = search.search_batch(spark.createDataFrame(queries, S.QUERIES), p, segments.create(p, f"{tmp_path}/i"),
                              now=NOW, snippets=False)
    counts = {r.query_id: r["count"] for r in got.groupBy("query_id").count().collect()}
    assert counts == {i: 20 if i % 3 else min(20, sum(f"w{i % 50}" in (f"w{j % 50}", f"w{j % 7}") for j in range(900)))
                      for i in range(90)}
