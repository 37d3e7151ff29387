from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from websift import schema as S
from websift.operators import crawl as C
from websift.sources import pages as P

ROBOTS = {
    "a.com": [(False, "/private"), (True, "/private/open"), (False, "/x?q")],
    "b.com": [(True, "/private/open"), (False, "/private")],
    "c.com": [(False, "")],
    "d.com": [(False, "/")],
    "e.com": [(True, "/ok"), (False, "*")],
}
URLS = [f"http://{h}{p}" for h in ("a.com", "b.com", "c.com", "d.com", "e.com", "f.com")
        for p in ("", "/", "/private", "/private/open/1", "/privately", "/x?q=1", "/x", "/ok/2")]


def robots(spark, rules=ROBOTS):
    return spark.createDataFrame([(d, [(i, a, p) for i, (a, p) in enumerate(r)]) for d, r in rules.items()], S.ROBOTS)


def test_robots_rules_are_the_standard_librarys(spark):
    want = {}
    for u in URLS:
        r = RobotFileParser()
        rules = ROBOTS.get(u.split("/")[2], [])
        r.parse(["User-agent: *"] + [f"{'Allow' if a else 'Disallow'}: {p}" for a, p in rules])
        want[u] = r.can_fetch("bot", u)
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    assert {r.url: r.allowed for r in C.with_robots(df, robots(spark)).collect()} == want


def test_rules_of_an_agent_are_the_standard_librarys(spark):
    files = {"a.com": [("*", False, "/all"), ("Sift", False, "/sift"), ("sif", False, "/late")],
             "b.com": [("other", False, "/other"), ("*", True, "/x/y"), ("*", False, "/x")],
             "c.com": [("other", False, "/")]}
    flat = [(d, a, i, ok, p) for d, f in files.items() for i, (a, ok, p) in enumerate(f)]
    rules = spark.createDataFrame(flat, "domain string, agent string, rule_no int, allow boolean, path string")
    urls = [f"http://{d}{p}" for d in [*files, "d.com"] for p in ("/all", "/sift", "/late", "/other", "/x", "/x/y", "/")]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for agent in ("sift/2.0", "other", "third/1"):
        want = {}
        for u in urls:
            r, lines, last = RobotFileParser(), [], None
            for a, ok, p in files.get(u.split("/")[2], []):
                lines += [] if a == last else ["", f"User-agent: {a}"]
                lines.append(f"{'Allow' if ok else 'Disallow'}: {p}")
                last = a
            r.parse(lines)
            want[u] = r.can_fetch(agent, u)
        got = C.with_robots(df, C.robots_for(rules, agent)).collect()
        assert {r.url: r.allowed for r in got} == want, agent


def test_acceptable_fetches(spark):
    rows = [(200, "text/html", 1, True), (204, "TEXT/HTML; x", 5 * 1024 * 1024, True), (399, "text/html", 1, True),
            (400, "text/html", 1, False), (599, "text/html", 1, False), (600, "text/html", 1, True),
            (200, "application/pdf", 1, False), (200, "text/html", 5 * 1024 * 1024 + 1, False)]
    df = spark.createDataFrame(rows, "status int, content_type string, n_bytes long, want boolean")
    assert df.filter(C.acceptable() != F.col("want")).count() == 0


def test_frontier(spark):
    offers = spark.createDataFrame([("http://a/news", 3), ("http://a/x", 1), ("http://a/x", 0), ("http://a/docs", 2),
                                    ("http://seen/", 0), ("http://seen/", 9)], "url string, seq long")
    visited = spark.createDataFrame([("http://seen/",)], "url string")
    new = C.unseen(offers, visited)
    assert C.count_seen(offers, visited).first()[0] == 2
    got = [tuple(r) for r in C.next_batch(new, 10).collect()]
    assert got == [("http://a/news", "high", 3), ("http://a/docs", "medium", 2), ("http://a/x", "low", 0)]
    assert [C.batch_size(visited, w, m) for w, m in ((1, 100), (50, visited.count() + 3), (50, 0))] == [2, 3, 0]
    assert [r.url for r in C.next_batch(new, 1).collect()] == ["http://a/news"]
    assert {tuple(r) for r in C.frontier_sizes(new).collect()} == {("high", 1), ("medium", 1), ("low", 1)}


def test_large_batches(spark):
    f = spark.range(200).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("low").alias("priority"), (F.col("id") % 7).alias("seq"))
    want = [r.url for r in f.orderBy("seq", "url").limit(90).collect()]
    assert sorted(r.url for r in C.next_batch(f, 90).collect()) == sorted(want)


def test_links_are_all_there_unless_a_limit_is_given(spark):
    df = spark.createDataFrame([("u", [f"http://a/{i}" for i in range(25)])], "url string, links array<string>")
    assert C.page_links(df).count() == 25
    assert [r.dst_url for r in C.page_links(df, 20).orderBy("pos").collect()] == [f"http://a/{i}" for i in range(20)]


CODED = ["/%7Ejoe/", "/~joe/", "/a%2Fb", "/a/b", "/caf%C3%A9", "/café", "/x+y", "/x%2By", "/bad%zz", "/bad%25zz", "/%", "/q?a=%20b"]


def test_robots_paths_are_compared_without_codes(spark):
    """As the standard library compares them."""
    for rule in CODED:
        parser = RobotFileParser()
        parser.parse(["User-agent: *", f"Disallow: {rule}"])
        rules = spark.createDataFrame([("w.com", "*", 0, False, rule)], "domain string, agent string, rule_no int, allow boolean, path string")
        urls = spark.createDataFrame([(f"http://w.com{p}x", i) for i, p in enumerate(CODED)], "url string, seq long")
        got = {r.url: r.allowed for r in C.with_robots(urls, C.robots_for(rules, "websift/1.0")).collect()}
        assert got == {u: parser.can_fetch("websift/1.0", u) for u in got}, rule


def test_counters_and_rate(spark):
    rows = [("2024-01-01 00:00:00", "crawled"), ("2024-01-01 00:00:02", "crawled"), ("2024-01-01 00:59:59", "failed"),
            ("2024-01-01 01:00:00", "duplicate"), ("2024-01-01 01:00:00", "robots_blocked")]
    log = spark.createDataFrame(rows, "t string, outcome string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    assert tuple(C.crawl_stats(log).first()) == (2, 1, 1, 1, pytest.approx(2 / 3600))
    assert tuple(C.crawl_stats(log.limit(1)).first())[-1] == 0.0
    assert sorted(tuple(r)[1:] for r in C.crawl_progress(log).collect()) == [(0, 0, 1, 1), (2, 1, 0, 0)]
