import sqlite3

from helpers import column
from pyspark.sql import functions as F

from websift.operators import filters

URLS = ["http://Example.com/a_b", "http://example.com/a%20b", "http://x/Ä", "http://x/ä", "http://x/a\\b", "http://x/K"]
VALUES = ["EXAMPLE", "a_b", "a%b", "ä", "a\\b", "%", "_", "k", "zzz", "a\\_", "K"]


def test_url_like_is_sqlites(spark):
    c = sqlite3.connect(":memory:")
    for v in VALUES:
        want = [bool(c.execute("SELECT ? LIKE ?", (u, f"%{v}%")).fetchone()[0]) for u in URLS]
        assert column(spark, URLS, lambda u: filters.url_like(u, v)) == want, v
        assert column(spark, URLS, lambda u: filters.holds(filters.ascii_lower(u), filters.needle(F.lit(v)))) == want, v


def test_since_is_sqlites(spark):
    c = sqlite3.connect(":memory:")
    steps = {"day": "-1 day", "week": "-7 days", "month": "-1 month", "year": "-1 year"}
    moments = [c.execute("SELECT datetime('2023-12-20 13:14:15', ?)", (f"+{i} days",)).fetchone()[0] for i in range(450)]
    for name, step in steps.items():
        want = [c.execute("SELECT datetime(?, ?)", (m, step)).fetchone()[0] for m in moments]
        got = column(spark, moments, lambda m: filters.since(m.cast("timestamp_ntz"), F.lit(name)).cast("string"))
        assert got == want, name


def test_unknown_ages_do_not_filter(spark):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    rows = [("2024-02-29 00:00:00", "day", False), ("2024-02-29 00:00:01", "day", True), (None, "day", False),
            ("2000-01-01 00:00:00", "decade", True), (None, None, True)]
    df = spark.createDataFrame(rows, "t string, f string, want boolean")
    ok = filters.young_enough(F.col("t").cast("timestamp_ntz"), filters.since(now, F.col("f")))
    assert df.filter(ok != F.col("want")).count() == 0


def test_file_type(spark):
    urls = ["http://a/x.PDF", "http://a/x.pdf?y=1", "http://a/x.pdf#z", "http://a/xpdf", "http://a/x.pdf/y"]
    assert column(spark, urls, lambda u: filters.url_has_type(u, "pdf")) == [True, True, True, False, False]
