import datetime as dt

import pytest
from helpers import store as make
from pyspark.sql import functions as F

from websift import schema as S
from websift.operators import index, manifest, store, urlset
from websift.sources import pages as P

NEW = "seq long, url string, title string, content string, status_code int"
LONG = "x" * 100


def ids(df, c="url"):
    return sorted(r[0] for r in df.select(c).collect())


@pytest.fixture(scope="module")
def stored(spark):
    return make(spark, [(7, "http://old/", "t", "c")])


def test_what_is_saved(spark, stored):
    rows = [(0, "http://a/", "first", LONG, 200), (1, "http://a/", "second", LONG, 200), (2, "http://old/", "t", LONG, 200),
            (3, "http://short/", "t", "x" * 99, 200), (4, "http://blank/", "t", "　" + "x" * 99 + "\xa0", 200),
            (5, "http://untitled/", "", LONG, 200), (6, "http://null/", None, LONG, 200), (7, "http://b/", "T" * 600, "y" * 60000, 203),
            (8, "http://late/", "t", "short", 200), (9, "http://late/", "t", LONG, 200)]
    got = {r.url: r for r in store.new_pages(spark.createDataFrame(rows, NEW), stored, max_title=500, max_content=50_000).collect()}
    whole = {r.url: r for r in store.new_pages(spark.createDataFrame(rows, NEW), stored).collect()}
    assert (len(whole["http://b/"].title), len(whole["http://b/"].content)) == (600, 60_000)
    assert sorted(got) == sorted(whole) == ["http://a/", "http://b/", "http://late/"]
    assert (got["http://a/"].title, got["http://late/"].seq) == ("first", 9)
    assert (len(got["http://b/"].title), len(got["http://b/"].content), got["http://b/"].status_code) == (500, 50_000, 203)


def test_ids_follow_the_largest(spark, stored):
    rows = spark.createDataFrame([(0, "http://a/", "t", LONG, 200), (3, "http://b/", "t", LONG, None)], NEW)
    got = store.with_ids(rows, stored).orderBy("id").collect()
    assert [(r.id, r.url, r.status_code) for r in got] == [(8, "http://a/", 200), (11, "http://b/", 200)]
    empty = spark.createDataFrame([], S.PAGES)
    assert ids(store.with_ids(rows, empty), "id") == [0, 3]


def test_many_copies_of_one_page(spark, stored):
    rows = spark.range(3000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "http://hot/").otherwise(
        F.concat(F.lit("http://h/"), F.col("id"))).alias("url"), F.lit("t").alias("title"), F.lit(LONG).alias("content"),
        F.lit(200).alias("status_code"))
    got = store.new_pages(rows, stored)
    assert (got.count(), got.filter("url = 'http://hot/'").first().seq) == (2001, 0)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_insert_or_ignore_and_load_if_empty(spark, stored):
    rows = spark.createDataFrame([(0, "http://old/"), (1, "http://a/"), (2, "http://a/")], "seq long, url string")
    assert [tuple(r) for r in store.insert_or_ignore(rows, stored).collect()] == [(1, "http://a/")]
    assert store.load_if_empty(rows, stored).count() == 0
    assert store.load_if_empty(rows, stored.limit(0)).count() == 2


def test_strict_insert(spark, stored):
    ok = spark.createDataFrame([("http://a/",), ("http://b/",)], "url string")
    assert store.strict_insert(ok, stored).count() == 2
    for bad in ([("http://a/",), ("http://a/",)], [("http://old/",)]):
        with pytest.raises(store.DuplicateUrl):
            store.strict_insert(spark.createDataFrame(bad, "url string"), stored)


def test_append_read_measure_clear(spark, stored, tmp_path):
    path = f"{tmp_path}/pages"
    store.append(stored, path)
    store.append(make(spark, [(8, "http://b/", "t", "c")]), path)
    back = P.stored_pages(spark, path)
    assert ids(back) == ["http://b/", "http://old/"]
    assert tuple(store.store_stats(back, index.build_doc_stats(back)).first()) == (2, 2)
    sizes = sum(f.stat().st_size for f in (tmp_path / "pages").glob("*.parquet"))
    assert store.bytes_on_disk(spark, path).first()[0] == sizes
    assert store.clear(spark, f"{tmp_path}/empty").count() == 0 and back.count() == 2
    with pytest.raises(ValueError):
        store.append(stored.withColumn("id", F.col("id").cast("int")), path)


def test_a_set_of_urls_grows_and_opens_again(spark, tmp_path):
    path = f"{tmp_path}/urls"
    urls = spark.createDataFrame([("http://a/",), ("http://b/",), ("http://a/",), (None,)], "url string")
    assert ids(urlset.create(urls, path, buckets=3)) == ["http://a/", "http://b/"]
    grown = urlset.add(spark.createDataFrame([("http://b/",), ("http://c/",), ("http://c/",)], "url string"), path)
    assert ids(grown) == ["http://a/", "http://b/", "http://c/"]
    assert "Bucketed: true" in grown.groupBy("url").count()._jdf.queryExecution().executedPlan().toString()
    spark.sql(f"DROP TABLE {urlset._name(path)}")                # a session that does not know the table
    assert ids(urlset.open_set(spark, path)) == ["http://a/", "http://b/", "http://c/"]
    assert ids(urlset.kept(urls, path)) == ["http://a/", "http://b/", "http://c/"]
    assert ids(urlset.create(urls.limit(0), f"{tmp_path}/none", buckets=2)) == []
    with pytest.raises(ValueError):
        urlset.open_set(spark, f"{tmp_path}/missing")


def test_the_manifest_knows_the_store(spark, tmp_path):
    path = f"{tmp_path}/s"
    old = make(spark, [(i, f"http://a/{i}", "t", "c", f"2024-01-{1 + i:02d} 00:00:00") for i in range(20)])
    new = make(spark, [(100 + i, f"http://b/{i}", "t", "c", f"2024-03-{1 + i:02d} 00:00:00") for i in range(20)])
    assert (manifest.exists(spark, path), manifest.read(spark, path).count(), manifest.totals(spark, path).first()["total_pages"]) == (False, 0, 0)
    manifest.append(old, path)
    manifest.append(new, path)
    t = manifest.totals(spark, path).first()
    sizes = sum(f.stat().st_size for f in (tmp_path / "s" / "data").rglob("*.parquet"))
    assert (t.total_pages, t.bytes, str(t.first_crawl), str(t.last_crawl)) == (40, sizes, "2024-01-01 00:00:00", "2024-03-20 00:00:00")
    since = manifest.read(spark, path, since=dt.datetime(2024, 3, 5))
    assert ids(since, "id") == list(range(104, 120))
    of_all = manifest.files(spark, path).count()
    assert 0 < len(since.inputFiles()) < of_all                 # the others are not opened
    manifest.clear(spark, path)
    assert (manifest.read(spark, path).count(), manifest.totals(spark, path).first()["bytes"]) == (0, 0)
    assert manifest.read(spark, path, version=1).count() == 40
    manifest.append(old.limit(3), path)
    assert manifest.totals(spark, path).first()["total_pages"] == 3


def test_seeds(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("http://a.com/\n\nhttp://b.com/x/\n http://a.com\nhttp://a.com/#top\n")
    seeds = P.seed_file(spark, f"{tmp_path}/seeds.txt")
    assert [r.url for r in seeds.orderBy("seq").collect()] == ["http://a.com/", "http://b.com/x/", "http://a.com", "http://a.com/#top"]
    assert ids(P.clean_seeds(seeds)) == ["http://a.com", "http://a.com/", "http://b.com/x"]


def test_wrong_input_is_named(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/x")
    with pytest.raises(ValueError, match="page_id is missing"):
        P.raw_pages(spark, f"{tmp_path}/x")
