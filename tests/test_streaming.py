from pyspark.sql import functions as F

from websift import schema as S
from websift.operators import index
from websift.streaming import jobs

LONG = "word " * 30


def write(spark, folder, name, rows):
    df = spark.createDataFrame([(i, u, f"<title>{t}</title>{b}") for i, u, t, b in rows], S.RAW_PAGES)
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def ingest(spark, folder, target, state):
    raw = spark.readStream.schema(S.RAW_PAGES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.ingest_pages(raw, target, state).awaitTermination()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_ingest_keeps_urls_unique_and_the_index_in_step(spark, tmp_path):
    src, target, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    write(spark, src, "one", [(0, "http://a/", "A", LONG), (1, "http://b/", "B", "short"), (2, "http://a/", "again", LONG)])
    ingest(spark, src, target, state)
    write(spark, src, "two", [(3, "http://a/", "late", LONG), (4, "http://b/", "B2", LONG)])
    ingest(spark, src, target, state)
    pages = spark.read.parquet(f"{target}/pages")
    assert rows(pages.select("id", "url", "title")) == [(0, "http://a/", "A"), (1, "http://b/", "B2")]
    cols = ["term", "field", "doc_id", "pos", "doc_len"]
    assert rows(spark.read.parquet(f"{target}/postings").select(*cols)) == rows(index.build_postings(pages).select(*cols))
    assert spark.read.parquet(f"{target}/doc_stats").count() == 2


def test_a_replayed_stream_leaves_nothing_twice(spark, tmp_path):
    src, target = f"{tmp_path}/in", f"{tmp_path}/out"
    write(spark, src, "one", [(0, "http://a/", "A", LONG)])
    ingest(spark, src, target, f"{tmp_path}/state1")
    ingest(spark, src, target, f"{tmp_path}/state2")            # state lost: batch 0 is run again
    assert spark.read.parquet(f"{target}/pages").count() == 1
    assert spark.read.parquet(f"{target}/doc_stats").count() == 1


def test_ids_are_unique_over_batches_numbered_alike(spark, tmp_path):
    src, target = f"{tmp_path}/in", f"{tmp_path}/out"
    write(spark, src, "one", [(0, "http://a/", "A", LONG), (1, "http://b/", "B", LONG)])
    write(spark, src, "two", [(0, "http://c/", "C", LONG), (1, "http://d/", "D", LONG)])
    ingest(spark, src, target, f"{tmp_path}/state1")
    pages = spark.read.parquet(f"{target}/pages")
    assert sorted(r.id for r in pages.collect()) == [0, 1, 2, 3] and pages.select("batch").distinct().count() >= 2
    # state lost, and all files come in one batch
    raw = spark.readStream.schema(S.RAW_PAGES).option("recursiveFileLookup", "true").parquet(src)
    jobs.ingest_pages(raw, target, f"{tmp_path}/state2").awaitTermination()
    write(spark, src, "three", [(0, "http://e/", "E", LONG), (1, "http://a/", "A", LONG)])
    jobs.ingest_pages(raw, target, f"{tmp_path}/state2").awaitTermination()
    pages = spark.read.parquet(f"{target}/pages")
    assert sorted((r.id, r.url) for r in pages.collect())[4:] == [(4, "http://e/")] and pages.count() == 5


def test_batches_ask_the_state_and_read_no_stored_page(spark, tmp_path, monkeypatch):
    src, target, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    for n in range(20):                                         # each file has a new page, the last one, and one of all
        write(spark, src, f"f{n:02}", [(3 * n, f"http://p/{n}", f"T{n}", LONG), (3 * n + 1, f"http://p/{max(n - 1, 0)}", "late", LONG),
                                       (3 * n + 2, "http://hot/", f"H{n}", LONG)])
    reads, batches = [], jobs._batches
    monkeypatch.setattr(jobs, "_batches", lambda *a: reads.append(a) or batches(*a))
    ingest(spark, src, target, state)
    assert len(reads) == 1                                      # the state of a new run
    pages = spark.read.parquet(f"{target}/pages")
    assert pages.select("batch").distinct().count() >= 20
    got = {r.url: r.title for r in pages.collect()}
    assert len(got) == pages.count() == 21
    assert all(got[f"http://p/{n}"] == f"T{n}" for n in range(20))
    assert sorted(r.id for r in pages.collect()) == list(range(21))


def test_a_batch_that_failed_before_its_commit_is_run_again(spark, tmp_path):
    import os
    src, target, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    write(spark, src, "one", [(0, "http://a/", "A", LONG), (1, "http://b/", "B", LONG)])
    ingest(spark, src, target, state)
    last = max(int(f) for f in os.listdir(f"{state}/commits") if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{state}/commits/{f}"):
            os.unlink(f"{state}/commits/{f}")                   # written, but not committed
    ingest(spark, src, target, state)
    assert rows(spark.read.parquet(f"{target}/pages").select("id", "url", "title")) == [(0, "http://a/", "A"), (1, "http://b/", "B")]


def test_progress_windows_close_with_the_watermark(spark, tmp_path):
    src = f"{tmp_path}/log"
    log = spark.createDataFrame([(0, "2024-01-01 00:10:00", "u", "crawled"), (1, "2024-01-01 00:50:00", "u", "failed"),
                                 (2, "2024-01-01 01:05:00", "u", "crawled"), (3, "2024-01-01 02:20:00", "u", "crawled")],
                                "seq long, t string, url string, outcome string")
    log.select("seq", F.col("t").cast("timestamp_ntz").alias("ts"), "url", "outcome").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(S.FETCH_LOG).parquet(src)
    jobs.write_progress(jobs.progress(stream), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("window_start").collect()
    assert [tuple(r)[1:] for r in got] == [(1, 1, 0, 0), (1, 0, 0, 0)]
