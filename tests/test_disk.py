"""What building an index and its searches leave on disk and send through shuffles."""

import os
import time

import numpy as np
import pyarrow as pa
from helpers import store
from pyspark.sql import functions as F

from websift.operators import segments as G
from websift.session import SHUFFLES_GO, shared_dir, stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f for f in files if "/shuffle_" in f}


def left(spark, before, most=0):
    """Bytes of shuffle files that came since, when those that go are gone; they go a moment after what they were for."""
    for _ in range(50):
        size = sum(os.path.getsize(f) for f in shuffle_files(spark) - before if os.path.exists(f))
        if size <= most:
            break
        time.sleep(0.1)
    return size


def test_written_tables_leave_no_shuffles(spark):
    before, kept = shuffle_files(spark), spark.conf.get(SHUFFLES_GO)
    some = stored(spark.range(5000).repartition(7, "id").groupBy((F.col("id") % 9).alias("k")).count(), "some")
    held, rows = G.held(spark.range(50).repartition(3, "id"), "held")
    assert left(spark, before) == 0
    assert some.count() == 9 and held.count() == len(rows) == 50
    assert spark.conf.get(SHUFFLES_GO) == kept


def test_building_leaves_the_index_only(spark, tmp_path):
    pages = store(spark, [(i, f"http://h/{i}", "a title", "b c " * (i % 9)) for i in range(60)])
    before, tables = shuffle_files(spark), set(os.listdir(shared_dir(spark)))
    G.create(pages, f"{tmp_path}/i", slice_docs=10)
    assert not [t for t in set(os.listdir(shared_dir(spark))) - tables if t.startswith("index-tokens")]
    assert left(spark, before, 10_000) <= 10_000      # of sums that are collected


def test_blocks_are_shuffled_packed(spark):
    t = spark.createDataFrame([(1, 3, ["a"], ["b", "b"], ["\x01abc"])], "doc_id long, n_tokens int, tt array<string>, ct array<string>, grams array<string>")
    made = plan(G._page_blocks(t, [], 8, F.lit(0).cast("long"), 1))
    dealt = made.split("MapInArrow", 1)[1].split("Exchange", 1)[1].split("\n", 1)[0]
    assert "bucket" in dealt and "blocks" in made and "pos" not in made.split("Exchange", 1)[1]


def test_packed_blocks_are_opened_as_they_were():
    begins = np.array([0, 2, 3, 5])
    ids = np.array([0, -5, 1 << 62, -(1 << 62), (1 << 63) - 1, 7, 7])
    null = np.array([1, 0, 0, 0, 0, 0, 0], bool)
    lens, fs, ts = np.array([3, 2_000_000, 0, 127, 128, 16384, 1]), np.array([2, 1, 1, 3, 1, 1, 1]), np.array([1, 0, 0, 2, 1, 0, 0])
    at = np.array([9, G.TITLE + 1, 0, 4, G.TITLE, G.TITLE + 300, G.TITLE + 5])
    places = np.array([0, 2, 3, 3, 6, 7, 7, 7])         # the second block and the last are of trigrams
    packed = G._pack()(begins, ids, null, lens, fs, ts, places, at)
    t = pa.table({"term": ["a", "\x01abc", "b", "\x01abd"], "n": pa.array([2, 1, 2, 2], pa.int32()), "packed": packed})
    rows = []
    for bucket, of_slice, k in ((3, 6, 1), (3, 5, 0), (3, 5, 2), (4, 1, 3)):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_table(t.slice(k, 1))
        rows.append({"bucket": bucket, "slice": of_slice, "blocks": sink.getvalue().to_pybytes()})
    got = [r for b in G._opened()(iter(pa.table({c: [r[c] for r in rows] for c in rows[0]}).to_batches(max_chunksize=3))) for r in b.to_pylist()]
    assert [(r["term"], r["slice"], r["n"], r["bucket"]) for r in got] == [("\x01abc", 6, 1, 3), ("a", 5, 2, 3), ("b", 5, 2, 3), ("\x01abd", 1, 2, 4)]
    got = [got[1], got[0], *got[2:]]
    assert [r["ids"] for r in got] == [[None, -5], [1 << 62], [-(1 << 62), (1 << 63) - 1], [7, 7]]
    assert [r["lens"] for r in got] == [[3, 2_000_000], [0], [127, 128], [16384, 1]]
    assert [r["fs"] for r in got] == [[2, 1], [1], [3, 1], [1, 1]] and [r["ts"] for r in got] == [[1, 0], [0], [2, 1], [0, 0]]
    assert [r["pos"] for r in got] == [[[9, G.TITLE + 1], [0]], [[]], [[4, G.TITLE, G.TITLE + 300], [G.TITLE + 5]], [[], []]]


def test_buckets_are_those_of_spark(spark):
    terms = ["é" * k + "x" * j for k in range(3) for j in range(100)] + ["\x01abc", "日本 語", "y" * 5000]
    want = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "i int, t string").select("i", G.bucket_of(F.col("t"), 1009).alias("b")).collect()
    array = pa.array(["cut", *terms])
    assert G._bucket_in()(array.slice(1), 1009).tolist() == [r["b"] for r in sorted(want)]
    assert G._bucket_in()(pa.array([], pa.string()), 8).tolist() == []


def test_rounds_make_the_same_blocks(spark, tmp_path, monkeypatch):
    pages = store(spark, [(i, f"http://h/{i}", "the t", "the of " * (i % 9) + f"w{i % 7}") for i in range(90)] + [(None, None, None, "the"), (None, None, None, "the")])
    one = G.create(pages, f"{tmp_path}/one", slice_docs=10).blocks()
    monkeypatch.setattr(G, "ROUND_SLICES", 2)
    made = []
    plain = G._page_blocks
    monkeypatch.setattr(G, "_page_blocks", lambda *a: made.append(1) or plain(*a))
    four = G.create(pages, f"{tmp_path}/four", slice_docs=10).blocks()
    assert len(made) == 4
    columns = ["term", "slice", "n", "ids", "lens", "fs", "ts", "pos", "peaks", "bucket"]
    rows = [sorted(map(repr, b.select(*columns).collect())) for b in (one, four)]
    assert rows[0] == rows[1] and len(rows[0]) > 20
