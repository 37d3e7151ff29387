"""Continuous forms of the page save path and of the crawl counters."""

from __future__ import annotations

import hashlib
import threading

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from websift import schema as S
from websift.functions.html import with_content
from websift.operators import crawl as C
from websift.operators import index, store

# Keeps the state of a partition on disk, so that it may outgrow memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_raw_pages(spark: SparkSession, folder: str, pattern: str = "*.parquet",
                     files_per_trigger: int = 1000) -> DataFrame:
    """Raw pages as files arrive in a folder."""
    return (spark.readStream.schema(S.RAW_PAGES).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


class _FirstOfUrl(StatefulProcessor):
    """Gives a URL's first row, once. What is kept for a URL is the number of that row."""

    def init(self, handle) -> None:
        self.first = handle.getValueState("first", "seq long")

    def handleInputRows(self, key, rows, timerValues):
        if not self.first.exists():
            row = min(rows, key=lambda r: r.seq)
            self.first.update((row.seq,))
            yield row

    def handleInitialState(self, key, row, timerValues) -> None:
        self.first.update((row.seq,))

    def close(self) -> None:
        pass


_FirstOfUrl.__module__ = "__main__"      # pickled by value: executors need no copy of this package


def _fewer_copies(batches):
    """Rows of one task without those that an earlier row of the same URL and a smaller number makes needless."""
    first: dict[bytes, int] = {}
    for b in batches:
        keep = []
        for url, seq in zip(b.column("url").to_pylist(), b.column("seq").to_pylist()):
            key = hashlib.blake2b(url.encode(), digest_size=16).digest()
            keep.append(seq < first.get(key, seq + 1))
            if keep[-1]:
                first[key] = seq
        yield b.filter(pa.array(keep, pa.bool_()))


_fewer_copies.__module__ = "__main__"


def _run_of(spark: SparkSession, checkpoint: str) -> str | None:
    """The id of the stream whose checkpoint this is; none for a new one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/metadata")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.text(str(path)).select(F.get_json_object("value", "$.id")).first()[0]


def ingest_pages(raw: DataFrame, target: str, checkpoint: str, now: Column | None = None,
                 available_now: bool = True) -> StreamingQuery:
    """Raw pages into ``target/pages`` and their tokens into ``target/postings`` and ``target/doc_stats``.

    Each batch of a stream owns the partition ``run=<stream>/batch=<id>`` and replaces it when it is run again. A stream is
    known by its checkpoint; if that is lost, the next one is another run. The URLs a stream has stored are its keyed state:
    a batch asks that for its own URLs and reads no stored page. The first batch of a run fills the state with the URLs of
    other runs. Of one batch's rows of a URL the smallest number wins; copies of a page leave already in the tasks that
    parse them. Ids are numbered above the largest in use, which ``target/ids`` tells for each batch, in order of the
    page's number in its source. One stream at a time writes into a target.
    """
    spark = raw.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # an empty part, so that there is a table to read from the first batch on
    spark.createDataFrame([], S.PAGES).write.mode("ignore").parquet(f"{target}/pages/run=start/batch=-1")
    run = _run_of(spark, checkpoint)
    others = _batches(spark, f"{target}/pages", S.PAGES)
    if run:
        others = others.filter(F.col("run") != run)
    started, own = threading.Event(), []

    read = with_content(raw, want=("title", "content")).select(
        F.col("page_id").alias("seq"), "url", "title", "content", F.lit(200).alias("status_code"))
    rows = store.savable(read).filter(F.col("url").isNotNull() & F.col("seq").isNotNull())
    fresh = rows.mapInArrow(_fewer_copies, rows.schema).groupBy("url").transformWithState(
        _FirstOfUrl(), rows.schema, "Append", "None", others.select("url", F.col("id").alias("seq")).groupBy("url"))

    def save(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        part, before = f"run={own[0]}/batch={batch_id}", f"run={own[0]}/batch={batch_id - 1}"
        top = (spark.read.schema("top long").parquet(f"{target}/ids/{before}") if batch_id else
               others.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))).first()[0]
        kept = store.with_ids(store.numbered(batch, "seq", "url"), top, now)
        kept.write.mode("overwrite").parquet(f"{target}/pages/{part}")
        pages = spark.read.schema(S.PAGES).parquet(f"{target}/pages/{part}")
        index.build_postings(pages).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{target}/postings/{part}")
        index.build_doc_stats(pages).write.mode("overwrite").parquet(f"{target}/doc_stats/{part}")
        pages.agg(F.coalesce(F.max("id"), F.lit(top)).alias("top")).write.mode("overwrite").parquet(f"{target}/ids/{part}")

    w = fresh.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    stream = (w.trigger(availableNow=True) if available_now else w).start()
    own.append(stream.id)
    started.set()
    return stream


def _batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """What has been written so far, with ``run`` and ``batch``."""
    full = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(full).parquet(path)


def progress(log: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Crawl counters for each window of a streamed fetch log. Watermarks need zoned times, so ``ts`` is
    one while it is counted."""
    zoned = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = C.crawl_progress(zoned, every)
    return counted.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def write_progress(counters: DataFrame, target: str, checkpoint: str, available_now: bool = True
                   ) -> StreamingQuery:
    """Append each window once it is closed by the watermark."""
    w = (counters.writeStream.outputMode("append").format("parquet").option("path", target)
         .option("checkpointLocation", checkpoint))
    return (w.trigger(availableNow=True) if available_now else w).start()
