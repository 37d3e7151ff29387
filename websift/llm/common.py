"""What the operators share: hashing of words, Arrow passes, stored tables, connected components."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from websift.session import scratch_path, stored

__all__ = ["Scratch", "arrow_pass", "components", "documents", "heaviest", "likely", "mix64", "ready", "scratch_path", "shingles", "stored", "word_hashes"]

# Executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

PICKED = 1 << 24            # hashes that the bitmap of wanted ids tells apart


def ready(spark: SparkSession) -> None:
    """Bounded Arrow batches: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_pass(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df`` through ``fn``, batch by batch; every batch that comes out has just ``schema``."""
    ready(df.sparkSession)
    want = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def fitted(batches):
        for b in fn(batches):
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(b.columns, want)], schema=want)
    return df.mapInArrow(fitted, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case."""
    words = (text or "").encode("utf-8", "replace").lower().split()     # of bytes: ASCII only, and just these separators
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width`` words in a row; of fewer words, one hash of all; of none, nothing.

    The highest byte falls with the shingle's length, so that long ones, which are mostly rare, come first.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    size = np.fromiter(map(len, words), np.int64, len(words))
    w = min(width, len(h))
    n = len(h) - w + 1
    s, total = np.full(n, w, np.uint64), np.zeros(n, np.int64)
    for i in range(w):
        s = mix64(s * np.uint64(0x9E3779B97F4A7C15) + h[i:n + i])
        total += size[i:n + i]
    return np.unique((s >> np.uint64(8)) | ((255 - np.minimum(total, 255)).astype(np.uint64) << np.uint64(56)))


def likely(big: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """All rows of a wide table whose number ``on`` is in ``ids`` (that column alone; repeats and nulls change nothing), and a few others.

    A bitmap of the ids' hashes goes to every task, in 262,144 words at most however many ids there are; so nothing of ``big`` is shuffled.
    Of the other rows a share comes along that grows with the ids (8 percent for 1.4 million): what is made of the rows has to meet the ids.
    """
    at = F.pmod(F.xxhash64(on), F.lit(PICKED))
    word, bit = F.shiftright(at, 6), (at % 64).cast("int")
    bits = (ids.where(F.col(on).isNotNull()).distinct().select(word.alias("_word"), bit.alias("_bit"))
            .groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")))
    near = big.where(F.col(on).isNotNull()).withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(bits), "_word")
    return near.where("shiftright(_bits, _bit) & 1 = 1").drop("_word", "_bit", "_bits")


class Scratch:
    """The intermediate tables of one operator, which deletes each after its last reader."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        self.paths.append(scratch_path(self.spark, what))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self, *whats: str) -> None:
        """Deletes the tables whose names begin so; all for none."""
        gone = [p for p in self.paths if not whats or p.rsplit("/", 1)[1].startswith(whats)]
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for p in gone:
            path = hadoop(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = [p for p in self.paths if p not in gone]


def heaviest(counted: DataFrame, value: str, weight: str, most: int, what: str, store=stored) -> np.ndarray:
    """Values of the largest weights, lightest first: as many whole classes of weight (quarters of a power of two) as fit into ``most``.

    ``counted`` has a row for each value. Only the classes' sizes and then at most ``most`` rows reach the driver.
    """
    counted = store(counted.select(F.col(value).alias("v"), F.col(weight).alias("w"), F.floor(F.log2(weight) * 4).alias("c")), what)
    held, lowest = 0, None
    for r in sorted(counted.groupBy("c").count().collect(), reverse=True):
        held += r["count"]
        if held > most:
            break
        lowest = r["c"]
    if lowest is None:
        return np.zeros(0, np.uint64)
    rows = counted.where(F.col("c") >= lowest).select("v", "w").toPandas().sort_values(["w", "v"])
    return rows["v"].to_numpy(np.int64).view(np.uint64)


def components(edges: DataFrame, what: str = "components", store=stored) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every node of ``edges`` (``a``, ``b``).

    Each round takes the smallest label among neighbours, then the label of that label, so labels travel
    doubling distances. Every round is a written table: plans stay short, and a lost executor costs one
    round. Only a flag comes to the driver. Empty input gives an empty table.
    """
    both = store(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{what}-edges")
    labels = store(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")),
                    f"{what}-0")
    n = 0
    while True:
        n += 1
        near = (both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("m")))
        low = (labels.join(near, labels.id == near.a)
               .select("id", F.least("component", "m").alias("c"), F.col("component").alias("was")))
        low = store(low, f"{what}-{n}a")
        far = low.select(F.col("id").alias("of"), F.col("c").alias("next"))
        new = store(low.join(far, low.c == far.of).select("id", F.col("next").alias("component"), "was"), f"{what}-{n}b")
        labels = new.select("id", "component")
        if new.where("component <> was").isEmpty():
            return labels
