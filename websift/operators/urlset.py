"""A set of URLs kept in buckets, so that candidates meet it without moving it.

The set is a table bucketed and sorted by URL. A join with candidates shuffles the candidates alone, into the set's buckets; where
these are as many as Spark's shuffle partitions, the shuffle that makes candidates distinct serves the join too. For a semi join
Spark adds its own Bloom filter of the smaller side; for an anti join none would help, since candidates are made distinct anyway.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "url string"


def _name(path: str) -> str:
    return "urls_" + hashlib.sha256(path.encode()).hexdigest()[:32]


def _written(spark: SparkSession, path: str) -> int | None:
    """The buckets of the set at ``path``; none if there is no set."""
    meta = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/buckets/_SUCCESS")
    if not meta.getFileSystem(spark._jsc.hadoopConfiguration()).exists(meta):
        return None
    return spark.read.schema("n int").parquet(f"{path}/buckets").first()[0]


def _write(urls: DataFrame, path: str, n: int, mode: str) -> None:
    # one file for each bucket and call
    rows = urls.select("url").where("url is not null").distinct().repartition(n, "url")
    (rows.write.mode(mode).format("parquet").option("path", f"{path}/urls").bucketBy(n, "url").sortBy("url").saveAsTable(_name(path)))


def create(urls: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """The set of the distinct ``urls``, in as many buckets as the session has shuffle partitions unless told otherwise."""
    spark = urls.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    _write(urls, path, n, "overwrite")
    spark.createDataFrame([(n,)], "n int").coalesce(1).write.mode("overwrite").parquet(f"{path}/buckets")
    return open_set(spark, path)


def open_set(spark: SparkSession, path: str) -> DataFrame:
    """``url``: the set at ``path``, which any session can open."""
    n = _written(spark, path)
    if n is None:
        raise ValueError(f"{path}: no set of URLs")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(path)} ({COLUMNS}) USING parquet CLUSTERED BY (url) SORTED BY (url) INTO {n} BUCKETS "
              f"LOCATION '{path}/urls'")
    return spark.table(_name(path))


def add(urls: DataFrame, path: str) -> DataFrame:
    """Adds what the set does not have; writes rows in proportion to ``urls``."""
    spark = urls.sparkSession
    known = open_set(spark, path)
    _write(urls.select("url").distinct().join(known, "url", "left_anti"), path, _written(spark, path), "append")
    return open_set(spark, path)


def kept(urls: DataFrame, path: str) -> DataFrame:
    """The set at ``path``; made of ``urls`` if there is none."""
    return create(urls, path) if _written(urls.sparkSession, path) is None else open_set(urls.sparkSession, path)
