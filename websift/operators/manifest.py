"""The page store's manifest: which files make up a version of the store, with their rows, bytes and crawl times.

Every append and clear writes a new version, last and as one table, so readers see all of a change or nothing; older versions
stay readable. Totals come from the manifest alone, and a reader of recent pages opens only the files that can hold some.
One writer at a time; a second one with the same version fails.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websift import schema as S

FILES = "file string, n long, bytes long, first_crawl timestamp_ntz, last_crawl timestamp_ntz"


def _versions(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [f.getPath() for f in fs.listStatus(folder)]
    done = [p.getName() for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix("version=")) for n in done)


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_versions(spark, path))


def files(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The files of a version, the last one unless told; a row for each: ``file, n, bytes, first_crawl, last_crawl``."""
    found = _versions(spark, path)
    if not found:
        return spark.createDataFrame([], FILES)
    return spark.read.schema(FILES).parquet(f"{path}/manifest/version={found[-1] if version is None else version}")


def _commit(listed: DataFrame, path: str) -> None:
    found = _versions(listed.sparkSession, path)
    listed.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/version={found[-1] + 1 if found else 0}")


def append(pages: DataFrame, path: str) -> None:
    """Adds ``pages`` in files that each cover a range of crawl times."""
    spark = pages.sparkSession
    part = f"{path}/data/{uuid.uuid4().hex}"
    S.require(pages, S.PAGES, path).repartitionByRange("crawled_at").sortWithinPartitions("crawled_at").write.parquet(part)
    sizes = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(part)
             .select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes")))
    times = (spark.read.schema(S.PAGES).parquet(part).groupBy(F.col("_metadata.file_name").alias("name"))
             .agg(F.count(F.lit(1)).alias("n"), F.min("crawled_at").alias("first_crawl"), F.max("crawled_at").alias("last_crawl")))
    new = times.join(sizes, "name").select(F.concat(F.lit(f"{part}/"), "name").alias("file"), "n", "bytes", "first_crawl", "last_crawl")
    _commit(files(spark, path).unionByName(new), path)


def clear(spark: SparkSession, path: str) -> None:
    """A version without files. Those of older versions stay for who still reads them."""
    _commit(spark.createDataFrame([], FILES), path)


def totals(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One row: ``total_pages, bytes, first_crawl, last_crawl``. No page is read."""
    return files(spark, path, version).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_pages"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.min("first_crawl").alias("first_crawl"), F.max("last_crawl").alias("last_crawl"))


def read(spark: SparkSession, path: str, since: dt.datetime | None = None, version: int | None = None) -> DataFrame:
    """The pages of a version; with ``since`` those crawled then or later, from the files that can hold some."""
    listed = files(spark, path, version)
    if since is not None:
        listed = listed.filter(F.col("last_crawl") >= F.lit(since).cast("timestamp_ntz"))
    names = [r["file"] for r in listed.select("file").collect()]        # what Spark would list itself
    pages = spark.read.schema(S.PAGES).parquet(*names) if names else spark.createDataFrame([], S.PAGES)
    return pages if since is None else pages.filter(F.col("crawled_at") >= F.lit(since).cast("timestamp_ntz"))
