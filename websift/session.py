"""Session settings the jobs rely on, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # terms of a lookup, named one by one in the scan of a stored index (see segments.named)
    "spark.sql.parquet.pushdown.inFilterThreshold": "50",
    # pages are up to 5 MiB each
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


_LOCAL: dict[str, str] = {}      # temporary folders of local sessions

# What is written or collected leaves no shuffle files. Spark would else keep them until the driver collects its garbage, and the files of all
# steps of a long job would add up.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app: str = "websift", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    A temporary folder is used only where the session runs in local mode and names none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="websift-")
    return _LOCAL[app]


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting that holds for what is written or collected inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    For results that several branches of a plan read: Spark shares a shuffle between branches only where
    their plans are equal to the letter. What is written also outlives lost executors. The folder's owner
    removes old tables.
    """
    path = scratch_path(df.sparkSession, what)
    with setting(df.sparkSession, SHUFFLES_GO, "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new, unused path for one intermediate table."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
