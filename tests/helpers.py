"""SQLite's full-text index as the judge of matches, ranks and snippets."""

import sqlite3

from pyspark.sql import functions as F



def sqlite_index(rows):
    """``rows``: (id, title, content)."""
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE f USING fts5(title, content)")
    c.executemany("INSERT INTO f(rowid, title, content) VALUES (?, ?, ?)", rows)
    return c


def sqlite_search(c, match):
    sql = "SELECT rowid, bm25(f), snippet(f, 1, '<mark>', '</mark>', ' … ', 15) FROM f WHERE f MATCH ?"
    return {r[0]: (r[1], r[2]) for r in c.execute(sql, (match,))}


def store(spark, rows):
    """A page table from (id, url, title, content[, crawled_at text])."""
    full = [(r[0], r[1], r[2], r[3], r[4] if len(r) > 4 else "2024-01-01 00:00:00") for r in rows]
    df = spark.createDataFrame(full, "id long, url string, title string, content string, t string")
    return df.select("id", "url", "title", "content", F.col("t").cast("timestamp_ntz").alias("crawled_at"),
                     F.lit(200).alias("status_code"))


def column(spark, values, fn, schema="v string"):
    """``fn`` over one column of values, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]
