"""A training-data pipeline over ``documents``: stages that each call one operator of ``websift.llm``.

Every stage works on all rows that the one before kept and, but for the last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from websift.llm.common import DOC_COLUMNS, documents, stored
from websift.llm.gumbel_pieces import sample_pieces
from websift.llm.ngram_join import ngram_jaccard_join
from websift.llm.source_mix import mix_sources
from websift.llm.surrogates import replace_entities
from websift.llm.weak_labels import weak_label_quality


def row_key() -> Column:
    """A stage's own key of a row: 128 bits of its columns, nulls told apart. Only equal rows share it."""
    written = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col(c).cast("string") for c in DOC_COLUMNS)]
    return F.md5(F.concat(*written))


def set_key() -> Column:
    """The id that the join over shingle sets has for a row: 64 bits of id and text, nulls told apart."""
    return F.xxhash64("doc_id", "text", F.col("doc_id").isNull(), F.col("text").isNull())


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; so do texts without words."""
    judged = weak_label_quality(docs, carried=tuple(DOC_COLUMNS[1:]))
    return judged.where("keep").select(*DOC_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest id, null last. Near: 0.8 of five-word shingles.

    Rows are judged by their own texts: of equal rows one stays, rows of one id with different texts are told apart, and rows with
    a null id are compared like others. Texts without words are near nothing; all their rows stay.
    """
    worded = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("key", set_key())
    groups = (ngram_jaccard_join(worded.select("key", "text"), width=5, per100=80, id_col="key")
              .select(F.col("doc_id").alias("key"), "component_id").distinct())
    smallest = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"]
    stay = worded.select("key", "doc_id").distinct().join(groups, "key").groupBy("component_id").agg(smallest.alias("key")).select("key")
    # of the rows of one key each task keeps one before they meet
    first = Window.partitionBy("key").orderBy("source", "lang", "n_chars")
    one = worded.join(stay, "key").withColumn("n", F.row_number().over(first)).where("n = 1")
    return one.select(*DOC_COLUMNS).unionByName(docs.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).select(*DOC_COLUMNS))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities in the texts become surrogates; every document stays. Null texts stay null, repeated rows are treated alike."""
    return replace_entities(docs, key="surrogates", carried=("lang", "source")).withColumn("n_chars", F.length("text").cast("long")).select(*DOC_COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row stands in the mix as often as it was taken, up to twice; one of which less than half was taken is left out.

    Each row has its own decision, also with a null id or an id that other rows have; equal rows share theirs in any order.
    """
    taken, _ = mix_sources(docs.withColumn("key", row_key()), carried=("key",))
    times = F.round(F.col("taken") / F.col("size"))
    counts = taken.where("taken > 0").groupBy("key").agg(F.count_if(times == 2).alias("twice"), F.count_if(times == 1).alias("once"))
    # equal rows are counted, then numbered: the first ones stand in the mix twice, the next once
    number = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
    return (docs.withColumn("key", row_key()).join(counts.where("twice + once > 0"), "key").withColumn("n", number)
            .withColumn("times", F.when(F.col("n") <= F.col("twice"), 2).when(F.col("n") <= F.col("twice") + F.col("once"), 1).otherwise(0)).where("times > 0")
            .withColumn("pass", F.explode(F.sequence(F.lit(1), "times"))).select(*DOC_COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document in the mix, as ids; whole texts. A row that stands in the mix twice is encoded twice, alike."""
    return sample_pieces(docs, k=2)


STAGES = [("weak_label_quality", quality), ("ngram_jaccard_join", near_duplicates), ("replace_entities", pii),
          ("mix_sources", mix), ("sample_pieces", encode)]
ORACLE_SQL: str | None = None       # shingle components and sampled pieces are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each is written as Parquet and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
