"""The queries of this package over the given tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websift.llm import block_search, divergence_audit, line_dedup, source_mix
from websift.llm.backoff_lm import backoff_scores
from websift.llm.common import documents
from websift.llm.gumbel_pieces import sample_pieces
from websift.llm.license_scan import license_scan
from websift.llm.ngram_join import ngram_jaccard_join
from websift.llm.order_minhash import neighbour_fingerprints
from websift.llm.repeat_removal import remove_repeats
from websift.llm.surrogates import replace_entities
from websift.llm.token_alignment import align_tokens
from websift.llm.weak_labels import weak_label_quality


def op1_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(documents(spark, sf_dir), k=2)


def op2_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), length=100).drop("spans")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(documents(spark, sf_dir), width=3, per100=90)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).drop("blocks")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(documents(spark, sf_dir))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, _ = source_mix.mix_sources(documents(spark, sf_dir))
    return taken.drop("source")


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(documents(spark, sf_dir), key="surrogates")


def op8_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(documents(spark, sf_dir))


def op9_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return block_search.nearest(vectors, F.col("vec_id") % 100 == 0, k=10)


def op10_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_label_quality(documents(spark, sf_dir))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.divergence_audit(documents(spark, sf_dir))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir)).drop("kept")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(documents(spark, sf_dir))


QUERIES = {q.__name__: q for q in (op1_gumbel_pieces, op2_repeat_removal, op3_ngram_jaccard, op4_license_scan, op5_order_minhash, op6_source_mix,
                                    op7_surrogates, op8_backoff_scores, op9_block_search, op10_weak_labels, op11_divergence_audit, op12_line_dedup,
                                    op13_token_alignment)}
ORACLE = {"op6_source_mix": source_mix.ORACLE, "op9_block_search": block_search.ORACLE,
          "op11_divergence_audit": divergence_audit.ORACLE, "op12_line_dedup": line_dedup.ORACLE}
