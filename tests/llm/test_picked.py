"""Texts that few rows ask for are not shuffled, and none is lost."""

import pytest
from pyspark.sql import functions as F

from websift.llm import common, ngram_join


@pytest.mark.parametrize("hashes", [64, 1 << 24])
def test_wanted_rows_and_few_others(spark, monkeypatch, hashes):
    monkeypatch.setattr(common, "PICKED", hashes)
    big = spark.createDataFrame([(i if i else None, f"t{i}") for i in range(500)] + [(7, "again"), (-5, "minus")], "id long, text string")
    ids = spark.createDataFrame([(7,), (7,), (None,), (-5,), (499,), (1 << 40,)], "id long")
    got, want = sorted(map(tuple, common.likely(big, ids, "id").collect())), [(-5, "minus"), (7, "again"), (7, "t7"), (499, "t499")]
    assert set(want) <= set(got) and len(got) == len(set(got)) < 100 and (hashes == 64 or got == want)
    assert common.likely(big, ids.where("false"), "id").count() == 0


def test_the_join_shuffles_no_texts(spark, monkeypatch):
    plans, arrow_pass = [], ngram_join.arrow_pass
    monkeypatch.setattr(ngram_join, "arrow_pass", lambda df, fn, schema: plans.append(df._jdf.queryExecution().executedPlan().toString()) or arrow_pass(df, fn, schema))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine ten {i % 3}") for i in range(30)], "doc_id long, text string")
        assert ngram_join.ngram_jaccard_join(docs, width=3, per100=50).agg(F.max("component_id")).first()[0] == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    texts = [p for p in plans if "BroadcastHashJoin" in p and "text" in p]
    assert len(texts) == 5                      # those of pairs, twice for either set of pairs, and of trees
    assert not any("text" in p for p in plans if "SortMergeJoin" in p or "hashpartitioning(doc_id" in p)
