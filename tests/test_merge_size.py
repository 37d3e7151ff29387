"""What a merge of the index writes, and how often the pages of the change sets are parsed."""

import glob

import pytest
from helpers import store
from pyspark.sql import functions as F

from websift.operators import segments as G
from websift.plans import catalog


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def contents(index):
    return sorted(index.blocks().drop("seq").collect(), key=lambda r: (r["bucket"], r["term"], r["slice"]))


def test_a_merge_writes_one_file_for_each_bucket(uncoalesced, tmp_path):
    pages = store(uncoalesced, [(i, f"http://h/{i % 7}", "the title", " ".join(["the", "of", f"w{i % 40}"] * (1 + i % 50))) for i in range(300)])
    kept = G.create(pages, str(tmp_path / "i"), slice_docs=16)
    changes = pages.where("id < 20").select(F.col("id").alias("seq"), F.lit("delete").alias("op"), "id", "url", "title", "content")
    kept = G.merge(G.apply_changes(kept, changes), slice_docs=16)
    (name, _), = kept.names("segment")
    buckets = glob.glob(f"{name.removeprefix('file:')}/blocks/bucket=*")
    assert len(buckets) == 8 and all(len(glob.glob(f"{b}/*.parquet")) == 1 for b in buckets)
    # the same as an index made of the living pages, but for pairs, which were settled before
    fresh = G.create(pages.where("id >= 20"), str(tmp_path / "j"), slice_docs=16)
    assert contents(kept) == contents(fresh)


@pytest.mark.parametrize("rows", [1, 2, 3, 1000])
def test_blocks_of_a_merge_go_on_in_the_next_batch(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(G, "MERGED_ROWS", rows)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        some = [(1, "http://h/a", "b", "a a b"), (None, "", "", "a"), (2, None, None, None), (3, "", "a", "b a b"), (3, "", "a", "b a b"), (4, "", "", "a b a"), (5, "http://h/a", "", "")]
        kept = G.create(store(spark, some), str(tmp_path / "i"))
        merged = G.merge(kept)
        assert contents(merged) == contents(kept)
        assert merged.blocks().where(F.col("peaks") != G.peaks(F.col("fs"), F.col("lens"))).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_changes_do_not_parse_pages_again(spark, tmp_path, monkeypatch):
    pages = [(i, f"http://h{i}.{'org' if i % 3 else 'com'}/{'en' if i % 2 else 'de'}/", f"<html><title>t{i}</title><body><p>some words {i}</p></body></html>") for i in range(12)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    plans, apply = [], G.apply_changes
    monkeypatch.setattr(G, "apply_changes", lambda index, changes: plans.append(changes._jdf.queryExecution().executedPlan().toString()) or apply(index, changes))
    assert catalog.index_apply_changes(spark, str(tmp_path)).count()
    assert len(plans) == 2 and not any("Python" in p for p in plans)
