"""Of the blocks that meet in a slice, only what can be a hit goes through the shuffles."""

import pytest
from helpers import store

from websift.operators import lookup
from websift.operators import segments as G

PHRASES = "sid string, phrases array<struct<title_only: boolean, tokens: array<string>>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [0, 3, 64])
def test_blocks_are_cut_down_to_the_rarest_one(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(lookup, "FEW", few)
    texts = {i: "the of the cat " * (1 + i % 2) + f"w{i % 20} sat" for i in range(200)} | {None: "of cat w3 sat the"}
    ix = G.create(store(spark, [(i, f"http://h/{i}", "", x) for i, x in texts.items()]), f"{tmp_path}/i", slice_docs=100)
    asked = {"a": [["w3", "sat"]], "b": [["the"], ["w3"], ["cat"]], "c": [["cat"], ["w3", "sat"]], "d": [["sat", "w3"]], "e": [["the"]]}
    w = spark.createDataFrame([(s, [{"title_only": False, "tokens": t} for t in ps]) for s, ps in asked.items()], PHRASES)
    hits = lookup.score_searches(ix, w)
    got = {(r["sid"], r["doc_id"]) for r in hits.collect()}
    assert got == {(s, i) for s, ps in asked.items() for i, x in texts.items() if all(f" {' '.join(p)} " in f" {x} " for p in ps)}
    assert "array_contains" in plan(hits)
