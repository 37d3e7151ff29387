"""Every operator over awkward rows and over none: nothing breaks, and each case has its defined result."""

import collections
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F
from rows import awkward, nothing  # noqa: F401

import corpus_pipeline
from websift.llm import backoff_lm, block_search, gumbel_pieces, license_scan, ngram_join, order_minhash, repeat_removal, source_mix, surrogates, weak_labels

BY_DOCUMENT = {
    "pieces": lambda d: gumbel_pieces.sample_pieces(d, k=2), "repeats": lambda d: repeat_removal.remove_repeats(d, 20),
    "join": lambda d: ngram_join.ngram_jaccard_join(d, 3, 90), "licenses": license_scan.license_scan, "fingerprints": order_minhash.neighbour_fingerprints,
    "mix": lambda d: source_mix.mix_sources(d)[0], "surrogates": lambda d: surrogates.replace_entities(d, "k"), "backoff": backoff_lm.backoff_scores,
    "quality": weak_labels.weak_label_quality,
}


@pytest.fixture(scope="module")
def results(awkward):
    return {name: op(awkward).collect() for name, op in BY_DOCUMENT.items()}


def by_id(rows, d):
    return [r for r in rows if r["doc_id"] == d]


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_no_rows(name, nothing):
    assert BY_DOCUMENT[name](nothing).collect() == []


@pytest.mark.parametrize("name", [n for n in BY_DOCUMENT if n != "pieces"])
def test_one_result_for_each_row(name, results, awkward):
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in awkward.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in results[name]) == ids


def test_pieces(results):
    rows = results["pieces"]
    for d in (3, 4):
        assert [(r["ids"], r["log_prob"], r["log_inclusion"]) for r in by_id(rows, d)] == [([], 0.0, 0.0)]
    assert [r["ids"] for r in by_id(rows, 2)][:2] != [] and len(by_id(rows, 2)) == 4
    assert all(r["round_trip"] for r in rows if r["doc_id"] != 9)
    assert not any(r["round_trip"] for r in by_id(rows, 9))          # a blank sign in the text decodes to a blank


def test_repeats(results):
    rows = results["repeats"]
    assert [r["n_removed"] for r in by_id(rows, 1)] == [0]
    assert [r["n_removed"] for r in by_id(rows, 2)] == [51, 51]
    assert {r["kept_sha256"] for d in (3, 4) for r in by_id(rows, d)} == {hashlib.sha256(b"").hexdigest()}
    assert by_id(rows, 11)[0]["n_removed"] == 4999                    # all but the first byte lie under a repeat
    assert all(r["n_removed"] == 0 for r in by_id(rows, None))


@pytest.mark.parametrize("held", [None, 0])
def test_equal_rows_keep_their_first_occurrence(spark, held, monkeypatch):
    if held is not None:                        # every batch is sent on, so equal rows meet only in their group, over batch ends
        monkeypatch.setattr(repeat_removal, "HELD", held)
    rng = random.Random(1)
    alone, long, shared = ("".join(rng.choice("abcdefghij ") for _ in range(n)) for n in (150, 150_000, 300))
    rows = [(1, alone)] * 3 + [(2, long)] * 6 + [(3, shared + alone[:50])] * 2 + [(4, "x" * 20 + shared)] * 2 + [(5, alone * 2)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted((r["doc_id"], r["n_removed"]) for r in repeat_removal.remove_repeats(df).collect())
    assert got == [(1, 0)] * 3 + [(2, 0)] * 6 + [(3, 0)] * 2 + [(4, 300)] * 2 + [(5, 300)] * 2


def test_join(results):
    rows = results["join"]
    assert {r["component_id"] for d in (1, 2) for r in by_id(rows, d)} == {1}
    assert [(r["n_shingles"], r["component_id"]) for d in (3, 4, 5) for r in by_id(rows, d)] == [(0, 3), (0, 4), (0, 5)]
    assert [(r["n_shingles"], r["component_id"]) for d in (6, 10) for r in by_id(rows, d)] == [(1, 6), (1, 6)]
    assert by_id(rows, 8)[0]["component_id"] == 7
    assert all(r["component_id"] is None for r in by_id(rows, None))


def test_licenses(results):
    rows = results["licenses"]
    assert [(r["n_words"], r["n_base"], r["first_word"], r["labels"], r["score"]) for d in (3, 4, 5) for r in by_id(rows, d)] == [(0, 0, None, "", 0.0)] * 3
    r = by_id(rows, 12)[0]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == (1, 3, 3, "apache", "apache", 1.0)


def test_fingerprints(results):
    rows = results["fingerprints"]
    assert len({r["fingerprint"] for d in (1, 2) for r in by_id(rows, d)}) == 1
    assert by_id(rows, 3)[0]["fingerprint"] == "0" * 256 and by_id(rows, 3)[0]["near_next"] == 1.0       # followed by an empty text
    assert by_id(rows, 1)[0]["near_next"] == 1.0
    assert by_id(rows, 7)[0]["near_next"] > 0.9


def test_mix(results):
    rows = results["mix"]
    assert {r["source"] for r in rows} == {None}
    assert sum(r["taken"] for r in rows) == math.floor(rows[0]["target"])
    assert all(r["taken"] <= 2 * r["size"] for r in rows)


def test_surrogates(results):
    rows = results["surrogates"]
    assert [r["text"] for r in by_id(rows, 3)] == [None] and [r["text"] for r in by_id(rows, 4)] == [""]
    r = by_id(rows, 13)[0]
    assert r["n_entities"] == 3 and not any(x in r["text"] for x in ("a.b@c.de", "555-3733", "John", "Doe")) and " or +1 (" in r["text"] and "Mr. " in r["text"]


def test_backoff(results):
    rows = results["backoff"]
    assert [(r["n_words"], r["log_score"], r["score"]) for d in (3, 4, 5) for r in by_id(rows, d)] == [(0, 0.0, None)] * 3
    assert all(r["n_triples"] == 11 for r in by_id(rows, 2))


def test_quality(results):
    rows = results["quality"]
    assert [(r["score"], r["keep"]) for d in (3, 4, 5) for r in by_id(rows, d)] == [(0.0, False)] * 3
    assert len({(r["score"], r["keep"]) for d in (1, 2) for r in by_id(rows, d)}) == 1


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
            (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (100, [1.0, 1.0]), (200, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, embedding array<float>, d int, stripe string")
    got = [tuple(r) for r in block_search.nearest(df, F.col("vec_id") % 100 == 0, k=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 1.0), (100, 1, 2, 0.0), (100, 2, 0, 1.0)]
    assert block_search.nearest(df.where("false"), F.col("vec_id") % 100 == 0).collect() == []


def test_pipeline_stages(spark, awkward, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing.select(*corpus_pipeline.DOC_COLUMNS), "").collect() == []
        out = stage(spark, awkward, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tuple(out.columns) == tuple(corpus_pipeline.DOC_COLUMNS)
        out.collect()


def said(seed, n):
    return " ".join(random.Random(seed).choices("alpha beta gamma delta epsilon zeta eta theta iota kappa".split(), k=n))


def in_columns(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_one_row_of_each_group_of_near_copies_stays(spark):
    twice, nowhere, alone, copied, both = (said(i, 60) for i in range(5))
    rows = [(1, twice), (1, twice), (None, nowhere), (None, nowhere), (2, alone), (2, copied + " end"), (0, copied), (None, both), (7, both), (3, ""), (3, "")]
    out = corpus_pipeline.near_duplicates(spark, in_columns(spark, rows), "")
    assert collections.Counter((r["doc_id"], r["text"]) for r in out.collect()) == collections.Counter(
        [(1, twice), (None, nowhere), (2, alone), (0, copied), (7, both), (3, ""), (3, "")])


def test_mix_decides_for_each_row(spark):
    rows = [(None, said(1, 700)), (None, said(2, 701)), (1, said(3, 300)), (1, said(4, 900)), (2, said(5, 500)), (2, said(5, 500)), (2, said(5, 500)), (3, said(6, 800))]
    for some in (rows, [r for r in rows if r[0] == 1]):
        df = in_columns(spark, some)
        expected = collections.Counter()
        for r in source_mix.mix_sources(df)[0].collect():
            expected[r["doc_id"], r["size"]] += math.floor(r["taken"] / r["size"] + 0.5)
        got = collections.Counter((r["doc_id"], len(r["text"].split())) for r in corpus_pipeline.mix(spark, df, "").collect())
        assert got == +expected
        assert len(got) == 6 if some is rows else sorted(got.values()) == [1, 2]        # rows of one id, each with its own decision
