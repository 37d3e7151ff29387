"""What the index and its searches make and shuffle, and rows that come twice or without an id."""

from helpers import store
from pyspark.sql import functions as F

from websift.operators import index, lookup
from websift.operators import segments as G
from websift.plans import search

PHRASES = "sid string, phrases array<struct<title_only: boolean, tokens: array<string>>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tokenised(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, tt array<string>, ct array<string>, grams array<string>") \
        .withColumn("n_tokens", (F.size("tt") + F.size("ct")).cast("int"))


ROWS = [(1, ["the", "of"], ["the", "of", "cat"], ["\x01abc"]), (1, ["the", "of"], ["the", "of", "cat"], ["\x01abc"]), (None, [], ["of"], []), (3, [], [], ["\x01abc"]),
        (4, ["of"], ["of"] * 9 + ["the"], [])]


def test_blocks_of_a_slice(spark):
    made = G._page_blocks(tokenised(spark, ROWS), ["the", "of"], 8, F.lit(7).cast("long"), 1)
    assert "FlatMapGroupsInArrow" in plan(made) and "Generate" not in plan(made)       # no row for each occurrence
    got = {r["term"]: r for r in made.collect()}
    want = {}
    for i, tt, ct, grams in ROWS:
        n = len(tt) + len(ct)
        for base, toks in ((G.TITLE, tt), (0, ct)):
            for k, t in enumerate(toks):
                want.setdefault(t, {}).setdefault((i, n), []).append(base + k)
                if toks[k:k + 2] and len(toks[k:k + 2]) == 2 and set(toks[k:k + 2]) <= {"the", "of"}:
                    want.setdefault(" ".join(toks[k:k + 2]), {}).setdefault((i, n), []).append(base + k)
        for g in grams:
            want.setdefault(g, {}).setdefault((i, n), [])
    assert set(got) == set(want)
    for t, pages in want.items():
        order = sorted(pages, key=lambda x: (x[0] is not None, x))
        r = got[t]
        assert (r["ids"], r["lens"], r["n"], r["slice"]) == ([i for i, _ in order], [n for _, n in order], len(order), 7)
        assert r["pos"] == [sorted(pages[x]) for x in order]
        assert r["fs"] == [max(len(pages[x]), 1) for x in order] and r["ts"] == [sum(p >= G.TITLE for p in pages[x]) for x in order]
    assert made.where(F.col("peaks") == G.peaks(F.col("fs"), F.col("lens"))).count() == len(want)


def test_long_pages_share_fewer_slices(spark):
    sizes = {20: (600, 600 * 20_000)}
    assert spark.range(600).select(F.col("id").alias("doc_id"), F.lit(1000).alias("n_tokens")).select(G._slice(sizes, 512)).distinct().count() == 1
    assert spark.range(600).select(F.col("id").alias("doc_id"), F.lit(1200).alias("n_tokens")).select(G._slice(sizes, 512)).distinct().count() == 6


def test_terms_are_counted_where_text_is_cut(spark):
    p = store(spark, [(1, "", "a", "b b"), (1, "", "a", "b b"), (2, "", "", "b"), (3, "", None, None)])
    counted = index.term_stats(index.build_postings(p.repartition("id")))
    assert "hashpartitioning(term" in plan(counted) and ", doc_id" not in plan(counted).split("hashpartitioning(term", 1)[1].split(")", 1)[0]
    assert sorted(map(tuple, counted.collect())) == [("a", 1, 2), ("b", 2, 5)]


def test_equal_searches_are_looked_up_once(spark, tmp_path, monkeypatch):
    p = store(spark, [(i, f"http://h/{i}", "", "the cat " * (i % 3 + 1) + f"w{i % 2}") for i in range(40)])
    ix = G.create(p, f"{tmp_path}/i", slice_docs=10)
    looked = []
    plain = lookup._evaluated
    monkeypatch.setattr(lookup, "_evaluated", lambda index, need, blocks, at: looked.append(at.select("sid").distinct().count()) or plain(index, need, blocks, at))
    asked = [["cat", "w1"], ["w1", "cat"], ["cat", "w1"], ["w1"], ["w1", "w1"]]
    w = spark.createDataFrame([(str(i), [{"title_only": False, "tokens": [t]} for t in ts]) for i, ts in enumerate(asked)], PHRASES)
    hits = {}
    for r in lookup.score_searches(ix, w).collect():
        hits.setdefault(r["sid"], {})[r["doc_id"]] = r["rank"]
    assert looked == [3]
    assert hits["0"] == hits["1"] == hits["2"] and len(hits["0"]) == 20
    assert {k: round(2 * v, 9) for k, v in hits["3"].items()} == {k: round(v, 9) for k, v in hits["4"].items()}
    queries = spark.createDataFrame([(i, "cat w1", 1 + i % 2, None, "date" if i % 2 else "relevance") for i in range(6)],
                                    "query_id long, q string, page int, time_filter string, sort_by string")
    looked.clear()
    total = search.batch_summary(queries, p, ix)
    assert looked == [1] and {r["total_results"] for r in total.collect()} == {20}


def test_changes_are_cut_once(spark, tmp_path, monkeypatch):
    cut = []
    plain = G._tokens
    monkeypatch.setattr(G, "_tokens", lambda pages: cut.append(1) or plain(pages))
    ix = G.create(store(spark, [(i, "", "", f"a b w{i}") for i in range(9)]), f"{tmp_path}/i")
    assert len(cut) == 1
    ix = G.apply_changes(ix, spark.createDataFrame([(0, "update", 3, "", "new", "a c"), (1, "delete", 4, "", "", "")],
                                                   "seq long, op string, id long, url string, title string, content string"))
    assert len(cut) == 2 and ix.n_docs == 8
    terms = ix.counters().groupBy("term").agg(F.sum("n_docs").alias("n")).where("n > 0")
    assert {r["term"]: r["n"] for r in terms.collect()} == {"a": 8, "b": 7, "c": 1, "new": 1, **{f"w{i}": 1 for i in range(9) if i not in (3, 4)}}
