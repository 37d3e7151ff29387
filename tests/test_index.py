import os
import random

from helpers import sqlite_index, store
import pytest
from pyspark.sql import functions as F

from websift.operators import index, lookup, paging
from websift.operators import segments as G

WORDS = "the of cat Été dog x_y".split()


def text(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def pages(spark, seed=1, n=60):
    rnd = random.Random(seed)
    return store(spark, [(i, f"http://h/{i}", text(rnd, rnd.randint(0, 3)), text(rnd, rnd.randint(0, 30))) for i in range(n)])


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_postings_are_sqlites(spark):
    p = pages(spark)
    c = sqlite_index([(r.id, r.title, r.content) for r in p.collect()])
    c.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, instance)")
    want = sorted(c.execute("SELECT doc, col, term, offset FROM v").fetchall())
    got = index.build_postings(p)
    assert rows(got.select("doc_id", "field", "term", "pos")) == want
    c.execute("CREATE VIRTUAL TABLE r USING fts5vocab(f, row)")
    assert rows(index.term_stats(got)) == sorted(c.execute("SELECT term, doc, cnt FROM r").fetchall())
    stats = index.corpus_stats(index.build_doc_stats(p)).first()
    assert tuple(stats) == (60, len(want) / 60)


PHRASES = "sid string, phrases array<struct<title_only: boolean, tokens: array<string>>>"


def wanted(spark, *searches):
    """Each search a list of phrases; a phrase is words, or words after ``t:`` for the title alone."""
    def phrase(p):
        return {"title_only": p.startswith("t:"), "tokens": p.removeprefix("t:").split()}
    return spark.createDataFrame([(str(i), [phrase(p) for p in ps]) for i, ps in enumerate(searches)], PHRASES)


ASKED = [["the"], ["the of"], ["of the cat"], ["the", "cat", "the"], ["t:the"], ["t:the of", "dog"], ["ete dog ete"], ["of of of"], ["nothing"], ["the", "nothing"], ["x y"],
         ["the of cat ete"], ["t:cat", "t:cat of"]]


def plain_hits(p, searches):
    """Ranks by the postings of SQLite's index."""
    c = sqlite_index([(r.id, r.title, r.content) for r in p.collect()])
    out = {}
    for i, ps in enumerate(searches):
        match = " AND ".join(f'title:"{x.removeprefix("t:")}"' if x.startswith("t:") else f'"{x}"' for x in ps)
        out |= {(str(i), r[0]): r[1] for r in c.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,))}
    return out


def found(ix, w, *more):
    return {(r.sid, r.doc_id): r["rank"] for r in lookup.score_searches(ix, w, *more).collect()}


def contents(ix):
    b = ix.blocks().select("term", "seq", F.explode(F.arrays_zip("ids", "lens", "pos")).alias("x")).select("term", "seq", F.col("x.ids").alias("doc_id"), "x.lens", "x.pos")
    return sorted((r.term, r.doc_id, r.lens, tuple(r.pos)) for r in ix.living(b).collect())


@pytest.mark.parametrize("frequent", [1, 8, 1000])            # no word, some, and all words are frequent
def test_lookups_are_sqlites(spark, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(G, "FREQUENT", frequent)
    p = pages(spark, 3, 80)
    ix = G.create(p, f"{tmp_path}/i", slice_docs=5)
    assert (len(ix.frequent()) > 0) == (frequent > 1)
    assert found(ix, wanted(spark, *ASKED)) == pytest.approx(plain_hits(p, ASKED), rel=1e-9)
    monkeypatch.setattr(G, "PUSHED", 2)                         # tables instead of named terms
    assert found(ix, wanted(spark, *ASKED[:5])) == pytest.approx(plain_hits(p, ASKED[:5]), rel=1e-9)


def test_changes_and_merges_equal_a_rebuild(spark, tmp_path):
    p = pages(spark, 5)
    state = {r.id: (r.title, r.content) for r in p.collect()}
    ix = first = G.create(p, f"{tmp_path}/i", slice_docs=5)
    rnd = random.Random(2)
    for step in range(3):
        changes = []
        for seq in range(30):
            i, op = rnd.randrange(80), rnd.choice(["insert", "update", "delete"])
            t, c = text(rnd, 2), text(rnd, rnd.randint(0, 9))
            changes.append((seq, op, i, f"http://h/{i}", t, c))
            state.pop(i, None)
            if op != "delete":
                state[i] = (t, c)
        ix = G.apply_changes(ix, spark.createDataFrame(changes, "seq long, op string, id long, url string, title string, content string"))
        if step == 1:
            ix = G.merge(ix)
            assert len(ix.names("segment")) == 1 and not ix.names("tombs")
    after = store(spark, [(i, f"http://h/{i}", t, c) for i, (t, c) in state.items()])
    fresh = G.create(after, f"{tmp_path}/fresh")
    assert (ix.n_docs, ix.n_tokens) == (fresh.n_docs, fresh.n_tokens) == (len(state), fresh.n_tokens)
    words = {(r.term, r.n_docs, r.n_title_docs) for r in ix.counters().groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_title_docs").alias("n_title_docs")).collect() if r.n_docs}
    assert words == {tuple(r) for r in fresh.counters().collect()}
    assert found(ix, wanted(spark, *ASKED)) == pytest.approx(plain_hits(after, ASKED), rel=1e-9)
    merged = G.merge(ix)
    assert [r for r in contents(merged) if " " not in r[0]] == [r for r in contents(fresh) if " " not in r[0]]
    assert found(merged, wanted(spark, *ASKED)) == pytest.approx(plain_hits(after, ASKED), rel=1e-9)
    # the first version is still there
    assert contents(G.open_index(spark, f"{tmp_path}/i", 1)) == contents(first) and first.n_docs == 60


def test_a_change_writes_in_proportion_to_itself(spark, tmp_path):
    def size(path):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))
    big = store(spark, [(i, f"http://h/{i}", f"t{i}", " ".join(f"w{(i * 7 + j) % 5000}" for j in range(300))) for i in range(600)])
    ix = G.create(big, f"{tmp_path}/i")
    before = size(tmp_path)
    G.apply_changes(ix, spark.createDataFrame([(0, "update", 3, "http://h/3", "new", "text"), (1, "delete", 4, "", "", "")],
                                              "seq long, op string, id long, url string, title string, content string"))
    assert size(tmp_path) - before < before / 10


def test_slices_out_of_reach_are_not_read(spark, tmp_path, monkeypatch):
    rows_ = [(i, f"http://h/{i}", "", "rare " * (1 + (i < 30) * 8) + "filler " * (i % 200 + (i >= 30) * 100) + f"w{i % 3}") for i in range(1200)]
    ix = G.create(store(spark, rows_ + [(10_000 + i, "", "", "other") for i in range(2000)]), f"{tmp_path}/i", slice_docs=16)
    read = []
    plain = lookup._evaluated
    monkeypatch.setattr(lookup, "_evaluated", lambda index, need, blocks, at: read.append(at.count()) or plain(index, need, blocks, at))
    depth = spark.createDataFrame([("0", 20), ("1", 20)], "sid string, depth int")
    best = found(ix, wanted(spark, ["rare"], ["rare", "w1"]), depth)
    stored_blocks = ix.blocks().where("term = 'rare'").count()
    assert sum(read) < stored_blocks                            # two searches, of as many slices each
    every = found(ix, wanted(spark, ["rare"], ["rare", "w1"]))
    for sid in "01":
        first, full = (sorted((r, d) for (s, d), r in hits.items() if s == sid)[:20] for hits in (best, every))
        assert first == full


def test_a_deep_search_does_not_widen_the_others(spark):
    hits = spark.range(40_000).select(F.concat(F.lit("s"), F.col("id") % 4).alias("sid"), F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, 9).otherwise(0).alias("depth_class"))
    out = paging.top_by_depth(hits, "sid", [F.col("doc_id").asc()], [0, 9])
    counts = {r["sid"]: r["count"] for r in out.groupBy("sid").count().collect()}
    assert counts == {"s0": 10_000, "s1": 20, "s2": 20, "s3": 20}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_trigrams_find_urls(spark, tmp_path):
    urls = [f"https://{h}.example.org/{p}" for h in ("src1", "src11", "Blog", "b_x") for p in ("en/a", "EN/b%20", "x'y\\z", "")]
    p = store(spark, [(i, u, "", "") for i, u in enumerate(urls)])
    ix = G.create(p, f"{tmp_path}/i", slice_docs=4)
    asked = ["src1.", "BLOG", "en/", "x'y", "y\\z", "nowhere"]
    low = spark.createDataFrame([(w, w.lower()) for w in asked], "sid string, w string")
    got = lookup.pages_with_all(ix, low.select("sid", G.grams_of(F.col("w")).alias("terms")))
    have = {(r.sid, r.doc_id) for r in got.collect()}
    assert have >= {(w, i) for w in asked for i, u in enumerate(urls) if w.lower() in u.lower()}
    assert {w for w, _ in have} == set(asked[:-1])


def test_an_empty_index(spark, tmp_path):
    ix = G.create(store(spark, [(0, "", "", "")]).where("false"), f"{tmp_path}/i")
    assert (ix.n_docs, ix.avg_tokens) == (0, 0.0) and found(ix, wanted(spark, ["the"], ["a b"])) == {}
