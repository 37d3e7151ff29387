"""Signature trees, the schedule's slots and the classifier's sample against plain versions."""

import collections
import random

import duckdb
import numpy as np
import pytest

from websift.llm import ngram_join, queries, source_mix, weak_labels


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("sizes", [(1, 1), (31, 900), (1024, 1024), (40, 1)])
def test_walk_finds_every_possible_pair(seed, sizes):
    """A dual traversal of two trees yields the pairs that a loop over all sets leaves possible, each once."""
    rng, per100 = np.random.default_rng(seed), 80
    pool = rng.integers(0, 2 ** 60, 400).astype(np.uint64)

    def sets(n):
        made = [np.unique(pool[s:s + k]) for s, k in zip(rng.integers(0, 300, n), rng.integers(3, 60, n))]
        made.sort(key=len)
        return (np.array([len(s) for s in made]), rng.integers(0, 5, n), np.stack([ngram_join._bitmap(s).view(np.uint64) for s in made]), made)
    a, b = sets(sizes[0]), sets(sizes[1])
    for one, two, same in ((a, b, False), (a, a, True)):
        found = [(int(i), int(j)) for x, y in ngram_join._walk(ngram_join._levels(*one[:3]), ngram_join._levels(*two[:3]), same, per100) for i, j in zip(x, y)]
        assert len(set(found)) == len(found)
        wanted = set()
        for i, s in enumerate(one[3]):
            sizes_fit = (per100 * len(s) <= 100 * two[0]) & (per100 * two[0] <= 100 * len(s)) & (one[1][i] != two[1])
            for j in np.flatnonzero(sizes_fit):
                both = len(np.intersect1d(s, two[3][j], assume_unique=True))
                if 100 * both >= per100 * (len(s) + len(two[3][j]) - both) and (not same or i <= j):
                    wanted.add((i, int(j)))
        assert wanted <= set(found)
        for i, j in found:                                   # what is left possible differs in component and fits in size
            assert one[1][i] != two[1][j] and per100 * one[0][i] <= 100 * two[0][j] and per100 * two[0][j] <= 100 * one[0][i]


def test_upper_nodes_hold_what_is_below():
    rng = np.random.default_rng(5)
    n, c, sig = np.sort(rng.integers(5, 99, 777)), rng.integers(0, 9, 777), rng.integers(0, 2 ** 63, (777, 16)).astype(np.uint64)
    levels = ngram_join._levels(n, c, sig)
    assert [len(x["lo"]) for x in levels] == [777, 25, 4, 1]
    root = levels[-1]
    assert (root["lo"][0], root["hi"][0], root["c_lo"][0], root["c_hi"][0]) == (n.min(), n.max(), c.min(), c.max())
    assert (root["or"][0] == np.bitwise_or.reduce(sig)).all() and (root["and"][0] == np.bitwise_and.reduce(sig)).all()


def test_links_do_not_depend_on_ids(spark):
    """One large group of near copies, its rows numbered in order and by chance: the same component, and few pairs to look at."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(600):
        words = list(base)
        for p in rng.sample(range(200), 3):
            words[p] = f"x{i}-{p}"
        texts.append(" ".join(words))
    for ids in (range(600), rng.sample(range(10 ** 6), 600)):
        df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_join(df, width=3, per100=80).collect()}
        sets = {d: {tuple(t.split()[k:k + 3]) for k in range(198)} for d, t in zip(ids, texts)}
        linked = collections.defaultdict(set)
        listed = sorted(sets)
        for x, i in enumerate(listed):
            for j in listed[x + 1:]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    linked[i].add(j), linked[j].add(i)
        wanted = {}
        for d in listed:
            if d not in wanted:
                todo = [d]
                while todo:
                    at = todo.pop()
                    if at not in wanted:
                        wanted[at] = d
                        todo.extend(linked[at])
        assert got == wanted


@pytest.fixture
def few(spark, tmp_path):
    rows = [(None, f"same words {i % 3} " * (i % 40), "en", "one" if i % 3 else "two", 0) for i in range(60)]
    rows += [(i, "many words of some text " * (i * 7 % 120), "en", ("one", "two", None)[i % 3], 0) for i in range(90)]
    rows += [(5, None, "en", "two", 0), (6, "", None, "void", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return tmp_path


def test_slots_match_sql(spark, few):
    """Also with rows that have no id. Equal rows share their results in any order, so rows are compared as a multiset."""
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{few}/documents.parquet/*.parquet')")
    df = queries.op6_source_mix(spark, str(few))
    got = collections.Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect())
    found = con.execute(source_mix.ORACLE)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    rows = [dict(zip(names, r)) for r in found.fetchall()]
    by_id = lambda some: sorted((r["doc_id"], r["size"], r["taken"], r["first_slot"], r["last_slot"]) for r in some if r["doc_id"] is not None and r["taken"])
    assert sum(got.values()) == len(rows) and by_id(df.collect()) == by_id(rows)
    source_words = collections.Counter()
    for r in rows:
        source_words[r["source_size"]] += r["taken"]
    mine = collections.Counter()
    for (_, _, size, _, taken), n in got.items():
        mine[size] += taken * n
    assert mine == source_words


def test_rows_without_an_id_spread(spark):
    """They are dealt and ordered by their text."""
    rows = [(None, f"text number {i} " * 20, "s") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    h = {r["first_slot"] for r in source_mix.mix_sources(df)[0].collect() if r["taken"]}
    assert len(h) > 100


def test_sample_counts_a_text_once(spark, monkeypatch):
    """However many copies a text has, the scorer sees it once, and a shard holds no more than its part."""
    rng = random.Random(1)
    good = ["the house of the man was on the hill, and it is that for which we came by " + str(i) + " of the day." for i in range(40)]
    bad = [" ".join(rng.choices(["|", "###", "BUY", "WIN!!", "$$$"], k=60)) + str(i) for i in range(40)]
    few = good + bad
    many = few + [bad[0]] * 400
    to = lambda texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in weak_labels.weak_label_quality(to(many), train_rows=len(many)).collect()}
    assert all(out[i]["keep"] == (i < 40) for i in range(80))
    assert {out[i]["score"] for i in range(80, 480)} == {out[40]["score"]}
    bound = weak_labels.weak_label_quality(to(many), train_rows=weak_labels.SHARDS)         # one text for each shard
    assert bound.count() == 480


