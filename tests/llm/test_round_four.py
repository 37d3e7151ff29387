"""What the third review's findings asked for, on rows of their own."""

from __future__ import annotations

import numpy as np

from websift.llm import common, gumbel_pieces, ngram_join, run_index


def test_tables_of_pieces_find_each_piece_and_no_other():
    pieces = ["<unk>", "<s>", "</s>", *(f"<0x{b:02X}>" for b in range(256)), *(chr(0x10000 + i) for i in range(70_000)), "ab", "abc"]
    lattices = gumbel_pieces.Lattices(pieces)
    table, ids, _ = lattices.tables[1]
    first, last = table[1:]
    assert not last.all() and len(ids) == 70_000        # some share a slot
    asked = lattices._hash([chr(0x10000 + i) for i in range(71_000)], 1)
    hit, at = lattices._hits(asked, gumbel_pieces._slot(asked), table)
    assert hit.tolist() == list(range(70_000))
    assert [pieces[i] for i in ids[at].tolist()] == [chr(0x10000 + i) for i in range(70_000)]
    assert len(lattices.prefixes[1][0]) == len(lattices.prefixes[2][0]) == 1 and not len(lattices.prefixes[3][0])


def test_decoder_takes_arrays_and_lists():
    pieces = ["<unk>", "<s>", "</s>", *(f"<0x{b:02X}>" for b in range(256)), "▁a", "é"]
    decode = gumbel_pieces.decoder(pieces)
    for ids in ([259, 260, 3 + 0xC3, 3 + 0xA9], [1], [0], []):
        assert decode(np.array(ids, np.int32)) == decode(ids)
    assert decode([259, 260, 3 + 0xC3, 3 + 0xA9]) == "aéé"


def _variants(spark, rng, groups: int, size: int, changed: int):
    """Groups of texts of 300 words, each with ``changed`` of them replaced at other places than in the others."""
    rows = []
    for g in range(groups):
        words = [f"w{g}x{i}" for i in range(300)]
        for k in range(size):
            own = list(words)
            for at in rng.choice(300, changed, replace=False):
                own[at] = f"v{g}x{k}x{at}"
            rows.append((len(rows), " ".join(own)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def _linked(rows, width, per100):
    sets = [set(zip(*(t.split()[i:] for i in range(width)))) for _, t in rows]
    low = list(range(len(rows)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= per100 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return {i: root(i) for i in range(len(rows))}


def test_trees_stand_for_all_shingles_of_a_hub(spark, monkeypatch):
    """Sets just below the threshold that share very many shingles meet in a few trees, not once for each shingle."""
    made, plain = {}, common.Scratch.stored

    def stored(self, df, what):
        out = plain(self, df, what)
        made[what] = out.count() if what == "join-trees" else 0
        return out
    monkeypatch.setattr(common.Scratch, "stored", stored)
    rows, df = _variants(spark, np.random.default_rng(7), 3, 30, 5)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_join(df, 5, 80).collect()}
    assert got == _linked(rows, 5, 80)
    assert 0 < made["join-trees"] < 60, made["join-trees"]


def test_join_meets_all_sets_of_a_frequent_shingle(spark):
    """Shingles with more sets than are paired at once, shared by sets that have no hub in common otherwise."""
    rng, rows = np.random.default_rng(5), []
    for g in range(6):
        base = [f"b{g}x{i}" for i in range(60)]
        for k in range(12):
            own = list(base)
            own[int(rng.integers(60))] = f"c{g}x{k}"
            own[int(rng.integers(60))] = "common"
            rows.append((len(rows), " ".join(["shared long words here"] * 2 + own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for per100 in (60, 80, 90):
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_join(df, 3, per100).collect()}
        assert got == _linked(rows, 3, per100)


def test_index_looks_only_at_what_is_still_equal(monkeypatch):
    """Suffixes that differ early are not sorted again in later rounds, and results are those of all windows compared."""
    rng = np.random.default_rng(3)
    strings = [bytes(rng.integers(97, 123, 150).astype(np.uint8)) for _ in range(60)]
    strings += [s[10:] for s in strings[:5]] + [b"", b"a" * 300, strings[0]]
    sorted_sizes, plain = [], np.argsort

    def counted(a, *args, **kw):
        sorted_sizes.append(len(a))
        return plain(a, *args, **kw)
    monkeypatch.setattr(run_index.np, "argsort", counted)
    places = []
    monkeypatch.setattr(run_index.np, "arange", lambda *a, made=np.arange: places.append(a[-1]) or made(*a))
    index = run_index.RunIndex(b"".join(strings), np.array([len(s) for s in strings]))
    assert places.count(index.n) <= 2 and max(sorted_sizes[1:-1]) < index.n // 4
    monkeypatch.undo()
    got = index.repeated(100)
    seen, want = set(), np.zeros(index.n, bool)
    for start, s in zip(index.starts.tolist(), strings):
        for k in range(len(s) - 99):
            want[start + k] = s[k:k + 100] in seen
            seen.add(s[k:k + 100])
    assert (got == want).all()
