"""Divergence audit, line dedup and token alignment: plain versions, awkward rows, and forced small shards, tiles and parts."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest
from rows import awkward, nothing, small  # noqa: F401

from websift.llm import divergence_audit as audit
from websift.llm import common, line_dedup, ngram_join, parts, token_alignment


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def by_id(rows, d):
    return [r for r in rows if r["doc_id"] == d]


# ------------------------------------------------------------------------------------------ audit

def plain_audit(rows, min_docs=3, ranks=200):
    n, df, of_lang = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text or ""))
        n[lang, source].update(found)
        of_lang[lang].add(source)
        df[lang].update(set(found))
    out = []
    for lang, sources in of_lang.items():
        kept = {t for t, k in df[lang].items() if k >= min_docs}

        def prices(counts, kept=kept):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10 ** 9 * (counts[t] + 1) // total for t in kept}
        p = {s: prices(n[lang, s]) for s in sources}
        q = prices(sum((n[lang, s] for s in sources), collections.Counter()))
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, i + 1) for i, (t, v) in enumerate(items[:most])]
    return sorted(out)


def audited(df, **options):
    return sorted(tuple(r) for r in audit.divergence_audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_against_a_plain_version(small):
    rows = [(r["text"], r["lang"], r["source"]) for r in small.collect()]
    assert audited(small) == plain_audit(rows)


def test_audit_of_many_sources_in_small_tiles_bands_and_fronts(spark, monkeypatch):
    for name, value in (("TILE", 40), ("BAND", 8), ("FRONT", 16), ("HELD", 30)):
        monkeypatch.setattr(audit, name, value)
    rng = random.Random(3)
    rows = [(" ".join(rng.choices([f"W{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)], weights=[1 / (i + 1) for i in range(150)], k=rng.randrange(12))),
             rng.choice(["en", "fr", None]), rng.choice([*(f"s{i}" for i in range(21)), None, "É"])) for _ in range(400)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert audited(df, ranks=4) == plain_audit(rows, ranks=4)


def test_audit_of_awkward_rows(awkward, nothing):
    rows = [(r["text"], r["lang"], r["source"]) for r in awkward.collect()]
    assert audited(awkward) == plain_audit(rows)
    assert audited(awkward.withColumn("source", awkward.text.substr(1, 3)).withColumn("lang", awkward.text.substr(1, 1)), min_docs=2) \
        == plain_audit([(r[0], (r[0] or "")[:1], (r[0] or "")[:3]) for r in rows], min_docs=2)
    assert audited(nothing) == []


def test_audit_without_kept_terms(spark):
    df = spark.createDataFrame([("a b", "x", "s"), ("c", "x", "t"), (None, "y", None)], "text string, lang string, source string")
    assert audited(df) == [("x", "s", "pair", "t", 0, 1), ("x", "t", "pair", "s", 0, 1)]


def test_prices_of_huge_counts_are_exact():
    counts, base = np.array([0, 10 ** 12, 9 * 10 ** 14, 3]), np.array([7 * 10 ** 12, 10 ** 13, 9 * 10 ** 14 + 1, 10])
    assert audit.prices(counts, base).tolist() == [1 + 10 ** 9 * (int(c) + 1) // int(b) for c, b in zip(counts, base)]


def test_tree_holds_its_cells():
    rng = np.random.default_rng(5)
    matrix = rng.integers(1, 9, (13, 70)) * (rng.random((13, 70)) < 0.1)
    r, c = np.nonzero(matrix)
    tree = audit.CountTree(r, c, matrix[r, c], 13, 70)
    back = np.zeros((tree.side, tree.side), int)

    def walk(level, node, row, column):
        if level == len(tree.levels):
            back[row * 4:row * 4 + 4, column * 4:column * 4 + 4] = tree.leaves[node]
            return
        for q in range(4):
            child = int(tree.below(level, np.array([node]), q)[0])
            if child >= 0:
                walk(level + 1, child, row * 2 + q // 2, column * 2 + q % 2)
    walk(0, 0, 0, 0)
    assert (back[:13, :70] == matrix).all() and back.sum() == matrix.sum()
    assert (tree.below(0, np.array([-1]), 0) == -1).all()


# ------------------------------------------------------------------------------------------ lines

def plain_lines(rows, min_docs, min_chars):
    keys = [[low(x.strip(" \t\n\v\f\r")) for x in (t or "").split("\n")] for _, t in rows]
    docs, last = collections.Counter(), {}
    for (d, _), ks in zip(rows, keys):
        for k in {k for k in ks if len(k) >= min_chars}:
            docs[k] += 1
            if k not in last or d is not None and (last[k] is None or d > last[k]):
                last[k] = d
    out = []
    for (d, t), ks in zip(rows, keys):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, ks) if len(k) < min_chars or docs[k] < min_docs or last[k] == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def deduped(df, *options):
    out = line_dedup.dedup_lines(df, *options).collect()
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in out)
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in out), key=repr)


def test_lines_against_a_plain_version(small):
    assert deduped(small) == plain_lines([(r["doc_id"], r["text"]) for r in small.collect()], 5, 40)


def test_lines_in_small_parts_and_shards(spark, monkeypatch):
    monkeypatch.setattr(parts, "PART_BYTES", 200)
    monkeypatch.setattr(parts, "SHARD_KEYS", 8)
    rng = random.Random(7)
    pool = [f"{'  ' * (i % 3)}Line {i} {'é' * (i % 40)}{chr(13) * (i % 2)}" for i in range(60)] + ["", " \t"]
    rows = [(rng.choice([None, *range(90)]), rng.choice([None, "", *["\n".join(rng.choices(pool, weights=[1 / (i + 1) for i in range(62)], k=rng.randrange(1, 25))) for _ in range(9)]]))
            for _ in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert deduped(df, 3, 12) == plain_lines(rows, 3, 12)


def test_lines_of_awkward_rows(awkward, nothing, spark):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    for options in ((5, 40), (2, 1), (3, 5)):
        assert deduped(awkward, *options) == plain_lines(rows, *options)
    assert deduped(nothing) == []
    nobody = spark.createDataFrame([(None, "x" * 50)] * 6, "doc_id long, text string")
    assert {r[2] for r in deduped(nobody)} == {0}


def test_minimal_hash_numbers_each_key_once():
    rng = np.random.default_rng(1)
    keys = np.empty(50_000, line_dedup.KEY)
    keys["hi"], keys["lo"] = rng.integers(0, 1 << 63, (2, 50_000), dtype=np.uint64)
    keys["hi"][:1000] = 5                           # keys that share a half
    keys["lo"][1000:2000] = 5
    keys = np.unique(keys)
    hashed = line_dedup.MinimalHash.over(keys)
    assert sorted(hashed.numbers(keys).tolist()) == list(range(len(keys)))
    assert len(hashed.words) * 64 < 4 * len(keys)
    assert len(line_dedup.MinimalHash.over(keys[:0]).numbers(keys[:3])) == 3


def test_index_knows_foreign_keys(spark):
    docs = spark.createDataFrame([(i, f"line number {i % 40}") for i in range(200)], "doc_id long, text string")
    other = spark.createDataFrame([(1, "line number 3\nline number 99"), (2, "not there")], "doc_id long, text string")
    _, lists = line_dedup.in_parts(docs, 1)
    index = line_dedup.build_index(parts.dealt(lists, 3, line_dedup.KINDS, line_dedup._shard_of))
    _, asked = line_dedup.in_parts(other, 1)
    found = line_dedup.probe(index, parts.dealt(asked, 3, line_dedup.KINDS, line_dedup._shard_of), 5).collect()
    assert [(len(r["keys"]), np.frombuffer(r["lasts"], np.int64).tolist()) for r in found] == [(16, [163])]


# ------------------------------------------------------------------------------------------ tokens

@pytest.fixture(scope="module")
def aligner():
    with open(token_alignment.BYTE_MODEL, encoding="utf-8") as a, open(token_alignment.PIECE_MODEL, "rb") as b:
        return token_alignment.Aligner(a.read(), b.read())


def plain_alignment(aligner, rows):
    docs, counts = [], collections.Counter()
    for d, t in rows:
        a = aligner.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = aligner.b.encode(t) if t else []
        sa, sb = [aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b]
        if not t or b"".join(sa) != (" " + t).encode() or b"".join(sb) != (" " + t).encode():
            docs.append((d, 0, 0, [], ""))
            continue
        links, groups, i, j, at_a, at_b = [], [([a[0]], [b[0]])], 0, 0, len(sa[0]), len(sb[0])
        while True:
            links.append((a[i], b[j]))
            both = at_a == at_b
            if both and i == len(a) - 1:
                break
            on_a, on_b = at_a <= at_b, at_b <= at_a
            if on_a:
                i += 1
                at_a += len(sa[i])
            if on_b:
                j += 1
                at_b += len(sb[j])
            if both:
                groups.append(([a[i]], [b[j]]))
            elif on_a:
                groups[-1][0].append(a[i])
            else:
                groups[-1][1].append(b[j])
        counts.update(links)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        docs.append((d, len(a), len(b), links, text))
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted(((d, na, nb, t.count(";") + 1 if t else 0, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(t.encode()).hexdigest() if t else "") for d, na, nb, links, t in docs), key=repr)


def alignment(df):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in token_alignment.align_tokens(df).select(*columns).collect()), key=repr)


def test_tokens_against_a_plain_version(small, aligner):
    assert alignment(small) == plain_alignment(aligner, [(r["doc_id"], r["text"]) for r in small.collect()])


ODD = ["a", " ", "  lead and  two  ", "x\n y   z　w  v", "don't we'll 'tis <|endoftext|> <s> </s> <unk>", "▁ literal", "a▁b c", "日本語 テスト 🤗🤗 naïve café", "é ö",
       "\u0000 \u0001\x1c \x1cq ᠎ r᠎ s", "tab\t tab \t\ttab\r\n end ", "1234567 89 0.5%  ...!!! ---", "ß" * 200, "ab" * 3000, "ﬁ Ω Ａ", "‎ ‏ x‍y", "  ", "\n", "\n\n x"]


def test_tokens_of_odd_texts_in_small_parts(spark, aligner, monkeypatch):
    monkeypatch.setattr(parts, "PART_BYTES", 100)
    monkeypatch.setattr(parts, "SHARD_KEYS", 16)
    rng = random.Random(11)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (None, None), (5, ""), (1, "a"), (1, "a")]
    rows += [(100 + i, "".join(rng.choices(["a", "B", " ", "  ", "\n", "é", "9", "'s", " the", "▁", " ", "🤗", ".", "-"], weights=[9] * 9 + [1] * 5, k=60))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert alignment(df) == plain_alignment(aligner, rows)


def test_tokens_of_awkward_rows(awkward, nothing, aligner):
    assert alignment(awkward) == plain_alignment(aligner, [(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert alignment(nothing) == []


def test_pointers_find_the_components():
    rng = np.random.default_rng(2)
    for _ in range(200):
        ends = np.arange(1, 40)
        a, b = (np.append(ends[rng.random(39) < share], 40) for share in rng.random(2))
        group_a, group_b, link_a, link_b, n = token_alignment.aligned(a, b)
        common = np.intersect1d(a, b)
        assert n == len(common)
        assert group_a.tolist() == np.searchsorted(common, a).tolist() and group_b.tolist() == np.searchsorted(common, b).tolist()
        starts_a, starts_b = np.append(0, a[:-1]), np.append(0, b[:-1])
        assert list(zip(link_a, link_b)) == [(i, j) for i in range(len(a)) for j in range(len(b)) if starts_a[i] < b[j] and starts_b[j] < a[i]]


def test_forgetting_changes_nothing(small, aligner, monkeypatch):
    texts = [r["text"] for r in small.collect()]
    once = [(s, h) for s, h, *_ in aligner.documents(texts)]
    monkeypatch.setattr(token_alignment, "KEPT_STRETCHES", 0)
    assert [(s, h) for t in texts for s, h, *_ in aligner.documents([t])] == once


# ------------------------------------------------------------------------------------------ near copies

def test_join_is_linear_in_a_group_whatever_its_ids(spark, monkeypatch):
    """Copies of one text, each changed at other places, link with it alone; no step makes their pairs, and no table stays behind."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        changed = dict.fromkeys(rng.sample(range(300), 5 if i else 0))
        rows.append((rng.randrange(1 << 60), " ".join(f"x{i}-{k}" if k in changed else w for k, w in enumerate(base))))
    made, paths, plain = {}, [], common.Scratch.stored

    def stored(self, df, what):
        out = plain(self, df, what)
        made[what] = max(made.get(what, 0), out.count())
        paths.extend(self.paths)
        return out
    monkeypatch.setattr(common.Scratch, "stored", stored)
    out = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert {r["component_id"] for r in out.collect()} == {min(r[0] for r in rows)}
    assert made["join-pairs"] == made["join-links"] == 399 and made["join-trees"] == 0
    assert not any(os.path.exists(p.removeprefix("file:")) for p in paths)
