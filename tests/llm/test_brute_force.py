"""Each operator against a plain version over the smallest table."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import small  # noqa: F401

from websift.llm import backoff_lm, gumbel_pieces, license_scan, ngram_join, order_minhash, queries, repeat_removal, source_mix, surrogates, weak_labels
from websift.llm.run_index import RunIndex

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(small):
    return {r["doc_id"]: r["text"] or "" for r in small.collect()}


def words(t):
    return t.encode().lower().split()


def test_pieces_follow_the_model():
    pieces = gumbel_pieces.load_pieces()
    lattices = gumbel_pieces.Lattices(pieces)
    ids = {p: i for i, p in enumerate(pieces) if i >= 259}
    mass = sum(1 / (r + 3) for r in range(len(pieces) - 3))

    def ways(word):
        if not word:
            return [((), 1.0)]
        return [((ids[word[:j]], *rest), p / ((ids[word[:j]] - 259 + 3) * mass)) for j in range(1, len(word) + 1) if word[:j] in ids for rest, p in ways(word[j:])]
    cut = gumbel_pieces.words_of("the cat", lattices.cut)
    lattices.add(cut)
    every = {a + b: p * q for a, p in ways(cut[0]) for b, q in ways(cut[1])}
    total = sum(every.values())
    every = {s: p / total for s, p in every.items()}
    n, firsts, seconds, unbiased = 4000, collections.Counter(), collections.Counter(), 0.0
    for i in range(n):
        found = lattices.top([lattices.starts(cut)], [i * 7919 + 1], 3)[0]
        got = [tuple(lattices.ids(e).tolist()) for e, *_ in found]
        assert len(set(got)) == 3                                              # without replacement
        assert all(abs(math.log(every[g]) - f[1]) < 1e-9 for g, f in zip(got, found))
        assert found[0][2] >= found[1][2] >= found[2][2]
        firsts[got[0]] += 1
        seconds[got[1]] += 1
        unbiased += sum(math.exp(f[1] - f[3]) for f in found)
    best = sorted(every, key=every.get)[::-1][:4]
    for s in best:
        assert abs(firsts[s] / n - every[s]) < 0.03
        assert abs(seconds[s] / n - sum(every[o] * every[s] / (1 - every[o]) for o in every if o != s)) < 0.03
    assert abs(unbiased / n - 1) < 0.02                                        # weights p / inclusion sum to one on average


def test_all_segmentations_come_out_once():
    lattices = gumbel_pieces.Lattices(gumbel_pieces.load_pieces())
    cut = gumbel_pieces.words_of("it is", lattices.cut)
    lattices.add(cut)
    found = lattices.top([lattices.starts(cut)], [5], 1000)[0]
    assert len({tuple(e.tolist()) for e, *_ in found}) == len(found) < 1000
    assert abs(sum(math.exp(log) for _, log, *_ in found) - 1) < 1e-9 and all(f[3] == 0 for f in found)


def test_pieces_decode_to_the_texts(small, texts):
    rows = gumbel_pieces.decode_pieces(gumbel_pieces.sample_pieces(small, k=2)).collect()
    assert all(r["round_trip"] and r["text"] == texts[r["doc_id"]] for r in rows)
    assert len({(r["doc_id"], tuple(r["ids"])) for r in rows}) == len(rows)


@pytest.mark.parametrize("seed", range(10))
def test_run_index(seed):
    rng = np.random.default_rng(seed)
    strings = [rng.choice([0, 97, 98, 255], rng.integers(0, 60)).astype(np.uint8).tobytes() for _ in range(10)]
    strings += [s[:20] + b"x" + s[21:] for s in strings]
    for length in (3, 10):
        seen, expected = set(), []
        for s in strings:
            for i in range(len(s) + 1):
                w = s[i:i + length]
                expected.append(len(w) == length and w in seen)
                if len(w) == length:
                    seen.add(w)
        assert RunIndex(b"".join(strings), [len(s) for s in strings]).repeated(length).tolist() == expected


@pytest.mark.parametrize("varied", [None, 2])
def test_repeats(small, texts, varied, monkeypatch):
    if varied:                                  # anchors dealt by windows, small indexes, several rounds in a task
        monkeypatch.setattr(repeat_removal, "VARIED", varied)
        monkeypatch.setattr(repeat_removal, "INDEXED", 50_000)
        monkeypatch.setattr(repeat_removal, "HELD", 2_000)
    rows = {r["doc_id"]: r for r in repeat_removal.remove_repeats(small).collect()}
    seen = set()
    for d in sorted(texts):
        data = texts[d].encode()
        gone, end = bytearray(len(data)), 0
        for p in range(len(data) - 99):
            w = data[p:p + 100]
            if w in seen:
                gone[max(p, end):p + 100] = b"\1" * (p + 100 - max(p, end))
                end = p + 100
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        r = rows[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def brute_components(texts, width, per100):
    sets = {}
    for d, t in texts.items():
        w = words(t)
        n = min(width, len(w))
        sets[d] = frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else frozenset()
    up = {d: d for d in texts}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d
    ids = sorted(d for d in texts if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if 100 * both >= per100 * (len(x) + len(y) - both):
                u, v = sorted((top(a), top(b)))
                up[v] = u
    return {d: (len(sets[d]), top(d)) for d in texts}


def test_join(spark):
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(0, 300, n)] for n in (5, 40, 40, 120, 200, 200)]
    texts = {}
    for i in range(300):
        w = list(base[i % len(base)])
        for _ in range(rng.integers(0, 6)):
            w[rng.integers(0, len(w))] = f"w{rng.integers(0, 300)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for width, per100 in ((3, 90), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(df, width, per100).collect()}
        assert got == brute_components(texts, width, per100)


def test_join_of_the_table(small, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(small, 3, 90).collect()}
    assert got == brute_components(texts, 3, 90)


def plain_blocks(w, templates, per100=85):
    """(start, template): containment, of every block that meets the template, start by start."""
    out = {}
    for k, (_, t) in enumerate(templates):
        t = license_scan.words(t)
        s, width = set(t), max(40, 2 * len(t))
        if len(s & set(w)) * 100 < per100 * len(s):
            continue
        for g in range(len(w)):
            n = len(s & set(w[g:g + width]))
            if 100 * n >= per100 * len(s):
                out[g, k] = n / len(s)
    return out


def check_runs(runs, blocks):
    got = [(g, r["template"]) for r in runs for g in range(r["first_start"], r["last_start"] + 1)]
    assert sorted(got) == sorted(blocks)
    for r in runs:
        assert r["containment"] == max(blocks[g, r["template"]] for g in range(r["first_start"], r["last_start"] + 1))
        assert (r["first_start"] - 1, r["template"]) not in blocks and (r["last_start"] + 1, r["template"]) not in blocks


def test_license_blocks_at_every_start(spark):
    long = " ".join(f"t{i}" for i in range(60))
    short = " ".join(f"s{i}" for i in range(20))
    templates = [("long", long), ("short", short), ("again", "a b a c")]
    rnd = random.Random(4)
    spread = " ".join(x for i in range(20) for x in (f"s{i}", "x"))         # 20 words over 39
    texts = [long, " ".join(reversed(long.split())), *(" ".join(["y"] * o + [spread] + ["y"] * (16 - o)) for o in range(16)), "", "a b c",
             *(" ".join(rnd.choice([f"s{rnd.randrange(20)}", f"t{rnd.randrange(60)}", "a", "b", "c", "z"]) for _ in range(rnd.choice([30, 200, 900])))
               for _ in range(30))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license_scan.license_scan(df, templates, per100=60).collect()}
    for d, t in enumerate(texts):
        check_runs(rows[d]["blocks"], plain_blocks(license_scan.words(t), templates, 60))
    whole = {r["doc_id"]: r["labels"] for r in license_scan.license_scan(df, templates).collect()}
    assert [whole[d] for d in range(18)] == ["long", "long"] + ["short"] * 16


def test_a_text_of_very_many_license_phrases(spark):
    n = 100_000
    df = spark.createDataFrame([(0, "mit license " * n)], "doc_id long, text string")
    r = license_scan.license_scan(df).first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"]) == (2 * n, n, 0, 2 * n - 2, "mit")


def test_vectors_of_any_size(spark):
    from websift.llm import block_search
    rnd = random.Random(8)
    sizes = [1e200, 1e308, 1.0, 1e-170, 5e-324, 1e154]
    rows = [(i, [rnd.choice(sizes) * rnd.uniform(0.1, 1) * rnd.choice([-1, 1]) for _ in range(3)] if i % 3 else [rnd.choice(sizes)] * 3) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    rows = [(i, v) for i, v in rows if any(v)]
    got = [tuple(r) for r in block_search.nearest(df, F.col("vec_id") % 10 == 0, 7).orderBy("query_id", "rank").collect()]
    want = []
    for q, v in rows:
        if q % 10 == 0:
            near = sorted((math.sqrt(sum((x - y) * (x - y) for x, y in zip(c, v))), i) for i, c in rows if i != q)[:7]
            want += [(q, n + 1, i, s) for n, (s, i) in enumerate(near)]
    assert got == want


def test_heaps_handed_on_early_merge(spark, monkeypatch):
    from websift.llm import block_search
    rnd = random.Random(9)
    df = spark.createDataFrame([(i, [rnd.random() for _ in range(4)]) for i in range(300)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, block_search.nearest(df, F.col("vec_id") % 10 == 0, 5).collect()))
    monkeypatch.setattr(block_search, "HEAPS", 3)
    assert sorted(map(tuple, block_search.nearest(df, F.col("vec_id") % 10 == 0, 5).collect())) == want


def test_licenses(spark, small, texts):
    lines = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation files",
             "free software you can copy", "THIS WORK IS LICENSED under a Creative Commons Attribution 4.0 license"]
    texts = {**texts, **{10_000 + i: "lead " * 37 + t + " tail" * 20 for i, t in enumerate(lines)}}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license_scan.license_scan(df).collect()}
    for d, t in texts.items():
        w = license_scan.words(t)
        assert w == [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x] or [x.decode() for x in w] == [
            x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x]
        places, base = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = [x.encode() for x in phrase.split()]
            at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
            places += at
            base |= {label} if at else set()
        blocks = plain_blocks(w, license_scan.TEMPLATES)
        r = rows[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)))
        check_runs(r["blocks"], blocks)
        assert r["labels"] == ",".join(sorted(base | {license_scan.TEMPLATES[k][0] for _, k in blocks}))
        assert r["score"] == (1.0 if places else max(blocks.values(), default=0.0))
    assert rows[10_000]["labels"] == "mit" and rows[10_001]["labels"] == "" and rows[10_002]["labels"] == "cc-by"


def plain_fingerprint(text):
    codes = [ord(c) for c in text]
    if not codes:
        return [0] * order_minhash.BINS
    m64 = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m64
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m64
        return x ^ x >> 31
    k = min(order_minhash.K, len(codes))
    times, bins = collections.Counter(), collections.defaultdict(list)
    for i in range(len(codes) - k + 1):
        h = 0
        for c in codes[i:i + k]:
            h = (h * 0x9E3779B97F4A7C15 + c) & m64
        h = mix(h) >> order_minhash.CUT
        v = mix((h << order_minhash.CUT) + times[h])
        times[h] += 1
        bins[v >> 58].append((v, i))
    out = [0] * order_minhash.BINS
    for b, got in bins.items():
        two = sorted(sorted(got)[:2], key=lambda x: x[1])
        out[b] = mix((two[0][0] * 0xD6E8FEB86659FD93 + two[-1][0] + (len(two) > 1)) & m64) % 65535 + 1
    return out


def test_fingerprints(small, texts):
    rows = {r["doc_id"]: r for r in order_minhash.neighbour_fingerprints(small).collect()}
    ids = sorted(texts)
    for d, after in zip(ids, ids[1:] + ids[:1]):
        t, n = texts[d], texts[after]
        half = len(t) // 2
        edited = t[:len(t) - half] + n[:half]
        marks = [plain_fingerprint(x) for x in (t, edited, n)] if len(t) < 1500 and len(n) < 1500 else [order_minhash.fingerprint(x).tolist() for x in (t, edited, n)]
        near = [order_minhash.likeness(np.array(marks[0]), np.array(m)) for m in marks[1:]]
        r = rows[d]
        assert (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), *near)
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple("".join(f"{x:04x}" for x in m) for m in marks[:2])


def test_fingerprints_see_order():
    a, b = ("".join(chr(97 + x) for x in np.random.default_rng(s).integers(0, 26, 2000)) for s in (1, 2))
    near = lambda x, y: order_minhash.likeness(order_minhash.fingerprint(x), order_minhash.fingerprint(y))
    assert near(a, a) == 1 and near(a, a[:1000] + "x" + a[1001:]) > 0.8
    assert near(a, a[1000:] + a[:1000]) < 0.75              # the same k-mers in another order
    assert near(a, b) < 0.05


def test_mix_takes_slots_in_step(small):
    taken, pieces = source_mix.mix_sources(small)
    rows, slots = taken.collect(), sorted((p["slot"], p["source"], p["words"]) for p in pieces.collect())
    assert sum(w for *_, w in slots) == sum(r["taken"] for r in rows)
    targets = {r["source"]: r["target"] for r in rows}
    whole = sum(w for *_, w in slots)
    half = collections.Counter()
    for s, source, w in slots:
        if s < slots[-1][0] // 2:
            half[source] += w
    for s, t in targets.items():                            # any half of the schedule is mixed like the whole
        assert abs(half[s] - t / 2) < 0.05 * whole / len(targets) + 6 * source_mix.BLOCK_WORDS
    by = collections.Counter()
    for r in rows:
        by[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    assert all(by[s] == math.floor(t) for s, t in targets.items())


def test_surrogates_are_distinct_and_consistent(spark, small, texts):
    rows = surrogates.replace_entities(small, "k").collect()
    find = re.compile(r"[\w.]+@[\w.]+\w|AKIA\w{16}|[0-9a-f]{40}|\d{16}|\d+\.\d+\.\d+\.\d+|\(\d{3}\) 555-\d{4}")
    old = {m.group() for t in texts.values() for m in find.finditer(t)}
    assert old and not any(o in r["text"] for r in rows for o in old)
    assert all(r["text"] == texts[r["doc_id"]] for r in rows if not r["n_entities"])
    many = spark.createDataFrame([(i, f"Mr. Person{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} x@y{i}.org 10.0.{i // 250}.{i % 250}") for i in range(3000)], "doc_id long, text string")
    parts = [tuple(r["text"].split(" ")) for r in surrogates.replace_entities(many, "k").collect()]
    for i in (1, 2, 3):
        assert len({p[i] for p in parts}) == 3000            # more names than given ones, and none twice
    again = {r["text"] for r in surrogates.replace_entities(many, "k").collect()}
    assert again == {" ".join(p) for p in parts}
    assert again.isdisjoint(r["text"] for r in surrogates.replace_entities(many, key="other").collect())


@pytest.mark.parametrize("n", [65, 150, 1000])
def test_long_secrets_are_replaced_whole(spark, n):
    rng = np.random.default_rng(n)
    mixed = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), n))
    late = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n - 1)) + "7"      # its only digit is the last character
    digits = "".join(rng.choice(list("0123456789abcdef"), n))
    df = spark.createDataFrame([(1, f"a token={mixed} b"), (2, f"password: {late}"), (3, f"see {digits}, end"), (4, f"token={'a1' * (n // 2)}")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in surrogates.replace_entities(df, "k").collect()}
    assert all(r["n_entities"] == 1 for r in rows.values())
    for d, (before, old, after) in enumerate((("a token=", mixed, " b"), ("password: ", late, ""), ("see ", digits, ", end")), 1):
        t = rows[d]["text"]
        assert t.startswith(before) and t.endswith(after) and len(t) == len(before) + n + len(after)
        new = t[len(before):len(before) + n]
        assert not any(old[i:i + 8] in new for i in range(n - 7)) and sum(x == y for x, y in zip(old, new)) < 0.35 * n
    new = rows[4]["text"][6:]
    assert n < 150 or new[:60] not in new[60:]             # the stream does not come round again


def test_names_of_many_parts_are_replaced_whole(spark):
    texts = ["Mr. John Quincy Adams left.", "Mrs Anna Maria Luisa Medici, too", "Mr. John Q. Adams left.", "Mr. John Roe Mrs. Jane Mary Doe", "Ms Amy Ng."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [r for r in sorted(surrogates.replace_entities(df, "k").collect())]
    assert [r["n_entities"] for r in rows] == [1, 1, 1, 2, 1]
    shapes = [r"Mr\. X X X left\.", "Mrs X X X X, too", r"Mr\. X X\. X left\.", r"Mr\. X X Mrs\. X X X", r"Ms X X\."]
    for r, t, shape in zip(rows, texts, shapes):
        assert re.fullmatch(shape.replace("X", "[A-Z][A-Za-z-]*"), r["text"]), r["text"]
        assert not set(re.findall(r"[A-Z]\w{2,}", t)) - {"Mrs"} & set(re.findall(r"\w+", r["text"]))


def test_surrogate_cards_pass_their_check(spark):
    df = spark.createDataFrame([(i, f"card {4000000000000000 + i * 7919}") for i in range(50)], "doc_id long, text string")
    for r in surrogates.replace_entities(df, "k").collect():
        digits = [int(c) for c in r["text"][5:]]
        assert sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0 and digits[0] == 4


def test_accounts_are_replaced_whole_and_checked(spark):
    texts = ["DE89 3704 0044 0532 0130 00", "to DE89370400440532013000.", "GB29 NWBK 6016 1331 9268 19, GB", "1234 5678 9012 3456 7890 1234", "AB12 IS FINE"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in surrogates.replace_entities(df, "k").collect()}
    assert [got[i]["n_entities"] for i in range(5)] == [1, 1, 1, 1, 0]
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", got[0]["text"]) and got[1]["text"] == f"to {got[0]['text'].replace(' ', '')}."
    assert re.fullmatch(r"GB\d\d [A-Z]{4}( \d{4}){3} \d\d, GB", got[2]["text"]) and re.fullmatch(r"\d{4}( \d{4}){5}", got[3]["text"])
    for i, cut in ((0, None), (2, -4)):
        x = got[i]["text"][:cut].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
        assert not set(texts[i].split(",")[0].split()[1:]) & set(got[i]["text"].split())


def test_the_key_is_needed_and_not_in_the_plan(spark):
    e = spark.createDataFrame([("email", "a@b.org", "m", "latin", 0)], "kind string, canon string, gender string, script string, attempt int")
    assert "very-secret" not in surrogates._drawn(e, "very-secret")._jdf.queryExecution().toString()
    for bad in ("", None):
        with pytest.raises(ValueError):
            surrogates._drawn(e, bad)


def test_counts_of_64_bits():
    for v in ([], [0], [1, 255, 256], [2 ** 32 - 1, 2 ** 32, 2 ** 40 + 7, 3], [2 ** 62]):
        assert backoff_lm._unpack_counts(backoff_lm._pack_counts(np.array(v, np.int64))).tolist() == v


@pytest.mark.parametrize("batch", [2_000, 10_000_000])
def test_backoff(small, texts, batch, monkeypatch):
    monkeypatch.setattr(backoff_lm, "BATCH_WORDS", batch)
    rows = {r["doc_id"]: r for r in backoff_lm.backoff_scores(small.repartition(3)).collect()}
    counts = collections.Counter()
    for t in texts.values():
        w = words(t)
        for n in (1, 2, 3):
            counts.update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    total = sum(len(words(t)) for t in texts.values())
    for d, t in texts.items():
        w, s, levels = words(t), 0.0, [0, 0, 0]
        for i in range(len(w)):
            three, two, one = tuple(w[i - 2:i + 1]), tuple(w[i - 1:i + 1]), (w[i],)
            if i >= 2 and counts[three] >= 2:
                s, k = s + math.log(counts[three] / counts[three[:2]]), 0
            elif i >= 1 and counts[two] >= 2:
                s, k = s + math.log(counts[two] / counts[two[:1]]) + (math.log(0.4) if i >= 2 else 0), 1
            else:
                s, k = s + math.log(counts[one] / total) + min(i, 2) * math.log(0.4), 2
            levels[k] += 1
        r = rows[d]
        assert (r["n_words"], r["n_triples"], r["n_pairs"], r["n_singles"]) == (len(w), *levels) and math.isclose(r["log_score"], s, rel_tol=1e-9, abs_tol=1e-9)


def test_quality_on_held_out_labels(spark):
    """No label is seen in fitting, so all are held out."""
    sf = "/root/testdata/sf0.01"
    got = weak_labels.weak_label_quality(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r["keep"] == (r["quality"] == 1) for r in rows) >= 0.97 * len(rows)
    assert sum(r["keep"] for r in rows if r["quality"] == 1) >= 0.98 * sum(r["quality"] for r in rows)


def test_every_operator_has_its_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
