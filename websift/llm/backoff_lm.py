"""LM scoring: stupid-backoff scores from n-gram counts of the whole corpus.

Words, pairs and triples are exploded from every text, counted in tables partitioned by hash, and the counts are joined back
and summed per document. Rows are packed: a batch of documents lists each of its n-grams once, with its count, as sorted
hashes cut into the tables' buckets; a bucket adds up what all batches sent and answers each with the totals in the
same order. So a frequent n-gram is one entry per batch, never a hot key, and a batch needs only its own n-grams' totals. Hashes
have 56 bits: among 10 ** 10 distinct n-grams one in seven million shares its count with another.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from websift.llm.common import arrow_pass, mix64, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_WORDS = 3_000_000
FREQUENT = 1 << 16          # words of a batch that are numbered by frequency
BUCKET_BYTES = 8 << 20      # of text for each bucket of the tables


def ngrams(h: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the words, pairs and triples that end at each word; pairs start at the second word, triples at the third."""
    yield h
    pair = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(2))
    yield pair
    yield mix64(pair[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[2:] + np.uint64(3))


def _listed(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the documents whose words stand in ``h``, each once as 56 bits, sorted, with their counts."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    two, three = place[1:] >= 1, place[2:] >= 2                 # n-grams do not cross documents
    del place
    ends = np.cumsum([len(h), int(two.sum()), int(three.sum())])
    s = np.empty(ends[2], np.uint64)
    for lo, g, inside in zip((0, *ends), ngrams(h), (slice(None), two, three)):
        g = g[inside]
        s[lo:lo + len(g)] = g
    s >>= np.uint64(8)
    s.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), s[1:] != s[:-1]]))
    return s[first], np.diff(np.append(first, len(s)))


def _pack(v: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte of equal weight. Bytes that are zero in all are left out; of the rest
    only the highest are alike enough to compress."""
    d = np.diff(v, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    used = max([i + 1 for i in range(8) if d[1:, i].any()], default=1)
    return bytes([used]) + v[:1].astype("<u8").tobytes() + d[1:, :used - 1].T.tobytes() + zlib.compress(d[1:, used - 1].tobytes(), 1)


def _unpack(data: bytes, n: int) -> np.ndarray:
    used, plain = data[0], 9 + (data[0] - 1) * (n - 1)
    d = np.zeros((n - 1, 8), np.uint8)
    d[:, :used - 1] = np.frombuffer(data, np.uint8, plain - 9, 9).reshape(used - 1, n - 1).T
    d[:, used - 1] = np.frombuffer(zlib.decompress(data[plain:]), np.uint8)
    return np.cumsum(np.concatenate([np.frombuffer(data, "<u8", 1, 1), d.reshape(-1).view("<u8")]), dtype=np.uint64)


def _pack_counts(v: np.ndarray) -> bytes:
    """Numbers of up to 64 bits, byte by byte of equal weight; highest bytes that are zero in all are left out."""
    d = np.ascontiguousarray(v, "<i8").view(np.uint8).reshape(-1, 8)
    used = max([i + 1 for i in range(8) if d[:, i].any()], default=1)
    return bytes([used]) + zlib.compress(d[:, :used].T.tobytes(), 1)


def _unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, :data[0]] = planes.T
    return d.reshape(-1).view("<i8")


def _pack_words(h: np.ndarray) -> tuple[bytes, bytes]:
    """The distinct words, the more frequent ones first, then the rest in order; and each place's word as a number in that list."""
    words, place, n = np.unique(h, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    order[FREQUENT:].sort()
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    rest = words[order[FREQUENT:]]
    return len(rest).to_bytes(8, "little") + words[order[:FREQUENT]].tobytes() + (_pack(rest) if len(rest) else b""), _pack_counts(rank[place])


def _unpack_words(table: bytes, places: bytes) -> np.ndarray:
    n, place = int.from_bytes(table[:8], "little"), _unpack_counts(places)
    first = min(FREQUENT, (len(table) - 8) // 8) if not n else FREQUENT
    words = np.frombuffer(table, np.uint64, first, 8)
    return np.concatenate([words, _unpack(table[8 + 8 * first:], n)])[place] if n else words[place]


def backoff_scores(docs: DataFrame, min_count: int = 2, alpha: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_triples``, ``n_pairs``, ``n_singles``, ``log_score``, ``score`` of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A word scores ``c(abc) / c(ab)`` if its triple occurs ``min_count`` times or more
    in all texts; else ``alpha * c(bc) / c(b)`` if its pair does; else ``alpha ** 2 * c(c) / N``. Near a text's start it begins with
    the longest n-gram there is, without a penalty. The three counts tell how many words were settled at which length;
    ``log_score`` is the sum of natural logarithms, ``score`` their mean. A text that is null or has no words has 0 and null. Counts
    are over all rows, repeated ones too. Other columns are left out.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches):
        for b in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, texts))]), pa.array([sum(len(t.split()) for t in texts)])], names=["size", "words"])

    size, total = (x or 0 for x in arrow_pass(docs.select("text"), count, "size long, words long").agg(F.sum("size"), F.sum("words")).first())
    bits = max(4, int(size // BUCKET_BYTES).bit_length())

    def explode(batches):
        """Rows of kind 0: a bucket's part of a batch's n-grams; of kind 1: the batch's documents, which follow on by themselves."""
        held, ids, words, n = [], [], 0, 0

        def sent():
            batch = (TaskContext.get().partitionId() << 20) + n
            h, sizes = np.concatenate(held), np.array([len(x) for x in held], np.int64)
            grams, counts = _listed(h, sizes)
            cuts = np.searchsorted(grams >> np.uint64(56 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            rows = [(0, batch, i, _pack(grams[a:b]), _pack_counts(counts[a:b]), None, None) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            rows.append((1, batch, -1 - batch, *_pack_words(h), sizes.tobytes(), ids))
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append(word_hashes(t))
                ids.append(d)
                words += len(held[-1])
                if words >= BATCH_WORDS:
                    yield sent()
                    held, ids, words, n = [], [], 0, n + 1
        if held:
            yield sent()

    names = ["kind", "batch", "bucket", "first", "second", "sizes", "ids"]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    schema = "kind int, batch long, bucket long, first binary, second binary, sizes binary, ids array<long>"

    def add_up(batches):
        """Buckets one after the other: each batch's part is answered with the totals of its n-grams."""
        bucket, rows = None, []

        def answered():
            own = [_unpack_counts(c) for _, _, c in rows]
            parts = [_unpack(g, len(c)) for (_, g, _), c in zip(rows, own)]
            every, counts = np.concatenate(parts), np.concatenate(own)
            order = np.argsort(every, kind="stable")
            s = every[order]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            totals = np.empty(len(every), np.int64)
            totals[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.append(first, len(s))))
            ends = np.cumsum([len(p) for p in parts])[:-1]
            out = [(0, i, bucket, _pack_counts(t), None, None, None) for (i, _, _), t in zip(rows, np.split(totals, ends))]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=names)
        for b in batches:
            own = b.column(0).to_numpy() == 1
            if own.any():
                yield b.filter(pa.array(own))
            b = b.filter(pa.array(~own))
            for i, k, g, c in zip(*(b.column(j).to_pylist() for j in range(1, 5))):
                if k != bucket and rows:
                    yield answered()
                    rows = []
                bucket = k
                rows.append((i, g, c))
        if rows:
            yield answered()

    parts = arrow_pass(docs, explode, schema).repartition("bucket").sortWithinPartitions("bucket")
    met = arrow_pass(parts, add_up, schema).repartition("batch").sortWithinPartitions("batch", "kind", "bucket")

    def score(batches):
        found: list[bytes] = []                              # answers to the batch at hand, by bucket
        for b in batches:
            for kind, first, second, sizes, ids in zip(*(b.column(j).to_pylist() for j in (0, 3, 4, 5, 6))):
                if kind == 0:
                    found.append(first)
                    continue
                h = _unpack_words(first, second)
                sizes = np.frombuffer(sizes, np.int64)
                grams, _ = _listed(h, sizes)
                counts = np.concatenate([np.zeros(0, np.int64), *map(_unpack_counts, found)])
                found = []
                if len(grams) != len(counts):
                    raise ValueError("the answers are not for this batch")
                yield scored(h, sizes, ids, grams, counts)

    def scored(h, sizes, ids, grams, counts):
        n = len(h)
        place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        one, two, three = (counts[np.minimum(np.searchsorted(grams, g >> np.uint64(8)), max(0, len(counts) - 1))].astype(float) if len(g) else np.zeros(0) for g in ngrams(h))
        value, level = np.log(np.maximum(one, 1) / max(total, 1)) + np.minimum(place, 2) * np.log(alpha), np.ones(n, np.int64)
        hit = np.flatnonzero((two >= min_count) & (place[1:] >= 1))
        value[hit + 1] = np.log(two[hit]) - np.log(one[hit]) + np.where(place[hit + 1] >= 2, np.log(alpha), 0.0)
        level[hit + 1] = 2
        hit = np.flatnonzero((three >= min_count) & (place[2:] >= 2))
        value[hit + 2] = np.log(three[hit]) - np.log(two[hit])
        level[hit + 2] = 3
        of = np.repeat(np.arange(len(sizes)), sizes)
        logs = np.bincount(of, value, len(sizes))
        at = [np.bincount(of, level == k, len(sizes)).astype(np.int64) for k in (3, 2, 1)]
        mean = pa.array(logs / np.maximum(sizes, 1), mask=sizes == 0)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), *map(pa.array, at), pa.array(logs), mean],
                                          names=["doc_id", "n_words", "n_triples", "n_pairs", "n_singles", "log_score", "score"])

    return arrow_pass(met, score, "doc_id long, n_words long, n_triples long, n_pairs long, n_singles long, log_score double, score double")
