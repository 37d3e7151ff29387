"""Line dedup by a sharded minimal perfect hash.

A line's key is the line without blanks at its ends, A-Z in lower case. The distinct key hashes of the corpus are dealt to shards. Each
shard numbers its keys by a minimal perfect hash: bit arrays by level, where a key's place is kept if no other key of that level has
it, and the key's number is the rank of its bit. Arrays in that order hold a fingerprint, the number of documents and the largest id
of each key. Parts of the corpus probe the arrays of the shards with their own distinct keys (see ``parts``) and drop their lines by
the answers; lines are never joined.

Keys are equal where 128 bits of their hashes are. A probe of a key that is not in the index finds a wrong number only where 32 bits of
fingerprint agree by chance; the keys of ``dedup_lines`` are all in its index.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from websift.llm import parts
from websift.llm.common import arrow_pass, mix64, scratch_path, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = np.dtype([("hi", "<u8"), ("lo", "<u8")])
NOBODY = -(1 << 63)         # stands for a null id, below all others
ROOM = 1.7                  # places for each key of a level


class MinimalHash:
    """A numbering 0 .. n - 1 of distinct keys, in about three bits each."""

    def __init__(self, words: np.ndarray, sizes: list[int]):
        self.words, self.sizes = words, sizes           # the levels' bits one after another, and their numbers
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return mix64(mix64(keys["hi"] + salt) ^ keys["lo"]) % np.uint64(size)

    @classmethod
    def over(cls, keys: np.ndarray) -> MinimalHash:
        words, sizes = [np.zeros(0, np.uint64)], []
        while len(keys):
            size = -(-int(ROOM * len(keys)) // 64) * 64 + 64
            at = cls.places(keys, len(sizes), size).astype(np.int64)
            taken = np.bincount(at, minlength=size)
            words.append(np.packbits((taken == 1).astype(np.uint8), bitorder="little").view(np.uint64))
            sizes.append(size)
            keys = keys[taken[at] != 1]
        return cls(np.concatenate(words), sizes)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; of a key that was not numbered, any number or -1."""
        out, left, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self.places(keys[left], level, size).astype(np.int64)
            word, bit = self.words[start + (at >> 6)], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[start + (at >> 6)] + below)[hit]
            left = left[~hit]
            start += size >> 6
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys["lo"] ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


def line_keys(text: bytes, least: int) -> list[bytes | None]:
    """For each line its key's hash; None for keys of fewer than ``least`` code points."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip()
        long = len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)
        out.append(xxhash.xxh3_128_digest(key.lower()) if long else None)
    return out


def _shard_of(keys: np.ndarray) -> np.ndarray:
    return mix64(keys["hi"])


LISTS, KINDS = "keys binary, ns binary, lasts binary", [KEY, np.dtype("<i8"), np.dtype("<i8")]
INDEX = "shard long, sizes binary, words binary, prints binary, counts binary, largest binary"


def in_parts(docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The corpus written down in parts, and each part's distinct keys: ``part, keys, ns, lasts`` (hash, documents, largest id)."""
    def cut(batches):
        numbers = parts.part_numbers()
        part, size, held = next(numbers), 0, {}

        def listed():
            keys = np.frombuffer(b"".join(held), KEY)
            ns, lasts = (np.array(v, np.int64) for v in zip(*held.values()))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([part, None, None, keys.tobytes(), ns.tobytes(), lasts.tobytes()],
                                                                              [pa.int64(), pa.int64()] + [pa.binary()] * 4)], names=names)
        names = ["part", "doc_id", "text", "keys", "ns", "lasts"]
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or b"" for t in b.column(1).to_pylist()]
            of_row, start = [], 0
            for i, (d, t) in enumerate(zip(ids, texts)):
                d = NOBODY if d is None else d
                for k in set(line_keys(t, least)):
                    if k is not None:
                        e = held.get(k)
                        if e is None:
                            held[k] = [1, d]
                        else:
                            e[0] += 1
                            e[1] = max(e[1], d)
                of_row.append(part)
                size += len(t)
                if size >= parts.PART_BYTES:
                    yield rows(of_row, ids[start:i + 1], texts[start:i + 1], names)
                    of_row, start = [], i + 1
                    if held:
                        yield listed()
                    part, size, held = next(numbers), 0, {}
            if of_row:
                yield rows(of_row, ids[start:], texts[start:], names)
        if held:
            yield listed()

    def rows(of_row, ids, texts, names):
        none = pa.nulls(len(ids), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(of_row, pa.int64()), pa.array(ids, pa.int64()), pa.array(texts, pa.binary()), none, none, none], names=names)

    # texts and lists share one file; a scan of either reads its own columns alone
    cut_up = arrow_pass(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")), cut, f"part long, doc_id long, text binary, {LISTS}")
    path = scratch_path(docs.sparkSession, "lines-parts")
    cut_up.write.option("compression", "zstd").parquet(path)
    both = docs.sparkSession.read.schema(cut_up.schema).parquet(path)
    return (both.where("text is not null").select("part", "doc_id", "text"), both.where("keys is not null").select("part", "keys", "ns", "lasts"))


def build_index(asked: DataFrame) -> DataFrame:
    """``INDEX``: for each shard its minimal perfect hash and, by number, fingerprints, counts of documents and largest ids.

    ``asked``: ``shard`` and key lists as ``parts.dealt`` gives them. A shard's lists are folded as they come in.
    """
    def build(batches):
        for shard, (keys, ns, lasts) in parts.folded_shards(batches, KINDS, [np.add, np.maximum]):
            hashed = MinimalHash.over(keys)
            at = hashed.numbers(keys)
            prints, counts, largest = np.empty(len(keys), np.uint32), np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
            prints[at], counts[at], largest[at] = fingerprints(keys), ns, lasts
            row = [shard, np.array(hashed.sizes, np.int64).tobytes(), hashed.words.tobytes(), prints.tobytes(), counts.tobytes(), largest.tobytes()]
            yield from parts.in_batches([row], [pa.int64()] + [pa.binary()] * 5, [c.split()[0] for c in INDEX.split(", ")])
    return arrow_pass(asked.select("shard", "keys", "ns", "lasts").repartition("shard").sortWithinPartitions("shard"), build, INDEX)


def probe(index: DataFrame, asked: DataFrame, min_docs: int) -> DataFrame:
    """``part, keys, lasts``: the keys of each part that stand in ``min_docs`` documents or more, and the largest id of each."""
    def look(batches):
        hashed = prints = counts = largest = None            # of the shard at hand
        for b in batches:
            found = []
            for late, part, keys, sizes, words, *arrays in zip(*(b.column(i).to_pylist() for i in range(1, 9))):
                if not late:
                    hashed = MinimalHash(np.frombuffer(words, np.uint64), np.frombuffer(sizes, np.int64).tolist())
                    prints, counts, largest = (np.frombuffer(x, k) for x, k in zip(arrays, (np.uint32, np.int64, np.int64)))
                    continue
                keys = np.frombuffer(keys, KEY)
                at = hashed.numbers(keys)
                known = (at >= 0) & (prints[at] == fingerprints(keys))
                heavy = known & (counts[at] >= min_docs)
                if heavy.any():
                    found.append((part, keys[heavy].tobytes(), largest[at[heavy]].tobytes()))
            yield from parts.in_batches(found, [pa.int64(), pa.binary(), pa.binary()], ["part", "keys", "lasts"])
    columns = ["shard", "late", "part", "keys", "sizes", "words", "prints", "counts", "largest"]
    return arrow_pass(parts.led(index, asked.select("shard", "part", "keys"), "shard").select(*columns), look, "part long, keys binary, lasts binary")


def drop_lines(texts: DataFrame, answers: DataFrame, least: int) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept, kept_sha256`` of every document in ``texts`` (``part, doc_id, text``)."""
    def drop(batches):
        part, heavy = None, {}
        for b in batches:
            ids, ns, dropped, kept = [], [], [], []
            for p, late, d, text, keys, lasts in zip(*(b.column(i).to_pylist() for i in range(6))):
                if p != part:
                    part, heavy = p, {}
                if not late:
                    heavy.update((keys[i * 16:i * 16 + 16], last) for i, last in enumerate(np.frombuffer(lasts, np.int64).tolist()))
                    continue
                lines = text.split(b"\n")
                ids.append(d)
                ns.append(len(lines))
                if heavy:
                    own = NOBODY if d is None else d
                    lines = [x for x, k in zip(lines, line_keys(text, least)) if heavy.get(k, own) == own]
                dropped.append(ns[-1] - len(lines))
                kept.append(b"\n".join(lines))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()),
                                              pa.array([hashlib.sha256(x).hexdigest() for x in kept])], names=["doc_id", "n_lines", "n_dropped", "kept", "kept_sha256"])
    met = parts.led(answers, texts, "part").select("part", "late", "doc_id", "text", "keys", "lasts")
    out = arrow_pass(met, drop, "doc_id long, n_lines long, n_dropped long, kept binary, kept_sha256 string")
    return out.withColumn("kept", F.col("kept").cast("string"))


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept, kept_sha256`` of every row.

    Lines end at ``\\n``. A key of ``min_chars`` code points or more that stands in ``min_docs`` documents or more loses all its lines
    except those in the document with the largest id that holds it. The other lines stay as they are, joined by ``\\n``.

    A null or empty text is one empty line, and stays so. Each row is a document: equal rows count one each, and of several rows with a
    key's largest id all keep their lines. A null id is below all others; where only null ids hold a key, its lines stay. A text of any
    length is one row, read whole. An empty table gives an empty one. Other columns are not looked at.
    """
    texts, lists = in_parts(docs, min_chars, id_col, text_col)
    asked = parts.dealt(lists, parts.shard_count(lists, "keys", 16), KINDS, _shard_of)
    index = stored(build_index(asked), "lines-index")
    return drop_lines(texts, probe(index, asked, min_docs), min_chars)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS n FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
heavy AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
m AS (SELECT k.*, heavy.key IS NULL OR k.doc_id IS NOT DISTINCT FROM last AS stays FROM k LEFT JOIN heavy ON heavy.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (stays), '')) AS kept_sha256
FROM m GROUP BY r"""
