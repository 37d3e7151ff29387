"""Document fingerprints by order MinHash.

The k-mers of a text are numbered by occurrence, so that repeats differ. A hash of (k-mer, number) deals them to bins;
in each bin the two smallest are selected, put back in text order, and hashed as a tuple. Two texts agree on a
bin when they share both k-mers in the same order: the share of equal bins falls with the edit distance, moved
passages included, where plain MinHash would not see the order.

Instead of one hash function per entry, one function deals the k-mers to disjoint bins: a text is hashed and sorted
once, whatever the number of entries.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from websift.llm.common import arrow_pass, mix64, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 8                       # code points of a k-mer
BINS = 64
CUT = 20                    # low bits of a k-mer's hash that make place for its position
_PER_BIN = 40               # expected selected k-mers a bin after the first cut; a bin with fewer than two undoes the cut


def fingerprint(text: str) -> np.ndarray:
    """BINS tuple hashes of 16 bits, 0 where a bin is empty. An empty text has only empty bins."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(codes):
        return np.zeros(BINS, np.uint16)
    k = min(K, len(codes))
    n = len(codes) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[i:i + n]
    h = mix64(h) >> np.uint64(CUT)
    if n <= 1 << CUT:
        s = np.sort((h << np.uint64(CUT)) | np.arange(n, dtype=np.uint64))
        at, s = (s & np.uint64((1 << CUT) - 1)).astype(np.int64), s >> np.uint64(CUT)
    else:
        at = np.argsort(h, kind="stable")
        s = h[at]
    index = np.arange(n)
    first = np.zeros(n, np.int64)
    np.multiply(index[1:], s[1:] != s[:-1], out=first[1:])
    number = index - np.maximum.accumulate(first)
    v = mix64((s << np.uint64(CUT)) + number.astype(np.uint64))
    shift = np.uint64(64 - BINS.bit_length() + 1)
    rest = v & np.uint64((1 << int(shift)) - 1)
    limit = int((1 << int(shift)) * min(1.0, BINS * _PER_BIN / n))
    few = np.flatnonzero(rest < np.uint64(limit)) if limit < 1 << int(shift) else index
    while True:
        few = few[np.argsort(v[few], kind="stable")]
        starts = np.searchsorted(v[few] >> shift, np.arange(BINS + 1, dtype=np.uint64))
        counts = np.diff(starts)
        if len(few) == n or counts.min() >= 2:
            break
        few = index
    out = np.zeros(BINS, np.uint16)
    full = counts > 0
    a = few[starts[:-1][full]]
    b = few[starts[:-1][full] + (counts[full] > 1)]
    swap = at[a] > at[b]
    one, two = np.where(swap, v[b], v[a]), np.where(swap, v[a], v[b])
    t = mix64(one * np.uint64(0xD6E8FEB86659FD93) + two + (counts[full] > 1))
    out[full] = (t % np.uint64(65535)).astype(np.uint16) + 1
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Share of equal bins among those that one of both fills; 1 for two empty texts."""
    filled = (x != 0) | (y != 0)
    return float((x == y)[filled].mean()) if filled.any() else 1.0


def _row(d, text: str, mark: np.ndarray, following: str, next_mark: np.ndarray) -> tuple:
    half = len(text) // 2
    edited = text[:len(text) - half] + following[:half]
    own = fingerprint(edited)
    return (d, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark.astype(">u2").tobytes().hex(),
            own.astype(">u2").tobytes().hex(), likeness(mark, own), likeness(mark, next_mark))


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDGE = "pid long, head string, tail string, tail_id long"


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of the text edited with its neighbour's, and how near both are.

    Rows stand in ascending id (null first; equal ids by text); the neighbour is the next row, after the last the first; a
    sole row is its own. The edited text is the text with its last ``n_chars // 2`` code points replaced by the first
    as many (or all) of the neighbour's. Null texts are empty ones; other columns are left out.

    Texts are shuffled once, into ranges of ids; within a range neighbours meet in order, row by row. Only the last row of
    a range needs the next range's first; those two rows of each range are finished apart.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = (rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h")
             .sortWithinPartitions("doc_id", "h").select("doc_id", "text"))

    def neighbours(batches):
        edge_kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
        head = last = None
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mark = fingerprint(t)
                if last is None:
                    head = t
                else:
                    out.append((*_row(*last, t, mark), None, None, None, None))
                last = (d, t, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), KINDS + edge_kinds)], names=NAMES + EDGES)
        if last is not None:
            pid = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, k) for k in KINDS] + [pa.array([v], k) for v, k in zip((pid, head, last[1], last[0]), edge_kinds)],
                                             names=NAMES + EDGES)

    EDGES = ["pid", "head", "tail", "tail_id"]  # noqa: N806
    path = scratch_path(spark, "fingerprints")
    arrow_pass(dealt, neighbours, f"{SCHEMA}, {EDGE}").write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(f"{SCHEMA}, {EDGE}").parquet(path)
    edges = made.where("pid is not null").select(*EDGES)
    # one narrow row for each range
    w = Window.orderBy("pid")
    order = (edges.select("pid").withColumn("next", F.lead("pid").over(w))
             .withColumn("next", F.coalesce("next", F.min("pid").over(Window.partitionBy()))))
    met = (edges.join(order, "pid").select("tail_id", "tail", "next")
           .join(edges.select(F.col("pid").alias("next"), "head"), "next").select("tail_id", "tail", "head"))

    def finish(batches):
        for b in batches:
            out = [_row(d, t, fingerprint(t), f, fingerprint(f)) for d, t, f in zip(*(b.column(i).to_pylist() for i in range(3)))]
            columns = zip(*out) if out else [[]] * len(KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, KINDS)], names=NAMES)
    return made.where("pid is null").select(*NAMES).union(arrow_pass(met, finish, SCHEMA))
