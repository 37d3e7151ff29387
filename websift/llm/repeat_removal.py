"""Suffix-array dedup: bytes under long repeated strings are removed, with run-length indexes.

A window is ``length`` bytes in a row. Windows with equal bytes have the same smallest k-mer at the same place, so windows are
dealt by that k-mer, their anchor: whatever repeats meets in one group. An anchor owns a run of neighbouring windows; their
bytes are its snippet. Equal snippets of a group need no index: all but the first are repeats. What differs inside a group goes,
once for each distinct snippet, into a run-compressed index of the group's part, and its matching statistics mark the windows
that also start earlier.

An anchor with very many distinct snippets (a frequent passage in ever new surroundings) is not gathered: its windows are
dealt one by one, by their own bytes.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from websift.llm.common import arrow_pass, heaviest, mix64, stored
from websift.llm.run_index import RunIndex

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 16                      # bytes of an anchor
PIECE = 1 << 20             # bytes of a text looked at together; pieces overlap by length - 1
HELD = 400_000              # anchors compared inside a task before they are sent on
INDEXED = 2 << 20           # bytes of snippets in one index
VARIED, LISTED = 1_000, 1 << 16     # from so many snippets an anchor is dealt by windows; so many anchors at most are told to all tasks
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and powers of the base and of its inverse, for hashes of substrings modulo 2 ** 64."""
    if len(_POWERS.get("up", ())) < n + 1:
        m = max(n + 1, 1 << 17)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, b in (("up", _BASE), ("down", inverse)):
            v = np.full(m, b, np.uint64)
            v[0] = 1
            _POWERS[name] = np.multiply.accumulate(v)
        _POWERS["bytes"] = mix64(np.arange(1, 257, dtype=np.uint64))
    return _POWERS["bytes"], _POWERS["up"], _POWERS["down"]


class _Hashed:
    """Hashes of any substring of some bytes."""

    def __init__(self, data: np.ndarray):
        value, up, self.down = _powers(len(data))
        self.h = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value[data] * up[:len(data)], out=self.h[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.h[end] - self.h[start]) * self.down[start] + (end - start).astype(np.uint64))


def anchors(data: np.ndarray, length: int):
    """``(anchor hash, anchor place, first window, last window, snippet hash, hashes)`` of all windows of some bytes."""
    n = len(data) - length + 1
    if n <= 0:
        return None
    hashed = _Hashed(data)
    at = np.arange(len(data) - K + 1)
    h = hashed.of(at, at + K)
    m = (h >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)      # the smallest, leftmost
    span, width = 1, length - K + 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[:n], m[width - span:width - span + n])
    place = (m[:n] & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], n) - 1
    q = place[first]
    # the snippet's hash knows where the anchor is in it
    s = mix64(hashed.of(first, last + length) ^ (q - first).astype(np.uint64))
    return h[q], q, first, last, s, hashed


def _pieces(text: str | None, length: int):
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    for o in range(0, max(1, len(data) - length + 1), PIECE):
        yield o, data[o:o + PIECE + length - 1]


def _tag(text: str | None) -> int:
    """Tells the rows of one id apart: 16 bits of the text's hash."""
    return int.from_bytes(hashlib.blake2b((text or "").encode("utf-8", "replace"), digest_size=2).digest(), "big")


def _varied(docs: DataFrame, length: int) -> np.ndarray:
    """Hashes of the anchors with very many distinct snippets, LISTED at most. What is not listed is still found, in its group."""
    def count(batches):
        got: list[np.ndarray] = []

        def distinct(parts):
            rows = np.concatenate(parts)                        # a snippet's hash stands for one anchor, too
            return rows[np.unique(rows[:, 1], return_index=True)[1]]
        for b in batches:
            for t in b.column(0).to_pylist():
                for _, data in _pieces(t, length):
                    found = anchors(data, length)
                    if found:
                        got.append(np.stack([found[0], found[4]], axis=1))
            if sum(map(len, got)) > 2_000_000:
                got = [distinct(got)]
        if got:
            a, n = np.unique(distinct(got)[:, 0], return_counts=True)
            a, n = a[n >= 8], n[n >= 8]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n)], names=["a", "n"])
    counted = arrow_pass(docs.select("text"), count, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    return np.sort(heaviest(counted.where(F.col("n") >= VARIED), "a", "n", LISTED, "repeats-varied"))


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``spans`` (start and end of each removed run) of every row.

    Removed is each byte under a string of ``length`` bytes that also starts earlier: in a document with a smaller id, or earlier
    in the same one. Strings are judged on the input. Texts are UTF-8 bytes, null an empty one; no string crosses documents. Rows with
    one id and the same text are one document with one result each, and hide nothing of each other; with different texts they count
    as one document whose starts are compared, equal starts in order of the texts' hashes. Rows with a null id are returned whole and hide nothing. Other columns are left out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    varied = spark.sparkContext.broadcast(_varied(docs, length))        # LISTED numbers at most

    def deal(batches):
        """Anchors by group. Inside a task only the first of equal snippets is sent to its group; runs of the others are told as repeats."""
        rows: list[tuple] = []

        def sent():
            d, tag, a, s, lo, hi = (np.concatenate(c) for c in zip(*rows))
            rows.clear()
            order = np.argsort(s)
            tied = s[order[1:]] == s[order[:-1]]
            tied = np.flatnonzero(np.append(tied, False) | np.append(False, tied))
            own = order[tied]                                   # most snippets stand here once; the others' rows are put in order
            order[tied] = own[np.lexsort((tag[own], lo[own], d[own], a[own], s[own]))]
            d, tag, a, s, lo, hi = (v[order] for v in (d, tag, a, s, lo, hi))
            keep = np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])])
            of = np.flatnonzero(keep)[np.cumsum(keep) - 1]
            # an equal row brings the first occurrence itself again, which is no repeat
            again = ~keep & ((d != d[of]) | (tag != tag[of]) | (lo != lo[of]))
            # neighbouring repeated snippets of one text are one run of windows
            rd, rt, rl, rh = d[again], tag[again], lo[again], hi[again]
            if len(rd):
                order = np.lexsort((rl, rt, rd))
                rd, rt, rl, rh = rd[order], rt[order], rl[order], rh[order]
                new = np.concatenate([[True], (rd[1:] != rd[:-1]) | (rt[1:] != rt[:-1]) | (rl[1:] > rh[:-1] + 1)])
                at = np.flatnonzero(new)
                rd, rt, rl, rh = rd[at], rt[at], rl[at], np.maximum.reduceat(rh, at)
            spread = mix64(rd.view(np.uint64) + rl.view(np.uint64)).view(np.int64)
            zero = np.zeros(len(rd), np.int64)
            for flag, cols in ((True, (spread, zero, rd, rt, rl, rh)), (False, (a[keep].view(np.int64), s[keep].view(np.int64), d[keep], tag[keep], lo[keep], hi[keep]))):
                for i in range(0, len(cols[0]), 50_000):
                    c = [v[i:i + 50_000] for v in cols]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c[0]), flag)), *map(pa.array, c[:3]), pa.array(c[3].astype(np.int32)), pa.array(c[4]), pa.array((c[5] - c[4]).astype(np.int32))],
                                                     names=["told", "a", "s", "doc_id", "tag", "lo", "more"])
        held = 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for o, data in _pieces(t, length):
                    found = anchors(data, length) if d is not None else None
                    if not found:
                        continue
                    a, _, lo, hi, s, hashed = found
                    many = np.isin(a, varied.value, kind="sort") if len(varied.value) else np.zeros(len(a), bool)
                    if many.any():
                        one = np.concatenate([np.arange(x, y + 1) for x, y in zip(lo[many], hi[many])])
                        w = hashed.of(one, one + length)
                        a = np.concatenate([a[~many], mix64(w ^ np.uint64(1))])
                        s, lo, hi = np.concatenate([s[~many], w]), np.concatenate([lo[~many], one]), np.concatenate([hi[~many], one])
                    rows.append((np.full(len(a), d), np.full(len(a), _tag(t)), a, s, lo + o, hi + o))
                    held += len(a)
            if held > HELD:
                yield from sent()
                held = 0
        if rows:
            yield from sent()

    def group(batches):
        """Rows in order of (group, snippet, place): later ones of a snippet are repeats; first ones are passed on where their group has another."""
        last = None                                             # (a, s) of the last row
        lead_of: tuple | None = None                            # (doc_id, tag, lo) of the last row's snippet where it stands first
        first: tuple | None = None                              # the group's only snippet so far
        for b in batches:
            told, a, s, d, tag, lo, more = (b.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            if not len(a):
                continue
            same_a = np.concatenate([[last is not None and last[0] == a[0]], a[1:] == a[:-1]])
            same_s = same_a & np.concatenate([[last is not None and last[1] == s[0]], s[1:] == s[:-1]])
            lead = ~(told | same_s)                             # first of its snippet
            of = np.maximum.accumulate(np.where(same_s, -1, np.arange(len(a))))
            fd, ft, fl = (np.where(of < 0, v[0] if lead_of is None else x, v[of]) for v, x in zip((d, tag, lo), lead_of or (0, 0, 0)))
            again = told | same_s & ((d != fd) | (tag != ft) | (lo != fl))      # an equal row's first occurrence is no repeat
            lead_of = (fd[-1], ft[-1], fl[-1])
            follows = lead & same_a                             # of a group that has an earlier snippet
            idx = np.flatnonzero(lead)
            paired = np.zeros(len(a), bool)
            paired[idx[1:]] = a[idx[1:]] == a[idx[:-1]]
            paired[idx[:-1]] |= a[idx[1:]] == a[idx[:-1]]
            extra = []
            if len(idx) and follows[idx[0]] and first is not None and first[1] == a[idx[0]]:
                paired[idx[0]] = True
                if not first[-1]:
                    extra.append(first[:-1])
            keep = again | paired
            out = [v[keep] for v in (again, a, d, tag, lo, more)]
            if extra:
                out = [np.concatenate([v, np.array([x], v.dtype)]) for v, x in zip(out, extra[0])]
            if len(idx):
                i = idx[-1]
                first = (False, a[i], d[i], tag[i], lo[i], more[i], bool(paired[i]))
            last = (a[-1], s[-1])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], names=["again", "a", "doc_id", "tag", "lo", "more"])

    met = (arrow_pass(docs, deal, "told boolean, a long, s long, doc_id long, tag int, lo long, more int")
           .repartition("a").sortWithinPartitions("a", "s", "doc_id", "lo", "tag"))
    found = stored(arrow_pass(met, group, "again boolean, a long, doc_id long, tag int, lo long, more int"), "repeats-anchors")

    def cut(batches):
        for b in batches:
            out = []
            for d, t, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                data, tag = (t or "").encode("utf-8", "replace"), _tag(t)
                out += [(w["a"], d, tag, w["lo"], data[w["lo"]:w["lo"] + w["more"] + length]) for w in wanted if w["tag"] == tag]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            for i in range(0, max(1, len(out)), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out[i:i + 20_000]) if out else [[]] * 5, kinds)], names=["a", "doc_id", "tag", "lo", "snippet"])

    wanted = found.where("not again").groupBy("doc_id").agg(F.collect_list(F.struct("a", "tag", "lo", "more")).alias("wanted"))
    snippets = arrow_pass(docs.join(wanted, "doc_id"), cut, "a long, doc_id long, tag int, lo long, snippet binary")

    def index(batches):
        """One index for each INDEXED bytes of whole groups, streamed in order of the anchor."""
        held: list[pa.RecordBatch] = []

        def marked(t: pa.Table):
            t = t.sort_by([("doc_id", "ascending"), ("lo", "ascending"), ("tag", "ascending"), ("a", "ascending")])
            a, d, tag, lo = (t.column(c).to_numpy() for c in ("a", "doc_id", "tag", "lo"))
            # rows of one id and text bring their snippets as often as they are repeated
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (tag[1:] != tag[:-1]) | (lo[1:] != lo[:-1])])
            t, d, tag, lo = t.filter(pa.array(new)), d[new], tag[new], lo[new]
            texts = t.column("snippet").to_pylist()
            sizes = np.array([len(x) for x in texts])
            ix = RunIndex(b"".join(texts), sizes)
            p = np.flatnonzero(ix.repeated(length))
            if not len(p):
                return
            run = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1] + 1]))
            start, end = p[run], p[np.append(run[1:], len(p)) - 1]
            of = np.searchsorted(ix.starts, start, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(d[of]), pa.array(tag[of]), pa.array(lo[of] + start - ix.starts[of]), pa.array((end - start).astype(np.int32))],
                                             names=["doc_id", "tag", "lo", "more"])
        for b in batches:
            held.append(b)
            if sum(x.nbytes for x in held) > INDEXED:
                t = pa.Table.from_batches(held).combine_chunks()
                a = t.column(0).to_numpy()
                whole = int(np.flatnonzero(a != a[-1])[-1]) + 1 if (a != a[-1]).any() else 0      # the last group may go on
                if whole:
                    yield from marked(t.slice(0, whole))
                    held = t.slice(whole).combine_chunks().to_batches()
        if held and sum(x.num_rows for x in held):
            yield from marked(pa.Table.from_batches(held).combine_chunks())

    indexed = arrow_pass(snippets.repartition("a").sortWithinPartitions("a"), index, "doc_id long, tag int, lo long, more int")
    spans = found.where("again").select("doc_id", "tag", "lo", "more").union(indexed)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "lo", "more")).alias("found"))

    def remove(batches):
        for b in batches:
            out = []
            for d, t, got in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data = np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8)
                got = got.as_py() or []
                tag = _tag(t) if got else 0
                step = np.zeros(len(data) + 1, np.int64)
                for x in got:
                    if x["tag"] == tag and x["lo"] + x["more"] + length <= len(data):
                        step[x["lo"]] += 1
                        step[x["lo"] + x["more"] + length] -= 1
                gone = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                out.append((d, len(data), int(gone.sum()), len(edge) // 2, hashlib.sha256(data[~gone].tobytes()).hexdigest(),
                            [{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)]))
            kinds = (*[pa.int64()] * 4, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return arrow_pass(docs.join(spans, "doc_id", "left").select("doc_id", "text", "found"), remove,
                      "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")
