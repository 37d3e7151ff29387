"""A stored search index in segments: block postings, kept counters, changes, merges.

An index is a folder. A segment holds the postings of some pages, written once and never changed:

- ``blocks``: one row for each term and slice of pages: the pages' ids, lengths, counts and positions; and as its peaks, for the counts
  from each power of two to the next, the greatest count and the shortest length. With any average length, these bound the BM25 part.
  Terms are tokens; pairs of neighbouring frequent tokens (a next-word index), named ``a b``; and trigrams of the URL.
- ``docs``: length and distinct terms of each page, which is what its deletion has to take back.
- ``terms``: how many pages of the segment hold each term.

A change set writes a segment of its new pages, and one of tombstones with the counters of the pages that they end, taken negative; so
what is written goes with the change. A tombstone ends its page in all segments before it. ``manifest`` has a small table for each
version, written last; readers keep their version. ``merge`` makes one segment of all and drops what is dead.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from websift.functions import text as X
from websift.operators import filters
from websift.session import SHUFFLES_GO, dropped, scratch_path, setting, stored

SLICE_DOCS = 512            # pages in a slice, about
SLICE_TOKENS = 2_000_000    # tokens in a slice, about; what a task holds at once
FILE_SLICES = 1024          # slices whose blocks share a file in each bucket, about
ROUND_SLICES = 128          # slices at least of which a round makes blocks
ROUNDS = 4                  # rounds at most: each reads the tokens once more, and leaves its shuffles behind
FREQUENT = 8                # a word is frequent if it stands in more than one of so many pages
TITLE = 1 << 30             # added to positions in titles
PUSHED = 2_000              # terms at most that are named in the scan's filter
BUCKET_TOKENS = 2_000_000   # tokens in a folder of blocks, about
MERGED_ROWS = 50_000        # entries that a merge makes blocks of at once, about
PACKED_ROWS, PACKED_BYTES = 20_000, 1 << 22     # packed blocks that are opened at once, at most or about
WRITERS = "32"              # files that a task has open at most
GRAM = "\x01"               # before trigrams of URLs

PACKED_COLUMNS = "bucket int, slice long, blocks binary"
BLOCK_COLUMNS = "term string, slice long, n int, ids array<long>, lens array<int>, fs array<int>, ts array<int>, pos array<array<int>>, peaks array<struct<f: int, len: int>>"
DOC_COLUMNS = "doc_id long, n_tokens int, terms array<string>, title_terms array<string>"
TERM_COLUMNS = "term string, n_docs long, n_title_docs long"
MANIFEST = "kind string, name string, seq long, n_docs long, n_tokens long, buckets int"


@dataclass(frozen=True)
class Index:
    """One version of a stored index."""

    spark: SparkSession
    path: str
    version: int
    rows: tuple             # of the manifest: one for each segment and set of tombstones

    def names(self, kind: str) -> list[tuple[str, int]]:
        return [(r["name"], r["seq"]) for r in self.rows if r["kind"] == kind]

    @property
    def n_docs(self) -> int:
        return sum(r["n_docs"] for r in self.rows)

    @property
    def n_tokens(self) -> int:
        return sum(r["n_tokens"] for r in self.rows)

    @property
    def avg_tokens(self) -> float:
        return self.n_tokens / self.n_docs if self.n_docs else 0.0

    @property
    def seq(self) -> int:
        return max(r["seq"] for r in self.rows)

    @property
    def buckets(self) -> int:
        return self.rows[0]["buckets"]

    def _all(self, kinds: tuple[str, ...], table: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{name}/{table}").withColumn("seq", F.lit(seq).cast("long"))
                 for kind in kinds for name, seq in self.names(kind)]
        out = parts[0] if parts else self.spark.createDataFrame([], f"{schema}, seq long")
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def blocks(self) -> DataFrame:
        return self._all(("segment",), "blocks", f"{BLOCK_COLUMNS}, bucket int")

    def docs(self) -> DataFrame:
        """The living pages."""
        return self.living(self._all(("segment",), "docs", DOC_COLUMNS))

    def counters(self) -> DataFrame:
        """``term, n_docs, n_title_docs`` by segment; to be summed."""
        return self._all(("segment", "tombs"), "terms", TERM_COLUMNS).drop("seq")

    def frequent(self) -> list[str]:
        """The words whose pairs are indexed: at most FREQUENT times the distinct words of an average page."""
        name = self.names("frequent")[0][0]
        return [r["term"] for r in self.spark.read.schema("term string").parquet(f"{name}/words").collect()]

    def living(self, rows: DataFrame) -> DataFrame:
        """``rows`` (``doc_id, seq``) without those that a tombstone ends."""
        if not self.names("tombs"):
            return rows
        ended = self._all(("tombs",), "ended", "doc_id long").select("doc_id", F.col("seq").alias("_ended"))
        return rows.join(ended, (rows["doc_id"] == ended["doc_id"]) & (rows["seq"] < ended["_ended"]), "left_anti")


def kept(pages: DataFrame, path: str) -> Index:
    """The index at ``path``, or one made of ``pages`` if there is none yet."""
    try:
        return open_index(pages.sparkSession, path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return create(pages, path)


def open_index(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The newest version of the index at ``path``, or the one named."""
    table = spark.read.schema(f"{MANIFEST}, version long").parquet(f"{path}/manifest")
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    rows = table.where(F.col("version") == version).orderBy("seq", "kind", "name").collect()     # a row for each segment
    return Index(spark, path, version, tuple(r.asDict() for r in rows))


def _commit(spark: SparkSession, path: str, version: int, rows: list[dict]) -> Index:
    """Writes a version's manifest; fails if another writer has been faster."""
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    table = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], MANIFEST)
    table.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/version={version}")
    return open_index(spark, path, version)


def _part(path: str, kind: str) -> str:
    return f"{path}/{kind}-{uuid.uuid4().hex}"


def fork(index: Index, path: str) -> Index:
    """An index of its own at a new ``path`` that begins with the segments of this version. Nothing is copied."""
    return _commit(index.spark, path, 1, list(index.rows))


def _tokens(pages: DataFrame) -> DataFrame:
    """``doc_id, tt, ct, grams`` of pages (``id, url, title, content``)."""
    low = filters.ascii_lower(F.coalesce("url", F.lit("")))
    both = F.struct(X.tokens(F.col("title")).alias("tt"), X.tokens(F.col("content")).alias("ct"))
    # through a one-row generator, so that text is cut into tokens once however often they are named
    once = pages.select(F.col("id").alias("doc_id"), F.explode(F.array(both)).alias("x"), grams_of(low).alias("grams"))
    return once.select("doc_id", "x.tt", "x.ct", "grams")


def grams_of(low: Column) -> Column:
    """The distinct trigrams of a lower-case string, as terms."""
    starts = F.sequence(F.lit(1), F.length(low) - 2)
    return F.when(F.length(low) > 2, F.array_distinct(F.transform(starts, lambda i: F.concat(F.lit(GRAM), F.substr(low, i, F.lit(3)))))) \
        .otherwise(F.array().cast("array<string>"))


@contextmanager
def _tokenised(pages: DataFrame):
    """``_tokens`` written down, with ``n_tokens``: pages are parsed and cut once, however many tables are made of them. Deleted after its readers."""
    t, path = _tokens(pages), scratch_path(pages.sparkSession, "index-tokens")
    t = t.select("doc_id", (F.size("tt") + F.size("ct")).alias("n_tokens"), "tt", "ct", "grams")
    _write(t, path)
    yield t.sparkSession.read.schema(t.schema).parquet(path)
    dropped(t.sparkSession, path)


def _write(df: DataFrame, path: str, by: str | None = None, mode: str = "error") -> None:
    """A table of the index. Parts by a column are written side by side: rows that are in order already are not sorted again."""
    with setting(df.sparkSession, SHUFFLES_GO, "true"), setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", WRITERS):
        df.write.mode(mode).parquet(path, partitionBy=by, compression="zstd")


def _write_docs(t: DataFrame, path: str) -> DataFrame:
    _write(t.select("doc_id", "n_tokens", F.array_distinct(F.concat("tt", "ct", "grams")).alias("terms"),
                    F.array_distinct("tt").alias("title_terms")), f"{path}/docs")
    return t.sparkSession.read.schema(DOC_COLUMNS).parquet(f"{path}/docs")


def _count_terms(docs: DataFrame) -> DataFrame:
    each = docs.select(F.explode("terms").alias("term"), F.lit(1).alias("a"), F.lit(0).alias("t")).unionByName(
        docs.select(F.explode("title_terms").alias("term"), F.lit(0).alias("a"), F.lit(1).alias("t")))
    return each.groupBy("term").agg(F.sum("a").alias("n_docs"), F.sum("t").alias("n_title_docs"))


def _band(n_tokens: Column) -> Column:
    return F.floor(F.log2(n_tokens + 1) * 2).cast("int")


def _slice(sizes: dict[int, tuple[int, int]], slice_docs: int) -> Column:
    """Pages of like length share slices, so that bounds of blocks differ. ``sizes``: pages and tokens in each band of length."""
    band = _band(F.col("n_tokens"))
    of_band = [max(1, -(-n // slice_docs), -(-tokens // SLICE_TOKENS)) for n, tokens in (sizes.get(b, (0, 0)) for b in range(max(sizes, default=0) + 1))]
    parts = F.coalesce(F.get(F.array(*map(F.lit, of_band)), band), F.lit(1))
    return band.cast("long") * (1 << 32) + F.pmod(F.xxhash64("doc_id"), parts)


def _sizes(docs: DataFrame) -> dict[int, tuple[int, int]]:
    """Pages and tokens by band of length: as many rows as twice the logarithm of the longest page."""
    by_band = docs.groupBy(_band(F.col("n_tokens")).alias("b")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
    return {r["b"]: (r["n"], r["tokens"]) for r in by_band.collect()}


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def peaks(fs: Column, lens: Column) -> Column:
    """For the counts from each power of two to the next: the greatest, and the length of the shortest page with one of them."""
    powers = F.sequence(F.lit(0), F.floor(F.log2(F.array_max(fs))).cast("int"))
    both = F.arrays_zip(fs.alias("f"), lens.alias("len"))

    def peak(k: Column) -> Column:
        some = F.filter(both, lambda x: F.floor(F.log2(x["f"])) == k)
        return F.when(F.size(some) > 0, F.struct(F.array_max(F.transform(some, lambda x: x["f"])).alias("f"), F.array_min(F.transform(some, lambda x: x["len"])).alias("len")))
    one = F.array(F.struct(fs[0].alias("f"), lens[0].alias("len")))
    return F.when(F.size(fs) == 1, one).otherwise(F.array_compact(F.transform(powers, peak)))


def _block_table():
    """Makes blocks of entries (a term in a page, in order): block ``k`` begins with entry ``begins[k]``."""
    def table(heads: dict, begins: np.ndarray, ids: pa.Array, lens: np.ndarray, fs: np.ndarray, ts: np.ndarray, pos: pa.Array) -> pa.Table:
        ranges = pa.array(np.append(begins, len(fs)), pa.int32())
        block = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(fs))))
        # peaks: see ``peaks``
        group = block * 64 + np.frexp(fs)[1]
        order = np.argsort(group, kind="stable")
        peak = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) != 0))) if len(group) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(fs[order], peak) if len(peak) else fs
        least = np.minimum.reduceat(lens[order], peak) if len(peak) else fs
        peak_ranges = np.searchsorted(group[order][peak] // 64, np.arange(len(begins) + 1))

        def lists(values):
            return pa.ListArray.from_arrays(ranges, pa.array(values, pa.int32()))
        return pa.table({
            **heads, "n": pa.array(np.diff(np.append(begins, len(fs))), pa.int32()),
            "ids": pa.ListArray.from_arrays(ranges, ids), "lens": lists(lens), "fs": lists(fs), "ts": lists(ts), "pos": pa.ListArray.from_arrays(ranges, pos),
            "peaks": pa.ListArray.from_arrays(pa.array(peak_ranges, pa.int32()), pa.StructArray.from_arrays([pa.array(most, pa.int32()), pa.array(least, pa.int32())], ["f", "len"]))})

    table.__module__ = "__main__"       # pickled by value, like what calls it
    return table


def _merged_blocks():
    """Blocks of ``term, slice, bucket, doc_id, n_tokens, pos`` (one row for each page and term) that come in order of block and page."""
    title, held_rows, table = TITLE, MERGED_ROWS, _block_table()

    def made(rows: pa.Table) -> pa.RecordBatch:
        at = [rows[c].combine_chunks() for c in ("term", "slice", "bucket")]
        new = np.concatenate(([True], np.any([pc.not_equal(a[1:], a[:-1]).to_numpy(zero_copy_only=False) for a in at], axis=0)))
        begins = np.flatnonzero(new)
        pos = rows["pos"].combine_chunks()
        n = pos.value_lengths().to_numpy()
        ends = np.cumsum(n)
        in_title = np.append(0, np.cumsum(pos.flatten().to_numpy() >= title))
        heads = {c: a.take(pa.array(begins)) for c, a in zip(("term", "slice", "bucket"), at)}
        t = table(heads, begins, rows["doc_id"].combine_chunks(), rows["n_tokens"].to_numpy(), np.maximum(n, 1), in_title[ends] - in_title[ends - n], pos)
        return t.select(["term", "slice", "n", "ids", "lens", "fs", "ts", "pos", "peaks", "bucket"]).combine_chunks().to_batches()[0]

    def blocks(batches):
        held, n, most = [], 0, held_rows
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= most:
                rows = pa.Table.from_batches(held).combine_chunks()
                last = rows.slice(rows.num_rows - 1)
                # the last block may go on in the next batch
                same = np.logical_and.reduce([pc.equal(rows[c].combine_chunks(), last[c][0]).to_numpy(zero_copy_only=False) for c in ("term", "slice", "bucket")])
                whole = int(np.argmax(same))
                if whole:
                    yield made(rows.slice(0, whole))
                held, n = rows.slice(whole).combine_chunks().to_batches(), rows.num_rows - whole
                most = max(held_rows, 2 * n)
        if held:
            yield made(pa.Table.from_batches(held))

    blocks.__module__ = "__main__"
    made.__module__ = "__main__"
    return blocks


def _write_blocks(blocks: DataFrame, path: str, mode: str = "error") -> None:
    """``blocks`` come in order of bucket, term and slice."""
    _write(blocks, f"{path}/blocks", "bucket", mode)


def _slice_blocks(frequent: list[str], buckets: int):
    """The packed blocks of one slice, a row for each bucket, from a table of its pages (``doc_id, n_tokens, tt, ct, grams, slice``; tokens joined by blanks, trigrams
    one after another): occurrences are numbers, sorted at once."""
    title, gram, pack, bucket_in = TITLE, GRAM, _pack(), _bucket_in()
    size = len(GRAM) + 3

    def cut(column: str, rows: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
        """All tokens, and how many there are in each row."""
        if column == "grams":
            each = [[s[i:i + size] for i in range(0, len(s), size)] for s in rows.to_pylist()]
            return pa.array([g for gs in each for g in gs], pa.string()), np.array([len(gs) for gs in each], np.int64)
        lists = pc.split_pattern(rows.combine_chunks(), " ")
        n, words = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten()
        none = pc.equal(rows, "").to_numpy()            # nothing is cut to one empty string
        return words.filter(pa.array(np.repeat(~none, n))), np.where(none, 0, n)

    def blocks(pages: pa.Table) -> pa.Table:
        null = pages["doc_id"].is_null().to_numpy()
        ids, lens = pages["doc_id"].fill_null(0).to_numpy(), pages["n_tokens"].to_numpy()
        # rows of one page (id and length) are one entry; pages in order of id, null first
        order = np.lexsort((lens, ids, ~null))
        ids, lens, null = ids[order], lens[order], null[order]
        new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (lens[1:] != lens[:-1]) | (null[1:] != null[:-1])))
        page_of = np.empty(len(order), np.int64)
        page_of[order] = np.cumsum(new) - 1
        ids, lens, null = ids[new], lens[new], null[new]
        words, page, at, ends = [], [], [], []
        for column, base in (("tt", title), ("ct", 0), ("grams", 0)):
            found, n = cut(column, pages[column])
            words.append(found)
            page.append(np.repeat(page_of, n))
            at.append(np.zeros(n.sum(), np.int64) if column == "grams" else np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + base)
            last = np.zeros(n.sum(), bool)
            last[np.cumsum(n)[n > 0] - 1] = True
            ends.append(last)
        page, at, ends = np.concatenate(page), np.concatenate(at), np.concatenate(ends)
        coded = pa.concat_arrays(words).dictionary_encode()
        terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        # pairs of neighbouring frequent words
        often = pc.is_in(terms, value_set=pa.array(frequent, pa.string())).to_numpy(zero_copy_only=False)[code]
        first = np.flatnonzero(often[:-1] & often[1:] & ~ends[:-1])
        pairs, pair = np.unique(code[first] * len(terms) + code[first + 1], return_inverse=True)
        names = pc.binary_join_element_wise(terms.take(pa.array(pairs // max(len(terms), 1))), terms.take(pa.array(pairs % max(len(terms), 1))), " ")
        code, page, at = np.concatenate((code, pair + len(terms))), np.concatenate((page, page[first])), np.concatenate((at, at[first]))
        terms = pa.concat_arrays([terms, names])
        # in order of term, page, position
        key = code * len(ids) + page
        if len(terms) * len(ids) < 1 << 32:
            key = np.sort(key << 31 | at)
            key, at = key >> 31, key & (1 << 31) - 1
        else:
            order = np.lexsort((at, key))
            key, at = key[order], at[order]
        # entries: a term in a page
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        code, page = key[starts] // max(len(ids), 1), key[starts] % max(len(ids), 1)
        is_gram = pc.starts_with(terms, gram).to_numpy(zero_copy_only=False)[code]
        fs = np.diff(np.append(starts, len(key)))
        ts = np.diff(np.append(0, np.cumsum(at >= title))[np.append(starts, len(key))])
        at = at[~np.repeat(is_gram, fs)]
        places = np.append(0, np.cumsum(np.where(is_gram, 0, fs)))
        fs = np.where(is_gram, 1, fs)
        # blocks: a term's entries
        begins = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
        terms = terms.take(pa.array(code[begins]))
        made = pa.table({"term": terms, "n": pa.array(np.diff(np.append(begins, len(fs))), pa.int32()), "packed": pack(begins, ids[page], null[page], lens[page], fs, ts, places, at)})
        bucket = bucket_in(terms, buckets)
        order = np.argsort(bucket, kind="stable")
        made, bucket = made.take(pa.array(order)).combine_chunks(), bucket[order]
        firsts = np.flatnonzero(np.diff(bucket, prepend=-1))
        sealed = []
        for a, b in zip(firsts, np.append(firsts[1:], len(bucket))):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, made.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(made.slice(a, b - a))
            sealed.append(sink.getvalue().to_pybytes())
        return pa.table({"bucket": pa.array(bucket[firsts], pa.int32()), "slice": pa.repeat(pages["slice"][0], len(firsts)), "blocks": pa.array(sealed, pa.binary())})

    cut.__module__ = blocks.__module__ = "__main__"      # pickled by value: executors need no copy of this package
    return blocks


def _bucket_in():
    """``bucket_of`` for an array of terms: Spark's xxhash64 of their bytes. Terms of one length are hashed side by side."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, k: int) -> np.ndarray:
        return x << np.uint64(k) | x >> np.uint64(64 - k)

    def hashed(rows: np.ndarray) -> np.ndarray:
        length, n = rows.shape[1], len(rows)
        words = np.ascontiguousarray(rows[:, :length // 8 * 8]).view("<u8").reshape(n, length // 8)
        seed, done = np.full(n, 42, np.uint64), length // 32 * 4
        h = seed + p5
        if done:
            lanes = [seed + p1 + p2, seed + p2, seed, seed - p1]
            for k in range(done):
                lanes[k % 4] = turned(lanes[k % 4] + words[:, k] * p2, 31) * p1
            h = turned(lanes[0], 1) + turned(lanes[1], 7) + turned(lanes[2], 12) + turned(lanes[3], 18)
            for v in lanes:
                h = (h ^ turned(v * p2, 31) * p1) * p1 + p4
        h = h + np.uint64(length)
        for k in range(done, length // 8):
            h = turned(h ^ turned(words[:, k] * p2, 31) * p1, 27) * p1 + p4
        at = length // 8 * 8
        if at + 4 <= length:
            h = turned(h ^ np.ascontiguousarray(rows[:, at:at + 4]).view("<u4").reshape(n).astype(np.uint64) * p1, 23) * p2 + p3
            at += 4
        for k in range(at, length):
            h = turned(h ^ rows[:, k].astype(np.uint64) * p5, 11) * p1
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        return h ^ h >> np.uint64(32)

    def bucket_in(terms: pa.Array, buckets: int) -> np.ndarray:
        terms = terms.cast(pa.large_binary())
        offsets = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset:terms.offset + len(terms) + 1] if len(terms) else np.zeros(1, np.int64)
        data, lengths, out = np.frombuffer(terms.buffers()[2] or b"", np.uint8), np.diff(offsets), np.zeros(len(terms), np.uint64)
        order = np.argsort(lengths, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            if len(same):
                out[same] = hashed(data[offsets[same][:, None] + np.arange(lengths[same[0]])])
        return out.view(np.int64) % buckets

    turned.__module__ = hashed.__module__ = bucket_in.__module__ = "__main__"
    return bucket_in


def _layout():
    """Where the numbers of packed blocks stand, for blocks of ``n`` entries and ``p`` positions each: a block's ids, lengths, counts, counts in titles
    (places of the first of each entry, and the width of the steps between these four), and its positions."""
    def layout(n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts = np.append(0, np.cumsum(4 * n + p))
        entry = np.arange(n.sum()) + np.repeat(starts[:-1] - np.cumsum(n) + n, n)
        place = np.arange(p.sum()) + np.repeat(starts[:-1] + 4 * n - np.cumsum(p) + p, p)
        return starts, entry, np.repeat(n, n), place

    layout.__module__ = "__main__"
    return layout


def _pack():
    """Blocks as strings of bytes, for the shuffle: differences of ids and positions, and all other numbers, seven bits in a byte."""
    layout, most, seven = _layout(), np.uint64(127), np.uint64(7)

    def steps(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Differences; at ``begins`` the numbers themselves."""
        out = np.diff(x, prepend=x[:1])
        out[begins] = x[begins]
        return out

    def pack(begins: np.ndarray, ids: np.ndarray, null: np.ndarray, lens: np.ndarray, fs: np.ndarray, ts: np.ndarray, places: np.ndarray, at: np.ndarray) -> pa.Array:
        n = np.diff(np.append(begins, len(fs)))
        starts, entry, width, place = layout(n, np.diff(places[np.append(begins, len(fs))]))
        v = np.empty(starts[-1], np.uint64)
        d = steps(ids, begins)
        v[entry] = (d << 1 ^ d >> 63).view(np.uint64)       # the sign goes last
        v[entry + width], v[entry + 2 * width], v[entry + 3 * width] = lens, fs, ts * 2 + null
        v[place] = steps(at, places[:-1][np.diff(places) > 0])
        size = np.ones(len(v), np.int64)
        more = np.flatnonzero(v > most)
        rest = v[more]
        while len(more):
            size[more] += 1
            rest = rest >> seven
            more, rest = more[rest > most], rest[rest > most]
        ends = np.append(0, np.cumsum(size))
        out = np.empty(ends[-1], np.uint8)
        at, rest = ends[:-1], v
        while len(at):
            on = rest > most
            out[at] = (rest & most).astype(np.uint8) | on.astype(np.uint8) << 7
            at, rest = at[on] + 1, rest[on] >> seven
        return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(ends[starts].astype(np.int32)), pa.py_buffer(out)])

    steps.__module__ = pack.__module__ = "__main__"
    return pack


def _opened():
    """Blocks of packed ones (``PACKED_COLUMNS``, that come in order of bucket), in order of bucket, term and slice."""
    layout, table, most_rows, most_bytes = _layout(), _block_table(), PACKED_ROWS, PACKED_BYTES

    def sums(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The numbers whose differences are ``steps``, in groups of so many."""
        total = np.cumsum(steps)
        first = (np.cumsum(counts) - counts)[counts > 0]
        return total - np.repeat(total[first] - steps[first], counts[counts > 0])

    def opened(rows: pa.Table) -> pa.RecordBatch:
        packed = rows["packed"].combine_chunks()
        offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1].astype(np.int64)
        data = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        ends = np.flatnonzero(data < 128)
        begins = np.append(0, ends[:-1] + 1)
        v = (data[begins] & 127).astype(np.uint64)
        more = np.flatnonzero(ends > begins)
        for k in range(1, 10):
            v[more] |= (data[begins[more] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
            more = more[ends[more] - begins[more] > k]
        n = rows["n"].to_numpy().astype(np.int64)
        p = np.diff(np.searchsorted(ends, offsets)) - 4 * n
        _, entry, width, place = layout(n, p)
        d = v[entry]
        ids = sums((d >> np.uint64(1)).view(np.int64) ^ -(d & np.uint64(1)).view(np.int64), n)
        lens, fs, ts = (v[entry + k * width].astype(np.int64) for k in (1, 2, 3))
        counts = np.where(np.repeat(p, n) > 0, fs, 0)       # trigrams have no positions
        pos = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(sums(v[place].view(np.int64), counts), pa.int32()))
        heads = {c: rows[c].combine_chunks() for c in ("term", "slice", "bucket")}
        t = table(heads, np.cumsum(n) - n, pa.array(ids, pa.int64(), mask=(ts & 1).astype(bool)), lens, fs, ts >> 1, pos)
        return t.select(["term", "slice", "n", "ids", "lens", "fs", "ts", "pos", "peaks", "bucket"]).combine_chunks().to_batches()[0]

    def in_order(bucket: int, slices: list) -> pa.Table:
        """All blocks of a bucket, still packed."""
        found = []
        for of_slice, sealed in slices:
            t = pa.ipc.open_stream(sealed).read_all()
            found.append(t.append_column("slice", pa.array(np.full(len(t), of_slice, np.int64))))
        rows = pa.concat_tables(found).combine_chunks()
        rows = rows.append_column("bucket", pa.array(np.full(len(rows), bucket, np.int32)))
        return rows.take(pc.sort_indices(rows, [("term", "ascending"), ("slice", "ascending")])).combine_chunks()

    def bucket_blocks(bucket: int, slices: list):
        rows = in_order(bucket, slices)
        # so many rows at once as hold about so many bytes
        size = np.cumsum(pc.binary_length(rows["packed"]).to_numpy().astype(np.int64))
        part = np.maximum(size // most_bytes, np.arange(len(rows)) // most_rows)
        firsts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(firsts, np.append(firsts[1:], len(rows))):
            yield opened(rows.slice(a, b - a))

    def blocks(batches):
        bucket, held = None, []
        for batch in batches:
            for b, of_slice, sealed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "slice", "blocks"))):
                if b != bucket and held:
                    yield from bucket_blocks(bucket, held)
                    held = []
                bucket = b
                held.append((of_slice, sealed))
        if held:
            yield from bucket_blocks(bucket, held)

    in_order.__module__ = bucket_blocks.__module__ = "__main__"
    sums.__module__ = opened.__module__ = blocks.__module__ = "__main__"
    return blocks


def _page_blocks(t: DataFrame, frequent: list[str], buckets: int, slices: Column, files: int) -> DataFrame:
    """Blocks of tokenised pages: these are shuffled by slice, and the blocks then by bucket, in ``files`` files each, packed in a row for a slice's
    blocks of a bucket. What a task opens at once does not grow with the bucket."""
    packed = t.select("doc_id", "n_tokens", F.array_join("tt", " ").alias("tt"), F.array_join("ct", " ").alias("ct"), F.array_join("grams", "").alias("grams"),
                      slices.alias("slice"))
    made = packed.groupBy("slice").applyInArrow(_slice_blocks(frequent, buckets), PACKED_COLUMNS)
    return _dealt(made, files).sortWithinPartitions("bucket", "slice").mapInArrow(_opened(), f"{BLOCK_COLUMNS}, bucket int")


def _write_page_blocks(t: DataFrame, frequent: list[str], buckets: int, slices: Column, rounds: int, files: int, path: str) -> None:
    """``_page_blocks`` of many slices in rounds, so that the shuffles of all are not there at once. A round has files of its own."""
    files = -(-files // rounds) * rounds
    for r in range(rounds):
        some = t.where(F.pmod(F.pmod(F.xxhash64(slices), F.lit(files)), F.lit(rounds)) == r) if rounds > 1 else t
        _write_blocks(_page_blocks(some, frequent, buckets, slices, files), path, "append")


def _rounds(n: int, slice_docs: int) -> int:
    return min(ROUNDS, max(1, n // (slice_docs * ROUND_SLICES)))


def _dealt(blocks: DataFrame, files: int) -> DataFrame:
    """A bucket's rows in ``files`` files; a block's rows together."""
    return blocks.repartition("bucket", F.pmod(F.xxhash64("slice"), F.lit(files)))


def _files(n: int, slice_docs: int) -> int:
    """Files in a bucket, so that a word that is everywhere stays in none alone."""
    return max(1, -(-n // (slice_docs * FILE_SLICES)))


def _totals(docs: DataFrame) -> tuple[int, int]:
    n, tokens = docs.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    return n, tokens


def create(pages: DataFrame, path: str, slice_docs: int = SLICE_DOCS) -> Index:
    """Index ``pages`` (``id, url, title, content``) under a new ``path``."""
    spark, name, words = pages.sparkSession, _part(path, "segment"), _part(path, "frequent")
    with _tokenised(pages) as t:
        docs = _write_docs(t, name)
        n, tokens = _totals(docs)
        _write(_count_terms(docs).sortWithinPartitions("term"), f"{name}/terms")
        counted = spark.read.schema(TERM_COLUMNS).parquet(f"{name}/terms")
        frequent = _write_frequent(counted, n, words)
        buckets = max(8, -(-tokens // BUCKET_TOKENS))
        _write_page_blocks(t, frequent, buckets, _slice(_sizes(docs), slice_docs), _rounds(n, slice_docs), _files(n, slice_docs), name)
    return _commit(spark, path, 1, [_row("segment", name, 1, n, tokens, buckets), _row("frequent", words, 0, 0, 0, buckets)])


def _row(kind: str, name: str, seq: int, n_docs: int, n_tokens: int, buckets: int) -> dict:
    return {"kind": kind, "name": name, "seq": seq, "n_docs": n_docs, "n_tokens": n_tokens, "buckets": buckets}


def _write_frequent(counted: DataFrame, n: int, path: str) -> list[str]:
    words = counted.where((F.col("n_docs") * FREQUENT > n) & ~F.col("term").startswith(GRAM)).select("term")
    words.coalesce(1).write.parquet(f"{path}/words")
    return [r["term"] for r in words.collect()]


def apply_changes(index: Index, changes: DataFrame, slice_docs: int = SLICE_DOCS) -> Index:
    """The next version: after inserts, updates and deletes.

    ``changes``: ``seq, op, id, url, title, content``, ``op`` one of insert, update, delete; of several changes to one page the last
    counts. Only new text is tokenised, and only what changed is written.
    """
    spark, path, seq = index.spark, index.path, index.seq + 1
    last = changes.groupBy("id").agg(F.max_by(F.struct("op", "url", "title", "content"), "seq").alias("c")).select("id", "c.*")
    last = stored(last, "index-changes")
    name, tombs = _part(path, "segment"), _part(path, "tombs")
    new = last.where("op <> 'delete'").select("id", "url", "title", "content")
    with _tokenised(new) as t:
        docs = _write_docs(t, name)
        n, tokens = _totals(docs)
        _write(_count_terms(docs), f"{name}/terms")
        _write_page_blocks(t, index.frequent(), index.buckets, _slice(_sizes(docs), slice_docs), _rounds(n, slice_docs), _files(n, slice_docs), name)
    ended = stored(index.docs().join(last.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").drop("seq"), "index-ended")
    gone, gone_tokens = _totals(ended)
    ended.select("doc_id").write.parquet(f"{tombs}/ended")
    less = _count_terms(ended).select("term", (-F.col("n_docs")).alias("n_docs"), (-F.col("n_title_docs")).alias("n_title_docs"))
    _write(less, f"{tombs}/terms")
    return _commit(spark, path, index.version + 1, [*index.rows, _row("segment", name, seq, n, tokens, index.buckets),
                                                    _row("tombs", tombs, seq, -gone, -gone_tokens, index.buckets)])


def merge(index: Index, slice_docs: int = SLICE_DOCS) -> Index:
    """The next version: one segment of all living pages, made from the blocks. Text is not read; which pairs are indexed stays."""
    spark, path, seq, name = index.spark, index.path, index.seq + 1, _part(index.path, "segment")
    _write(index.docs().drop("seq"), f"{name}/docs")
    docs = spark.read.schema(DOC_COLUMNS).parquet(f"{name}/docs")
    n, tokens = _totals(docs)
    counters = index.counters().groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_title_docs").alias("n_title_docs")).where("n_docs > 0")
    _write(counters.sortWithinPartitions("term"), f"{name}/terms")
    entry = F.explode(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("lens").alias("n_tokens"), "pos"))
    each = index.living(index.blocks().select("bucket", "term", "seq", entry.alias("x")).select("bucket", "term", "seq", "x.*"))
    # dealt like the blocks of new pages: a bucket has as many files as its slices need, not one for each task
    each = each.select("term", _slice(_sizes(docs), slice_docs).alias("slice"), "bucket", "doc_id", "n_tokens", "pos")
    each = _dealt(each, _files(n, slice_docs)).sortWithinPartitions("bucket", "term", "slice", "doc_id", "n_tokens", "pos")
    _write_blocks(each.mapInArrow(_merged_blocks(), f"{BLOCK_COLUMNS}, bucket int"), name)
    words = next(r for r in index.rows if r["kind"] == "frequent")
    return _commit(spark, path, index.version + 1, [_row("segment", name, seq, n, tokens, index.buckets), words])


def held(df: DataFrame, what: str) -> tuple[DataFrame, list | None]:
    """A table that plans read again and again, made once: with its rows if there are no more than PUSHED, else written down."""
    with setting(df.sparkSession, SHUFFLES_GO, "true"):
        rows = df.limit(PUSHED + 1).collect()
    if len(rows) <= PUSHED:
        return df.sparkSession.createDataFrame(rows, df.schema), rows
    return stored(df, what), None


def listed(values: list[str]) -> str:
    """``values`` as string literals of SQL. One expression is parsed much faster than so many literals are made one by one."""
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def named(column: str, values: list[str]) -> Column:
    """``column`` is one of ``values``, in lists that a Parquet scan takes whole, joined as a balanced tree: its depth is small."""
    parts = [f"{column} in ({listed(values[i:i + 50])})" for i in range(0, len(values), 50)] or ["false"]
    while len(parts) > 1:
        parts = [f"({parts[i]} or {parts[i + 1]})" if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return F.expr(parts[0])


def blocks_of(index: Index, asked: DataFrame, rows: list | None) -> DataFrame:
    """The blocks of the terms in ``asked`` (``term``; ``rows``, if it is held in few). Few terms are named in the scan's filter; of
    more, the buckets alone are known to it."""
    if rows is not None:
        few = sorted({r["term"] for r in rows})
        numbers = index.spark.createDataFrame([(t,) for t in few], "term string").select(bucket_of(F.col("term"), index.buckets).alias("b"))
        return index.blocks().where(F.col("bucket").isin([r["b"] for r in numbers.distinct().collect()]) & named("term", few)).drop("bucket")
    asked = asked.select("term").distinct().withColumn("bucket", bucket_of(F.col("term"), index.buckets))
    return index.blocks().join(asked, ["bucket", "term"], "left_semi").drop("bucket")


def counts_of(index: Index, asked: DataFrame, kept: list | None) -> DataFrame:
    """``term, n_docs, n_title_docs`` of the terms in ``asked`` (``kept``: its rows, if few), from the kept counters."""
    rows = index.counters()
    rows = rows.join(asked.select("term").distinct(), "term", "left_semi") if kept is None else rows.where(named("term", sorted({r["term"] for r in kept})))
    return rows.groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_title_docs").alias("n_title_docs"))
