"""N-gram Jaccard join by signature trees.

Documents become sets of word shingles. Equal sets are one node of the join. Sets are ordered by one global order,
long shingles first and the most frequent last; two sets at or above the threshold then share a shingle of their prefixes. Few sets under
one prefix shingle are paired at once. Where there are more, shingles with one hub (see below) hold mostly the same sets, so the sets of
all these shingles together form one tree: leaves of a few sets, nodes above them, each with the OR and the AND of
its sets' token bitmaps and its range of sizes. Two trees of a hub are walked together; a pair of nodes is left
when sizes or bitmaps show that no pair below can reach the threshold, or when all below is already one component.

Large groups of near copies would give all their pairs. So each set is first held against one hub for each of its shingles: of the
sets under the shingle, the one whose own shingles stand in the most sets. Among copies that were each changed at other places this is
the text they were copied from, whatever the ids are. The links found make components, and the trees are walked only between
different ones. No link between components is lost, and the pairs inside one are never made. Intermediate tables are deleted
after their last reader; the result is a table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from websift.llm.common import Scratch, arrow_pass, components, heaviest, likely, shingles, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 1024                 # of the token bitmap that each set has
WIDE = 8192                 # of the bitmap in the trees, which pairs are held to before their sets meet
FEW = 8                     # sets under one shingle that are paired without a tree
HOT = 1 << 17               # shingles whose frequency orders them last; only the order, never the result, depends on it
LEAF, FAN, BLOCK = 32, 8, 1024      # sets in a leaf, nodes below one above the leaves, sets in one tree
OPENED = 64                 # pairs of nodes opened together


def _bitmap(tokens: np.ndarray, width: int = BITS) -> np.ndarray:
    bits = np.zeros(width, np.uint8)
    bits[(tokens % np.uint64(width)).astype(np.int64)] = 1
    return np.packbits(bits)


def _frequent(docs: DataFrame, width: int, store) -> np.ndarray:
    """The most frequent shingles, least frequent first: at most HOT rows reach the driver.

    Tasks report what two million shingles in a row hold four times or more, so reports shrink before the shuffle.
    """
    def count(batches):
        parts, held = [], 0

        def folded():
            v, c = np.unique(np.concatenate(parts), return_counts=True)
            return v[c >= 4], c[c >= 4]

        def sent(v, c):
            for i in range(0, len(v), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[i:i + 50_000].view(np.int64)), pa.array(c[i:i + 50_000])], names=["token", "df"])
        for b in batches:
            for t in b.column(0).to_pylist():
                parts.append(shingles(t, width))
                held += len(parts[-1])
            if held > 2_000_000:
                yield from sent(*folded())
                parts, held = [], 0
        if parts:
            yield from sent(*folded())
    counted = arrow_pass(docs.select("text"), count, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))
    return heaviest(counted, "token", "df", HOT, "join-frequent", store)


def _levels(n: np.ndarray, c: np.ndarray, sig: np.ndarray) -> list[dict[str, np.ndarray]]:
    """The nodes of a tree, from its sets up to one root: OR and AND of the bitmaps, ranges of sizes and components."""
    level = {"lo": n, "hi": n, "c_lo": c, "c_hi": c, "or": sig, "and": sig}
    out, fan = [level], LEAF
    while len(level["lo"]) > 1:
        cuts = np.arange(0, len(level["lo"]), fan)
        level = {k: f.reduceat(level[k], cuts, axis=0) for k, f in (("lo", np.minimum), ("hi", np.maximum), ("c_lo", np.minimum),
                                                                   ("c_hi", np.maximum), ("or", np.bitwise_or), ("and", np.bitwise_and))}
        out.append(level)
        fan = FAN
    return out


def _below(nodes: np.ndarray, height: int, levels: list) -> tuple[np.ndarray, np.ndarray]:
    """First child of each node and how many it has."""
    fan = LEAF if height == 1 else FAN
    first = nodes * fan
    return first, np.minimum(fan, len(levels[height - 1]["lo"]) - first)


def _possible(a: dict, b: dict, i: np.ndarray, j: np.ndarray, per100: int) -> np.ndarray:
    """Whether sets of different components below nodes ``i`` and ``j`` may overlap as much as the threshold wants.

    A set of size u that lacks at least m of its tokens in a set of size v can share u - m with it; needed are
    per100 * (u + v) / (100 + per100). The largest u and smallest v below the nodes ask least.
    """
    def lacks(x, y):
        return np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
    one = (a["c_lo"][i] == a["c_hi"][i]) & (b["c_lo"][j] == b["c_hi"][j]) & (a["c_lo"][i] == b["c_lo"][j])
    room = np.minimum(100 * a["hi"][i] - per100 * b["lo"][j], 100 * b["hi"][j] - per100 * a["lo"][i])
    ok = ~one & (room >= 0)
    i, j = i[ok], j[ok]
    ok[ok] = (((100 + per100) * lacks(a["and"][i], b["or"][j]) <= 100 * a["hi"][i] - per100 * b["lo"][j])
              & ((100 + per100) * lacks(b["and"][j], a["or"][i]) <= 100 * b["hi"][j] - per100 * a["lo"][i]))
    return ok


def _walk(x: list, y: list, same: bool, per100: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets, by their places below two roots, that sizes and bitmaps leave possible: a dual traversal.

    A pair of nodes that passes is opened: the higher node, or both of one height.
    """
    open_ = [(len(x) - 1, len(y) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while open_:
        u, v, i, j = open_.pop()
        ok = _possible(x[u], y[v], i, j, per100)
        if same:                    # both sides are one tree, so always at one height
            ok &= i <= j
        i, j = i[ok], j[ok]
        if not u and not v:
            yield i, j
            continue
        for at in range(0, len(i), OPENED):
            k, m = i[at:at + OPENED], j[at:at + OPENED]
            first_k, n_k = _below(k, u, x) if u >= v else (k, np.ones(len(k), np.int64))
            first_m, n_m = _below(m, v, y) if v >= u else (m, np.ones(len(m), np.int64))
            of = np.repeat(np.arange(len(k)), n_k * n_m)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(n_k * n_m) - n_k * n_m, n_k * n_m)
            open_.append((u - (u >= v), v - (v >= u), first_k[of] + nth // n_m[of], first_m[of] + nth % n_m[of]))


def ngram_jaccard_join(docs: DataFrame, width: int = 5, per100: int = 80, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row.

    Rows link when ``100 * |A and B| >= per100 * |A or B|`` for their sets of ``width``-word shingles (the whole
    sequence where it has fewer words). ``component_id`` is the smallest id reachable. Null and empty texts have an empty set and link with nothing.
    A null id is returned without component. Rows of one id count as one document. Other columns are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hot = _frequent(docs, width, scratch.stored)
    scratch.drop()
    by_value = np.argsort(hot)
    hot_value, hot_rank = hot[by_value], (by_value + 1).astype(np.uint64)
    shared = spark.sparkContext.broadcast((hot_value, hot_rank))     # at most HOT entries of 16 bytes

    def ordered_prefix(s: np.ndarray) -> np.ndarray:
        value, rank = shared.value
        length = len(s) - -(-per100 * len(s) // 100) + 1
        if not len(value):
            return s[:length]
        at = np.minimum(np.searchsorted(value, s), len(value) - 1)
        late = np.where(value[at] == s, rank[at], np.uint64(0))
        return s[np.lexsort((s, late))[:length]]

    def describe(batches):
        for b in batches:
            ids, keys, sizes, sigs, tokens = [], [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(t, width)
                ids.append(d)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(_bitmap(s).tobytes() if len(s) else None)
                tokens.append(ordered_prefix(s) if len(s) and d is not None else s[:0])
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
            flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()),
                 pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["doc_id", "key", "n", "sig", "prefix"])

    sets = scratch.stored(arrow_pass(docs, describe, "doc_id long, key binary, n long, sig binary, prefix array<long>"), "join-sets")
    # one node for each distinct set
    nodes = scratch.stored(sets.where("n > 0 and doc_id is not null").groupBy("key")
                           .agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("prefix").alias("prefix")), "join-nodes")
    listed = nodes.select(F.explode("prefix").alias("token"), "id", "n")
    under = scratch.stored(listed.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1"), "join-candidates")
    weights = under.groupBy("id").agg(F.sum("df").alias("weight"))
    heads = scratch.stored(under.select("token", "id", "n").join(weights, "id").groupBy("token").agg(F.max(F.struct("weight", F.bitwise_not("id"), "id", "n")).alias("hub"))
                           .select("token", F.col("hub.id").alias("head"), F.col("hub.n").alias("head_n")), "join-heads")

    def plausible(batches):
        for b in batches:
            n_a, n_b = b.column(1).to_numpy(), b.column(4).to_numpy()
            sa, sb = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, BITS // 8) for k in (2, 5))
            need = -(-per100 * (n_a + n_b) // (100 + per100))
            ok = (need <= np.minimum(n_a, n_b)) & (np.bitwise_count(sa & ~sb).sum(axis=1) <= n_a - need)
            ok &= np.bitwise_count(sb & ~sa).sum(axis=1) <= n_b - need
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(3).filter(pa.array(ok))], names=["a", "b"])

    def wide(batches):
        for b in batches:
            n_a, n_b = b.column(1).to_numpy(), b.column(4).to_numpy()
            sa, sb = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(-1, WIDE // 64) for k in (2, 5))
            need = -(-per100 * (n_a + n_b) // (100 + per100))
            ok = (np.bitwise_count(sa & ~sb).sum(axis=1) <= n_a - need) & (np.bitwise_count(sb & ~sa).sum(axis=1) <= n_b - need)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(3).filter(pa.array(ok))], names=["a", "b"])

    def exact(batches):
        for b in batches:
            a, c = [], []
            for i, x, j, y in zip(*(b.column(k).to_pylist() for k in range(4))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= per100 * (len(x) + len(y) - both):
                    a.append(i), c.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    def bitmaps_of(batches):
        for b in batches:
            sets = [shingles(t, width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_bitmap(s, WIDE).tobytes() for s in sets], pa.binary())],
                                             names=["id", "n", "sig"])

    def tokens_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, width).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "tokens"])

    def sided(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(table.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
        return pairs.select(*(c for side in ("a", "b") for c in (side, *(f"{x}_{side}" for x in columns))))

    def made_of(ids: DataFrame, fn, schema: str) -> DataFrame:
        """``fn`` over the texts of ``ids``, where they are read: what is made of them is shuffled, not the texts."""
        made = arrow_pass(likely(docs, ids, "doc_id").select("doc_id", "text"), fn, schema)
        return made.join(ids.distinct().withColumnRenamed("doc_id", "id"), "id")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))

    def verified(pairs: DataFrame, what: str) -> DataFrame:
        """The pairs of ``a`` and ``b`` at or above the threshold. Wide bitmaps are made for just the documents in them, sets for those in what these leave."""
        own = scratch.stored(made_of(ends(pairs), bitmaps_of, "id long, n long, sig binary"), f"join-{what}-wide")
        pairs = scratch.stored(arrow_pass(sided(pairs, own, "n", "sig"), wide, "a long, b long").distinct(), f"join-{what}-close")
        own = scratch.stored(made_of(ends(pairs), tokens_of, "id long, tokens binary"), f"join-{what}-tokens")
        return arrow_pass(sided(pairs, own, "tokens"), exact, "a long, b long").distinct()

    compatible = f"{per100} * n <= 100 * {{0}} and {per100} * {{0}} <= 100 * n"
    stars = under.join(heads, "token").where("id <> head").where(compatible.format("head_n"))
    stars = stars.select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")).distinct()
    stars = scratch.stored(arrow_pass(sided(stars, nodes, "n", "sig"), plausible, "a long, b long"), "join-pairs")
    links = scratch.stored(verified(stars, "pairs"), "join-links")
    scratch.drop("join-pairs")
    labels = components(links, "join-star", scratch.stored)

    # pairs and trees, only under shingles that still hold two components, of sets with a neighbour of fitting size
    placed = under.select("token", "id", "n").join(labels, "id", "left").select("token", "id", "n", F.coalesce("component", "id").alias("c"))
    open_tokens = placed.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("token")

    def fitting(batches):
        """Drops rows whose neighbours by (shingle, size) are another shingle's or too far in size; rows at the ends stay."""
        held, kept = None, True          # the last row so far, and whether it stays
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            token, n = t.column(0).to_numpy(), t.column(3).to_numpy()
            near = (token[1:] == token[:-1]) & (per100 * n[1:] <= 100 * n[:-1])
            keep = np.concatenate([[kept], near])
            keep[:-1] |= near
            kept, keep[-1] = keep[-1], False
            yield from t.filter(pa.array(keep)).to_batches()
            held = t.slice(t.num_rows - 1).to_batches()[0]
        if held is not None:
            yield held

    def dealt(batches):
        """Pairs (``id``, ``other``) of the sets under shingles with few; the rows of other shingles, and of those at the ends, which may go on elsewhere."""
        def cut(t, all_rows):
            token, id_, c, n = (t.column(k).to_numpy() for k in range(4))
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            sizes = np.diff(np.append(starts, len(token)))
            many = (sizes > FEW) | np.isin(token[starts], list(all_rows))
            alone = np.repeat(many, sizes)
            first, second = [], []
            for k in range(1, FEW):
                i = np.flatnonzero((token[k:] == token[:-k]) & ~alone[k:] & (c[k:] != c[:-k]) & (per100 * n[k:] <= 100 * n[:-k]))
                first.append(i), second.append(i + k)
            first, second = np.concatenate(first), np.concatenate(second)
            rows = np.flatnonzero(alone)
            at = np.concatenate([rows, first])
            other = pa.array(np.concatenate([np.zeros(len(rows), np.int64), id_[second]]), mask=np.arange(len(at)) < len(rows))
            return pa.RecordBatch.from_arrays([*(pa.array(v[at]) for v in (token, id_, c)), other], names=["token", "id", "c", "other"])
        held, ends = None, set()            # the rows of the last shingle so far; shingles whose rows are not paired here
        for b in fitting(batches):
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
            token = t.column(0).to_numpy()
            if held is None and not ends:
                ends = {int(token[0])}
            last = int(token[-1])
            start = int(np.searchsorted(token, last))
            if len(token) - start > FEW or last in ends:        # enough is known of the last one, too
                start, ends = len(token), ends | {last}
            if start:
                yield cut(t.slice(0, start), ends)
                ends = {last} if start == len(token) else {int(token[0])}
            held = t.slice(start)
        if held is not None and held.num_rows:
            yield cut(held, {int(held.column(0)[0].as_py())})

    fit = scratch.stored(arrow_pass(placed.join(open_tokens, "token").select("token", "id", "c", "n").repartitionByRange("token", "n", "id")
                                    .sortWithinPartitions("token", "n", "id"), dealt, "token long, id long, c long, other long"), "join-fit")
    few = fit.where("other is not null").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    few = arrow_pass(sided(few, nodes, "n", "sig"), plausible, "a long, b long").distinct()
    many = scratch.stored(fit.where("other is null").join(heads, "token").select(F.col("head").alias("token"), "id", "c").distinct(), "join-many")
    broad = scratch.stored(made_of(many.select(F.col("id").alias("doc_id")), bitmaps_of, "id long, n long, sig binary").where("n > 0").distinct(), "join-broad")
    rest = many.join(broad, "id").repartitionByRange("token", "n", "id").sortWithinPartitions("token", "n", "id")

    def trees(batches):
        """Runs of one hub's sets, cut into blocks; a block is one tree."""
        def packed(t, rows):
            i, c, n, s = zip(*rows)
            pack = lambda v: np.array(v, np.int64).tobytes()
            return t, i[0], min(n), max(n), c[0] if min(c) == max(c) else None, pack(i), pack(c), pack(n), b"".join(s)
        out, token, run, held = [], None, [], 0
        for b in batches:
            for t, i, c, n, s in zip(*(b.column(k).to_pylist() for k in range(5))):
                if t != token or len(run) == BLOCK:
                    if run:
                        out.append(packed(token, run))
                    token, run = t, []
                run.append((i, c, n, s))
            held += b.num_rows
            if out and held > 4 * BLOCK:
                yield batch(out)
                out, held = [], 0
        if run:
            out.append(packed(token, run))
        if out:
            yield batch(out)

    names = ["token", "block", "lo", "hi", "one", "ids", "cs", "ns", "sigs"]

    def batch(rows):
        kinds = [pa.int64()] * 5 + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)

    blocks = scratch.stored(arrow_pass(rest.select("token", "id", "c", "n", "sig"), trees,
                               "token long, block long, lo long, hi long, one long, ids binary, cs binary, ns binary, sigs binary"), "join-trees")
    x, y = (blocks.select("token", *(F.col(c).alias(f"{c}_{s}") for c in names[1:])) for s in "xy")
    met = x.join(y, "token").where("(block_x < block_y or (block_x = block_y and ids_x <= ids_y)) and (one_x is null or one_y is null or one_x <> one_y)"
                                   f" and {per100} * lo_x <= 100 * hi_y and {per100} * lo_y <= 100 * hi_x")

    def walk(batches):
        def built(ids, cs, ns, sigs):
            return np.frombuffer(ids, np.int64), _levels(np.frombuffer(ns, np.int64), np.frombuffer(cs, np.int64),
                                                         np.frombuffer(sigs, np.uint64).reshape(-1, WIDE // 64))
        for b in batches:
            found: set[tuple[int, int]] = set()
            for px, py in zip(zip(*(b.column(k).to_pylist() for k in range(4))), zip(*(b.column(k).to_pylist() for k in range(4, 8)))):
                ids_x, x = built(*px)
                same = px[0] == py[0]
                ids_y, y = (ids_x, x) if same else built(*py)
                for i, j in _walk(x, y, same, per100):
                    u, v = ids_x[i], ids_y[j]
                    found.update(zip(np.minimum(u, v).tolist(), np.maximum(u, v).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())],
                                             names=["a", "b"])
    pairs = arrow_pass(met.select(*(f"{c}_{s}" for s in "xy" for c in ("ids", "cs", "ns", "sigs"))), walk, "a long, b long")
    pairs = scratch.stored(pairs.union(few).distinct(), "join-pairs")
    scratch.drop("join-trees", "join-star", "join-candidates", "join-heads", "join-fit", "join-many", "join-broad")
    links = scratch.stored(links.union(verified(pairs, "pairs")), "join-all-links")
    scratch.drop("join-pairs", "join-links")
    final = components(links, "join-final", scratch.stored)
    of_key = nodes.join(final, "id", "left").select("key", F.coalesce("component", "id").alias("component_id"))
    result = (sets.drop("prefix", "sig").join(of_key, "key", "left")
              .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))
    result = stored(result, "join-result")
    scratch.drop()
    return result
