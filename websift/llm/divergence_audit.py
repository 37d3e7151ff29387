"""Source divergence audit over the group-term count matrix, held in K²-trees.

Groups are the sources of a language, terms its kept words. The matrix of counts is sparse: most terms stand in few sources. Its columns
are dealt to tiles; a tile is a K²-tree (k = 2), where each node that holds a count has four bits, one for each quadrant, and a
quadrant without counts is a zero bit and nothing below it. Pairs of groups walk the tree together, down the quadrants of both rows at
the same columns. Where both quadrants are zero, all cells below have the price of an absent term in their group, so the pair's
sum over them is a number of columns times one product, added at the end; only the other leaves are computed cell by cell.

Words are counted for each group inside the tasks before anything moves, so neither a hot source nor a hot word is one key's rows.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from websift.llm.common import arrow_pass, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TERM = re.compile(rb"[a-z\x80-\xff]+")      # of UTF-8 in lower case: letters a-z and all beyond ASCII
SCALE = 1_000_000_000
HELD = 400_000              # words of all groups that a task counts before it passes them on
TILE = 1 << 16              # counts in a tile, about
LEAF = 4                    # rows and columns of a leaf
FRONT = 1 << 15             # node pairs walked at once
BAND = 512                  # groups whose sums with as many others are held at once


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, df``: occurrences and documents of each term, from each task; and a row without term for each group."""
    def count(batches):
        n: dict = {}
        df: dict = {}

        def sent():
            for (lang, source), terms in n.items():
                found = [(None, 0, 0), *((t, k, df[lang, source][t]) for t, k in terms.items())]
                for i in range(0, len(found), 50_000):
                    t, k, d = zip(*found[i:i + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(t)), pa.array([source] * len(t)), pa.array(t, pa.binary()).cast(pa.string()),
                                                      pa.array(k, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "df"])
        for b in batches:
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                g = (lang, source)
                if g not in n:
                    n[g], df[g] = Counter(), Counter()
                found = TERM.findall(text.lower())
                n[g].update(found)
                df[g].update(set(found))
            if sum(map(len, n.values())) > HELD:
                yield from sent()
                n, df = {}, {}
        yield from sent()
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return arrow_pass(docs.select(*blank, text), count, "lang string, source string, term string, n long, df long")


def priced(count: str, total: str, size: str) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + size))``, exactly."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + 1 as decimal(20, 0))) div cast({total} + {size} as decimal(20, 0))")


def gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def prices(counts: np.ndarray, base: np.ndarray) -> np.ndarray:
    """``priced`` for arrays; ``base``: total + size of the count's group. Three digits at a time, so that nothing overflows below 9e15."""
    base = np.maximum(base, 1)
    out, rest = np.divmod(counts + 1, base)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, base)
        out = out * 1000 + more
    return out + 1


class CountTree:
    """K²-tree over cells ``(row, column, value)`` with four bits for each node, and dense leaves of ``LEAF`` rows and columns."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_rows: int, n_columns: int):
        self.side = LEAF
        while self.side < max(n_rows, n_columns):
            self.side *= 2
        r, c = rows // LEAF, columns // LEAF
        code, depth = np.zeros(len(rows), np.int64), (self.side // LEAF).bit_length() - 1
        for bit in reversed(range(depth)):
            code = code << 2 | (r >> bit & 1) << 1 | c >> bit & 1
        found, at = np.unique(code, return_inverse=True)
        self.leaves = np.zeros((len(found), LEAF, LEAF), np.int64)
        self.leaves[at, rows % LEAF, columns % LEAF] = values
        self.held = np.zeros((len(found), LEAF, LEAF), bool)
        self.held[at, rows % LEAF, columns % LEAF] = True
        self.levels = []            # from the root: bits of each node, and its first child's place in the next level
        for _ in range(depth):
            above, first = np.unique(found >> 2, return_index=True)
            bits = np.zeros(len(above), np.uint8)
            np.bitwise_or.at(bits, np.searchsorted(above, found >> 2), (1 << (found & 3)).astype(np.uint8))
            self.levels.append((bits, first.astype(np.int64)))
            found = above
        self.levels.reverse()
        self.empty = not len(found)

    def below(self, level: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        """The places in the next level of the quadrant (row bit, column bit) of nodes; -1 where it, or the node, is zero."""
        bits, first = self.levels[level]
        at = np.maximum(node, 0)
        before = np.bitwise_count(bits[at] & np.uint8((1 << quadrant) - 1))
        there = (node >= 0) & (bits[at] >> quadrant & 1 == 1)
        return np.where(there, first[at] + before, -1)


def pair_sums(tree: CountTree, base: np.ndarray, n_columns: int):
    """For bands of groups: first groups, and matrices of the columns computed cell by cell and of the sums of ``gap`` over these.

    In row g, column h: p from g, q from h. ``base``: total + size of each group.
    """
    n = len(base)
    absent = prices(np.zeros(n, np.int64), base)
    padded = np.ones(-(-n // LEAF) * LEAF, np.int64)
    padded[:n] = absent
    of_leaf = padded.reshape(-1, LEAF)
    last = len(tree.levels)
    for x in range(0, n, BAND):
        for y in range(x, n, BAND):
            done, sums = (np.zeros((2, BAND, BAND), np.int64) for _ in range(2))        # (x to y) and (y to x)
            waiting = [] if tree.empty else [(0, *(np.zeros(1, np.int64) for _ in range(5)))]
            while waiting:
                level, a, b, ra, rb, c = waiting.pop()
                if len(a) > FRONT:
                    half = len(a) // 2
                    waiting += [(level, *(v[s] for v in (a, b, ra, rb, c))) for s in (slice(half), slice(half, None))]
                    continue
                if level < last:
                    side = tree.side >> level + 1
                    parts = []
                    for i in (0, 1):
                        for j in (0, 1):
                            na, nb, nc = ra * 2 + i, rb * 2 + j, None
                            fits = (na * side < min(x + BAND, n)) & ((na + 1) * side > x) & (nb * side < min(y + BAND, n)) & ((nb + 1) * side > y) & (na <= nb)
                            if not fits.any():
                                continue
                            for k in (0, 1):
                                nc = c * 2 + k
                                ca, cb = tree.below(level, a, i * 2 + k), tree.below(level, b, j * 2 + k)
                                go = fits & ((ca >= 0) | (cb >= 0))             # two zero quadrants are priced at the end
                                if go.any():
                                    parts.append([v[go] for v in (ca, cb, na, nb, nc)])
                    if parts:
                        waiting.append((level + 1, *(np.concatenate(v) for v in zip(*parts))))
                    continue
                columns = np.clip(n_columns - c * LEAF, 0, LEAF)
                real = (np.arange(LEAF) < columns[:, None])[:, None, None, :]

                def cells(node, row):
                    none = of_leaf[row][:, :, None]
                    at = np.maximum(node, 0)
                    return np.where((node >= 0)[:, None, None] & tree.held[at], tree.leaves[at], none)
                p, q = cells(a, ra)[:, :, None, :], cells(b, rb)[:, None, :, :]
                square = (p - q) * (p - q) * real
                g = np.broadcast_to((ra * LEAF)[:, None, None] + np.arange(LEAF)[:, None] - x, (len(a), LEAF, LEAF))
                h = np.broadcast_to((rb * LEAF)[:, None, None] + np.arange(LEAF) - y, (len(a), LEAF, LEAF))
                inside = (g >= 0) & (g < BAND) & (h >= 0) & (h < BAND)
                g, h, width = g[inside], h[inside], np.broadcast_to(columns[:, None, None], inside.shape)[inside]
                np.add.at(done[0], (g, h), width)
                np.add.at(sums[0], (g, h), (square // q).sum(axis=3)[inside])
                # a block above the diagonal stands for its mirror image too
                upper = np.broadcast_to((ra < rb)[:, None, None], inside.shape)[inside]
                np.add.at(done[1], (h[upper], g[upper]), width[upper])
                np.add.at(sums[1], (h[upper], g[upper]), (square // p).sum(axis=3)[inside][upper])
            if x == y:
                yield x, y, done[0] + done[1], sums[0] + sums[1]
            else:
                yield x, y, done[0], sums[0]
                yield y, x, done[1], sums[1]


def _tile_sums(batches):
    """``lang, source, item, done, value`` of each tile. A tile's first row has its language's sources, its others a term's counts each."""
    key, names, place, base, rows, columns, values, size = None, [], {}, None, [], [], [], 0

    def finished():
        r, v = np.concatenate(rows), np.concatenate(values)
        c = np.repeat(np.arange(len(columns)), columns)
        # terms of the same sources side by side, so that zero quadrants are large
        at = np.concatenate([[0], np.cumsum(columns)[:-1]])
        mask = np.bitwise_or.reduceat(np.left_shift(1, r % 62), at)
        order = np.lexsort((mask, np.bitwise_count(mask)))
        turn = np.empty(len(order), np.int64)
        turn[order] = np.arange(len(order))
        tree = CountTree(r, turn[c], prices(v, base[r]), len(names), len(columns))
        for x, y, done, sums in pair_sums(tree, base, len(columns)):
            g, h = np.nonzero(done)
            keep = (g + x != h + y) & (g + x < len(names)) & (h + y < len(names))
            g, h = g[keep], h[keep]
            for i in range(0, len(g), 50_000):
                s = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(g[s])), pa.array([names[k + x] for k in g[s]]), pa.array([names[k + y] for k in h[s]]),
                                                  pa.array(done[g[s], h[s]]), pa.array(sums[g[s], h[s]])], names=["lang", "source", "item", "done", "value"])
    for b in batches:
        for lang, tile, late, sources, counts in zip(*(b.column(i).to_pylist() for i in range(5))):
            if (lang, tile) != key:
                if rows:
                    yield from finished()
                key, rows, columns, values = (lang, tile), [], [], []
            if not late:
                names, base = sources, np.array(counts, np.int64)
                place = {s: i for i, s in enumerate(names)}
                continue
            rows.append(np.fromiter((place[s] for s in sources), np.int64, len(sources)))
            values.append(np.array(counts, np.int64))
            columns.append(len(sources))
    if rows:
        yield from finished()


def divergence_audit(docs: DataFrame, min_docs: int = 3, ranks: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source's word use is from the other sources and from its language.

    A language keeps the terms in at least ``min_docs`` of its documents, V of them. A group (source of a language, or the whole
    language) gives each the price ``1 + floor(1e9 * (count + 1) / (N + V))``, N its count of all kept terms. With prices p and q the gap
    is ``floor((p - q)² / q)``. Part ``pair``: gaps to each other source of the language, summed over the kept terms. Part ``term``: gaps
    to the language of terms that the source has and that it prices higher, the first ``ranks``. Ranks go by falling value, then item.

    Null texts, languages and sources are empty ones; an empty text adds to no count but its group is there. Each row is a document, equal
    rows too. A text or a term of any length is taken whole. Ties of value are ranked by item in UTF-8 order. An empty table gives an
    empty one. Other columns are not looked at. The pairs of sources are the result, so a language's number of sources is taken to be
    one whose square can be written; sums of 512 by 512 of them are in memory at once.
    """
    cells = count_terms(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    terms = (cells.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("by"))
             .where(f"term is null or df >= {int(min_docs)}").drop("df"))
    terms = stored(terms, "audit-terms")          # the rows without term list the groups
    langs = terms.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("term").alias("v"), F.sum(F.size("by")).alias("cells"))
    groups = (terms.select("lang", F.explode("by").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("group_n"))
              .join(langs, "lang"))
    groups = stored(groups, "audit-groups")
    langs = groups.groupBy("lang").agg(F.first("v").alias("v"), F.first("cells").alias("cells"), F.sort_array(F.collect_list(F.struct("source", "group_n"))).alias("x"))
    langs = langs.where("v > 0").select("lang", F.ceil(F.col("cells") / TILE).cast("int").alias("tiles"), F.col("x.source").alias("sources"),
                                        F.transform("x.group_n", lambda k: k + F.col("v")).alias("counts"))
    heads = langs.select("lang", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(False).alias("late"), "sources", "counts")
    tile = F.pmod(F.xxhash64("term"), "tiles").cast("int")
    columns = (terms.where("term is not null").join(langs.select("lang", "tiles"), "lang")
               .select("lang", tile.alias("tile"), F.lit(True).alias("late"), F.col("by.source").alias("sources"), F.col("by.n").alias("counts")))
    tiles = heads.unionByName(columns).repartition("lang", "tile").sortWithinPartitions("lang", "tile", "late")
    sums = (arrow_pass(tiles, _tile_sums, "lang string, source string, item string, done long, value long")
            .groupBy("lang", "source", "item").agg(F.sum("done").alias("done"), F.sum("value").alias("value")))
    g = groups.select("lang", "source", "v", priced("0", "group_n", "v").alias("p")).where("v > 0")
    g = g.unionByName(groups.where("v = 0").select("lang", "source", "v", F.lit(1).cast("long").alias("p")))
    h = g.select("lang", F.col("source").alias("item"), F.col("p").alias("q"))
    pairs = g.join(h, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
    absent = F.expr("v - coalesce(done, 0L)") * gap("p", "q")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("value", F.lit(0)) + absent).alias("value"))
    by_source = terms.where("term is not null").select("lang", "term", F.col("n").alias("of_lang"), F.explode("by").alias("x")).where("x.n > 0")
    by_source = (by_source.select("lang", F.col("x.source").alias("source"), "term", F.col("x.n").alias("k"), "of_lang").join(groups, ["lang", "source"])
                 .select("lang", "source", F.col("term").alias("item"), priced("k", "group_n", "v").alias("p"), priced("of_lang", "lang_n", "v").alias("q")))
    by_source = by_source.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", gap("p", "q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", rank).unionByName(by_source.withColumn("rank", rank).where(f"rank <= {int(ranks)}"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
tf AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS df FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM tf GROUP BY ALL HAVING sum(df) >= 3),
langs AS (SELECT lang, count(term)::HUGEINT AS v, coalesce(sum(n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
groups AS (SELECT lang, source, coalesce(sum(tf.n), 0)::HUGEINT AS n
           FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT tf.* FROM tf JOIN kept USING (lang, term)) tf USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(tf.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(tf.n, 0) + 1)) // (g.n + l.v) AS p,
             1 + (1000000000::HUGEINT * (k.n + 1)) // (l.n + l.v) AS q
      FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN tf ON tf.lang = g.lang AND tf.source = g.source AND tf.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 200"""
