"""Exact nearest neighbours by a block matrix join.

Queries and candidates are quantised to int8, each vector with its own scale, and packed into tiles. A pair of tiles
gives all its inner products at once; they bound each distance from both sides by the known quantisation errors. A
candidate whose lower bound is above the query's k-th upper bound cannot be among the nearest; the survivors'
distances are computed again from the original vectors in double precision. Each task keeps a heap of k for each query,
and the heaps are merged by query.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from websift.llm.common import arrow_pass

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERIES_IN_TILE, ROWS_IN_TILE = 256, 1024
STRIPES, ROWS_IN_STRIPE = 64, 1 << 18       # candidates are dealt to stripes: at least so many, of so many rows on average
HEAPS = 1 << 16                             # heaps a task holds before it hands them on


def _quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the length of what rounding left over, of each row. Lengths beyond the doubles are infinite."""
    scale = np.abs(v).max(axis=1) / 127
    scale[scale == 0] = 1
    with np.errstate(over="ignore"):
        codes = np.clip(np.rint(v / scale[:, None]), -127, 127).astype(np.int8)
        return codes, scale, np.sqrt(((v - codes * scale[:, None]) ** 2).sum(axis=1))


def _bounds(q: tuple, c: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible distance of every pair of a query tile and a candidate tile.

    Products of int8 codes sum exactly in float32 while the dimension stays below 1,040; beyond, in float64. Where squares leave
    the doubles there is no bound: least 0, greatest infinite. Squares that vanish are in the absolute slack.
    """
    (qc, qs, qe), (cc, cs, ce) = q, c
    kind = np.float32 if qc.shape[1] < 1040 else np.float64
    dot = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64)
    length = lambda x, s: (x.astype(np.float64) ** 2).sum(axis=1) * s * s
    with np.errstate(over="ignore", invalid="ignore"):
        top = length(qc, qs)[:, None] + length(cc, cs)[None, :]
        near = np.sqrt(np.maximum(top - 2 * dot * qs[:, None] * cs[None, :], 0))
        slack = qe[:, None] + ce[None, :] + 1e-7 * np.sqrt(top) + 1e-150    # triangle inequality, and rounding of doubles
        low, high = np.maximum(near - slack, 0), near + slack
    unknown = ~np.isfinite(high)
    low[unknown], high[unknown] = 0, np.inf
    return low, high


def _distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of each row of c to q: squares added component by component, in order, so that equal vectors get equal distances."""
    total = np.zeros(len(c))
    with np.errstate(over="ignore"):
        for i in range(len(q)):
            d = c[:, i] - q[i]
            total += d * d
    return np.sqrt(total)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` nearest rows of each query by Euclidean distance.

    Candidates are all rows but those of the query's own id; with fewer than ``k`` all are returned. Ties go to the smaller id.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids. Of rows with one id
    the smallest vector counts. Vectors of another length than the query's are no candidates. Distances whose squares leave the doubles
    are infinite, as they are when added plainly, and tie. No rows give none. Other columns are left out.
    """
    good = vectors.withColumn("_q", is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), "_q")
    good = good.where("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    good = good.groupBy("id").agg(F.min(F.struct("v", "_q")).alias("s")).select("id", "s.v", F.col("s._q").alias("q"), F.size("s.v").alias("d"))

    def tiles(rows: int):
        def pack(batches):
            held: dict[int, list] = {}

            def tile(d, got):
                v = np.concatenate([x for _, x in got]).reshape(-1, d)
                codes, scale, error = _quantised(v)
                return (d, np.concatenate([i for i, _ in got]).tobytes(), codes.tobytes(), scale.tobytes(), error.tobytes(), v.tobytes())

            def batch(out):
                kinds = [pa.int64()] + [pa.binary()] * 5
                return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=TILE)
            for b in batches:
                ds = b.column(2).to_numpy()
                for d in np.unique(ds):
                    own = b.filter(pa.array(ds == d))
                    ids, flat = own.column(0).to_numpy(), own.column(1).flatten().to_numpy().reshape(-1, d)
                    for i in range(0, len(ids), rows):
                        held.setdefault(int(d), []).append((ids[i:i + rows], flat[i:i + rows]))
                    if sum(len(i) for i, _ in held[int(d)]) >= rows:
                        yield batch([tile(int(d), held.pop(int(d)))])
            if held:
                yield batch([tile(d, got) for d, got in held.items()])
        return pack

    TILE = ["d", "ids", "codes", "scale", "error", "v"]  # noqa: N806
    schema = "d long, ids binary, codes binary, scale binary, error binary, v binary"
    columns = [F.col("id"), F.col("v"), F.col("d").cast("long")]
    q = arrow_pass(good.where("q").select(*columns), tiles(QUERIES_IN_TILE), schema)
    c = arrow_pass(good.select(*columns), tiles(ROWS_IN_TILE), schema)
    # a query tile goes to every stripe, a candidate tile to one
    stripes = max(STRIPES, -(-good.count() // ROWS_IN_STRIPE))
    q = q.select("d", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), *(F.col(x).alias(f"q_{x}") for x in TILE[1:]))
    c = c.select("d", F.pmod(F.xxhash64("ids"), F.lit(stripes)).cast("int").alias("stripe"), *(F.col(x).alias(f"c_{x}") for x in TILE[1:]))
    met = c.join(q, ["d", "stripe"]).select("d", *(f"{s}_{x}" for s in "qc" for x in TILE[1:]))

    def search(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def heaps():
            for i in range(0, len(best), 500):
                part = list(best.items())[i:i + 500]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _ in part], [len(x[0]) for _, x in part])),
                                                  pa.array(np.concatenate([x[0] for _, x in part])), pa.array(np.concatenate([x[1] for _, x in part]))],
                                                 names=["query_id", "vec_id", "score"])

        def unpacked(d, ids, codes, scale, error, v):
            ids = np.frombuffer(ids, np.int64)
            return ids, (np.frombuffer(codes, np.int8).reshape(-1, d), np.frombuffer(scale), np.frombuffer(error)), np.frombuffer(v).reshape(-1, d)
        for b in batches:
            for n in range(b.num_rows):
                row = [b.column(i)[n].as_py() for i in range(11)]
                d = row[0]
                qi, qq, qv = unpacked(d, *row[1:6])
                ci, cq, cv = unpacked(d, *row[6:11])
                low, high = _bounds(qq, cq)
                for r, i in enumerate(qi.tolist()):
                    own = ci != i
                    ids, dist = best.get(i, (np.zeros(0, np.int64), np.zeros(0)))
                    known = np.concatenate([high[r][own], dist])
                    limit = np.partition(known, k - 1)[k - 1] if len(known) >= k else np.inf
                    at = np.flatnonzero(own & (low[r] <= limit))
                    if len(at):
                        ids, dist = np.concatenate([ids, ci[at]]), np.concatenate([dist, _distances(qv[r], cv[at])])
                        top = np.lexsort((ids, dist))[:k]
                        best[i] = (ids[top], dist[top])
                if len(best) >= HEAPS:              # another heap of the same query is merged with this one in the end
                    yield from heaps()
                    best.clear()
        yield from heaps()

    found = arrow_pass(met, search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
with v as (select vec_id, embedding::double[] as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
             and len(list_filter(embedding, lambda x: x <> 0)) > 0),
d as (select q.vec_id as query_id, c.vec_id,
        sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda x, y: x + y)) as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0),
r as (select query_id, (row_number() over (partition by query_id order by score, vec_id))::int as rank, vec_id, score from d)
select query_id, rank, vec_id, score from r where rank <= 10
"""
