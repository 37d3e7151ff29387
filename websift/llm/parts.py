"""Questions and answers between parts of a corpus and shards of a key space.

A pass over the corpus cuts it into parts of bounded size and lists each part's distinct keys once, however often they stand there.
The lists are dealt to shards of the key space; a shard answers every part that asked, and the answers travel back to the parts. So a
key that stands in a third of all documents is one entry for each part, and no document is joined with its keys row by row.
Parts are numbered in the pass that writes them down; a task that runs again writes its own parts anew, and one of both is committed.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from websift.llm.common import arrow_pass

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART_BYTES = 8 << 20        # text in a part, one document at least
SHARD_KEYS = 1 << 20        # entries in a shard, on average


def part_numbers():
    """Numbers for the parts that this task makes, unique over tasks."""
    context = TaskContext.get()
    n = (context.partitionId() if context else 0) << 32
    while True:
        yield n
        n += 1


def led(first: DataFrame, then: DataFrame, key: str) -> DataFrame:
    """Both tables dealt by ``key``; in its task, a key's rows of ``first`` come before those of ``then`` (``late``)."""
    both = first.withColumn("late", F.lit(False)).unionByName(then.withColumn("late", F.lit(True)), allowMissingColumns=True)
    return both.repartition(key).sortWithinPartitions(key, "late")


def shard_count(asked: DataFrame, column: str, width: int) -> int:
    """How many shards hold the entries of ``width`` bytes in the lists of ``column``."""
    total = asked.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, -(-total // (width * SHARD_KEYS)))


def dealt(asked: DataFrame, shards: int, kinds: list, shard_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``shard, part`` and each part's lists cut by shard. ``asked`` has ``part`` and binary lists, the keys first, with dtypes ``kinds``."""
    names = [c for c in asked.columns if c != "part"]

    def cut(batches):
        for b in batches:
            rows = []
            for part, *lists in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                lists = [np.frombuffer(x, k) for x, k in zip(lists, kinds)]
                shard = (shard_of(lists[0]) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                ends = np.searchsorted(shard[order], np.arange(shards + 1)) if shards < len(order) else None
                if ends is None:
                    found, at = np.unique(shard[order], return_index=True)
                    spans = zip(found.tolist(), at.tolist(), [*at[1:].tolist(), len(order)])
                else:
                    spans = ((s, ends[s], ends[s + 1]) for s in range(shards) if ends[s] < ends[s + 1])
                rows.extend((s, part, *(x[order[i:j]].tobytes() for x in lists)) for s, i, j in spans)
            yield from in_batches(rows, [pa.int64(), pa.int64()] + [pa.binary()] * len(names), ["shard", "part", *names])
    fields = "".join(f", {n} binary" for n in names)
    return arrow_pass(asked.select("part", *names), cut, f"shard long, part long{fields}")


def in_batches(rows: list, kinds: list, names: list, size: int = 500):
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows[i:i + size]), kinds)], names=names)


def reduced(keys: np.ndarray, *sums: tuple[np.ufunc, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct ``keys`` in order, and for each the values of its rows drawn together by the given function."""
    if not len(keys):
        return (keys, *(v for _, v in sums))
    order = np.argsort(keys, kind="stable") if keys.dtype.names is None else np.lexsort([keys[n] for n in reversed(keys.dtype.names)])
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[at], *(f.reduceat(v[order], at) for f, v in sums))


def folded_shards(batches, kinds: list, functions: list, most: int = 1 << 22):
    """For each shard in turn: its number, and its distinct keys with their values drawn together. Batches hold ``shard`` and lists."""
    shard, held, size = None, [], 0

    def fold():
        lists = [np.concatenate(x) for x in zip(*held)]
        return reduced(lists[0], *zip(functions, lists[1:]))
    for b in batches:
        for s, *lists in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
            if s != shard:
                if held:
                    yield shard, fold()
                shard, held, size = s, [], 0
            held.append([np.frombuffer(x, k) for x, k in zip(lists, kinds)])
            size += len(held[-1][0])
            if size > most:
                held = [fold()]
                size = 0            # what is folded counts no more, so each fold sees `most` new entries
    if held:
        yield shard, fold()
