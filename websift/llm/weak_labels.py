"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the counts of vote
patterns estimates how each labeller votes on good and on bad documents, and so the posterior of each pattern. The
posteriors are soft labels for a linear scorer over hashed word shapes, which also judges what the labellers leave
open. Votes and pattern counts come from all documents; only the scorer is fitted on a bounded sample.
"""

from __future__ import annotations

import sys
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from websift.llm.common import arrow_pass, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIM = 1 << 12               # hashed features
SHARDS = 8                  # the sample is fitted in shards whose weights are averaged
# Frequent function words of the languages at hand.
FUNCTION_WORDS = frozenset(w.encode() for w in (
    "the of and to in a is that for it with as was on be at by this are or from "
    "der die und das ist nicht ein eine mit zu den von für auf dem im sich des als auch "
    "le la les de des et en un une est que qui du dans pour pas sur au par ne ce "
    "el los las y que en un una es se del por con para no su al lo como más").split())
_SHAPE = bytes(0x41 if 0x41 <= c <= 0x5A else 0x61 if 0x61 <= c <= 0x7A or c >= 0x80 else 0x30 if 0x30 <= c <= 0x39 else c for c in range(256))
_STRIP = b".,;:!?\"'()"


def measures(text: str | None) -> tuple[dict[str, float], Counter]:
    """Shares that the labellers look at, and the counted shapes of words: letters, capitals and digits become a, A and 0."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, high = counts[0x41:0x5B].sum(), counts[0x61:0x7B].sum(), counts[0x80:].sum()
    letters = upper + lower + high
    blank = counts[[0x20, *range(9, 14)]].sum()
    plain = counts[[0x2C, 0x2E]].sum()
    digits = counts[0x30:0x3A].sum()
    symbols = len(data) - letters - blank - plain - digits
    tokens = Counter(words)
    known = sum(c for w, c in tokens.items() if w.strip(_STRIP).lower() in FUNCTION_WORDS)
    m = {"n": n, "upper": upper / max(1, upper + lower), "symbols": symbols / max(1, len(data) - blank),
         "pipes": counts[0x7C] / max(1, n), "repeats": sum(map(bytes.__eq__, words[1:], words)) / max(1, n - 1),
         "distinct": len(tokens) / max(1, n), "top": max(tokens.values(), default=0) / max(1, n), "known": known / max(1, n),
         "stops": counts[[0x2E, 0x3F]].sum() / max(1, n), "length": (len(data) - blank) / max(1, n), "shouts": counts[0x21] / max(1, n)}
    return m, Counter(data.translate(_SHAPE).split())


def _between(x: float, good: bool, bad: bool) -> int:
    return 1 if good else -1 if bad else 0


#: Labellers: 1 good, -1 bad, 0 no vote.
LABELLERS = {
    "capitals": lambda m: _between(m, m["upper"] < 0.12, m["upper"] > 0.3),
    "symbols": lambda m: _between(m, m["symbols"] < 0.02, m["symbols"] > 0.08),
    "tables": lambda m: _between(m, False, m["pipes"] > 0.15),
    "repeats": lambda m: _between(m, m["repeats"] < 0.05, m["repeats"] > 0.2),
    "variety": lambda m: _between(m, m["distinct"] > 0.4, m["n"] >= 30 and m["distinct"] < 0.2),
    "top word": lambda m: _between(m, m["n"] >= 30 and m["top"] < 0.12, m["n"] >= 30 and m["top"] > 0.2),
    "function words": lambda m: _between(m, m["known"] > 0.15, m["n"] >= 20 and m["known"] < 0.04),
    "sentences": lambda m: _between(m, 0.02 < m["stops"] < 0.5, m["n"] >= 40 and m["stops"] < 0.005),
    "word length": lambda m: _between(m, 3 < m["length"] < 8, m["length"] < 2 or m["length"] > 14),
    "shouts": lambda m: _between(m, False, m["shouts"] > 0.2),
}


def votes(m: dict[str, float]) -> str:
    """One of ``+ - 0`` for each labeller. A text without words gets no votes."""
    return "".join("0+-"[vote(m)] if m["n"] else "0" for vote in LABELLERS.values())


def features(m: dict[str, float], shapes: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shapes (first two and last three characters) and coarse shares, with weights of length 1 together."""
    f: Counter = Counter()
    for s, c in shapes.items():
        f[s[:2] + s[-3:]] += c / m["n"]
    for name in ("repeats", "distinct", "top", "known"):
        f[b"%s=%d" % (name.encode(), int(m[name] * 10))] += 0.5
    index = np.fromiter((xxhash.xxh3_64_intdigest(k) % DIM for k in f), np.int32, len(f))
    value = np.sqrt(np.fromiter(f.values(), np.float64, len(f)))
    return index, (value / max(np.sqrt((value ** 2).sum()), 1e-9)).astype(np.float32)


def estimate(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of good for each vote pattern, and the labellers' vote rates as [labeller, bad or good, none/good/bad].

    Labellers are taken as independent given the class. A labeller starts out right four times in five.
    """
    names = sorted(patterns)
    if not names:
        return {}, np.zeros((len(LABELLERS), 2, 3))
    v = np.array([["0+-".index(c) for c in p] for p in names])
    n = np.array([patterns[p] for p in names], float)
    one = np.eye(3)[v]                                                      # pattern, labeller, vote
    lean = (one[:, :, 1] - one[:, :, 2]).sum(axis=1)
    post = 1 / (1 + np.exp(-lean * np.log(4.0)))
    for _ in range(rounds):
        w = np.stack([1 - post, post], axis=1) * n[:, None]
        rates = np.einsum("pc,plv->lcv", w, one) + 1.0                      # one vote of each kind beforehand
        rates /= rates.sum(axis=2, keepdims=True)
        prior = (w.sum(axis=0) + 1) / (w.sum() + 2)
        spoken = one * (np.arange(3) != 0)                                  # a missing vote says nothing
        given = rates[:, :, 1:] / rates[:, :, 1:].sum(axis=2, keepdims=True)
        log = np.log(prior)[None, :] + np.einsum("plv,lcv->pc", spoken[:, :, 1:], np.log(given))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(names, post.tolist())), rates


def _fit(index: list, value: list, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Logistic regression of soft labels by Adam over the whole shard; the last weight is the constant."""
    rows = np.repeat(np.arange(len(y)), [len(i) for i in index])
    i, x = np.concatenate(index), np.concatenate(value).astype(float)
    w, m, s = np.zeros(DIM + 1), np.zeros(DIM + 1), np.zeros(DIM + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, x * w[i], len(y)) + w[DIM]
        e = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        g = np.append(np.bincount(i, x * e[rows], DIM), e.sum()) / len(y) + 1e-4 * np.append(w[:DIM], 0)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8)
    return w


def weak_label_quality(docs: DataFrame, train_rows: int = 20_000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
                       carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the ``carried`` columns, ``votes``, ``posterior``, ``score`` and ``keep`` of every row.

    ``train_rows`` bounds the distinct texts that the scorer is fitted on: drawn by a hash of the text, each once, however
    many copies it has. No rows give none; long texts are measured whole. A text that is null or
    has no words gets no votes, the prior as posterior, score 0, and is not kept. Equal texts get equal results. With nothing
    to fit on, the score is the posterior. Columns not named are left out; ``carried`` may not name an output column.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *carried)
    share = min(1.0, train_rows / max(1, docs.count()))

    def look(batches):
        for b in batches:
            found, index, value, shard, drawn = [], [], [], [], []
            for t in b.column(0).to_pylist():
                m, shapes = measures(t)
                found.append(votes(m))
                h = xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "replace"))
                i, x = features(m, shapes) if m["n"] and h < share * 2 ** 64 else (None, None)
                index.append(i), value.append(x), shard.append(None if i is None else h % SHARDS), drawn.append(None if i is None else h >> 1)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(shard, pa.int32()), pa.array(drawn, pa.int64()), pa.array(index, pa.list_(pa.int32())),
                                              pa.array(value, pa.list_(pa.float32()))], names=["votes", "shard", "drawn", "index", "value"])
    seen = stored(arrow_pass(docs.select("_text"), look, "votes string, shard int, drawn long, index array<int>, value array<float>"), "votes")
    # at most 3 ** len(LABELLERS) patterns
    post, _ = estimate({r["votes"]: r["count"] for r in seen.groupBy("votes").count().collect()})

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("drawn")
        w = _fit(list(rows["index"]), list(rows["value"]), rows["votes"].map(post).to_numpy(float))
        return pd.DataFrame({"rows": [len(rows)], "w": [w.tolist()]})
    # a text is drawn with all its copies, and then counts once; a shard holds no more than its part of ``train_rows``
    first = Window.partitionBy("shard").orderBy("drawn")
    sample = (seen.where("shard is not null").dropDuplicates(["shard", "drawn"])
              .withColumn("place", F.row_number().over(first)).where(F.col("place") <= max(1, train_rows // SHARDS)).drop("place"))
    fitted = sorted(map(tuple, sample.groupBy("shard").applyInPandas(fit, "rows long, w array<double>").collect()))    # SHARDS rows
    weights = np.average([w for _, w in fitted], axis=0, weights=[n for n, _ in fitted]) if fitted else None

    def judge(batches):
        for b in batches:
            found, posterior, score = [], [], []
            for t in b.column(1).to_pylist():
                m, shapes = measures(t)
                v = votes(m)
                p = post[v]
                if not m["n"]:
                    s = 0.0
                elif weights is None:
                    s = p
                else:
                    i, x = features(m, shapes)
                    s = float(1 / (1 + np.exp(-np.clip((weights[i] * x).sum() + weights[DIM], -50, 50))))
                found.append(v), posterior.append(p), score.append(s)
            columns = [c for i, c in enumerate(b.columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(posterior, pa.float64()), pa.array(score, pa.float64()),
                                              pa.array([s >= threshold for s in score], pa.bool_())], names=names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "_text")
    names = [c for c in docs.columns if c != "_text"] + ["votes", "posterior", "score", "keep"]
    return arrow_pass(docs, judge, f"{kinds}, votes string, posterior double, score double, keep boolean")
