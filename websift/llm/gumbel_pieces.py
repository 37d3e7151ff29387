"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

All segmentations of a text into pieces form a lattice; a unigram model over the pieces makes them a distribution. Adding Gumbel
noise to the log-probability of each segmentation and taking the k largest gives k distinct samples. A perturbed A* search finds
them without listing segmentations: the largest perturbed value below a partial segmentation is one Gumbel variable at the logarithm of
its exact total probability (a backward pass over the lattice gives it), so an exact bound of each open branch waits in a heap. The
best branch is completed, what it leaves aside at each piece becomes a new branch with its own truncated Gumbel value.

Pieces do not cross blanks or line ends, so the lattice is a chain of the lattices of words. These are built once per distinct word
in a task, and all words of a text are walked in step with array operations. The pieces and ranks come from a given BPE model;
the unigram probabilities follow Zipf's law over its ranks. Nothing is trained.
"""

from __future__ import annotations

import heapq
import re
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from websift.llm.common import arrow_pass, mix64

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
# Where no piece can cross: around line ends and before blanks; and, if the model's pieces keep kinds of characters apart, between those.
_WORDS = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")
_LETTER, _OTHER = r"[^\W\d_²]", rf"(?:[^\w{BLANK}\n]|[_²])"
_FINE = re.compile(rf"\n|{BLANK}*{_LETTER}+|{BLANK}*{_OTHER}+|{BLANK}+|\d")
_BASE, _STEP, _TURN, _WORD, _BRANCH = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
EDGES = 7_000_000           # of word lattices kept in a task before they are built anew
GROUP = 100                 # texts walked together
SLOTS = 16                  # bits of a hash that name its slot in a table of pieces


def load_pieces(model: str = MODEL) -> list[str]:
    """The model's pieces by id. Read on the driver; tasks get the list (some 32,000 short strings)."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())]


class Lattices:
    """Lattices of words, as arrays over edges. Nodes are places in words; a node's edges stand together."""

    def __init__(self, pieces: list[str]):
        special = {"<unk>", "<s>", "</s>"}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if re.fullmatch("<0x[0-9A-F]{2}>", p)}
        spelt = set(self.byte.values())
        normal = [i for i, p in enumerate(pieces) if p not in special and i not in spelt]
        # ids of a BPE model stand in order of rank
        mass = sum(1 / (r + 3) for r in range(len(normal) + len(self.byte)))
        log = {i: -np.log((r + 3) * mass) for r, i in enumerate(normal)}
        self.byte_log = -np.log((len(normal) + 3) * mass)
        self.cut = _FINE if all(_FINE.fullmatch(pieces[i]) for i in normal) else _WORDS
        self.longest = max((len(pieces[i]) for i in normal), default=1)
        # by length: tables of the pieces' hashes with ids and logarithms, and of what longer pieces begin with
        self.tables, self.prefixes = {}, {}
        by_length: dict[int, list[int]] = {}
        for i in normal:
            by_length.setdefault(len(pieces[i]), []).append(i)
        begun: set[str] = set()
        for n in range(self.longest, 0, -1):
            own = by_length.get(n, [])
            table, o = self._table(self._hash([pieces[i] for i in own], n))
            self.tables[n] = table, np.array(own, np.int32)[o], np.array([log[i] for i in own], float)[o]
            self.prefixes[n] = self._table(np.unique(self._hash(list(begun), n)))[0]
            begun = {p[:n - 1] for p in begun}.union(pieces[i][:n - 1] for i in own)
        self.clear()

    @staticmethod
    def _hash(strings: list[str], n: int) -> np.ndarray:
        codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64)
        h = np.zeros(len(codes), np.uint64)
        for k in range(n):
            h = h * _BASE + codes[:, k] + np.uint64(1)
        return h

    @staticmethod
    def _table(hashes: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """Hashes in order of their slots, each slot's first one (-1: none) and which are their slot's last; and that order."""
        slot = _slot(hashes)
        order = np.argsort(slot, kind="stable")
        slot, first = slot[order], np.full(1 << SLOTS, -1, np.int32)
        first[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        return (hashes[order], first, np.append(slot[1:] != slot[:-1], True)), order

    @staticmethod
    def _hits(hashes: np.ndarray, slots: np.ndarray, table: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are in ``table``, and where."""
        keys, first, last = table
        i = first[slots]
        some = np.flatnonzero(i >= 0)
        h, i = hashes[some], i[some]
        wrong = np.flatnonzero(keys[i] != h)
        while len(wrong):
            wrong = wrong[~last[i[wrong]]]
            i[wrong] += 1
            wrong = wrong[keys[i[wrong]] != h[wrong]]
        same = keys[i] == h
        return some[same], i[same]

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.n_edges = self.n_nodes = 0
        #: cumulative probability in the node, the likeliest edge first; logarithm of the probability; piece; next node or -1
        self.edges = {"cum": np.empty(1 << 16), "log": np.empty(1 << 16), "piece": np.empty(1 << 16, np.int32), "next": np.empty(1 << 16, np.int32)}
        self.first = np.zeros(1 << 15, np.int64)                # by node: its first edge, and one more for the end

    def starts(self, words: list[str]) -> np.ndarray:
        """First nodes of ``words``; unknown words must have been added."""
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def add(self, words: list[str]) -> None:
        """Builds the lattices of distinct new words together."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n, base = len(codes), self.n_nodes
        if not n:
            return
        end = np.repeat(np.cumsum(sizes), sizes)
        self.words.update(zip(words, (base + np.cumsum(sizes) - sizes).tolist()))
        at, h = np.arange(n), np.zeros(n, np.uint64)
        found = []
        single = np.zeros(n, bool)
        for k in range(1, self.longest + 1):
            h = h * _BASE + codes[at + k - 1] + np.uint64(1)
            slots = _slot(h)
            table, ids, logs = self.tables[k]
            if len(ids):
                hit, i = self._hits(h, slots, table)
                found.append((at[hit], np.full(len(hit), k), ids[i], logs[i]))
                if k == 1:
                    single[at[hit]] = True
            begins = self.prefixes[k]
            if not len(begins[0]):
                break
            more = np.flatnonzero(at + k < end[at])
            more = more[self._hits(h[more], slots[more], begins)[0]]
            at, h = at[more], h[more]
        # a character that is no piece is spelt in bytes
        odd = np.flatnonzero(~single)
        if len(odd):
            c = codes[odd].astype(np.int64)
            length = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            one = np.array([self.byte.get(x, 0) for x in range(128)], np.int64)
            found.append((odd, np.ones(len(odd), np.int64), np.where(c < 128, one[np.minimum(c, 127)], -1 - c).astype(np.int32), length * self.byte_log))
        i, k, piece, log = (np.concatenate(x) for x in zip(*found))
        # total probability of all ways to the word's end, nearest places first
        order = np.argsort(((end[i] - i) << 34) + (i << 6) + k)
        i, k, piece, log = i[order], k[order], piece[order], log[order]
        after = np.where(i + k == end[i], n, i + k)
        far = end[i] - i
        total = np.zeros(n + 1)
        edge_cuts = np.flatnonzero(np.concatenate([[True], far[1:] != far[:-1]]))
        for lo, hi in zip(edge_cuts, np.append(edge_cuts[1:], len(i))):
            w = log[lo:hi] + total[after[lo:hi]]
            seg = np.flatnonzero(np.concatenate([[True], i[lo + 1:hi] != i[lo:hi - 1]]))
            total[i[lo:hi][seg]] = np.logaddexp.reduceat(w, seg)
        q = log + total[after] - total[i]
        # likeliest first, in steps of a 4,096th; equal ones by length
        order = np.argsort((i << 26) + (np.minimum(-q * 4096, (1 << 20) - 1).astype(np.int64) << 6) + k)
        i, piece, after, q = i[order], piece[order], after[order], q[order]
        p = np.exp(q)
        sums = np.cumsum(p)
        first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        counts = np.diff(np.append(first, len(i)))
        cum = sums - np.repeat(sums[first] - p[first], counts)
        cum[first + counts - 1] = 2                             # the last edge takes what rounding leaves
        m = len(i)
        self.edges = {name: v if self.n_edges + m <= len(v) else np.concatenate([v[:self.n_edges], np.empty(self.n_edges + 2 * m, v.dtype)]) for name, v in self.edges.items()}
        if base + n >= len(self.first):
            self.first = np.concatenate([self.first[:base], np.empty(base + 2 * n + 1, np.int64)])
        here = slice(self.n_edges, self.n_edges + m)
        for name, v in (("cum", cum), ("log", np.minimum(q, 0)), ("piece", piece),
                        ("next", np.where(after == n, -1, base + after))):
            self.edges[name][here] = v
        self.first[base:base + n], self.first[base + n] = self.n_edges + first, self.n_edges + m
        self.n_edges, self.n_nodes = self.n_edges + m, base + n

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One sampled way from each node to its word's end: all edges in order, and which of ``nodes`` each belongs to."""
        first, cum, after = self.first, self.edges["cum"], self.edges["next"]
        steps, open_, cur = [], np.arange(len(nodes)), nodes
        length = np.zeros(len(nodes), np.int64)
        while len(open_):
            u = _uniform(seeds[open_] + _times(len(steps), _STEP))
            e = first[cur]
            wait = np.flatnonzero(u >= cum[e])
            while len(wait):
                e[wait] += 1
                wait = wait[u[wait] >= cum[e[wait]]]
            steps.append((open_, e))
            length[open_] += 1
            cur = after[e]
            more = cur >= 0
            open_, cur = open_[more], cur[more]
        offset = np.cumsum(length) - length
        edges = np.empty(int(length.sum()), np.int64)
        for k, (i, e) in enumerate(steps):
            edges[offset[i] + k] = e
        return edges, np.repeat(np.arange(len(nodes)), length)

    def top(self, texts: list[np.ndarray], rows: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text, as first nodes of its words with its row's seed: the k segmentations with the largest perturbed log-probabilities,
        as (edges, log-probability, perturbed value, log of inclusion). The texts' ways are walked together.
        """
        heaps: list[list] = [[] for _ in texts]
        found: list[list] = [[] for _ in texts]
        tick = 0
        # what each text walks next: (text, value, edges before, their words, logarithm before, first word, nodes)
        to_do = [(t, float(-np.log(-np.log(_number(row, 0, 0)))), np.zeros(0, np.int64), np.zeros(0, np.int64), 0.0, 0, nodes) for t, (nodes, row) in enumerate(zip(texts, rows))]
        for turn in range(1, k + 1):
            n_words = np.array([len(x[-1]) for x in to_do], np.int64)
            of = np.repeat(np.arange(len(to_do)), n_words)
            ordinal = np.arange(len(of)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
            row = np.array([rows[x[0]] for x in to_do], np.uint64)
            seeds = mix64(row[of] + _times(turn, _TURN) + ordinal.astype(np.uint64) * _WORD)
            edges, word = self.walk(np.concatenate([np.zeros(0, np.int64), *(x[-1] for x in to_do)]), seeds)
            logs = self.edges["log"][edges]
            of_edge = of[word]
            n_edges = np.bincount(of_edge, minlength=len(to_do))
            ends = np.cumsum(n_edges)
            sums = np.concatenate([[0.0], np.cumsum(logs)])
            base = sums[ends - n_edges]
            bound = np.array([x[1] for x in to_do])
            before = np.array([x[4] for x in to_do])
            # what each piece leaves aside is a branch: a Gumbel variable at the logarithm of its probability, below the way's own value
            open_ = np.flatnonzero(logs < -1e-12)
            o = of_edge[open_]
            place = before[o] + sums[open_] - base[o] + np.log(-np.expm1(logs[open_]))
            u = _uniform(mix64(row[o] + _times(turn, _BRANCH) + (open_ - (ends - n_edges)[o]).astype(np.uint64)))
            values = place - np.log(np.exp(np.minimum(place - bound[o], 700)) - np.log(u))
            cuts = np.searchsorted(o, np.arange(len(to_do) + 1))
            for j, (t, value, done, done_word, prior, first_word, _) in enumerate(to_do):
                own = slice(ends[j] - n_edges[j], ends[j])
                path = np.concatenate([done, edges[own]])
                path_word = np.concatenate([done_word, ordinal[word[own]] + first_word])
                found[t].append((path, prior + float(sums[ends[j]] - base[j]), value))
                own_values, own_at = values[cuts[j]:cuts[j + 1]], open_[cuts[j]:cuts[j + 1]] - own.start
                want = k + 1 - turn
                best = np.argpartition(-own_values, want - 1)[:want] if len(own_values) > want else np.arange(len(own_values))
                for i in best.tolist():
                    tick += 1
                    at = len(done) + int(own_at[i])
                    e = int(path[at])
                    heapq.heappush(heaps[t], (-float(own_values[i]), tick, path, path_word, at, (e,), -float(np.expm1(self.edges["log"][e]))))
            to_do = []
            for t in range(len(texts)) if turn < k else ():
                if heaps[t]:
                    to_do.append((t, *self._branch(heaps[t], texts[t], rows[t], turn)))
        out = []
        for heap, ways in zip(heaps, found):
            threshold = -heap[0][0] if heap else -np.inf
            x = [log - threshold for _, log, _ in ways]
            out.append([(*w, 0.0 if threshold == -np.inf else d if d < -30 else float(np.log(-np.expm1(-np.exp(min(d, 700)))))) for w, d in zip(ways, x)])
        return out

    def _branch(self, heap: list, nodes: np.ndarray, row: int, turn: int) -> tuple:
        """Takes the best branch: another edge at its place, by probability; what is then left there becomes a branch again."""
        value, _, path, word, at, used, left = heapq.heappop(heap)
        value, node = -value, int(np.searchsorted(self.first[:self.n_nodes], path[at], side="right")) - 1
        options = [e for e in range(int(self.first[node]), int(self.first[node + 1])) if e not in used]
        p = np.exp(self.edges["log"][options])
        i = min(int(np.searchsorted(np.cumsum(p), _number(row, turn, 1) * p.sum(), side="right")), len(p) - 1)
        e, prior = options[i], float(self.edges["log"][path[:at]].sum())
        left = float(p.sum() - p[i])
        if len(options) > 1 and left > 0:
            place = prior + np.log(left)
            again = float(place - np.log(np.exp(min(place - value, 700)) - np.log(_number(row, turn, 2))))
            heapq.heappush(heap, (-again, -turn, path, word, at, (*used, e), left))
        w = int(word[at])
        rest, first_word = nodes[w + 1:], w + 1
        if self.edges["next"][e] >= 0:
            rest, first_word = np.concatenate([self.edges["next"][e:e + 1], rest]), w
        return value, np.append(path[:at], e), word[:at + 1], prior + float(self.edges["log"][e]), first_word, rest

    def ids(self, edges: np.ndarray) -> np.ndarray:
        p = self.edges["piece"][edges]
        if (p >= 0).all():
            return p.astype(np.int32)
        out: list[int] = []
        for x in p.tolist():
            out += [x] if x >= 0 else [self.byte[c] for c in chr(-1 - x).encode("utf-8", "surrogatepass")]
        return np.array(out, np.int32)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(29))) * _BASE >> np.uint64(64 - SLOTS)).view(np.int64)


def _times(n: int, factor: np.uint64) -> np.uint64:
    return np.uint64(n * int(factor) & (1 << 64) - 1)


def _uniform(seeds: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1, one for each seed."""
    return ((mix64(seeds) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0 ** -52


def _number(row: int, turn: int, what: int) -> float:
    return (xxhash.xxh3_64_intdigest(f"{row}/{turn}/{what}".encode()) + 0.5) / 2.0 ** 64


def words_of(text: str, cut: re.Pattern = _WORDS) -> list[str]:
    """A blank is put in front, blanks become the pieces' blank sign, and the text is cut where no piece can cross."""
    return cut.findall(BLANK + text.replace(" ", BLANK)) if text else []


def decoder(pieces: list[str]):
    """A function from ids to text: blanks for blank signs, bytes to characters (broken ones to U+FFFD), without the blank in front."""
    spelt = {i: int(p[3:5], 16) for i, p in enumerate(pieces) if re.fullmatch("<0x[0-9A-F]{2}>", p)}
    data = [bytes([spelt[i]]) if i in spelt else b"" if p in ("<s>", "</s>") else b" \xe2\x81\x87 " if p == "<unk>" else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
    flat, size = np.frombuffer(b"".join(data), np.uint8), np.fromiter(map(len, data), np.int64, len(data))
    start = np.cumsum(size) - size

    def decode(ids) -> str:
        ids = np.asarray(ids, np.int64)
        n = size[ids]
        ends = np.cumsum(n)
        at = np.repeat(start[ids] - ends + n, n)
        at += np.arange(len(at))
        text = flat[at].tobytes().decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text
    return decode


def sample_pieces(docs: DataFrame, k: int = 2, model: str = MODEL, seed: str = "pieces", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``sample`` (from 1, by falling perturbed value), ``ids``, ``n_pieces``, ``log_prob``, ``perturbed``, ``log_inclusion``, ``round_trip``.

    Up to ``k`` distinct segmentations of each row's whole text; fewer where the text has fewer. ``log_prob`` is the logarithm of the
    segmentation's probability among all of its text, ``log_inclusion`` that of being among the ``k`` given the (k+1)-th perturbed value
    (0 when there is none). Row key and ``seed`` fix the noise: equal ids and texts give equal rows. A null text is an empty one; that has
    one segmentation, without pieces. ``round_trip`` tells whether decoding gives the text back: always, but for blank signs in the text
    itself, which decode to blanks. Other columns are left out.
    """
    pieces = load_pieces(model)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        lattices, decode = Lattices(pieces), decoder(pieces)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for low in range(0, len(ids), GROUP):
                if lattices.n_edges > EDGES:
                    lattices.clear()
                part = [(d, t or "") for d, t in zip(ids[low:low + GROUP], texts[low:low + GROUP])]
                words = [words_of(t, lattices.cut) for _, t in part]
                lattices.add(list(set().union(*words).difference(lattices.words)))
                keys = [xxhash.xxh3_64_intdigest(f"{seed}\0{d}\0{t}".encode("utf-8", "replace")) for d, t in part]
                rows, flat = [], []
                for (d, t), ways in zip(part, lattices.top([lattices.starts(w) for w in words], keys, k)):
                    for i, (edges, log, value, inclusion) in enumerate(ways):
                        got = lattices.ids(edges)
                        rows.append((d, i + 1, len(got), log, value, inclusion, decode(got) == t))
                        flat.append(got)
                columns = list(zip(*rows))
                offsets = np.concatenate([[0], np.cumsum(columns[2])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field(0).type), pa.array(columns[1], pa.int32()), lists, pa.array(columns[2], pa.int64()),
                                                  *(pa.array(c, pa.float64()) for c in columns[3:6]), pa.array(columns[6])],
                                                 names=["doc_id", "sample", "ids", "n_pieces", "log_prob", "perturbed", "log_inclusion", "round_trip"])
    return arrow_pass(docs, encode, f"doc_id {kind}, sample int, ids array<int>, n_pieces long, log_prob double, perturbed double, log_inclusion double, round_trip boolean")


def decode_pieces(encoded: DataFrame, model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the text of its ids in a last column ``text``; null ids give null. A column ``text`` that was there is replaced."""
    pieces = load_pieces(model)
    rest = encoded.drop("text")

    def decoded(batches):
        decode = decoder(pieces)
        for b in batches:
            at = b.schema.get_field_index(ids_col)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if i is None else decode(i) for i in b.column(at).to_pylist()], pa.string())],
                                             names=[*b.schema.names, "text"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return arrow_pass(rest, decoded, f"{kinds}, text string")
