"""Alignment of the tokens of two tokenizers, with corpus-wide counts of linked ids.

Both tokenizers cut the same bytes. Tokens overlap where their byte ranges do; the connected components of overlaps are the groups
between offsets where tokens of both end. They are found by pointer jumping: every token points to its farthest-right overlapping token
(the one of the other tokenizer that holds its last byte, itself if none reaches further), and all pointers are replaced by the
pointers of what they point at until nothing changes. Each token then points to its component's terminal token, which labels the group.

No token crosses the place before a blank between two other characters, neither by the byte-level pattern nor in a piece model whose
pieces hold blanks only at their front. So texts are cut there; a task tokenises and aligns each distinct stretch once, many at a time
in one array, and puts documents together from them. (If a model's pieces do cross blanks, whole texts are the stretches.)

Counts of id pairs are settled between parts of the corpus and shards of the pairs (see ``parts``); a shard holds all pairs of its B ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from websift.llm import parts
from websift.llm.common import arrow_pass, mix64, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BYTE_MODEL, PIECE_MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
KEPT_STRETCHES, KEPT_BYTES = 300_000, 32 << 20       # what a task remembers before it starts anew
JOINED = 256                # stretches tokenised as one text
_BLANK_PAIR, _PAIR_BLANK = re.compile(r" \s"), re.compile(r"\s ")
OLD_BLANK = "\u180e"                               # a blank to some versions of Unicode


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Aligner:
    """Both tokenizers, and the stretches of text aligned so far."""

    def __init__(self, byte_model: str, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers
        self.a = tokenizers.Tokenizer.from_str(byte_model)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        symbol = byte_symbols()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(symbol[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.cut = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.a_len, self.b_len = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.shift = 16 if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else 32
        self.code = np.dtype("<u4" if self.shift == 16 else "<u8")
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.codes = np.zeros(0, self.code)         # linked pairs of all stretches, (B id, A id) in one number
        self.sizes = np.zeros((0, 4), np.int64)     # of each stretch: A and B tokens, groups, links
        self.start = np.zeros(1, np.int64)          # where its links begin
        self.groups: list[bytes] = []
        self.wrong: dict[int, tuple[bytes, bytes]] = {}       # the joined bytes where they are not the stretch's own
        self.held = 0

    def stretches(self, text: str) -> list[str]:
        """``text`` cut before each blank between two other characters; those blanks are left out."""
        if not self.cut:
            return [text]
        found = text.split(" ")
        if not (_BLANK_PAIR.search(text) or _PAIR_BLANK.search(text) or text[0].isspace() or text[-1].isspace() or OLD_BLANK in text):
            return found
        out = [found[0]]
        for p in found[1:]:
            last = out[-1][-1:]
            if last and p and not (last.isspace() or p[0].isspace() or OLD_BLANK in (last, p[0])):
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    def tokens(self, stretches: list[str]):
        """The ids of both tokenizers for a blank and each stretch, one array each, with the numbers of ids; and which stretches are given
        back byte for byte (others have no ids). Stretches that could stand in one text are tokenised as one, many at a time."""
        joined, alone = [], []
        for s in stretches:
            (joined if self.cut and s and not (s[0].isspace() or s[-1].isspace() or OLD_BLANK in s) else alone).append(s)
        place = {s: i for i, s in enumerate(stretches)}
        runs = [joined[i:i + JOINED] for i in range(0, len(joined), JOINED)]
        found: list = [None] * len(stretches)
        for run, (own, a, b) in zip(runs, self._encoded([" ".join(r) for r in runs])):
            ends = np.cumsum([len(s.encode()) + 1 for s in run])
            cuts = []
            for ids, length, spelt in ((a, self.a_len, self.a_bytes), (b, self.b_len, self.b_bytes)):
                to = np.cumsum(length[ids])
                cut = np.searchsorted(to, ends, side="right")
                if b"".join(map(spelt.__getitem__, ids.tolist())) != own or not np.array_equal(to[cut - 1], ends):
                    break
                cuts.append(cut.tolist())
            else:
                for s, i, j, k, m in zip(run, [0, *cuts[0]], cuts[0], [0, *cuts[1]], cuts[1]):
                    found[place[s]] = a[i:j], b[k:m]
                continue
            alone.extend(run)
        spelt = {}
        for s, (own, a, b) in zip(alone, self._encoded(alone)):
            as_a, as_b = (b"".join(map(x.__getitem__, ids.tolist())) for x, ids in ((self.a_bytes, a), (self.b_bytes, b)))
            if as_a == own == as_b:
                found[place[s]] = a, b
            else:
                spelt[place[s]] = as_a, as_b
        return found, spelt

    def _encoded(self, texts: list[str]):
        """Of a blank and each text: its bytes, and both tokenizers' ids."""
        if not texts:
            return []
        a_ids = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        return [((" " + t).encode(), np.array(a.ids, np.int64), np.array(b, np.int64)) for t, a, b in zip(texts, a_ids, self.b.encode(texts, num_threads=1))]

    def add(self, stretches: list[str]) -> None:
        """Aligns stretches that are not known yet, all in one array."""
        if not stretches:
            return
        first = len(self.groups)
        found, spelt = self.tokens(stretches)
        self.index.update(zip(stretches, range(first, first + len(stretches))))
        self.wrong.update((first + i, x) for i, x in spelt.items())
        self.held += sum(map(len, stretches))
        good = np.array([i for i, x in enumerate(found) if x is not None], np.int64)
        sizes, groups = np.zeros((len(stretches), 4), np.int64), [b""] * len(stretches)
        if len(good):
            n_a, n_b = (np.fromiter((len(found[i][side]) for i in good.tolist()), np.int64, len(good)) for side in (0, 1))
            a, b = (np.concatenate([found[i][side] for i in good.tolist()]) for side in (0, 1))
            group_a, group_b, link_a, link_b, n_groups = aligned(np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b]))
            codes = ((b[link_b].astype(np.uint64) << np.uint64(self.shift)) | a[link_a].astype(np.uint64)).astype(self.code)
            to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
            to_link = np.searchsorted(link_a, to_a)                                 # links stand in order of both
            to_group = np.concatenate([group_a[1:], [n_groups]])[to_a - 1]          # the next stretch's first group
            sizes[good] = np.stack([n_a, n_b, np.diff(to_group, prepend=0), np.diff(to_link, prepend=0)], axis=1)
            spelled, ends = listed_groups(a, b, group_a, group_b)
            to = ends[to_a + to_b - 1].tolist()
            for i, x, y in zip(good.tolist(), [0, *to], to):
                groups[i] = spelled[x:y - 1]
            self.codes = np.concatenate([self.codes, codes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.start = np.concatenate([[0], np.cumsum(self.sizes[:, 3])])
        self.groups.extend(groups)

    def documents(self, texts: list[str | None]):
        """For each text its sizes (A and B tokens, groups, links), its groups' hash, and its distinct linked pairs with their numbers."""
        if len(self.groups) > KEPT_STRETCHES or self.held > KEPT_BYTES:
            self.forget()
        cut = [self.stretches(t) if t else [] for t in texts]
        self.add([s for s in dict.fromkeys(s for c in cut for s in c) if s not in self.index])
        for text, c in zip(texts, cut):
            at = list(map(self.index.__getitem__, c))
            wrong = bool(self.wrong) and any(i in self.wrong for i in at)
            if not at or wrong and not self._same(text, c, at):
                yield (0, 0, 0, 0), "", np.zeros(0, self.code), np.zeros(0, np.int64)
                continue
            if wrong:                                   # the bytes agree as a whole only: one stretch
                if text not in self.index:
                    self.add([text])
                at = [self.index[text]]
            once, times = np.unique(np.array(at), return_counts=True)
            sizes = tuple((self.sizes[once] * times[:, None]).sum(axis=0).tolist())
            n = self.sizes[once, 3]
            before = np.cumsum(n) - n
            links = np.repeat(self.start[once] - before, n) + np.arange(int(n.sum()))
            codes, n = parts.reduced(self.codes[links], (np.add, np.repeat(times, n)))
            yield sizes, hashlib.sha256(b";".join(list(map(self.groups.__getitem__, at)))).hexdigest(), codes, n

    def _same(self, text: str, cut: list[str], at: list[int]) -> bool:
        """Whether the joined bytes of the whole text are its own though those of a stretch are not."""
        joined = [b"".join(self.wrong[i][side] if i in self.wrong else (" " + s).encode() for s, i in zip(cut, at)) for side in (0, 1)]
        return joined[0] == joined[1] == (" " + text).encode()


def listed_groups(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` in ASCII, and where each token's part ends, its separator included."""
    turn = np.concatenate([group_a * 2, group_b * 2 + 1])
    order = np.argsort(turn, kind="stable")
    turn, ids = turn[order], np.concatenate([a, b])[order]
    step = np.append(turn[1:], -2) - turn
    mark = np.where(step == 0, ord(","), np.where((turn % 2 == 0) & (step == 1), ord("|"), ord(";")))
    digits = np.ones(len(ids), np.int64)
    power = 10
    while power <= ids.max():
        digits += ids >= power
        power *= 10
    ends = np.cumsum(digits + 1)
    out = np.empty(ends[-1], np.uint8)
    out[ends - 1] = mark
    for k in range(digits.max()):
        some = digits > k
        out[ends[some] - 2 - k] = 48 + ids[some] // 10 ** k % 10
    return out.tobytes(), ends


def aligned(ends_a: np.ndarray, ends_b: np.ndarray):
    """Groups of two tokenisations of the same bytes, given the ends of their tokens.

    ``group_a, group_b``: the group of each token, numbered from the left; ``link_a, link_b``: the overlapping pairs from left to
    right; and the number of groups.
    """
    n = len(ends_a)
    over_a = np.searchsorted(ends_b, ends_a - 1, side="right")      # the B token that holds the last byte
    over_b = np.searchsorted(ends_a, ends_b - 1, side="right")
    own = n + np.arange(len(ends_b))
    to = np.concatenate([n + over_a, np.where(ends_a[over_b] > ends_b, over_b, own)])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        to = further
    terminal = np.flatnonzero(to[n:] == own) + n
    group = np.searchsorted(terminal, to)
    starts = np.concatenate([[0], np.union1d(ends_a, ends_b)[:-1]])    # between two neighbouring ends lies one pair
    return (group[:n], group[n:], np.searchsorted(ends_a, starts, side="right"), np.searchsorted(ends_b, starts, side="right"), len(terminal))


def _shard_of(shift: int):
    return lambda codes: mix64(codes.astype(np.uint64) >> np.uint64(shift))


def align_tokens(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    A: byte-level BPE (a ``tokenizers`` file) over a blank and the text. B: a SentencePiece model over the text. ``n_best`` counts
    links whose pair is linked as often, corpus-wide, as any pair of their B id; ``count_sum`` sums the counts of the links' pairs.

    Null and empty texts, and texts that one of the tokenizers does not give back byte for byte, have zeros and an empty hash, and add
    to no count. A text of any length is aligned whole; memory goes with its distinct stretches. Equal rows count one each. A null id
    stays null. An empty table gives an empty one. Other columns are not looked at.
    """
    spark = docs.sparkSession
    with open(byte_model, encoding="utf-8") as f:
        a_model = f.read()
    with open(piece_model, "rb") as f:
        b_model = f.read()
    models = spark.sparkContext.broadcast((a_model, b_model))          # two vocabulary files, some MB
    size = max(len(json.loads(a_model)["model"]["vocab"]), _pieces(b_model))
    shift, code = (16, np.dtype("<u4")) if size <= 1 << 16 else (32, np.dtype("<u8"))
    kinds = [code, np.dtype("<i8")]
    names = ["part", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times", "keys", "ns"]
    types = [pa.int64()] * 6 + [pa.string()] + [pa.binary()] * 4

    def cut(batches):
        aligner = Aligner(*models.value)
        numbers = parts.part_numbers()
        part, size, held = next(numbers), 0, []

        def listed():
            keys, ns = parts.reduced(np.concatenate([k for k, _ in held]), (np.add, np.concatenate([n for _, n in held])))
            return part, None, None, None, None, None, None, None, None, keys.tobytes(), ns.tobytes()
        for b in batches:
            ids, texts = (b.column(i).to_pylist() for i in range(2))
            for lo, hi in _runs(texts, 4 << 20):
                rows = []
                for d, t, (sizes, sha, codes, n) in zip(ids[lo:hi], texts[lo:hi], aligner.documents(texts[lo:hi])):
                    rows.append((part, d, *sizes, sha, codes.tobytes(), n.astype("<u4" if len(n) == 0 or n.max() < 1 << 32 else "<i8").tobytes(), None, None))
                    held.append((codes, n))
                    size += len(t or "")
                    if size >= parts.PART_BYTES:
                        rows.append(listed())
                        part, size, held = next(numbers), 0, []
                yield from parts.in_batches(rows, types, names)
        if held:
            yield from parts.in_batches([listed()], types, names)

    schema = "part long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary, keys binary, ns binary"
    both = stored(arrow_pass(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), cut, schema), "aligned-parts")
    lists = both.where("keys is not null").select("part", "keys", "ns")
    asked = parts.dealt(lists, parts.shard_count(lists, "keys", code.itemsize), kinds, _shard_of(shift))

    def count(batches):
        for shard, (keys, ns) in parts.folded_shards(batches, kinds, [np.add]):
            # keys stand in order of their B ids
            b_id = keys >> code.type(shift)
            at = np.flatnonzero(np.concatenate([[True], b_id[1:] != b_id[:-1]])) if len(keys) else np.zeros(0, np.int64)
            best = np.repeat(np.maximum.reduceat(ns, at), np.diff([*at, len(keys)])) == ns if len(keys) else np.zeros(0, bool)
            yield from parts.in_batches([(shard, keys.tobytes(), ns.tobytes(), best.tobytes())], [pa.int64()] + [pa.binary()] * 3, ["shard", "every", "counts", "best"])
    counted = stored(arrow_pass(asked.select("shard", "keys", "ns").repartition("shard").sortWithinPartitions("shard"), count,
                                "shard long, every binary, counts binary, best binary"), "aligned-counts")

    def answer(batches):
        every = counts = best = None                  # of the shard at hand
        for b in batches:
            rows = []
            for late, part, keys, *arrays in zip(*(b.column(i).to_pylist() for i in range(6))):
                if not late:
                    every, counts, best = (np.frombuffer(x, k) for x, k in zip(arrays, (code, np.int64, bool)))
                    continue
                at = np.searchsorted(every, np.frombuffer(keys, code))
                rows.append((part, keys, counts[at].tobytes(), best[at].tobytes()))
            yield from parts.in_batches(rows, [pa.int64()] + [pa.binary()] * 3, ["part", "keys", "counts", "best"])
    met = parts.led(counted, asked.select("shard", "part", "keys"), "shard").select("late", "part", "keys", "every", "counts", "best")
    answers = arrow_pass(met, answer, "part long, keys binary, counts binary, best binary")

    def settle(batches):
        part, told, table = None, [], None
        for b in batches:
            rows = []
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for p, late, keys, counts, best, codes, times, *row in zip(*columns):
                if p != part:
                    part, told, table = p, [], None
                if not late:
                    told.append([np.frombuffer(x, k) for x, k in zip((keys, counts, best), (code, np.int64, bool))])
                    continue
                if table is None and told:
                    table = [np.concatenate(x) for x in zip(*told)]
                    order = np.argsort(table[0])
                    table = [x[order] for x in table]
                n_best = count_sum = 0
                if codes:
                    codes = np.frombuffer(codes, code)
                    times = np.frombuffer(times, "<u4" if len(times) == 4 * len(codes) else "<i8").astype(np.int64)
                    at = np.searchsorted(table[0], codes)
                    n_best, count_sum = int(times[table[2][at]].sum()), int((times * table[1][at]).sum())
                rows.append((*row, n_best, count_sum))
            yield from parts.in_batches(rows, [pa.int64()] * 5 + [pa.string()] + [pa.int64()] * 2, [*names[1:7], "n_best", "count_sum"])
    results = both.where("n_a is not null").select(*names[:9])
    met = parts.led(answers, results, "part").select("part", "late", "keys", "counts", "best", "codes", "times", *names[1:7])
    return arrow_pass(met, settle, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def _pieces(model: bytes) -> int:
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()


def _runs(texts: list[str | None], most: int):
    """Spans of ``texts`` of about ``most`` characters together, one text at least."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
