"""License scans: an exact containment join of text blocks with license templates.

A block of a template is any run of words as wide as ``stretch`` times the template, 40 words at least; one starts at
every word of a text. A block meets the template when it holds at least ``per100`` percent of its distinct words.
Template words are ordered by their frequency over all documents, rarest first: a block that meets a template holds one
of its first words, so only starts near such a word are looked at (prefix filter); a text needs enough words (length
filter); and while the words around are looked up in order, too many missing ones end the look-up (positional filter).
All three only skip what cannot meet the threshold. What is left is swept once: each place of a word opens a range of
starts whose blocks hold it, and the starts under enough ranges meet. Phrases that stand word for word count besides.
"""

from __future__ import annotations

import math
import sys
from bisect import bisect_left

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from websift.llm.common import arrow_pass

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Phrases with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Templates: opening sentences and bodies of well-known notices, with their labels.
TEMPLATES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
            "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
            "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies "
            "or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties "
            "of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders "
            "be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of "
            "or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
            "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
            "disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including "
            "but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no "
            "event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or "
            "consequential damages"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty "
            "of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
]
BLOCK, STRETCH = 40, 2      # words of a block: at least, and for each word of the template

# Bytes that do not belong to words become blanks, A-Z become a-z.
_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


def _template_frequencies(docs: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """In how many documents each template word stands; as many rows as the templates have words."""
    known = frozenset(vocabulary)

    def count(batches):
        seen = dict.fromkeys(known, 0)
        for b in batches:
            for t in b.column(0).to_pylist():
                for w in known.intersection(words(t)):
                    seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen]), pa.array(seen.values(), pa.int64())],
                                         names=["word", "df"])
    counted = arrow_pass(docs.select("text"), count, "word string, df long").groupBy("word").agg(F.sum("df").alias("df"))
    return {r["word"].encode(): r["df"] for r in counted.collect()}


def _regions(at: list[int], width: int) -> list[tuple[int, int]]:
    """Ranges of starts whose blocks hold one of the places ``at`` (ascending)."""
    out: list[tuple[int, int]] = []
    for p in at:
        if out and p - width < out[-1][1] + 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((max(p - width + 1, 0), p))
    return out


def _runs(held: list[list[int]], lo: int, hi: int, width: int, need: int) -> list[tuple[int, int, int]]:
    """(first start, last start, most words) of the maximal runs of starts from ``lo`` to ``hi`` whose blocks hold ``need`` words.
    ``held``: the places of each word, ascending. A place counts for the starts after the word's place before, so once."""
    change: dict[int, int] = {}
    for places in held:
        after = -1
        for p in places:
            first, last = max(p - width, after) + 1, min(p, hi)
            first = max(first, lo)
            if first <= last:
                change[first] = change.get(first, 0) + 1
                change[last + 1] = change.get(last + 1, 0) - 1
            after = p
    found, count, start, most = [], 0, None, 0
    for g in sorted(change):
        count += change[g]
        if count >= need:
            start, most = (g, count) if start is None else (start, max(most, count))
        elif start is not None:
            found.append((start, g - 1, most))
            start = None
    return found


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None,
                 per100: int = 85, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, stretch: float = STRETCH) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_base`` (places of phrases), ``first_word`` and ``last_word``
    (smallest and largest start of such a place; null without one), ``base_labels``, ``labels`` (with those of templates;
    distinct, sorted, comma-joined), ``score`` (the highest containment of a template that some block meets, 1 with a
    phrase, else 0), and ``blocks``: every block that meets a template, as maximal runs of blocks that start at neighbouring words
    (``first_start``, ``last_start``, number of the template, highest containment in the run).

    Templates may be of any length; those without words are met by nothing. Blocks at the end of a text are shorter. A null text is an
    empty one; it has no words, no places and empty labels. Texts are looked at whole, at a cost in line with their length. Repeated rows
    give repeated results, no rows give none. Of several blocks with the highest containment the score does not depend.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = [frozenset(words(t)) for _, t in templates]
    df = _template_frequencies(docs, sorted(set().union(*sets)))
    ordered = [sorted(s, key=lambda w: (df.get(w, 0), w)) for s in sets]
    need = [-(-per100 * len(s) // 100) for s in sets]
    width = [max(block, math.ceil(stretch * len(words(t)))) for _, t in templates]
    prefixes = [o[:len(o) - k + 1] if k else [] for o, k in zip(ordered, need)]
    any_prefix = frozenset().union(*prefixes)
    vocabulary = frozenset().union(*sets)
    spaced = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]

    def met(ws: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(first start, last start, template, containment) of every run of blocks that meet a template."""
        places: dict[bytes, list[int]] = {}
        for at, w in enumerate(ws):
            if w in vocabulary:
                places.setdefault(w, []).append(at)
        found = []
        for k, order in enumerate(ordered):
            near = sorted(p for w in prefixes[k] for p in places.get(w, ()))
            if len(ws) < need[k] or not near:
                continue
            for lo, hi in _regions(near, width[k]):
                held, missing = [], 0
                for w in order:
                    of = places.get(w, [])
                    here = of[bisect_left(of, lo):bisect_left(of, hi + width[k])]
                    if here:
                        held.append(here)
                    else:
                        missing += 1
                        if missing > len(order) - need[k]:
                            break
                else:
                    found += [(a, z, k, n / len(order)) for a, z, n in _runs(held, lo, hi, width[k], need[k])]
        return sorted(found)

    def scan(batches):
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(t)
                line = b" " + b" ".join(ws) + b" "
                places, base = [], set()
                for p, label in spaced:
                    at, before, n = line.find(p), 0, 0
                    while at >= 0:
                        n += line.count(b" ", before, at)
                        places.append(n)
                        base.add(label)
                        before, at = at, line.find(p, at + 1)
                blocks = met(ws) if not any_prefix.isdisjoint(ws) else []
                labels = base | {templates[k][0] for _, _, k, _ in blocks}
                rows.append((d, len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                             ",".join(sorted(labels)), 1.0 if places else max((c for *_, c in blocks), default=0.0),
                             [{"first_start": f, "last_start": z, "template": k, "containment": c} for f, z, k, c in blocks]))
            kinds = [b.schema.field(0).type, *[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(),
                     pa.list_(pa.struct([("first_start", pa.int64()), ("last_start", pa.int64()), ("template", pa.int32()), ("containment", pa.float64())]))]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, kinds)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
              "score double, blocks array<struct<first_start: long, last_start: long, template: int, containment: double>>")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
    return arrow_pass(docs, scan, schema)
