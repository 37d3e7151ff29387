"""Result snippets: the best window of tokens around the hits, with the hits marked.

Meant for the rows of result pages, not for a corpus. All of it is array functions: a text's tokens are cut once, hits
are looked up by their first token, and each window is scored from its own few tokens, so the work grows with the text and
its hits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from websift.functions import text as X

# Fixed values of the snippet format.
WINDOW = 15
OPEN, CLOSE, ELLIPSIS = "<mark>", "</mark>", " … "
NEW_PHRASE, START_BONUS, SENTENCE_BONUS = 1000, 120, 100

_RAW_TOKEN = rf"[\p{{L}}\p{{N}}\p{{Co}}][\p{{L}}\p{{N}}\p{{Co}}{X.MARKS}]*"
_SENTENCE_GAP = r"[.:][ \t\n\r]+\z"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is made once however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _span(first: Column, last: Column) -> Column:
    """The numbers from ``first`` to ``last``; none if that is smaller."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _hits(tokens: Column, phrases: Column, first: Column, last: Column) -> Column:
    """Hits that start from ``first`` to ``last``, as (position, phrase number, size), by position and then phrase."""
    def of(phrase: Column, no: Column) -> Column:
        m = F.size(phrase)
        starts = _span(F.greatest(first, F.lit(0)), F.least(last, F.size(tokens) - m))
        there = F.filter(starts, lambda i: (m > 0) & (F.get(tokens, i) == F.get(phrase, F.lit(0)))
                         & ((m == 1) | (F.slice(tokens, i + 1, m) == phrase)))
        return F.transform(there, lambda i: F.struct(i.alias("pos"), no.alias("no"), m.alias("m")))
    return F.array_sort(F.flatten(F.transform(phrases, of)))


def _score(window: Column) -> Column:
    """1000 for each phrase in the window, 1 for each repetition."""
    return (NEW_PHRASE - 1) * F.size(F.array_distinct(window["no"])) + F.size(window)


def _choose(t: Column, phrases: Column) -> Column:
    """The first token of the window: where a hit and those that follow stand in the middle, or where a hit's sentence begins,
    for a bonus. The earliest of the best wins; 0 without hits."""
    n = F.size(t["tokens"])

    def inside(start: Column) -> Column:
        return _hits(t["tokens"], phrases, start, start + WINDOW - 1)

    def centred(hit: Column, order: Column) -> Column:
        def of(window: Column) -> Column:
            end = F.element_at(window, -1)
            spare = WINDOW - (end["pos"] + end["m"] - hit["pos"])
            at = F.greatest(F.least(hit["pos"] - (spare / 2).cast("int"), n - WINDOW), F.lit(0))
            return F.struct(_score(window).alias("score"), (-2 * order).alias("order"), at.alias("at"))
        return _bound(inside(hit["pos"]), of)

    def at_sentence(hit: Column, order: Column) -> Column:
        s = F.get(t["sentence"], hit["pos"])
        bonus = F.when(s > 0, SENTENCE_BONUS).otherwise(START_BONUS)
        found = F.struct((_score(inside(s)) + bonus).alias("score"), (-2 * order - 1).alias("order"), s.alias("at"))
        return F.when((n > WINDOW) & (s < hit["pos"]), found)

    both = F.flatten(F.transform(t["hits"], lambda h, k: F.array(centred(h, k), at_sentence(h, k))))
    return F.coalesce(F.array_max(both)["at"], F.lit(0))        # nulls are no windows


def _marked(t: Column, phrases: Column, first: Column) -> Column:
    """The window from ``first``. Overlapping hits share one mark; what began before the window is not marked."""
    n = F.size(t["tokens"])
    last = F.least(first + WINDOW, n) - 1
    longest = F.coalesce(F.array_max(F.transform(phrases, F.size)), F.lit(0))

    def shown(near: Column) -> Column:
        def goes_on(j: Column) -> Column:
            return F.exists(near, lambda h: (h["pos"] <= j) & (h["pos"] + h["m"] > j + 1))

        def is_open(j: Column) -> Column:
            return F.exists(near, lambda h: h["pos"] == j) & ~goes_on(j - 1)

        def with_opened(opened: Column) -> Column:
            def token(j: Column) -> Column:
                hit = F.exists(near, lambda h: (h["pos"] <= j) & (h["pos"] + h["m"] > j))
                closes = hit & (~goes_on(j) | (j == last)) & (F.array_min(opened) <= j)
                return F.concat(F.when(j > first, F.get(t["gaps"], j)).otherwise(F.lit("")),
                                F.when(F.array_contains(opened, j), F.lit(OPEN)).otherwise(F.lit("")), F.get(t["raw"], j),
                                F.when(closes, F.lit(CLOSE)).otherwise(F.lit("")))
            return F.array_join(F.transform(F.sequence(first, last), token), "")
        return _bound(F.filter(F.sequence(first, last), is_open), with_opened)

    before = F.when(first > 0, F.lit(ELLIPSIS)).otherwise(F.get(t["gaps"], F.lit(0)))
    after = F.when(last == n - 1, F.get(t["gaps"], n)).otherwise(F.lit(ELLIPSIS))
    return F.concat(before, _bound(_hits(t["tokens"], phrases, first - longest + 1, last), shown), after)


def snippet(content: Column, phrases: Column) -> Column:
    """A marked snippet of ``content``. ``phrases``: ``array<array<string>>`` of index tokens."""
    text = F.coalesce(content, F.lit(""))
    cut_ = F.struct(F.regexp_extract_all(text, F.lit(_RAW_TOKEN), F.lit(0)).alias("raw"),
                    F.split(text, _RAW_TOKEN, -1).alias("gaps"), X.tokens(text).alias("tokens"))

    def with_hits(c: Column) -> Column:
        n = F.size(c["tokens"])
        begins = F.filter(_span(F.lit(1), n - 1), lambda j: F.get(c["gaps"], j).rlike(_SENTENCE_GAP))

        def sentence(starts: Column) -> Column:
            """Of every token, where its sentence begins."""
            return F.flatten(F.transform(starts, lambda s, k: F.array_repeat(s, F.coalesce(F.get(starts, k + 1), n) - s)))
        return F.struct(c["raw"].alias("raw"), c["gaps"].alias("gaps"), c["tokens"].alias("tokens"),
                        _hits(c["tokens"], phrases, F.lit(0), n - 1).alias("hits"),
                        _bound(F.concat(F.array(F.lit(0)), begins), sentence).alias("sentence"))

    def whole(t: Column) -> Column:
        return _bound(_choose(t, phrases), lambda first: _marked(t, phrases, first))
    return _bound(cut_, lambda c: F.when(F.size(c["tokens"]) == 0, F.array_join(c["gaps"], "")).otherwise(
        _bound(with_hits(c), whole)))


def cut(snip: Column, length: int = 300) -> Column:
    """At most ``length`` characters, tags counted, then an ellipsis."""
    return F.when(F.length(snip) > length,
                  F.concat(F.substr(snip, F.lit(1), F.lit(length)), F.lit("..."))).otherwise(snip)


def without_marks(snip: Column) -> Column:
    return F.replace(F.replace(snip, F.lit(OPEN), F.lit("")), F.lit(CLOSE), F.lit(""))
