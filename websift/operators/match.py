"""Full-text match and BM25 of one search over pages, read straight from their text.

For one search over pages that have no index: one narrow scan for the corpus statistics, one for the
matches. Tables of searches go through ``operators.index``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from websift.functions import rank as R
from websift.functions import text as X

Phrase = tuple[bool, list[str]]     # title only?, tokens


def _per_page(of_page) -> Column:
    """A one-item array holding ``of_page(title tokens, content tokens)``.

    Tokens are bound to a lambda variable, so a page's text is cleaned and cut once however many phrases
    look at it.
    """
    both = F.struct(X.token_string(F.col("title")).alias("t"), X.token_string(F.col("content")).alias("c"))
    return F.transform(F.array(both), lambda s: of_page(s.t, s.c))


def _is_hit(phrases: list[Phrase], t: Column, c: Column) -> Column:
    def one(p: Phrase) -> Column:
        title_only, toks = p
        hit = X.phrase_match(t, toks)
        return hit if title_only else hit | X.phrase_match(c, toks)
    return reduce(lambda a, b: a & b, [one(p) for p in phrases], F.lit(True))


def _counts(phrases: list[Phrase], t: Column, c: Column) -> list[Column]:
    out = [(X.n_tokens(t) + X.n_tokens(c)).alias("doc_len")]
    for i, (title_only, toks) in enumerate(phrases):
        f = X.phrase_count(t, toks)
        out.append((f if title_only else f + X.phrase_count(c, toks)).alias(f"f{i}"))
    return out


def matching(pages: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """The pages that contain every phrase."""
    if not phrases:
        return pages
    hit = F.filter(_per_page(lambda t, c: _is_hit(phrases, t, c)), lambda h: h)
    # explode, not filter: a filter would be moved below the cleaning of the text and repeat it
    return pages.select(*pages.columns, F.explode(hit).alias("_hit")).drop("_hit")


def scored(pages: DataFrame, phrases: list[Phrase], where: Column | None = None, kept: tuple[int, float, list[int]] | None = None) -> DataFrame:
    """The pages that contain every phrase (and satisfy ``where``), with their BM25 ``rank``.

    Statistics come from all of ``pages``, whatever ``where`` says: ``kept`` (pages, average length, pages with each phrase) if they are
    known, else one row, computed once as a scalar subquery. Without phrases every page matches with rank 0.
    """
    found = pages if where is None else pages.filter(where)
    if not phrases:
        return found.withColumn("rank", F.lit(0.0))
    ids = range(len(phrases))
    counted = _per_page(lambda t, c: F.when(_is_hit(phrases, t, c), F.struct(*_counts(phrases, t, c))))
    found = found.select(*pages.columns, F.explode(F.filter(counted, lambda m: m.isNotNull())).alias("m"))
    if kept is not None:
        n_docs, avg_len, df = kept
        parts = [R.bm25_part(R.idf(F.lit(n_docs), F.lit(df[i])), F.col(f"m.f{i}"), F.col("m.doc_len"), F.lit(avg_len)) for i in ids]
        return found.select(*pages.columns, reduce(lambda a, b: a + b, parts).alias("rank"))
    facts = pages.select(F.explode(_per_page(lambda t, c: F.struct(*_counts(phrases, t, c)))).alias("m"))
    stats = facts.agg(F.struct(
        F.count(F.lit(1)).alias("n_docs"),
        (F.sum("m.doc_len") / F.count(F.lit(1))).alias("avg_len"),
        *[F.count_if(F.col(f"m.f{i}") > 0).alias(f"n{i}") for i in ids]).alias("stats"))
    found = found.withColumn("_s", stats.scalar())
    s = F.col("_s")
    parts = [R.bm25_part(R.idf(s["n_docs"], s[f"n{i}"]), F.col(f"m.f{i}"), F.col("m.doc_len"), s["avg_len"])
             for i in ids]
    return found.select(*pages.columns, reduce(lambda a, b: a + b, parts).alias("rank"))
