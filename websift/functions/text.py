"""Text cleaning, tokens and phrase counts as Column expressions.

Patterns are for Java's regex engine. Its ``\\w`` and ``\\s`` know ASCII only, so the Unicode
classes are spelled out.
"""

from __future__ import annotations

import html as _html
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"\p{IsWhite_Space}\x1c-\x1f"
WORD = r"\p{L}\p{N}_"

# Entities decoded without leaving the JVM. Fixed values of the HTML standard; "amp" must stay last,
# so that "&amp;lt;" gives "&lt;".
JVM_ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©",
    "reg": "®", "middot": "·", "laquo": "«", "raquo": "»", "ndash": "–",
    "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "hellip": "…", "bull": "•", "trade": "™", "euro": "€", "times": "×",
    "rarr": "→", "larr": "←", "amp": "&",
}
# An "&" that may open an entity outside the table above.
OTHER_ENTITY = "&(?!(?:" + "|".join(JVM_ENTITIES) + ");)[#A-Za-z]"


def jvm_unescape(c: Column) -> Column:
    """Decode the entities of ``JVM_ENTITIES``; right only where ``OTHER_ENTITY`` finds nothing."""
    out = c
    for name, char in JVM_ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


@lru_cache(maxsize=1)
def _unescape_udf():
    decode = _html.unescape

    def unescape_all(col: pa.Array) -> pa.Array:
        return pa.array([None if v is None else decode(v) for v in col.to_pylist()], pa.string())

    udf = F.arrow_udf(unescape_all, "string")
    unescape_all.__module__ = "__main__"    # pickled by value: executors need no copy of this package
    return udf


def unescape(c: Column) -> Column:
    """Every HTML entity. Rows with unusual entities alone are sent to the Arrow worker."""
    odd = c.rlike(OTHER_ENTITY)
    rest = _unescape_udf()(F.when(odd, c))
    return F.when(~c.contains("&"), c).when(odd, rest).otherwise(jvm_unescape(c))


def squeeze(c: Column) -> Column:
    """Runs of blanks to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, f"[{BLANK}]{{2,}}|[{BLANK}&&[^ ]]", " "))


def tidy(c: Column) -> Column:
    """The cleaning steps after entity decoding: blanks, odd characters, space around punctuation."""
    # single spaces, the common blank, are left where they are
    x = F.regexp_replace(c, f"[{BLANK}]{{2,}}|[{BLANK}&&[^ ]]", " ")
    x = F.regexp_replace(x, rf"""[^{WORD}{BLANK}.,!?;:()\-"']""", " ")
    x = F.regexp_replace(x, " +([,.!?;:])", "$1")
    x = F.regexp_replace(x, "([.!?]) *([A-Z])", "$1 $2")
    return F.trim(x)


def clean_text(c: Column) -> Column:
    return F.coalesce(tidy(unescape(c)), F.lit(""))


def clean_text_basic(c: Column) -> Column:
    """Tags out, entities decoded, blanks squeezed."""
    return F.coalesce(squeeze(unescape(F.regexp_replace(c, "<[^>]+>", " "))), F.lit(""))


def strip(c: Column) -> Column:
    """Both ends free of every Unicode blank."""
    return F.regexp_replace(c, f"^[{BLANK}]+|[{BLANK}]+$", "")


def truncate_text(c: Column, max_length: Column | int = 1000) -> Column:
    """At most ``max_length`` characters, cut at the last space, with an ellipsis if cut."""
    n = F.lit(max_length) if isinstance(max_length, int) else max_length
    head = F.substr(c, F.lit(1), n)
    back = F.locate(" ", F.reverse(head))
    space = F.length(head) - back + 1
    cut = F.when((back > 0) & (space > 1), F.substr(head, F.lit(1), space - 1)).otherwise(head)
    return F.when(c.isNull() | (F.length(c) <= n), c).otherwise(F.concat(cut, F.lit("...")))


# ---------------------------------------------------------------------------------------------
# tokens

# Letters whose folded form does not follow the rule below. Fixed values of the tokeniser.
FOLD_EXCEPTIONS = {"Ǣ": "ǣ", "ǣ": "ǣ", "Ǯ": "ǯ", "ǯ": "ǯ", "Ǽ": "ǽ", "ǽ": "ǽ", "Ǿ": "ǿ", "ǿ": "ǿ", "İ": "i"}


def _folded(ch: str) -> str:
    """One letter's case taken off, then a single accent if the letter is Latin."""
    if ch in FOLD_EXCEPTIONS:
        return FOLD_EXCEPTIONS[ch]
    low = next((x for x in (ch.casefold(), ch.lower()) if len(x) == 1), ch)
    base, *marks = unicodedata.normalize("NFD", low)
    single = len(marks) == 1 and unicodedata.category(marks[0]) == "Mn"
    return base if single and unicodedata.name(base, "").startswith("LATIN") else low


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str]:
    """Letters to fold, and what they fold to."""
    letters = (chr(c) for c in range(0x41, 0xFFFF) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt"))
    pairs = [(ch, _folded(ch)) for ch in letters if _folded(ch) != ch]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


# Accents written as characters of their own that do not end a token. Fixed values of the tokeniser.
MARKS = "".join(map(chr, [*range(0x300, 0x305), *range(0x306, 0x30D), 0x30F, 0x311, 0x31B, *range(0x323, 0x329), 0x32D, 0x32E, 0x330, 0x331]))


def fold(c: Column) -> Column:
    """Case and single accents folded. Names ``c`` once, as it may stand for costly text cleaning."""
    letters, folded = _fold_tables()
    return F.translate(c, letters + MARKS, folded)      # characters without a counterpart are taken out


TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def tokens(c: Column) -> Column:
    """The index tokens of a text, in order; an empty array for null."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_string(c: Column) -> Column:
    """The tokens as one string, two spaces between tokens and at both ends.

    Each token owns a space on either side, so " a " can be counted by plain replacement.
    """
    padded = F.concat(F.lit("  "), fold(F.coalesce(c, F.lit(""))), F.lit("  "))
    return F.regexp_replace(padded, r"[^\p{L}\p{N}\p{Co}]+", "  ")


def n_tokens(ts: Column) -> Column:
    """Number of tokens in a ``token_string``."""
    gaps = (F.length(ts) - F.length(F.replace(ts, F.lit("  "), F.lit("")))) / 2
    return (gaps - 1).cast("int")


def _self_overlapping(phrase: list[str]) -> bool:
    return any(phrase[:k] == phrase[-k:] for k in range(1, len(phrase)))


def phrase_count(ts: Column, phrase: list[str]) -> Column:
    """How often the phrase occurs in a ``token_string``; overlapping occurrences all count."""
    if not phrase:
        return F.lit(0)
    needle = " " + "  ".join(phrase) + " "
    if _self_overlapping(phrase):
        return F.regexp_count(ts, F.lit(f"(?={needle})"))
    left = F.length(F.replace(ts, F.lit(needle), F.lit("")))
    return ((F.length(ts) - left) / len(needle)).cast("int")


def phrase_match(ts: Column, phrase: list[str]) -> Column:
    if not phrase:
        return F.lit(False)
    return ts.contains(" " + "  ".join(phrase) + " ")


def count_in_tokens(toks: Column, phrase: Column) -> Column:
    """Phrase count on token arrays, for phrases that are columns themselves."""
    n, m = F.size(toks), F.size(phrase)
    starts = F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1)))
    hit = F.filter(starts, lambda i: F.slice(toks, i, m) == phrase)
    return F.when((m == 0) | (n < m), F.lit(0)).otherwise(F.size(hit))
