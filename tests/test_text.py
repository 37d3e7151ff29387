import html
import sqlite3

from helpers import column
from pyspark.sql import functions as F

from websift.functions import text as X


def test_clean_text(spark):
    cases = {
        None: "",
        "": "",
        "  a \t\n b  ": "a b",
        "a\xa0\x1fb c": "a b c",
        "été – naïve_1 ②": "été   naïve_1 ②",      # the dash goes, its neighbours' blanks stay
        "one , two ;three !": "one, two;three!",
        "End.Start?Now!  Go": "End. Start? Now! Go",
        "a.b c.É": "a.b c.É",                       # only ASCII capitals begin a sentence
        "x @@ y": "x    y",
        "x @@. Y": "x. Y",
        "Tom &amp; &lt;b&gt; &amp;amp; &eacute;": "Tom    b   amp; é",
        "(\"quoted\" - it's)": "(\"quoted\" - it's)",
        "é": "e",
    }
    assert column(spark, list(cases), X.clean_text) == list(cases.values())


def test_unescape_equals_the_standard_library(spark):
    values = ["&amp;lt;", "&copy", "&copysr;", "&#233;&#xe9;&#x80;&#0;", "&am", "&notit;", "a & b &c; &", "&AMP;",
              "&ampx", "&Amp;", "&#99999999;", "&nbsp;x&middot;y", "", "plain"]
    assert column(spark, values, X.unescape) == [html.unescape(v) for v in values]


def test_clean_text_basic(spark):
    cases = {None: "", "<p>a</p><b>b</b>": "a b", "1 < 2 and 3 > 2": "1 2", "&lt;x&gt;\n y": "<x> y", "<>": "<>"}
    assert column(spark, list(cases), X.clean_text_basic) == list(cases.values())


def test_truncate_text(spark):
    cases = {None: None, "": "", "short": "short", "exactly ten": "exactly...", "0123456789": "0123456789",
             "01234567890": "0123456789...", "ab cd efghij": "ab cd...", " 0123456789": " 012345678..."}
    assert column(spark, list(cases), lambda c: X.truncate_text(c, 10)) == list(cases.values())


def test_tokens_are_those_of_the_index(spark):
    """Compared through the vocabulary of SQLite's index."""
    letters = [chr(c) for lo, hi in ((0x21, 0x250), (0x300, 0x36f), (0x370, 0x530), (0x1E00, 0x1F00)) for c in range(lo, hi)
               if chr(c).isprintable()]
    values = ["Hello, WORLD_x c++ don't", "été ÊTRE naïve", "ß ² ½ ộ ǣ ſ", "éa ö", "a­b", "😀 x1y2", "",
              "Straße ΣΊΣΥΦΟΣ İstanbul"] + [f"x{a}y" for a in letters]
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    c.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, instance)")
    c.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", [(i + 1, v) for i, v in enumerate(values)])
    want = [[] for _ in values]
    for term, doc, off in c.execute("SELECT term, doc, offset FROM v ORDER BY doc, offset"):
        want[doc - 1].append(term)
    got = column(spark, values, X.tokens)
    wrong = [(v, g, w) for v, g, w in zip(values, got, want) if g != w]
    # letters that got a lower case, or a decomposition, after the index's tables were made
    assert {v[1:-1] for v, _, _ in wrong} <= set("ͿϓϔԨԪԬԮ"), wrong


def test_phrase_counts(spark):
    rows = [("a a a b", ["a", "a"], 2), ("a b a b a", ["a", "b", "a"], 2), ("the cat, the hat", ["the"], 2),
            ("", ["a"], 0), ("a", ["a", "a"], 0), ("of the the of the", ["of", "the"], 2), ("aa a", ["a"], 1)]
    for text, phrase, n in rows:
        df = spark.createDataFrame([(text, phrase)], "t string, p array<string>")
        ts = X.token_string(F.col("t"))
        got = df.select(X.phrase_count(ts, phrase), X.phrase_match(ts, phrase), X.n_tokens(ts),
                        X.count_in_tokens(X.tokens(F.col("t")), F.col("p"))).first()
        assert tuple(got) == (n, n > 0, len(text.replace(",", "").split()), n), text
