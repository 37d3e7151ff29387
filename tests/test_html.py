import subprocess
import sys

from pyspark.sql import functions as F

from websift.functions.html import with_content, with_parts

PAGE = """<title>Tide tables</title><body><ul><li>High water at <em>six</em>
<li>Low water at noon</ul><style>li { color: blue }</style><blockquote>Mind the <a href="/gap">gap</a></blockquote>"""

CASES = {
    # html: (title, content)
    PAGE: ("Tide tables", "Tide tablesHigh water at six Low water at noonMind the gap"),
    "<p>no title": ("Untitled", "no title"),
    "<title></title><h1>Head</h1>": ("Head", "Head"),
    "<title> </title><h1>Head</h1>": ("Untitled", "Head"),
    "<title>a<b>c</b></title><h1>H <i>x</i></h1>z": ("H x", "acH xz"),
    "<title><b>only</b></title>": ("only", "only"),
    "<title>a<!-- x --></title>": ("Untitled", "a"),
    "<h1>One</h1><h1>Two</h1>": ("One", "OneTwo"),
    "a<nav>b<header>c</header>d</nav>e": ("Untitled", "ae"),
    "a<div><nav>b</div>c": ("Untitled", "ac"),                  # an end tag outside closes what is open inside
    "a<nav>b<p>c": ("Untitled", "a"),
    "a</nav>b": ("Untitled", "ab"),
    "a<!-- b --><!DOCTYPE html>c": ("Untitled", "ac"),
    "x &amp;lt; &eacute;&#233; &unknown; y": ("Untitled", "x   éé  unknown y"),
    "a&nbsp;b": ("Untitled", "a b"),
    "<script>var t='</p>';</script>t<style>p{}</style>": ("Untitled", "t"),
    "<template>x</template><ruby>漢<rt>kan</rt></ruby>": ("Untitled", "漢"),
    "one<p>two<br>three": ("Untitled", "onetwothree"),
    "": ("Untitled", ""),
    None: ("Untitled", ""),
    "<title>" + "x" * 300 + "</title>": ("x" * 300, "x" * 300),
}


def pages(spark, htmls, url="http://h.org/d/p.html?q#f"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_title_and_content(spark):
    rows = with_content(pages(spark, list(CASES))).orderBy("page_id").collect()
    for row, (h, want) in zip(rows, CASES.items()):
        assert (row.title, row.content) == want, h


def test_a_title_is_cut_on_request(spark):
    df = pages(spark, ["<title>" + "x" * 300 + "</title>", "<title></title>"])
    assert [r.title for r in with_content(df, want=("title",), max_title=200).orderBy("page_id").collect()] == ["x" * 200, "Untitled"]


def test_links(spark):
    h = """<a href="/x/">1</a><A HREF='y'>2</A><a href=../z#f>3</a><a name=n>4</a><a href>5</a><nav><a href="//o.net/?a=1&amp;b">6</a>
    </nav><a href="mailto:a@b">7</a><a href="pic.JPG">8</a><!-- <a href="/c">c</a> --><a href="?utm_source=1">9</a>"""
    raw = with_parts(pages(spark, [h])).first().raw_links
    assert raw == ["http://h.org/x/", "http://h.org/d/y", "http://h.org/z#f", "http://h.org/d/p.html?q#f",
                   "http://o.net/?a=1&b", "mailto:a@b", "http://h.org/d/pic.JPG", "http://h.org/d/p.html?utm_source=1"]
    assert with_content(pages(spark, [h])).first().links == [
        "http://h.org/x", "http://h.org/d/y", "http://h.org/z", "http://h.org/d/p.html?q", "http://o.net/?a=1&b",
        "http://h.org/d/p.html"]


def test_a_bad_link_makes_the_page_unreadable(spark):
    row = with_content(pages(spark, ['<title>t</title><a href="http://[bad/">x</a>'])).first()
    assert (row.readable, row.title, row.content, row.links) == (False, None, None, [])


def test_workers_need_no_installed_package(tmp_path):
    """What is sent to a worker can be loaded where this package is not."""
    from pyspark import cloudpickle

    from websift.functions import html, text
    for i, udf in enumerate((html._parser_udf(), text._unescape_udf())):
        file = tmp_path / str(i)
        file.write_bytes(cloudpickle.dumps(udf.func))
        code = f"import sys, pickle; sys.path = [p for p in sys.path if 'repo' not in p]; " \
               f"pickle.load(open({str(file)!r}, 'rb')); assert 'websift' not in sys.modules"
        subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_filters_on_content_parse_once(spark):
    df = with_content(pages(spark, list(CASES))).filter((F.col("title") != "") & (F.length("content") > 3))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
