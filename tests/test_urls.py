from urllib.parse import urlparse

from helpers import column

from websift.functions import urls as U

URLS = ["http://a.com/x", "HTTPS://User:pw@Host_1.org:80/p?q#f", "mailto:x@y.z", "ftp://f.net/a", "//h/x", "a/b", "",
        "http:///x", "http://a.com?x=//b", " http://lead.com/", "http://ta\tb.com/", "x-y+z.1://h"]


def test_domain_and_scheme(spark):
    assert column(spark, URLS, U.domain) == [urlparse(u).netloc for u in URLS]
    assert column(spark, URLS, U.scheme) == [urlparse(u).scheme for u in URLS]
    assert column(spark, [None], U.domain) == [None]


def test_normalize_url(spark):
    cases = {None: None, "": "", "http://a.com///": "http://a.com", "a/#top": "a/", "a#x#y": "a",
             "a?utm_source=x&b=1": "a&b=1", "a?b=1&utm_medium=x": "a?b=1", "a?utm_term=1&utm_campaign=2": "a",
             "a?": "a", "a?b&": "a?b", "a??": "a?", "a?utm_sources=1": "a?utm_sources=1", "a/?utm_content=": "a/"}
    assert column(spark, list(cases), U.normalize_url) == list(cases.values())


def test_is_valid_url(spark):
    cases = {None: False, "": False, "http://a.com": True, "HTTP://A.com/x": True, "https://a.com/x.PDF": False,
             "https://a.com/x.pdf?y": True, "ftp://a.com/": False, "mailto:a@b": False, "//a.com/x": False,
             "http://m.facebook.com/": False, "http://notfacebook.com.example/": False,
             "http://a.com/facebook.com": True, "http://h_1/": True, "http://[::1]/": True, "http://[::1/": False,
             "http:///x": False, "http://a.com/archive.docx": False}
    assert column(spark, list(cases), U.is_valid_url) == list(cases.values())


def test_url_priority(spark):
    cases = {"http://a/NEWS": "high", "http://blog.a/docs": "high", "http://a/2024/": "high", "http://a/Learn": "medium",
             "http://guide.a/": "medium", "http://a/x": "low"}
    assert column(spark, list(cases), U.url_priority) == list(cases.values())
