"""Reads one HTML page with the standard library's parser. Runs inside Arrow workers."""

from __future__ import annotations

from collections import Counter
from html import unescape
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

# Elements dropped with their contents.
DROPPED = ["script", "style", "nav", "footer", "header", "aside"]
# Elements whose strings are not part of a page's text (HTML tree builder rules).
SILENT = ["script", "style", "template", "rt", "rp"]
# Elements without an end tag (the HTML standard's, and older ones).
VOID = ["area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input",
        "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr"]


class _Reader(HTMLParser):
    """Collects text, title, first heading and hrefs while tracking which elements are open."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open: list[str] = []
        self.count: Counter = Counter()
        self.text: list[str] = []
        self.hrefs: list[str] = []
        self.heading: list[str] | None = None
        self.heading_at = 0
        self.title: list | None = None      # child nodes: strings are one-item lists
        self.title_at = 0
        self.title_path: list[list] = []
        self.glue = False                   # may the next string join the last one?

    # elements
    def handle_starttag(self, tag, attrs):
        self.glue = False
        if tag == "a":
            href = dict(attrs).get("href", False)
            if href is not False:
                self.hrefs.append(href or "")
        if self.title_path:
            node: list = []
            self.title_path[-1].append(node)
            if tag not in VOID:
                self.title_path.append(node)
        if tag in VOID:
            return
        self.open.append(tag)
        self.count[tag] += 1
        if tag == "title" and self.title is None:
            self.title, self.title_at = [], len(self.open)
            self.title_path = [self.title]
        if tag == "h1" and self.heading is None:
            self.heading, self.heading_at = [], len(self.open)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.glue = False
        if not self.count[tag]:
            return
        while True:
            name = self.open.pop()
            self.count[name] -= 1
            if self.title_path:
                self.title_path.pop()
            if len(self.open) < self.heading_at:
                self.heading_at = 0
            if name == tag:
                return

    # strings
    def _string(self, data, silent):
        if self.title_path:
            nodes = self.title_path[-1]
            if self.glue and nodes and isinstance(nodes[-1], str):
                nodes[-1] += data
            else:
                nodes.append(data)
        self.glue = True
        if silent:
            return
        if self.heading_at:
            self.heading.append(data)
        if not any(self.count[t] for t in DROPPED):
            self.text.append(data)

    def handle_data(self, data):
        self._string(data, any(self.count[t] for t in SILENT))

    def handle_charref(self, name):
        number = int(name[1:], 16) if name[0] in "xX" else int(name)
        try:
            char = (bytes([number]).decode("cp1252", "ignore") if 0 < number < 256 else "") or chr(number)
            char.encode()
        except (ValueError, OverflowError):
            char = "�"
        self.handle_data("�" if number == 0 else char)

    def handle_entityref(self, name):
        self.handle_data(html5.get(name + ";", "&" + name))

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self.glue = False
            self._string(data[6:], False)
        else:
            self.handle_comment(data)
        self.glue = False

    def handle_comment(self, data):
        self.glue = False
        if self.title_path:
            self.title_path[-1].append(data)

    handle_decl = handle_pi = handle_comment


def _only_string(nodes: list) -> str | None:
    while len(nodes) == 1:
        if isinstance(nodes[0], str):
            return nodes[0]
        nodes = nodes[0]
    return None


def read_page(html: str | None, url: str | None) -> dict:
    """Raw title, text and absolute links of one page; ``readable`` is false if it cannot be read."""
    if not html:
        return {"readable": True, "title": None, "text": "", "links": []}
    r = _Reader()
    try:
        r.feed(html)
        r.close()
        links = [urljoin(url or "", h) for h in r.hrefs]
    except (ValueError, AssertionError):
        return {"readable": False, "title": None, "text": None, "links": []}
    title = _only_string(r.title) if r.title is not None else None
    if not title:
        title = "".join(r.heading) if r.heading is not None else None
    # the second decoding is the first step of text cleaning
    return {"readable": True, "title": None if title is None else unescape(title),
            "text": unescape("".join(r.text)), "links": links}
