"""SQL fragments for checking the queries of ``catalog`` against another engine (DuckDB)."""

from __future__ import annotations

from websift.functions.rank import AUTHORITY
from websift.functions.urls import SKIP_DOMAINS, SKIP_SUFFIXES

BLANK = (r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
         r"\x{205F}\x{3000}")
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "copy": "©", "middot": "·", "nbsp": " "}


def sub(x: str, pattern: str, to: str) -> str:
    pattern, to = pattern.replace("'", "''"), to.replace("'", "''")
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def unescape(x: str) -> str:
    for name, char in ENTITIES.items():
        x = f"replace({x}, '&{name};', '{char}')"
    return sub(x, "&amp;?", "&")


def tidy(x: str) -> str:
    x = sub(x, f"[{BLANK}]+", " ")
    x = sub(x, rf"""[^\p{{L}}\p{{N}}_{BLANK}.,!?;:()\-"']""", " ")
    x = sub(x, " +([,.!?;:])", r"\1")
    x = sub(x, "([.!?]) *([A-Z])", r"\1 \2")
    return f"trim({x}, ' ')"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({x})), '[\p{{L}}\p{{N}}\p{{Co}}]+')"


def domain(x: str) -> str:
    return rf"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"


def normalize(x: str) -> str:
    x = sub(f"rtrim({x}, '/')", "#.*$", "")
    for p in ("source", "medium", "campaign", "content", "term"):
        x = sub(x, f"[?&]utm_{p}=[^&]*", "")
    return sub(x, "[?&]$", "")


SUFFIXES = "|".join(s.removeprefix(".") for s in SKIP_SUFFIXES)


def valid(x: str) -> str:
    host = f"lower({domain(x)})"
    skip = " AND ".join(f"NOT contains({host}, '{d}')" for d in SKIP_DOMAINS)
    return (rf"regexp_matches({x}, '^(?i:https?)://') AND {host} <> '' AND {skip} "
            rf"AND NOT regexp_matches(lower({x}), '\.({SUFFIXES})$')")


def priority(x: str) -> str:
    return (f"CASE WHEN regexp_matches(lower({x}), 'news|blog|article|2024|2023') THEN 'high' "
            f"WHEN regexp_matches(lower({x}), 'docs|tutorial|guide|learn') THEN 'medium' ELSE 'low' END")


_BARE = "html"
for _t in ("script", "style"):
    _BARE = sub(_BARE, rf"(?s)<{_t}\b[^>]*>.*?</{_t}>", "")
_BARE = sub(_BARE, "(?s)<!--.*?-->", "")
_BODY = "bare"
for _t in ("nav", "footer", "header", "aside"):
    _BODY = sub(_BODY, rf"(?s)<{_t}\b[^>]*>.*?</{_t}>", "")
_BODY = sub(_BODY, "<[^>]*>", "")
_TITLE = tidy(unescape(unescape("regexp_extract(bare, '<title>([^<]*)</title>', 1)")))
_CONTENT = tidy(unescape(unescape(_BODY)))

# from raw pages to stored pages
CORPUS = f"""
raw AS (SELECT page_id, url, {_BARE} AS bare FROM pages),
corpus AS (
  SELECT page_id AS id, url, coalesce(nullif({_TITLE}, ''), 'Untitled') AS title,
         {_CONTENT} AS content, TIMESTAMP '2024-01-01' + to_hours(page_id * 7) AS crawled_at,
         200 AS status_code
  FROM raw)"""

DOC_CORPUS = """
corpus AS (
  SELECT doc_id AS id, 'https://' || source || '.example.com/' || doc_id AS url,
         split_part(text, chr(10), 1) AS title, text AS content,
         TIMESTAMP '2024-01-01' + to_hours(doc_id * 7) AS crawled_at, 200 AS status_code
  FROM documents)"""

_HREF = "regexp_extract(url, '^(https?://[^/?#]+)', 1) || h"
LINKS = f"""
raw AS (SELECT page_id, url, {_BARE} AS bare FROM pages),
hrefs AS (SELECT page_id, url, {unescape("unnest(regexp_extract_all(bare, '<a href=" + chr(34) + "([^" + chr(34) + "]*)" + chr(34) + "', 1))")} AS h,
                 generate_subscripts(regexp_extract_all(bare, '<a href="([^"]*)"', 1), 1) AS n FROM raw),
full_links AS (SELECT page_id, url, n, {normalize(_HREF)} AS dst_url FROM hrefs),
links AS (
  SELECT page_id, url AS src_url, pos, dst_url FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INTEGER) AS pos
    FROM full_links WHERE {valid("dst_url")}))"""


def phrase_count(toks: str, phrase: list[str]) -> str:
    m = len(phrase)
    if m == 1:
        return f"len([t FOR t IN {toks} IF t = '{phrase[0]}'])"
    items = ", ".join(f"'{p}'" for p in phrase)
    return (f"len([i FOR i IN range(1, greatest(len({toks}) - {m} + 2, 1)) "
            f"IF {toks}[i:i + {m} - 1] = [{items}]])")


def found(phrases: list[tuple[bool, list[str]]], corpus: str = CORPUS, where: str = "true") -> str:
    """CTEs up to ``found``: the matching rows with ``rank``."""
    counts, idfs, parts, hit = [], [], [], ["true"]
    for i, (title_only, p) in enumerate(phrases):
        f = phrase_count("tt", p) + ("" if title_only else " + " + phrase_count("ct", p))
        counts.append(f", {f} AS f{i}")
        raw = f"ln((count(*) - count(*) FILTER (f{i} > 0) + 0.5) / (count(*) FILTER (f{i} > 0) + 0.5))"
        idfs.append(f", CASE WHEN {raw} <= 0 THEN 1e-6 ELSE {raw} END AS idf{i}")
        parts.append(f"idf{i} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / avgd))")
        hit.append(f"f{i} > 0")
    rank = "-(" + " + ".join(parts) + ")" if parts else "0.0::DOUBLE"
    return f"""{corpus},
toks AS (SELECT *, {tokens("title")} AS tt, {tokens("content")} AS ct FROM corpus),
facts AS (SELECT * EXCLUDE (tt, ct), len(tt) + len(ct) AS d{''.join(counts)} FROM toks),
st AS (SELECT count(*) AS n, avg(d) AS avgd{''.join(idfs)} FROM facts),
found AS (SELECT id, url, title, content, crawled_at, {rank} AS rank FROM facts, st
          WHERE {' AND '.join(hit)} AND ({where}))"""


def website_rank(url: str, title: str, length: str, terms: str) -> str:
    """``terms``: SQL for a list of strings."""
    host = f"lower({domain(url)})"
    site = " ".join(f"WHEN contains({host}, '{s}') THEN {b}" for s, b in AUTHORITY.items())
    return (f"CAST(CASE {site} ELSE 0 END"
            f" + CASE WHEN contains({host}, '.com') OR contains({host}, '.org') OR contains({host}, '.net')"
            f" THEN 20 ELSE 0 END"
            f" + 30 * len([t FOR t IN {terms} IF contains(lower({title}), lower(t))])"
            f" + 15 * len([t FOR t IN {terms} IF contains(lower({url}), lower(t))])"
            f" + CASE WHEN {length} > 1000 THEN 10 WHEN {length} > 500 THEN 5 ELSE 0 END AS INTEGER)")


BADGE = "CASE WHEN custom_rank > 80 THEN 'Original Site' WHEN custom_rank > 50 THEN 'High Quality' END"


def page_ctes(phrases, terms: list[str], order: str, page: int = 1, rerank: bool = False,
              corpus: str = CORPUS, where: str = "true") -> str:
    """CTEs up to ``shown``: one page of results in its final order."""
    lst = "[" + ", ".join(f"'{t}'" for t in terms) + "]::VARCHAR[]"
    lead = "custom_rank DESC, " if rerank else ""
    return f"""{found(phrases, corpus, where)},
page AS (SELECT *, CAST(length(content) AS INTEGER) AS content_length FROM found ORDER BY {order}, id
         LIMIT 20 OFFSET {max((page - 1) * 20, 0)}),
ranked AS (SELECT *, {website_rank("url", "title", "length(content)", lst)} AS custom_rank FROM page),
shown AS (SELECT CAST(row_number() OVER (ORDER BY {lead}{order}, id) AS INTEGER) AS pos, id, url, title, content,
                 round(rank, 6) AS rank, crawled_at, content_length, {domain("url")} AS domain,
                 strftime(crawled_at, '%Y-%m-%d') AS crawled_date, custom_rank, {BADGE} AS badge FROM ranked)"""


def result_page(*args, **kw) -> str:
    return f"WITH {page_ctes(*args, **kw)} SELECT * EXCLUDE (content) FROM shown"


_RAW = (r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\x{300}-\x{304}\x{306}-\x{30c}\x{30f}\x{311}\x{31b}\x{323}-\x{328}"
        r"\x{32d}\x{32e}\x{330}\x{331}]*")

# ``rows(key, content, phrases)`` to ``snips(key, snippet)``: every window that begins at a hit or at the
# sentence before it is scored against all hits.
SNIPPETS = rf"""
sn AS (SELECT key, phrases, content, regexp_extract_all(content, '{_RAW}') AS raw,
              string_split_regex(content, '{_RAW}') AS gaps, {tokens("content")} AS ft,
              len(regexp_extract_all(content, '{_RAW}')) AS n
       FROM (SELECT key, phrases, coalesce(content, '') AS content FROM rows)),
sn_pos AS (SELECT key, unnest(range(n)) AS j FROM sn),
sn_ph AS (SELECT key, unnest(phrases) AS p, unnest(range(len(phrases))) AS ph FROM sn),
sn_hits AS (SELECT key, j AS pos, ph, len(p) AS m FROM sn_pos JOIN sn USING (key) JOIN sn_ph USING (key)
            WHERE len(p) > 0 AND ft[j + 1:j + len(p)] = p),
sn_starts AS (SELECT key, j FROM sn_pos JOIN sn USING (key) WHERE j = 0 OR regexp_matches(gaps[j + 1], '[.:][ \t\n\r]+$')),
sn_before AS (SELECT h.key, h.pos, max(j) AS s FROM (SELECT DISTINCT key, pos FROM sn_hits) h
              JOIN sn_starts s ON s.key = h.key AND s.j <= h.pos GROUP BY h.key, h.pos),
sn_w AS (SELECT DISTINCT key, pos AS start, 0 AS bonus, pos * 2 AS turn FROM sn_hits
         UNION ALL SELECT key, s, CASE WHEN s = 0 THEN 120 ELSE 100 END, pos * 2 + 1 FROM sn_before JOIN sn USING (key)
         WHERE s < pos AND n > 15),
sn_score AS (SELECT w.key, w.start, w.bonus, w.turn, 999 * count(DISTINCT h.ph) + count(*) + w.bonus AS score,
                    max_by(h.pos + h.m, h.pos * 1000 + h.ph) AS fin
             FROM sn_w w JOIN sn_hits h ON h.key = w.key AND h.pos BETWEEN w.start AND w.start + 14
             GROUP BY w.key, w.start, w.bonus, w.turn),
sn_best AS (SELECT * FROM sn_score QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, turn) = 1),
sn_lo AS (SELECT sn.key, n, CAST(CASE WHEN start IS NULL THEN 0 WHEN bonus > 0 THEN start
                 ELSE greatest(least(start - trunc((15 - (fin - start)) / 2.0), n - 15), 0) END AS BIGINT) AS lo
          FROM sn LEFT JOIN sn_best USING (key)),
sn_win AS (SELECT *, least(lo + 14, n - 1) AS hi FROM sn_lo),
sn_tok AS (SELECT w.key, p.j, coalesce(bool_or(h.pos <= p.j AND h.pos + h.m > p.j), false) AS cov,
                  coalesce(bool_or(h.pos = p.j), false) AND NOT coalesce(bool_or(h.pos < p.j AND h.pos + h.m > p.j), false) AS opn
           FROM sn_win w JOIN sn_pos p ON p.key = w.key AND p.j BETWEEN w.lo AND w.hi + 1
           LEFT JOIN sn_hits h ON h.key = w.key AND h.pos BETWEEN w.lo - 50 AND w.hi + 1 GROUP BY w.key, p.j),
sn_mark AS (SELECT *, bool_or(opn) OVER (PARTITION BY key ORDER BY j) AS begun, lead(cov) OVER (PARTITION BY key ORDER BY j) AS next_cov,
                   lead(opn) OVER (PARTITION BY key ORDER BY j) AS next_opn FROM sn_tok),
sn_body AS (SELECT key, string_agg(CASE WHEN j > lo THEN gaps[j + 1] ELSE '' END || CASE WHEN opn THEN '<mark>' ELSE '' END
                || raw[j + 1] || CASE WHEN cov AND begun AND (j = hi OR NOT next_cov OR next_opn) THEN '</mark>' ELSE '' END, '' ORDER BY j) AS body
            FROM sn_mark JOIN sn_win USING (key) JOIN sn USING (key) WHERE j <= hi GROUP BY key),
sn_full AS (SELECT key, CASE WHEN sn.n = 0 THEN content ELSE CASE WHEN lo > 0 THEN ' … ' ELSE gaps[1] END || body
                             || CASE WHEN hi >= sn.n - 1 THEN gaps[sn.n + 1] ELSE ' … ' END END AS s
            FROM sn JOIN sn_win USING (key) LEFT JOIN sn_body USING (key)),
snips AS (SELECT key, CASE WHEN length(s) > 300 THEN substr(s, 1, 300) || '...' ELSE s END AS snippet FROM sn_full)"""


def sql_list(items) -> str:
    return "[" + ", ".join(sql_list(i) if isinstance(i, list) else f"'{i}'" for i in items) + "]"


# results(key, title, snippet, exclude, ...) without excluded rows, as displayed
KEPT = """NOT coalesce(len([w FOR w IN exclude IF contains(lower(coalesce(title, '') || ' ' ||
    replace(replace(snippet, '<mark>', ''), '</mark>', '')), lower(w))]) > 0, false)"""
DISPLAYED = """REPLACE (coalesce(nullif(title, ''), 'Untitled') AS title,
                         coalesce(nullif(snippet, ''), 'No description available.') AS snippet)"""


def full_page(phrases, exclude: list[str], *args, **kw) -> str:
    """CTEs up to ``results``: ``page_ctes`` with snippets, exclusions and defaults."""
    words = sql_list([p for title_only, p in phrases if not title_only])
    return f"""{page_ctes(phrases, *args, **kw)},
rows AS (SELECT id AS key, content, {words}::VARCHAR[][] AS phrases FROM shown),
{SNIPPETS},
results AS (SELECT * {DISPLAYED} FROM (
  SELECT shown.* EXCLUDE (content), snippet FROM shown JOIN snips ON key = id,
         (SELECT {sql_list(exclude)}::VARCHAR[] AS exclude) WHERE {KEPT}))"""


def summary(phrases, page: int, where: str = "true", corpus: str = CORPUS) -> str:
    return f"""WITH {found(phrases, corpus, where)},
t AS (SELECT count(*) AS total_results, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM found)
SELECT total_results, total_pages, CAST({page} AS INTEGER) AS current_page, {page} < total_pages AS has_next,
       {page} > 1 AS has_prev FROM t"""
