"""Inputs that queries derive from the stored tables.

The derivations are plain SQL that reads the same in Spark and in the checking engine, so both sides
start from equal rows. ``DIV`` and ``HEXBYTE(text, n)`` mark the two spots where the dialects differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from pagewright.sources.snapshot import read_table

_SPARK = (r"HEXBYTE\((\w+), (\d+)\)", r"CAST(conv(substr(md5(\1), \2, 2), 16, 10) AS INT)"), ("DIV", "div"), ("MICROS\\((\\w+)\\)", r"unix_micros(CAST(\1 AS TIMESTAMP))")
_CHECK = (r"HEXBYTE\((\w+), (\d+)\)", r"CAST('0x' || substr(md5(\1), \2, 2) AS INT)"), ("DIV", "//"), ("MICROS\\((\\w+)\\)", r"epoch_us(\1)")


def _render(sql: str, rules) -> str:
    for pattern, replacement in rules:
        sql = re.sub(pattern, replacement, sql)
    return sql


def spark_sql(sql: str) -> str:
    return _render(sql, _SPARK)


def check_sql(sql: str) -> str:
    return _render(sql, _CHECK)


# URLs that reach every routing rule.
ROUTED = """CASE page_id % 18
 WHEN 1 THEN 'https://www.linkedin.com/in/p' || CAST(page_id AS STRING)
 WHEN 2 THEN 'https://X.com/u/status/' || CAST(page_id AS STRING)
 WHEN 3 THEN 'https://docs.example.org/p/' || CAST(page_id AS STRING)
 WHEN 4 THEN 'https://proj' || CAST(page_id AS STRING) || '.readthedocs.io/en/'
 WHEN 5 THEN 'https://example.com/app/' || CAST(page_id AS STRING)
 WHEN 6 THEN 'https://example.com/Dashboard'
 WHEN 7 THEN 'https://example.com/#/home/' || CAST(page_id AS STRING)
 WHEN 8 THEN 'https://example.com/#!/u'
 WHEN 9 THEN 'https://github.com/Owner' || CAST(page_id AS STRING) || '/repo/issues/5'
 WHEN 10 THEN 'https://github.com/Settings/profile'
 WHEN 11 THEN 'https://news.ycombinator.com/item?id=' || CAST(page_id AS STRING)
 WHEN 12 THEN 'https://news.ycombinator.com/item?id=abc'
 WHEN 13 THEN 'https://notgithub.com/a/b'
 WHEN 14 THEN 'http://exa mple.com/x' || CAST(page_id AS STRING)
 WHEN 15 THEN 'https://en.wikipedia.org/wiki/P' || CAST(page_id AS STRING)
 WHEN 16 THEN 'https://netflix.com/browse?u=' || url
 WHEN 17 THEN 'https://shop.amazon.com/console'
 ELSE url END"""

# URLs that reach every skip rule.
SKIPPABLE = """CASE page_id % 12
 WHEN 1 THEN url || '/file.PDF'
 WHEN 2 THEN 'https://example.com/Cart/' || CAST(page_id AS STRING)
 WHEN 3 THEN 'https://example.com/x/login'
 WHEN 4 THEN 'https://example.com/wp-admin/plugins.php'
 WHEN 5 THEN 'https://example.com/s?a=1&b=2&c=3&d=4&e=5&f=' || CAST(page_id AS STRING)
 WHEN 6 THEN 'https://example.com/s?a=1&b=2&c=3&d=4&e=5&f=&a=7&novalue'
 WHEN 7 THEN 'https://example.com/password-reset'
 WHEN 8 THEN 'https://example.com/blog/cartoon'
 WHEN 9 THEN 'https://example.com/v.tar.gz;type=a'
 WHEN 10 THEN 'https://example.com/rss#top'
 WHEN 11 THEN 'https://example.com/share/abc.html'
 ELSE url END"""

# URLs with user info, ports, upper-case schemes, encoded and raw non-ASCII paths.
WRITTEN = """CASE page_id % 8
 WHEN 1 THEN 'HTTPS://user:pw@Example.com:8443/a b/' || CAST(page_id AS STRING) || '?q=1#f'
 WHEN 2 THEN url || '///'
 WHEN 3 THEN 'http://example.com/f%C3%BCr/x?y=1/'
 WHEN 4 THEN 'http://example.com/für/' || CAST(page_id AS STRING) || '/#frag/ment'
 WHEN 5 THEN 'http://example.com/%zz'
 WHEN 6 THEN 'http://example.com'
 WHEN 7 THEN 'not-a-url'
 ELSE url END"""

STATUS = "CASE WHEN page_id % 11 = 7 THEN 404 WHEN page_id % 13 = 5 THEN 503 ELSE 200 END"
CONTENT_TYPE = "CASE WHEN page_id % 17 = 3 THEN 'application/json' WHEN page_id % 19 = 4 THEN '' ELSE 'text/html; charset=utf-8' END"

# A site of 32 pages per crawl: page n links to its parent, two children, a copy, an asset and two strangers.
_NODE, _SITE = "(page_id % 32)", "(page_id DIV 32)"
SITE_URL = f"'http://site' || CAST({_SITE} AS STRING) || '.example/n' || CAST({_NODE} AS STRING)"
SITE_HTML = (
    f"'<title>Page ' || CAST(page_id AS STRING) || ' &amp; more</title><a href=\"/n' || CAST(({_NODE} + 1) DIV 2 - 1 + CASE WHEN {_NODE} = 0 THEN 1 ELSE 0 END AS STRING)"
    f" || '\">up</a><a href=\"n' || CAST(2 * {_NODE} + 1 AS STRING) || '\">l</a><a href=\"./n' || CAST(2 * {_NODE} + 2 AS STRING)"
    f" || '/\">r</a><a href=\"/n' || CAST(2 * {_NODE} + 1 AS STRING) || '#again\">c</a><a href=\"/doc.PDF\">d</a>"
    "<a href=\"http://other.example/n1\">o</a><a href=\"mailto:x@y\">m</a>' || replace(html, '<a ', '<i ')"
)
CRAWL_PAGES = f"SELECT page_id, {SITE_URL} AS url, {STATUS} AS status, {CONTENT_TYPE} AS content_type, {SITE_HTML} AS html FROM pages"
CRAWL_JOBS = f"""SELECT site, 'http://site' || CAST(site AS STRING) || '.example/n0' AS url, 3 + (site % 5) * 4 AS max_pages,
 2 + site % 4 AS max_depth FROM (SELECT DISTINCT {_SITE} AS site FROM pages) AS s"""



def with_stored(made: str, key: str = "page_id", extra: str = "") -> str:
    """The stored URLs and, under other ids, the made ones."""
    return f"SELECT page_id AS {key}, url{extra} FROM pages UNION ALL SELECT page_id + 1000000000 AS {key}, {made} AS url{extra} FROM pages"


# Event time squeezed so that limits and throttles bite.
# Some events have no type, some no user, some no time.
SQUEEZED = """SELECT event_id, CASE WHEN event_id % 41 <> 7 THEN user_id END AS user_id, CASE WHEN event_id % 37 <> 5 THEN event_type END AS event_type, props, value,
 CASE WHEN event_id % 101 <> 3 THEN MICROS(ts) DIV 900 END AS us FROM events"""

# Two addresses per host of the page table; some private, some hosts without any.
DNS = """SELECT host, pos, CASE HEXBYTE(host, 1) % 8
  WHEN 0 THEN CASE pos WHEN 0 THEN '8.8.4.4' ELSE '10.0.0.' || CAST(HEXBYTE(host, 3) AS STRING) END
  WHEN 1 THEN '::1'
  WHEN 2 THEN '2606:4700::' || CAST(pos AS STRING)
  ELSE '93.' || CAST(HEXBYTE(host, 3) AS STRING) || '.' || CAST(HEXBYTE(host, 5) AS STRING) || '.' || CAST(pos + 1 AS STRING) END AS ip
 FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, 0 AS pos FROM pages UNION ALL SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, 1 AS pos FROM pages) AS h
 WHERE HEXBYTE(host, 1) % 8 <> 3"""

MARKDOWN = """CASE doc_id % 4
 WHEN 0 THEN replace(text, chr(10), chr(10) || chr(10))
 WHEN 1 THEN '# Title ' || CAST(doc_id AS STRING) || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10))
 WHEN 2 THEN replace(text, '.' || chr(10), '.' || chr(10) || '## Part' || chr(10) || chr(10))
 ELSE text END"""

# Pages with every Markdown element, made from the words of a document.
ELEMENT_WORDS = "SELECT doc_id, 'Doc ' || CAST(doc_id AS STRING) AS a, 'w' || regexp_extract(text, '[A-Za-z]+ [A-Za-z]+', 0) AS b, 'v' || regexp_extract(text, '[a-z]{3,}', 0) AS c FROM documents"
ELEMENT_PAGES = f"""SELECT doc_id, concat('<h2>', a, '</h2><p>', b, ' <a href="/p', c, '">', c, '</a> <img src="', c, '.png" alt="', a, '"> <a>n</a></p><ul><li>', b, '<ol><li>',
 c, '</li><li>y</li></ol></li><li>x', c, '</li></ul><pre><code>', a, '  {{', chr(10), '  ', c, ' &lt; 1', chr(10), '}}</code></pre><blockquote><p>', b, '</p><p>', c,
 '</p></blockquote><hr><h6>', c, '</h6><p><b>', a, '</b> <em>', b, '</em> <code>', c, '</code> t<br>u</p><aside>', c, '</aside>') AS html FROM ({ELEMENT_WORDS}) AS w"""

# One request per order; one owner per customer, one plan per market segment.
REQUESTS = """SELECT o_orderkey AS request_id, o_custkey AS owner,
  CASE o_orderkey % 3 WHEN 0 THEN 'scrape' WHEN 1 THEN 'crawl' ELSE 'extract' END AS kind,
  CASE o_orderkey % 12
   WHEN 1 THEN 'https://www.linkedin.com/in/x'
   WHEN 2 THEN 'https://public.example/app/x'
   WHEN 3 THEN 'ftp://public.example/x'
   WHEN 4 THEN 'https://private.example/'
   WHEN 5 THEN 'https://unknown.example/'
   WHEN 6 THEN 'http://10.1.2.3/x'
   WHEN 7 THEN ''
   WHEN 8 THEN 'https://github.com/owner/repo?a=<b>&c'
   ELSE 'https://public.example/o/' || CAST(o_orderkey AS STRING) END AS url,
  CASE o_orderkey % 7 WHEN 1 THEN 'html' WHEN 2 THEN 'text' WHEN 3 THEN 'pdf' WHEN 4 THEN 'markdown' ELSE '' END AS format,
  CASE o_orderkey % 5 WHEN 1 THEN '' WHEN 2 THEN '{bad' ELSE '{"type": "object", "n": ' || CAST(o_orderkey AS STRING) || '}' END AS extract_schema,
  CAST(o_orderkey % 1300 - 50 AS INT) AS max_pages, CAST(o_orderkey % 15 - 1 AS INT) AS max_depth, CAST(o_orderkey % 900 - 20 AS INT) AS max_timeout
 FROM orders"""
REQUEST_DNS = "SELECT * FROM (VALUES ('public.example', 0, '93.184.216.34'), ('public.example', 1, '2606:4700::1'), ('github.com', 0, '140.82.112.3'), ('www.linkedin.com', 0, '13.107.42.14'), ('private.example', 0, '93.1.1.1'), ('private.example', 1, '192.168.0.9')) AS t(host, pos, ip)"
PLANS = """SELECT c_custkey AS owner, lower(c_mktsegment) AS name, 1000 AS max_credits_per_month,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'fast' WHEN 'AUTOMOBILE' THEN 'fast,browser' WHEN 'MACHINERY' THEN 'fast,browser,stealth' ELSE '' END AS tiers,
  c_mktsegment <> 'BUILDING' AS can_extract,
  CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'AUTOMOBILE' THEN 30 ELSE 60 END AS max_rate_per_min, 5 AS max_concurrency,
  CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'AUTOMOBILE' THEN 100 ELSE 2000 END AS max_crawl_pages,
  CASE c_mktsegment WHEN 'BUILDING' THEN -1 WHEN 'AUTOMOBILE' THEN 24 ELSE 5000 END AS result_retention_hours, 1 AS max_bandwidth_gb
 FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'"""

# Status events: one job per user, in event order.
STATUS_EVENTS = """SELECT user_id AS job_id, event_id AS seq,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'queued' ELSE 'running' END AS status,
  CAST(event_id % 40 AS INT) AS pages_completed FROM events"""
# Ids of entries as a queue gives them, in the order of event_id as numbers but not as text.
ENTRY_ID = "CAST(event_id DIV 13 AS STRING) || '-' || CAST(event_id % 13 AS STRING)"
# Queue entries, some without a URL or a job, a job in several entries.
QUEUED = """SELECT CAST(event_id AS STRING) AS entry_id, ts, CASE event_type WHEN 'error' THEN 'browser_jobs' ELSE 'scrape_jobs' END AS stream,
  CASE WHEN event_id % 13 <> 4 THEN 'http://h/' || CAST(user_id AS STRING) END AS url, CASE WHEN event_id % 11 <> 3 THEN 'job-' || CAST(user_id AS STRING) END AS job FROM events"""
STREAM_OF = "CASE event_type WHEN 'error' THEN 'stealth_jobs' WHEN 'purchase' THEN 'browser_jobs' ELSE 'scrape_jobs' END"


# Scrapes of the stored pages: some bodies unreadable, some URLs not stored, not allowed or unresolved, some bodies over the cap.
SCRAPE_CAP = 4_000
CUT_CAP = 700
SCRAPES = """SELECT page_id AS request_id, page_id % 50 AS owner, 'scrape' AS kind, page_id % 13 <> 4 AS readable,
  CASE page_id % 11 WHEN 2 THEN 'https://public.example/gone' WHEN 5 THEN '' WHEN 7 THEN 'http://10.0.0.8/x' WHEN 9 THEN 'https://www.linkedin.com/in/x' ELSE url END AS url,
  CASE page_id % 7 WHEN 3 THEN 'pdf' ELSE '' END AS format, CAST(NULL AS STRING) AS extract_schema FROM pages"""
# Scrapes of every stored page at its stored URL.
STORED_SCRAPES = """SELECT page_id AS request_id, page_id % 50 AS owner, 'scrape' AS kind, true AS readable, url, '' AS format, CAST(NULL AS STRING) AS extract_schema FROM pages"""
SCRAPE_DNS = """SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, 0 AS pos, '93.184.216.34' AS ip FROM pages
 UNION SELECT 'public.example', 0, '93.184.216.34' UNION SELECT 'www.linkedin.com', 0, '13.107.42.14'"""


# IPv6 addresses of every kind: text before and after a document's number in hexadecimal, and what each dialect says.
IP6_KINDS = [
    ("fc00::", "", "TTTT"), ("fdff:a:", "::9", "TTTT"), ("fe80::1:", "", "TTTT"), ("febf::", ":2", "TTTT"), ("fec0::", "", "FFFF"), ("ff02::", "", "TFFT"), ("ff05::", ":1", "FFFF"),
    ("2001:db8::", "", "FFFF"), ("2606:4700:0:0:0:0:", ":1111", "FFFF"), ("::ffff:0a00:", "", "TTTT"), ("::ffff:5db8:", "", "FFFF"), ("0:0:0:0:0:FFFF:e000:", "", "?FTT"), ("1::", "::3", "NNTT"),
    ("12345::", "", "NNTT"), ("FE80:0:0:0:0:0:0:", "", "TTTT"), ("fbff::", "", "FFFF"),
]
IP6 = " UNION ALL ".join(f"SELECT doc_id, {i} AS kind, '{a}' || lower(hex(doc_id % 65536)) || '{b}' AS ip FROM documents" for i, (a, b, _) in enumerate(IP6_KINDS))

# Pages made from the stored ones whose heads hold every metadata field, some of them, or empty ones.
HEADS = """SELECT page_id, concat(CASE page_id % 4 WHEN 3 THEN '<html>' ELSE '<html lang="l' END, CASE page_id % 4 WHEN 3 THEN '' ELSE concat(CAST(page_id AS STRING), '">') END, '<head>',
  CASE page_id % 4 WHEN 1 THEN '<title> </title>' ELSE concat('<title> T', CAST(page_id AS STRING), ' &amp; more </title><title>no</title>') END,
  CASE page_id % 3 WHEN 0 THEN concat('<meta name="description" content="D', CAST(page_id AS STRING), '"><meta name="description" content="second">') WHEN 1 THEN '<meta name="description" content="">' ELSE '' END,
  CASE page_id % 2 WHEN 0 THEN concat('<meta property="og:title" content="O', CAST(page_id AS STRING), '"/><meta content=''od'' property=''og:description''><meta property=og:image content=/i', CAST(page_id AS STRING), '.png><meta property="og:url" content="', url, '">') ELSE '' END,
  '</head>', html) AS html FROM pages"""
# Pages whose links have other schemes and hosts, assets, skipped paths and relative forms.
LINKED = """SELECT page_id, concat('http://h', CAST(page_id % 5 AS STRING), '.example/a/b?x=1') AS url, concat('<a href="ftp://h', CAST(page_id % 5 AS STRING), '.example/f">1</a><a href="https://other.example/o">2</a><a href="/f',
  CAST(page_id AS STRING), '.PDF">3</a><a href="c', CAST(page_id AS STRING), '">4</a><a href="../up/">5</a><a href="?q=', CAST(page_id AS STRING), '">6</a><a href="//h', CAST((page_id + page_id % 2) % 5 AS STRING),
  '.example/net">7</a><a href="tel:1">8</a><a href="/style.css">9</a><a href="/keep.html#x">10</a><a href="/drop/me">11</a>') AS html FROM pages"""


# Addresses of documents, some of them unreadable, and ranges made from the same documents: nested ones, ones that
# differ behind their prefix only, single addresses and the whole of both families.
_OCTETS = "CAST(doc_id % 224 AS STRING) || '.' || CAST(doc_id * 7 % 256 AS STRING) || '.' || CAST(doc_id * 13 % 256 AS STRING)"
_GROUPS = "'2001:db8:' || lower(hex(doc_id % 4096)) || ':' || lower(hex(doc_id * 31 % 65536))"
RANGE_ADDRESSES = f"""SELECT doc_id, 0 AS kind, {_OCTETS} || '.' || CAST(doc_id % 256 AS STRING) AS ip FROM documents
 UNION ALL SELECT doc_id, 1 AS kind, {_GROUPS} || ':0:0:0:' || lower(hex(doc_id * 17 % 65536)) AS ip FROM documents
 UNION ALL SELECT doc_id, 2 AS kind, '0:0:0:0:0:FFFF:' || lower(hex(doc_id % 57344)) || ':' || lower(hex(doc_id * 5 % 65536)) AS ip FROM documents
 UNION ALL SELECT doc_id, 3 AS kind, CASE doc_id % 3 WHEN 0 THEN '1.2.3' WHEN 1 THEN '1.2.3.' || CAST(256 + doc_id AS STRING) ELSE 'h' || CAST(doc_id AS STRING) END AS ip FROM documents"""
RANGE_TABLE = f"""SELECT doc_id, CASE doc_id % 11
  WHEN 0 THEN {_OCTETS} || '.0/24' WHEN 1 THEN {_OCTETS} || '.' || CAST(doc_id % 64 AS STRING) || '/25' WHEN 2 THEN CAST(doc_id % 224 AS STRING) || '.0.0.0/8'
  WHEN 3 THEN CAST(doc_id % 224 AS STRING) || '.' || CAST(doc_id * 7 % 256 AS STRING) || '.9.9/' || CAST(9 + doc_id % 14 AS STRING) WHEN 4 THEN {_OCTETS} || '.' || CAST(doc_id % 256 AS STRING)
  WHEN 5 THEN {_GROUPS} || ':0:0:0:1/' || CAST(33 + doc_id % 31 AS STRING) WHEN 6 THEN {_GROUPS} || ':0:0:0:' || lower(hex(doc_id * 17 % 65536)) WHEN 7 THEN {_GROUPS} || ':0:0:0:' || lower(hex(doc_id * 17 % 65536)) || '/' || CAST(65 + doc_id % 60 AS STRING)
  WHEN 8 THEN '2001:db8:0:0:0:0:0:0/32' WHEN 9 THEN CASE doc_id % 2 WHEN 0 THEN '0.0.0.0/1' ELSE '0:0:0:0:0:0:0:0/0' END ELSE {_OCTETS} || '.0/33' END AS cidr FROM documents"""

# Hosts of the pages' URLs and of made ones, and a table of names made from the same pages.
HOSTS = f"SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host FROM ({with_stored(ROUTED)}) AS u"
NAMED = """SELECT CASE page_id % 6 WHEN 0 THEN h WHEN 1 THEN regexp_extract(h, '[^.]*[.][^.]*$', 0) WHEN 2 THEN regexp_extract(h, '^[^.]*', 0) WHEN 3 THEN 'www.' || h WHEN 4 THEN 'd' || CAST(page_id AS STRING) || '.example.org' ELSE regexp_extract(h, '[^.]*$', 0) END AS name,
  CASE page_id % 7 WHEN 0 THEN 'exact' WHEN 1 THEN 'below' WHEN 2 THEN 'first' ELSE 'domain' END AS match, CASE page_id % 3 WHEN 0 THEN 'static_doc' ELSE 'protected' END AS list
 FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS h FROM pages) AS p WHERE page_id % 5 < 2"""


def derive(spark: SparkSession, folder: str, sql: str, *tables: str) -> DataFrame:
    """Run a derivation over the named tables, without leaving views behind."""
    frames = {t: read_table(spark, folder, t) for t in tables}
    return spark.sql(spark_sql(re.sub(rf"\bFROM ({'|'.join(tables)})\b", r"FROM {\1}", _escape(sql))), **frames)


def _escape(sql: str) -> str:
    return sql.replace("{", "{{").replace("}", "}}")
