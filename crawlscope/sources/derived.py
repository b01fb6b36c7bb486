"""Recorded inputs the given tables lack, derived from `pages` by plain arithmetic on page_id.

The SQL text here only uses syntax that Spark and other SQL engines read alike, so the same inputs can be built
on both sides of a comparison. Row counts follow `pages`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscope.sources.tables import read_table


def _sql_text(template: str) -> str:
    """SQL expression for a template with {U} own URL, {O} own origin, {N} page id and | for a line break."""
    out = []
    for piece in template.replace("{U}", "\0url\0").replace("{O}", "\0site\0").replace("{N}", "\0CAST(page_id AS STRING)\0").replace("|", "\0chr(10)\0").split("\0"):
        if piece in ("url", "site", "CAST(page_id AS STRING)", "chr(10)"):
            out.append(piece)
        elif piece:
            out.append(f"'{piece}'")
    return " || ".join(out) or "''"


def _case(selector: str, templates: list[str] | dict[int, str], default: str = "''") -> str:
    items = templates.items() if isinstance(templates, dict) else enumerate(templates)
    return f"CASE {selector} " + " ".join(f"WHEN {i} THEN {_sql_text(t)}" for i, t in items) + f" ELSE {default} END"


PATHS = [
    "/", "/services", "/blog", "/blog/post-{N}", "/products/item-{N}", "/pricing", "/about", "/team/person-{N}",
    "/solutions/s-{N}?color=red&page=2", "/en/{N}", "/privacy",
]

_LD = '<script type="application/ld+json">'
HEADS = [
    "",
    '<meta name="description" content="Page {N} in short"><link rel="canonical" href="{U}"><meta name="viewport" content="width=device-width, initial-scale=1"><meta name="author" content="Ann Lee"><meta property="article:published_time" content="2024-01-02"><meta name="generator" content="PressKit 5">',
    '<link rel="canonical" href="{U}"><link rel="canonical" href="{O}/other"><meta name="robots" content="noindex, follow">',
    '<meta name="viewport" content="width=device-width, user-scalable=no"><meta name="robots" content="nofollow, max-snippet:50"><link rel="canonical" href="/services">',
    '<link rel="alternate" hreflang="en" href="{U}"><link rel="alternate" hreflang="en-UK" href="{O}/pricing"><link rel="alternate" hreflang="x-default" href="{O}/">',
    '<link rel="alternate" hreflang="fr" href="{O}/about"><link rel="alternate" hreflang="de" href="{O}/gone">' + _LD + '{"@type":"Product","name":"Item {N}"}</script>',
    _LD + '{"@context":"https://schema.org","@type":"Article","headline":"Headline {N}","author":[{"name":"Bo"}],"datePublished":"2024-03-01"}</script>',
    _LD + '{"@type":"Event","name":}</script>',
    _LD + '{"@graph":[{"@type":"BreadcrumbList","itemListElement":[{"position":1,"name":"Home","item":"{O}/"},{"position":2}]},{"@type":["Organization","Brand"],"name":"Org {N}","url":"{O}","logo":"l","sameAs":["a"]}]}</script>',
    '<meta name="googlebot" content="none"><meta name="viewport" content="width=1024">',
    '<script src="http://cdn.example/x.js"></script><link rel="stylesheet" href="http://cdn.example/x.css"><link rel="canonical" href="mailto:x">',
    '<meta name="description" content="Shared text"><link rel="canonical" href="{O}/about">' + _LD + '{"@type":"SoftwareApplication","name":"App","offers":[{"price":"9"}],"review":"good"}</script>',
    '<meta name="description" content="Shared text"><link rel="canonical" href="{O}/gone"><meta name="robots" content="nosnippet">',
]

# All derived documents carry the same link patterns on top of their own ones.
_NAV = '<nav><a href="/services">Services</a><a href="/blog">Blog</a><a href="/products/item-{N}">Item</a><a href="/old?page=1&amp;x=2">Old</a>'
_MAIN = '<a href="/pricing#plans">See plans</a><a href="mailto:a@b.example">Mail</a><a>no target</a><a href="../team/./person-{N}">Person</a><img src="http://img.example/p.png" alt=""></article>'
_FOOT = '<a href="/privacy">Privacy</a><a href="https://other.example/x" rel="nofollow">Elsewhere</a></footer>'
_CHALLENGE = '<!DOCTYPE html><html><head><title>Just a moment...</title></head><body><div id="challenge-form">Checking your browser</div></body></html>'

X_ROBOTS = {4: "noindex", 6: "googlebot: nosnippet", 8: "otherbot: noindex", 14: "max-snippet:0|noarchive"}
ROBOTS_TEXTS = [
    "User-agent: *|Disallow: /private|",
    "# all|User-agent: Googlebot|Disallow: /blog/|Allow: /blog/post-1|Sitemap: {O}/sitemap.xml|",
    "User-agent: GPTBot|User-agent: ClaudeBot|Disallow: /||User-agent: *|Disallow: /*?color=|Allow: /*?color=red&page=2$|",
    "User-agent: *|Disallow: /|Allow: /$|Allow: /services|",
    "",
    "User-agent: googlebot|Crawl-delay: 5|Disallow:||User-agent: OAI-SearchBot|Disallow: /team|User-agent: googlebot|Disallow: /about|",
    "Disallow: /lost|User-agent: PerplexityBot|Disallow: /pricing$|Allow: /pricing|Sitemap: ftp://x.example/s.xml|Sitemap: https://maps.example/site.xml|",
]

CRAWL_SQL = f"""
SELECT page_id, host, site, path, url, doc,
  CASE WHEN page_id % 7 = 4 THEN split_part(doc, '<body>', 1) || '<body><div id="app"></div><script src="/app.js"></script></body></html>'
       WHEN page_id % 23 = 6 THEN '{_CHALLENGE}'
       ELSE doc END AS html,
  CASE WHEN page_id % 7 = 1 THEN replace(doc, '<title>', '<title>JS ')
       WHEN page_id % 7 = 2 THEN replace(doc, '<nav>', '<nav><a href="/a1">A1</a><a href="/a2">A2</a><a href="/a3">A3</a><a href="/a4">A4</a><a href="/a5">A5</a><a href="/a6">A6</a><a href="/a7">A7</a><a href="/a8">A8</a><a href="/a9">A9</a><a href="/b1">B1</a><a href="/b2">B2</a><a href="/b3">B3</a><a href="/b4">B4</a>')
       WHEN page_id % 23 = 6 THEN CASE WHEN page_id % 2 = 0 THEN '{_CHALLENGE}' ELSE doc END
       ELSE doc END AS dom,
  CASE WHEN page_id % 17 = 3 THEN 404 WHEN page_id % 17 = 5 THEN 403 WHEN page_id % 17 = 9 THEN 500
       WHEN page_id % 17 = 11 THEN 429 WHEN page_id % 17 = 13 THEN 410 WHEN page_id % 17 IN (14, 15) THEN NULL
       WHEN page_id % 17 = 16 THEN 204 ELSE 200 END AS status,
  CASE WHEN page_id % 17 = 14 THEN 'TIMEOUT' WHEN page_id % 17 = 15 THEN 'REDIRECT_LOOP' ELSE 'OK' END AS acquisition,
  CASE WHEN page_id % 17 IN (3, 5, 9, 11, 13, 14, 15) THEN CASE WHEN page_id % 17 = 14 THEN 200 ELSE NULL END ELSE 200 END AS dom_status,
  CASE WHEN page_id % 17 IN (3, 5, 9, 11, 13, 15) THEN 'RENDER_FAILED' ELSE 'OK' END AS dom_acquisition,
  page_id % 5 AS hop_kind,
  {_case('page_id % 19', X_ROBOTS, 'NULL')} AS x_robots,
  CASE WHEN page_id % 19 = 10 THEN '<' || site || '/hdr>; rel="canonical", <' || site || '/about>; rel="alternate"; hreflang="it"' ELSE NULL END AS link_header
FROM (
  SELECT page_id, host, site, path, url,
    replace(replace(replace(replace(html, '</head>', {_case('page_id % 13', HEADS)} || '</head>'),
      '<nav>', {_sql_text(_NAV)}), '</article>', {_sql_text(_MAIN)}), '</footer>', {_sql_text(_FOOT)}) AS doc
  FROM (
    SELECT page_id, host, 'https://' || host AS site, path, 'https://' || host || path AS url, html
    FROM (SELECT page_id, split_part(url, '/', 3) AS host, {_case('page_id % 11', PATHS)} AS path, html FROM pages)
  )
)
"""

ROBOTS_SQL = f"""
SELECT site AS origin, page_id, CASE page_id % 11 WHEN 5 THEN 503 WHEN 6 THEN 404 WHEN 7 THEN 429 WHEN 8 THEN NULL ELSE 200 END AS status,
  CASE WHEN page_id % 11 = 8 THEN 'TIMEOUT' ELSE 'OK' END AS acquisition, page_id % 13 = 9 AS challenge,
  {_case('page_id % 7', ROBOTS_TEXTS)} AS text
FROM (SELECT 'https://' || host AS site, page_id FROM (SELECT split_part(url, '/', 3) AS host, min(page_id) AS page_id FROM pages GROUP BY 1))
"""


def pages_view(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "pages")


def derived(spark: SparkSession, root: str, text: str) -> DataFrame:
    """Run one of the texts above over the `pages` table."""
    escaped = text.replace("{", "{{").replace("}", "}}").replace("FROM pages", "FROM {pages}")
    return spark.sql(escaped, pages=pages_view(spark, root))


def crawl(spark: SparkSession, root: str) -> DataFrame:
    """RAW and RENDERED records of every page: source, DOM, status, redirect hops and headers."""
    rows = derived(spark, root, CRAWL_SQL)
    hop = lambda source, code, target: F.struct(source.alias("url"), F.lit(code).alias("status"), target.alias("location"))
    site, url, host = F.col("site"), F.col("url"), F.col("host")
    insecure = F.concat(F.lit("http://"), host, F.col("path"))
    step = F.concat(site, F.lit("/step"))
    none = F.array().cast("array<struct<url:string,status:int,location:string>>")
    hops = (
        F.when(F.col("hop_kind") == 1, F.array(hop(insecure, 301, url)))
        .when(F.col("hop_kind") == 2, F.array(hop(url, 302, insecure), hop(insecure, 301, url)))
        .when(F.col("hop_kind") == 3, F.array(hop(insecure, 301, step), hop(step, 302, F.concat(step, F.lit("2"))), hop(F.concat(step, F.lit("2")), 302, url)))
        .otherwise(none)
    )
    entry = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    headers = F.map_from_entries(F.filter(
        F.array(
            entry("content-type", F.lit("text/html")), entry("x-robots-tag", F.col("x_robots")), entry("link", F.col("link_header")),
            entry("cf-mitigated", F.when(F.col("page_id") % 19 == 12, F.lit("challenge"))),
            entry("referrer-policy", F.when(F.col("page_id") % 2 == 0, F.lit("no-referrer"))),
        ),
        lambda e: e["value"].isNotNull(),
    ))
    return rows.select(
        "page_id", "site", "host", "url", "html", "dom", "status", "acquisition", "dom_status", "dom_acquisition",
        hops.alias("hops"), headers.alias("headers"),
        F.when(F.col("acquisition") == "OK", url).alias("final_url"),
        F.when(F.col("page_id") % 29 == 8, F.concat(site, F.lit("/moved"))).when(F.col("dom_acquisition") == "OK", url).alias("dom_url"),
    )


def robots_files(spark: SparkSession, root: str) -> DataFrame:
    return derived(spark, root, ROBOTS_SQL)


PROBES_SQL = """
SELECT site, 'origin' AS kind, 'https://' || host || '/' AS url, CASE m % 7 WHEN 3 THEN 'TLS_ERROR' WHEN 5 THEN 'NETWORK_ERROR' ELSE 'OK' END AS acquisition,
  CASE WHEN m % 7 IN (3, 5) THEN NULL ELSE 200 END AS status, CASE WHEN m % 7 IN (3, 5) THEN NULL WHEN m % 5 = 1 THEN 'http://' || host || '/' ELSE 'https://' || host || '/' END AS final_url,
  CASE m % 4 WHEN 0 THEN NULL ELSE 'https://' || host || '/' END AS canonical, 'text/html' AS content_type, '' AS body_prefix, '' AS title, '' AS h1, CASE WHEN m % 7 IN (3, 5) THEN NULL ELSE 'VALID_PAGE' END AS validity FROM {H}
UNION ALL SELECT site, 'origin', 'http://' || host || '/', CASE m % 11 WHEN 4 THEN 'TIMEOUT' ELSE 'OK' END, CASE m % 11 WHEN 4 THEN NULL ELSE 200 END,
  CASE WHEN m % 11 = 4 THEN NULL WHEN m % 3 = 0 THEN 'https://' || host || '/' ELSE 'http://' || host || '/' END, CASE m % 4 WHEN 1 THEN 'https://' || host || '/' WHEN 2 THEN 'http://' || host || '/' ELSE NULL END,
  'text/html', '', '', '', CASE m % 11 WHEN 4 THEN NULL WHEN 6 THEN 'ACCESS_CHALLENGE' ELSE 'VALID_PAGE' END FROM {H}
UNION ALL SELECT site, 'missing', site || '/missing-' || CAST(m AS STRING), CASE m % 6 WHEN 5 THEN 'TIMEOUT' ELSE 'OK' END, CASE m % 6 WHEN 0 THEN 404 WHEN 3 THEN 503 WHEN 4 THEN 410 WHEN 5 THEN NULL ELSE 200 END,
  NULL, NULL, 'text/html', '', CASE m % 6 WHEN 1 THEN 'Oops' ELSE 'Welcome' END, CASE m % 4 WHEN 1 THEN 'Page not found' ELSE 'Home' END,
  CASE m % 6 WHEN 0 THEN 'ERROR_DOCUMENT' WHEN 3 THEN 'ERROR_DOCUMENT' WHEN 4 THEN 'ERROR_DOCUMENT' WHEN 5 THEN NULL ELSE 'VALID_PAGE' END FROM {H}
UNION ALL SELECT site, 'sitemap', site || '/sitemap.xml', 'OK', CASE m % 5 WHEN 1 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 404 ELSE 200 END, NULL, NULL, CASE m % 5 WHEN 2 THEN 'text/html' ELSE 'application/xml' END, '<?xml', '', '', 'VALID_PAGE' FROM {H}
UNION ALL SELECT site, 'sitemap', site || '/sitemap_index.xml', 'OK', CASE m % 5 WHEN 4 THEN 200 WHEN 3 THEN 429 ELSE 404 END, NULL, NULL, 'application/xml', '<?xml', '', '', 'VALID_PAGE' FROM {H}
UNION ALL SELECT site, 'llms', site || '/llms.txt', CASE m % 5 WHEN 4 THEN 'TIMEOUT' ELSE 'OK' END, CASE m % 5 WHEN 1 THEN 404 WHEN 3 THEN 500 WHEN 4 THEN NULL ELSE 200 END, NULL, NULL, CASE m % 5 WHEN 2 THEN 'text/html' ELSE 'text/plain' END, '# Guide', '', '', 'VALID_PAGE' FROM {H}
""".replace("{H}", "(SELECT 'https://' || host AS site, host, m FROM (SELECT split_part(url, '/', 3) AS host, min(page_id) AS m FROM pages GROUP BY 1))")

FIELD_SQL = """
SELECT page_id, 'https://' || split_part(url, '/', 3) AS site,
  CASE page_id % 6 WHEN 0 THEN NULL ELSE CAST(1500 + (page_id * 37) % 4000 AS DOUBLE) END AS lcp_ms, CASE page_id % 5 WHEN 0 THEN NULL ELSE CAST((page_id * 13) % 700 AS DOUBLE) END AS inp_ms,
  CASE page_id % 7 WHEN 0 THEN NULL ELSE CAST((page_id * 3) % 40 AS DOUBLE) / 100 END AS cls
FROM pages
"""

# Answers of a vitals service as text: numbers, numbers in text, other values, cut and empty bodies, failures.
_P75 = '{"percentiles":{"p75":'
FIELD_ANSWERS_SQL = f"""
SELECT page_id, scope, key, CASE page_id % 9 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN NULL ELSE 200 END AS status, CASE WHEN page_id % 9 = 2 AND page_id % 2 = 0 THEN 'TimeoutError' END AS error,
  page_id % 31 <> 5 AS configured, CASE WHEN page_id % 37 = 6 THEN 'RATE_LIMITED' END AS stopped,
  CASE page_id % 8
    WHEN 0 THEN '{{"record":{{"key":{{"formFactor":"DESKTOP"}},"collectionPeriod":{{"firstDate":{{"year":2024,"month":3,"day":7}},"lastDate":{{"year":2024,"month":11,"day":"3"}}}},"metrics":{{"largest_contentful_paint":{_P75}' || CAST(1000 + page_id * 7 % 5000 AS STRING) || '}}}},"interaction_to_next_paint":{_P75}"' || CAST(page_id % 700 AS STRING) || '"}}}},"cumulative_layout_shift":{_P75}"0.' || CAST(page_id % 40 AS STRING) || '"}}}}}}}}}}'
    WHEN 1 THEN '{{"record":{{"collectionPeriod":{{"firstDate":{{"year":2023,"month":12,"day":31}}}},"metrics":{{"largest_contentful_paint":{_P75}" 2501.5 "}}}},"interaction_to_next_paint":{_P75}true}}}},"cumulative_layout_shift":{_P75}""}}}}}}}}}}'
    WHEN 2 THEN '{{"record":{{}}}}' WHEN 3 THEN '{{"record":' WHEN 4 THEN '{{}}'
    WHEN 5 THEN '{{"record":{{"metrics":{{"largest_contentful_paint":{_P75}"4.2e3"}}}},"interaction_to_next_paint":{_P75}"0x1F"}}}},"cumulative_layout_shift":{_P75}0.' || CAST(page_id % 30 AS STRING) || '}}}}}}}}}}'
    WHEN 6 THEN '{{"record":{{"metrics":{{"largest_contentful_paint":{_P75}[1]}}}},"interaction_to_next_paint":{_P75}"fast"}}}},"cumulative_layout_shift":{_P75}null}}}}}}}}}}'
    ELSE '{{"record":{{"metrics":{{"largest_contentful_paint":{_P75}"1e999"}}}},"interaction_to_next_paint":{_P75}-3}}}},"cumulative_layout_shift":{{"percentiles":{{}}}}}}}}}}' END AS body
FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'ORIGIN' ELSE 'URL' END AS scope, 'https://' || split_part(url, '/', 3) || CASE WHEN page_id % 4 = 0 THEN '' ELSE '/p/' || CAST(page_id AS STRING) END AS key FROM pages)
"""

FETCH_LOG_SQL = """
SELECT event_id AS seq, 'https://s' || CAST(user_id AS STRING) || '.example' AS site, 's' || CAST(user_id % 50 AS STRING) || '.example' AS host,
  'https://s' || CAST(user_id AS STRING) || '.example/p' || CAST(event_id % 7 AS STRING) AS url, event_type AS purpose, ts AS started_at,
  CASE event_id % 23 WHEN 7 THEN 429 ELSE 200 END AS status, event_id % 31 = 5 AS challenged
FROM events
"""

REVIEW_SQL = """
SELECT CASE page_id % 8 WHEN 1 THEN page_id + 1000000000 ELSE page_id END AS page_id, CASE page_id % 8 WHEN 2 THEN 'EV-none' ELSE 'EV-' || CAST(page_id AS STRING) END AS evidence_id,
  CASE page_id % 8 WHEN 3 THEN 'this text is not on the page at all' ELSE split_part(split_part(html, '<h1>', 2), '</h1>', 1) END AS excerpt,
  CASE page_id % 8 WHEN 4 THEN 'See www.somewhere.example for more' WHEN 5 THEN 'Traffic would rise by 35 percent' ELSE 'The opening is unclear' END AS observation,
  CASE page_id % 8 WHEN 6 THEN 'Aim for a score of nine' ELSE 'State the subject first' END AS suggestion
FROM pages
"""

PREVIOUS_SQL = """
SELECT page_id, url, CASE page_id % 5 WHEN 1 THEN 'CHALLENGED' ELSE 'VALID' END AS state, CASE page_id % 7 WHEN 2 THEN 'ERROR_DOCUMENT' ELSE 'VALID_PAGE' END AS raw_validity,
  CASE page_id % 11 WHEN 3 THEN NULL ELSE 'VALID_PAGE' END AS dom_validity
FROM pages WHERE page_id % 3 <> 0
"""

CONFIG_SQL = """
SELECT site, CASE m % 5 WHEN 3 THEN 'restricted' ELSE 'search_ai_discovery' END AS goal, CASE m % 6 WHEN 1 THEN 'staging' ELSE 'production' END AS environment, m % 4 = 2 AS multilingual
FROM (SELECT 'https://' || split_part(url, '/', 3) AS site, min(page_id) AS m FROM pages GROUP BY 1)
"""


def with_events(spark: SparkSession, root: str, text: str) -> DataFrame:
    return spark.sql(text.replace("FROM events", "FROM {events}"), events=read_table(spark, root, "events"))
