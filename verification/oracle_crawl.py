"""SQL twins of the crawl queries."""

from __future__ import annotations

from crawlscope import registry as G
from crawlscope.functions import urls as U
from crawlscope.plans import catalog as C
from crawlscope.plans import catalog_crawl as CC
from crawlscope.sources import derived as D
from verification.oracle import CRAWL, ORACLE, SITE_SQL, TOKENS, keys_of, page_type_sql, path_of, segs_of, stems_of, text_sql, values, words

CHALLENGED = "contains({0}, 'id=\"challenge-form\"')"
# Validity and states of the derived crawl.
ST = f"""{CRAWL},
va AS (SELECT *, CASE WHEN acquisition <> 'OK' THEN NULL WHEN status IS NULL THEN 'UNKNOWN_RESPONSE' WHEN page_id % 19 = 12 OR {CHALLENGED.format('html')} THEN 'ACCESS_CHALLENGE' WHEN status >= 400 THEN 'ERROR_DOCUMENT'
   WHEN status >= 300 THEN 'UNKNOWN_RESPONSE' WHEN length(html) >= 200 AND NOT regexp_matches(right(html, 4000), '</body>|</html>') AND right(html, 1) <> '>' THEN 'EMPTY_OR_TRUNCATED' ELSE 'VALID_PAGE' END AS raw_validity,
  CASE WHEN dom_acquisition <> 'OK' THEN NULL WHEN {CHALLENGED.format('dom')} THEN 'ACCESS_CHALLENGE' ELSE 'VALID_PAGE' END AS dom_validity FROM crawl),
vb AS (SELECT *, coalesce(acquisition = 'OK' AND raw_validity = 'VALID_PAGE' AND status = 200, false) AS raw_valid, coalesce(dom_validity = 'VALID_PAGE', false) AS ren_valid FROM va),
st AS (SELECT *, CASE WHEN raw_valid OR ren_valid THEN 'VALID' WHEN raw_validity = 'ACCESS_CHALLENGE' OR dom_validity = 'ACCESS_CHALLENGE' THEN 'CHALLENGED' WHEN raw_validity = 'ERROR_DOCUMENT' THEN 'ERROR_PAGE' ELSE 'UNAVAILABLE' END AS state,
  CASE WHEN ren_valid THEN dom WHEN raw_valid THEN html END AS best FROM vb),
gt AS (SELECT *, CASE WHEN state = 'VALID' THEN '' WHEN state = 'ERROR_PAGE' THEN 'NOT_APPLICABLE' ELSE 'NOT_TESTABLE' END AS gate,
  CASE WHEN raw_valid AND ren_valid THEN '' WHEN ren_valid THEN 'RAW_UNAVAILABLE' WHEN raw_valid THEN 'RENDERED_UNAVAILABLE' ELSE 'BOTH_UNAVAILABLE' END AS pair_gate FROM st)"""
CONF = f"conf AS ({D.CONFIG_SQL}), cfg AS (SELECT *, goal = 'restricted' OR environment = 'staging' AS intentional FROM conf)"
FAILS = words([r[0] for r in G.REASONS if r[2] == "FAIL"])


def unit(check: str, gate: str, reasons: list[tuple[str, str]], src: str = "gt", missing: str = "false") -> str:
    """Status and reasons of one rule from (condition, code) pairs."""
    arr = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {code if code.startswith('concat') or code == 'acquisition' else chr(39) + code + chr(39)} END" for c, code in reasons) + "], lambda x: x IS NOT NULL)" if reasons else "CAST([] AS VARCHAR[])"
    return f"""SELECT page_id, '{check}' AS check_id, CASE WHEN g <> '' THEN g WHEN list_has_any(r, {list(FAILS_LIST)}) THEN 'FAIL' WHEN len(r) > 0 THEN 'WARN' WHEN {missing} THEN 'NOT_TESTABLE' ELSE 'PASS' END AS status,
 CASE WHEN g <> '' THEN '' ELSE array_to_string(r, ',') END AS reasons FROM (SELECT *, {gate} AS g, {arr} AS r FROM {src})"""


FAILS_LIST = [r[0] for r in G.REASONS if r[2] == "FAIL"]


def meta(src: str, name: str) -> str:
    return f"regexp_extract({src}, '<meta name=\"{name}\" content=\"([^\"]*)\"', 1)"


CANON = "regexp_extract_all({0}, '<link rel=\"canonical\" href=\"([^\"]*)\"', 1)"

ORACLE["source_validity"] = f"""WITH {ST} SELECT page_id, coalesce(raw_validity, '') AS raw_validity, coalesce(dom_validity, '') AS dom_validity, raw_valid, ren_valid, state, gate, pair_gate,
 CASE WHEN acquisition <> 'OK' THEN acquisition ELSE raw_validity || ' (HTTP ' || status || ')' END AS label FROM gt"""
ORACLE["truncated_sources"] = """WITH c AS (SELECT page_id, trim(left(html, length(html) - page_id % 40)) AS s FROM pages)
SELECT page_id, length(s) >= 200 AND regexp_matches(s, '<body[\\s>]') AND NOT regexp_matches(right(s, 4000), '</body\\s*>|</html\\s*>') AND right(s, 1) <> '>' AS truncated FROM c"""
ORACLE["error_states"] = """SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'DNS_ERROR' WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'TLS_ERROR' WHEN 4 THEN 'CANCELLED' WHEN 5 THEN 'UNSAFE_DESTINATION' WHEN 6 THEN 'TLS_ERROR' WHEN 7 THEN 'TLS_ERROR' ELSE 'NETWORK_ERROR' END AS acquisition FROM pages"""
ORACLE["coverage"] = f"WITH {ST} SELECT site, count(*) AS selected, count(*) FILTER (acquisition = 'OK' OR dom_acquisition = 'OK') AS fetched, count(*) FILTER (state = 'VALID') AS valid, 0 AS blocked, count(*) FILTER (state = 'UNAVAILABLE') AS unavailable, count(*) FILTER (state = 'CHALLENGED') AS challenged, count(*) FILTER (state = 'ERROR_PAGE') AS error_page FROM gt GROUP BY site"
ORACLE["run_quality"] = f"WITH {ST} SELECT site, CASE WHEN count(*) FILTER (state = 'VALID') = 0 THEN 'INSUFFICIENT' WHEN count(*) FILTER (state IN ('VALID', 'ERROR_PAGE')) < count(*) THEN 'PARTIAL' ELSE 'COMPLETE' END AS quality, 'COMPLETED' AS status FROM gt GROUP BY site"
ORACLE["profile_comparison"] = ""

# --- directives and head -----------------------------------------------------------------------------------------------------
_TOK = "list_transform(string_split(lower({0}), ','), lambda t: trim(t))"
DIRECT = f"""dir AS (SELECT *, list_concat({_TOK.format(meta('{S}', 'robots'))}, list_concat({_TOK.format(meta('{S}', 'googlebot'))}, CASE {{X}} WHEN 4 THEN ['noindex'] WHEN 6 THEN ['nosnippet'] WHEN 14 THEN ['max-snippet:0', 'noarchive'] ELSE CAST([] AS VARCHAR[]) END)) AS toks FROM {{T}})"""


def directives(src: str, table: str, x: str = "page_id % 19") -> str:
    return DIRECT.replace("{S}", src).replace("{X}", x).replace("{T}", table)


_HAS = "list_contains(toks, '{0}')"
_NOINDEX, _NOFOLLOW = f"({_HAS.format('noindex')} OR {_HAS.format('none')})", f"({_HAS.format('nofollow')} OR {_HAS.format('none')})"
_NOSNIP = f"({_HAS.format('nosnippet')} OR {_HAS.format('max-snippet:0')})"
ORACLE["effective_directives"] = f"WITH {CRAWL}, {directives('html', 'crawl')} SELECT page_id, {_NOINDEX} AS noindex, {_NOFOLLOW} AS nofollow, {_NOSNIP} AS nosnippet, CASE WHEN {_HAS.format('max-snippet:0')} THEN '0' WHEN {_HAS.format('max-snippet:50')} THEN '50' ELSE '' END AS max_snippet FROM dir"
ORACLE["head_signals"] = f"""
WITH {CRAWL}, h AS (SELECT *, regexp_extract_all(html, '<link rel="alternate" hreflang="([^"]*)" href="([^"]*)">', 1) AS hc, regexp_extract_all(html, '<link rel="alternate" hreflang="([^"]*)" href="([^"]*)">', 2) AS hh FROM crawl)
SELECT page_id, {meta('html', 'description')} AS description, array_to_string({CANON.format('html')}, '|') AS canonical_head, CASE WHEN page_id % 19 = 10 THEN site || '/hdr' ELSE '' END AS canonical_http,
 CASE WHEN contains(html, '<meta name="robots"') THEN 'robots=' || {meta('html', 'robots')} WHEN contains(html, '<meta name="googlebot"') THEN 'googlebot=' || {meta('html', 'googlebot')} ELSE '' END AS robots, {meta('html', 'viewport')} AS viewport,
 array_to_string(list_concat(list_transform(list_zip(hc, hh), lambda z: z[1] || ' ' || z[2] || ' HTML'), CASE WHEN page_id % 19 = 10 THEN ['it ' || site || '/about HTTP'] ELSE CAST([] AS VARCHAR[]) END), '|') AS hreflang,
 CASE WHEN contains(html, 'content="Ann Lee"') THEN 'meta author: Ann Lee' WHEN contains(html, '"author":[{{"name":"Bo"}}]') THEN 'JSON-LD author: Bo' ELSE '' END AS authors,
 CASE WHEN contains(html, 'article:published_time') THEN 'article:published_time: 2024-01-02' WHEN contains(html, '"datePublished"') THEN 'JSON-LD datePublished: 2024-03-01' ELSE '' END AS dates, {meta('html', 'generator')} AS generator FROM h
"""

# --- links and candidates -------------------------------------------------------------------------------------------------------
ENC = "url_encode({0})"


def encode(x: str) -> str:
    out = f"regexp_replace(url_encode({x}), '\\+', '%20', 'g')"
    for code, ch in (("%2F", "/"), ("%2C", ","), ("%21", "!"), ("%2A", "*"), ("%24", "$"), ("%40", "@"), ("%3A", ":"), ("%3F", "?"), ("%3D", "="), ("%26", "&"), ("%25", "%")):
        out = f"replace({out}, '{code}', '{ch}')"
    return out


def dir_of(u: str) -> str:
    return f"regexp_replace({path_of(u)}, '[^/]*$', '')"


# Dot segments only occur as ../team/./person-N below a directory.
LINKS = f"""{CRAWL}, {TOKENS.format(table='crawl')},
lk AS (SELECT l.page_id, a_no, site, zone, {text_sql('text')} AS text, coalesce(regexp_extract(tag, 'rel="([^"]*)"', 1), '') AS rel, replace(href, '&amp;', '&') AS href, l.url AS doc,
  CASE WHEN href LIKE 'mailto:%' THEN NULL WHEN href LIKE 'https:%' THEN href WHEN href LIKE '../%' THEN site || regexp_replace({dir_of('l.url')}, '[^/]+/$', '') || 'team/' || substr(href, 11)
   ELSE site || {encode("regexp_replace(replace(href, '&amp;', '&'), '#.*$', '')")} END AS url
  FROM link l JOIN crawl c USING (page_id)),
edge AS (SELECT *, url IS NOT NULL AS crawlable, url IS NOT NULL AND url NOT LIKE 'https://other.example/%' AS internal FROM lk)"""
ORACLE["crawl_links"] = f"WITH {LINKS} SELECT page_id, href AS href_raw, url, text, zone, rel, crawlable, internal, CASE WHEN crawlable THEN '' ELSE 'mailto: link' END AS reason FROM edge WHERE zone <> 'nav'"
ROLL = f"roll AS (SELECT site, url, count(*) AS n_links, count(DISTINCT page_id) AS n_pages, bool_or(zone = 'nav') AS in_nav FROM edge WHERE internal GROUP BY site, url)"
ORACLE["link_rollup"] = f"WITH {LINKS}, {ROLL} SELECT * FROM roll"
_ZR = "CASE zone WHEN 'nav' THEN 1 WHEN 'main' THEN 2 WHEN 'footer' THEN 3 ELSE 4 END"
ORACLE["document_link_cap"] = f"""WITH {LINKS}, dk AS (SELECT *, row_number() OVER (PARTITION BY site, doc ORDER BY {_ZR}, pos, page_id) AS n FROM (SELECT e.*, CAST(a_no - 1 AS INTEGER) AS pos FROM edge e WHERE internal))
SELECT site, page_id, pos, zone, CAST(n AS INTEGER) AS link_no FROM dk WHERE n <= 6"""
EXCL = f"""CASE WHEN lower(regexp_extract({path_of('url')}, '[.]([A-Za-z0-9]+)$', 1)) IN {words(U.NON_HTML_EXTENSIONS)} THEN 'NON_HTML'
 WHEN len(list_filter({segs_of('url')}, lambda s: lower(s) IN {words(U.UTILITY_SEGMENTS)})) > 0 THEN 'UTILITY:' || list_filter({segs_of('url')}, lambda s: lower(s) IN {words(U.UTILITY_SEGMENTS)})[1]
 WHEN len(list_filter({segs_of('url')}, lambda s: lower(s) IN {words(U.LEGAL_SEGMENTS)})) > 0 THEN 'LEGAL:' || list_filter({segs_of('url')}, lambda s: lower(s) IN {words(U.LEGAL_SEGMENTS)})[1]
 WHEN len(list_filter({keys_of('url')}, lambda k: lower(k) IN {words(U.SEARCH_KEYS)})) > 0 THEN 'INTERNAL_SEARCH'
 WHEN len({keys_of('url')}) > 0 AND len(list_filter({keys_of('url')}, lambda k: lower(k) IN {words(U.FACET_KEYS)} OR regexp_matches(lower(k), '^utm_[a-z]+$'))) = len({keys_of('url')}) THEN 'FACET:' || array_to_string({keys_of('url')}, '&') ELSE '' END"""
TOPK = f"""tk AS (SELECT r.*, CASE WHEN c.url IS NULL THEN 0 ELSE 1 END AS sampled FROM (SELECT *, {EXCL} AS ex FROM roll) r LEFT JOIN (SELECT DISTINCT site, url FROM crawl) c ON c.site = r.site AND c.url = r.url WHERE ex = '' OR ex LIKE 'LEGAL%'),
tr AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY sampled DESC, in_nav DESC, n_links DESC, url) AS rank FROM tk)"""
ORACLE["link_target_topk"] = f"WITH {LINKS}, {ROLL}, {TOPK} SELECT site, CAST(rank AS INTEGER) AS rank, url, sampled, n_links FROM tr WHERE rank <= 5"
ORACLE["query_variant_cap"] = f"WITH v AS ({CC.VARIANTS_SQL.replace('AS STRING', 'AS VARCHAR')}) SELECT site, url, CASE WHEN row_number() OVER (PARTITION BY site, split_part(url, '?', 1) ORDER BY zone_rank, type_rank, depth, url) > 1 THEN 'QUERY_VARIANT' ELSE '' END AS excluded FROM v"
_STEM = "regexp_replace({0}, '[.][A-Za-z0-9]{{2,5}}$', '')"
_EXT = "regexp_extract({0}, '[.][A-Za-z0-9]{{2,5}}$')"


def signature_sql(table: str, locale: str) -> str:
    return f"""w AS (SELECT site, url, list_transform({segs_of('url')}, lambda s, i: CASE WHEN i = 1 AND {locale} THEN '{{locale}}' WHEN regexp_full_match({_STEM.format('s')}, '[0-9]+') THEN '{{n}}' || {_EXT.format('s')} WHEN regexp_full_match({_STEM.format('s')}, '[0-9a-fA-F]{{16,}}') THEN '{{hash}}' || {_EXT.format('s')} ELSE s END) AS segs,
  array_to_string(list_sort(list_distinct({keys_of('url')})), '&') AS ks FROM {table}),
l AS (SELECT site, regexp_extract(url, '^https?://[^/?#]+') AS o, segs[1:len(segs) - 1] AS parent FROM w WHERE len(segs) >= 2 GROUP BY ALL HAVING count(DISTINCT segs[-1]) >= 2),
sg AS (SELECT w.site, w.url, '/' || array_to_string(CASE WHEN l.parent IS NOT NULL AND NOT starts_with(segs[-1], '{{') THEN list_append(segs[1:len(segs) - 1], '{{slug}}' || {_EXT.format('segs[-1]')}) ELSE segs END, '/') || CASE WHEN ks <> '' THEN '?' || ks ELSE '' END AS signature
  FROM w LEFT JOIN l ON l.site = w.site AND l.o = regexp_extract(w.url, '^https?://[^/?#]+') AND l.parent = segs[1:len(segs) - 1] AND len(segs) >= 2)"""


ORACLE["url_signatures"] = f"WITH u AS ({C.URLS_SQL}), d AS (SELECT DISTINCT {SITE_SQL} AS site, regexp_replace(url, '#.*$', '') AS url FROM u), {signature_sql('d', 'false')} SELECT * FROM sg"
ORACLE["signature_groups"] = f"""WITH {CRAWL}, en AS (SELECT site, bool_or(contains(html, 'hreflang="en"') AND path LIKE '/en/%') AS en FROM crawl GROUP BY site), d AS (SELECT * FROM (SELECT site, url FROM crawl UNION SELECT site, site || '/fr/blog/x-' || page_id || '.html' FROM crawl) JOIN en USING (site)), {signature_sql('d', "(s = 'fr' OR (en AND s = 'en'))")},
k AS (SELECT *, row_number() OVER (PARTITION BY site, signature ORDER BY url) AS n FROM sg) SELECT site, signature, count(*) AS n_urls, string_agg(CASE WHEN n <= 3 THEN url END, ' ' ORDER BY url) AS examples FROM k GROUP BY site, signature"""
_PT = page_type_sql(stems_of("url"), "lower(text)")
ORACLE["link_expansion"] = f"""
WITH {LINKS}, homes AS (SELECT DISTINCT site, site || '/' AS home FROM crawl WHERE url = site || '/'),
ed AS (SELECT e.site, e.doc, e.url, e.text, {_ZR} AS zr, row_number() OVER (PARTITION BY e.site, e.doc ORDER BY {_ZR}, a_no) AS n, a_no, page_id FROM edge e WHERE internal),
ok AS (SELECT * FROM ed WHERE n <= 300 AND NOT regexp_matches(url, '^https://[^/]+/$')), l1 AS (SELECT ok.*, 1 AS depth FROM ok JOIN homes h ON h.site = ok.site AND h.home = ok.doc),
m1 AS (SELECT site, url, min(zr) AS zr, min_by(text, a_no) FILTER (text <> '') AS text FROM l1 GROUP BY site, url), t1 AS (SELECT *, {_PT} AS pt, {EXCL} AS ex FROM m1),
hub AS (SELECT * FROM t1 WHERE ex = '' AND zr <> 3 AND len({segs_of('url')}) BETWEEN 1 AND 2 AND pt IN ('category_hub', 'service', 'product')
  QUALIFY row_number() OVER (PARTITION BY site ORDER BY zr, list_position({list(U.PAGE_TYPES)}, pt), url) <= 8),
l2 AS (SELECT * FROM l1 UNION ALL SELECT ok.*, 2 FROM ok JOIN hub ON hub.site = ok.site AND hub.url = ok.doc),
m2 AS (SELECT site, url, min(depth) AS depth, min(zr) AS zr, min_by(text, [depth, a_no]) FILTER (text <> '') AS text FROM l2 GROUP BY site, url)
SELECT m2.site, url, depth, CASE zr WHEN 1 THEN 'nav' WHEN 2 THEN 'main' WHEN 3 THEN 'footer' ELSE 'other' END AS zone, {_PT} AS page_type, {EXCL} AS excluded, true AS in_raw, false AS in_rendered FROM m2
"""
ORACLE["operator_selection"] = f"""
WITH {CRAWL}, ch AS (SELECT site, min(page_id) AS position, u AS url FROM (SELECT site, page_id, CASE WHEN page_id % 3 = 0 THEN site || '/new/' || page_id ELSE url END AS u FROM crawl) GROUP BY site, u),
f AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY position, url) AS slot FROM ch), p AS (SELECT DISTINCT site, url FROM crawl WHERE page_id % 2 = 0), c AS (SELECT DISTINCT site, url FROM crawl WHERE page_id % 2 = 1)
SELECT f.site, CAST(slot AS INTEGER) AS slot, f.url, {page_type_sql(stems_of('f.url'))} AS page_type, {path_of('f.url')} AS signature, CASE WHEN p.url IS NOT NULL THEN 'proposed' WHEN c.url IS NOT NULL THEN 'candidate chosen by the operator' ELSE 'added by the operator' END AS reason
FROM f LEFT JOIN p ON p.site = f.site AND p.url = f.url LEFT JOIN c ON c.site = f.site AND c.url = f.url WHERE slot <= 4
"""
# One step a recursion: the state of a site is three lists, and a step adds the first fitting candidate to them.
_STEPS = [(0, t) for t in G.SELECTION_PLAN] + [(1, "distinct group")] * 10 + [(2, "second page")] * 10
ORACLE["sample_rounds"] = f"""
WITH RECURSIVE cand AS (SELECT *, list_position({list(U.PAGE_TYPES)}, page_type) AS type_rank FROM ({CC.CANDIDATES_SQL.replace('STRING', 'VARCHAR')})),
steps AS (SELECT * FROM (VALUES {', '.join(f"({i}, {k}, '{w}')" for i, (k, w) in enumerate(_STEPS))}) s(n, mode, what)),
own AS (SELECT site, list(url ORDER BY page_id) AS urls, list({page_type_sql(stems_of("url"))} ORDER BY page_id) AS kinds, list(signature ORDER BY page_id) AS sigs FROM cand WHERE supplied GROUP BY site),
fit AS (SELECT * FROM cand WHERE excluded IS NULL AND verification = 'verified' AND robots_auditor = 'ALLOW' AND NOT supplied),
st AS (
  SELECT s.site, 0 AS n, list_concat([s.site || '/'], coalesce(urls, []))[:10] AS keys, list_concat(['/'], coalesce(sigs, []))[:10] AS sigs,
    list_concat(['homepage'], coalesce(kinds, []))[:10] AS kinds, list_concat(['homepage'], list_transform(coalesce(urls, []), lambda x: 'supplied'))[:10] AS why
  FROM (SELECT DISTINCT site FROM cand) s LEFT JOIN own USING (site)
  UNION ALL
  SELECT site, n + 1, CASE WHEN b IS NULL THEN keys ELSE list_append(keys, b.final_key) END, CASE WHEN b IS NULL THEN sigs ELSE list_append(sigs, b.signature) END,
    CASE WHEN b IS NULL THEN kinds ELSE list_append(kinds, b.page_type) END, CASE WHEN b IS NULL THEN why ELSE list_append(why, what) END
  FROM (SELECT st.site, st.n, any_value(keys) AS keys, any_value(sigs) AS sigs, any_value(kinds) AS kinds, any_value(why) AS why, any_value(what) AS what,
      arg_min({{'final_key': f.final_key, 'signature': f.signature, 'page_type': f.page_type}},
        {{'a': CASE WHEN mode = 1 THEN type_rank ELSE 0 END, 'z': zone_rank, 't': type_rank, 'd': depth, 'u': f.url}}) FILTER (f.url IS NOT NULL) AS b
    FROM st JOIN steps ON steps.n = st.n LEFT JOIN fit f ON f.site = st.site AND len(keys) < 10 AND NOT list_contains(keys, f.final_key)
      AND CASE mode WHEN 0 THEN f.page_type = what AND NOT list_contains(sigs, f.signature) WHEN 1 THEN NOT list_contains(sigs, f.signature)
        ELSE len(list_filter(sigs, lambda g: g = f.signature)) = 1 AND f.page_type NOT IN ('other', 'contact') END
    GROUP BY st.site, st.n))
SELECT site, CAST(i AS INTEGER) AS slot, 'P' || lpad(i::VARCHAR, 2, '0') AS sample_id, keys[i] AS url, kinds[i] AS page_type, sigs[i] AS signature, why[i] AS reason
FROM (SELECT *, unnest(range(1, len(keys) + 1)) AS i FROM st WHERE n = {len(_STEPS)})
"""
ORACLE["registrable_domains"] = """
WITH h AS (SELECT DISTINCT split_part(url, '/', 3) AS host FROM pages), s AS (SELECT host, string_split(host, '.') AS l, host LIKE '%.org' AS org FROM h),
-- example.com and example.net are suffixes, *.example.org takes one label more, blog.example.org is its exception
w AS (SELECT *, CASE WHEN org AND host LIKE '%.blog.example.org' THEN 2 WHEN org THEN 3 ELSE 2 END + 1 AS keep FROM s),
r AS (SELECT host, CASE WHEN len(l) >= keep THEN array_to_string(l[len(l) - keep + 1:], '.') END AS registrable FROM w)
SELECT host, registrable, CASE WHEN host = registrable OR host = 'www.' || registrable THEN 'www.' || registrable ELSE '' END AS www_host FROM r
"""
PROBES = f"pr AS ({D.PROBES_SQL.replace('AS STRING', 'AS VARCHAR')})"
ORACLE["preferred_origins"] = f"""WITH {PROBES}, o AS (SELECT * FROM pr WHERE kind = 'origin' QUALIFY row_number() OVER (PARTITION BY site ORDER BY CASE WHEN acquisition = 'OK' THEN 0 ELSE 1 END, CASE WHEN url LIKE 'https%' THEN 0 ELSE 1 END) = 1)
SELECT site AS seed, url, rtrim(final_url, '/') AS preferred_origin, CASE WHEN final_url IS NULL THEN 'NO_ORIGIN' WHEN final_url = url THEN 'DIRECT' ELSE 'REDIRECT_SAME_SITE' END AS origin_note, url LIKE 'http:%' AS http_fallback FROM o"""

# --- duplicates --------------------------------------------------------------------------------------------------------------------
_TITLE = text_sql("regexp_extract({0}, '(?s)<title>(.*?)</title>', 1)")
DUP = f"t AS (SELECT page_id, {SITE_SQL} AS site, {_TITLE.format('html')} AS title FROM pages), d AS (SELECT site, title, count(*) AS n_pages, min(page_id) AS first_page FROM t WHERE title <> '' GROUP BY ALL HAVING count(*) > 1)"
ORACLE["duplicate_titles"] = f"WITH {DUP} SELECT site, 'title' AS field, title AS value, n_pages, first_page FROM d"
ORACLE["duplicate_pages"] = f"WITH {DUP} SELECT site, page_id, title, n_pages FROM t JOIN d USING (site, title)"
ORACLE["duplicate_check"] = f"""WITH {ST}, b AS (SELECT site, page_id, {_TITLE.format('best')} AS t, {meta('best', 'description')} AS d FROM gt WHERE best IS NOT NULL),
a AS (SELECT site, count(*) AS n FROM b GROUP BY site), dt AS (SELECT DISTINCT site FROM b WHERE t <> '' GROUP BY site, t HAVING count(*) > 1), dd AS (SELECT DISTINCT site FROM b WHERE d <> '' GROUP BY site, d HAVING count(*) > 1),
r AS (SELECT a.*, array_to_string(list_filter([CASE WHEN dt.site IS NOT NULL THEN 'DUPLICATE_TITLE_IN_SAMPLE' END, CASE WHEN dd.site IS NOT NULL THEN 'DUPLICATE_DESCRIPTION_IN_SAMPLE' END], lambda x: x IS NOT NULL), ',') AS reasons FROM a LEFT JOIN dt USING (site) LEFT JOIN dd USING (site))
SELECT site, 'O-2.4' AS check_id, CASE WHEN n < 2 THEN 'NOT_APPLICABLE' WHEN reasons <> '' THEN 'WARN' ELSE 'PASS' END AS status, reasons FROM r"""

# --- robots ------------------------------------------------------------------------------------------------------------------------
ROBOTS = f"""rf AS ({D.ROBOTS_SQL}), rs AS (SELECT *, CASE WHEN acquisition <> 'OK' OR status IS NULL THEN 'UNREACHABLE' WHEN challenge THEN 'CHALLENGED' WHEN status = 429 THEN 'RATE_LIMITED' WHEN status >= 500 THEN 'SERVER_ERROR' WHEN status >= 300 THEN 'NO_RESTRICTIONS_4XX' ELSE 'PARSED' END AS robots_state FROM rf),
rl AS (SELECT origin, CAST(unnest(generate_series(1, len(ls))) AS INTEGER) AS line, trim(regexp_replace(unnest(ls), '#.*$', '')) AS txt FROM (SELECT origin, string_split(text, chr(10)) AS ls FROM rs WHERE robots_state = 'PARSED')),
kv AS (SELECT origin, line, lower(trim(split_part(txt, ':', 1))) AS k, trim(substr(txt, strpos(txt, ':') + 1)) AS v FROM rl WHERE strpos(txt, ':') > 1),
kp AS (SELECT *, lag(k) OVER (PARTITION BY origin ORDER BY line) AS pk FROM kv WHERE k IN ('user-agent', 'allow', 'disallow')),
gr AS (SELECT *, CAST(sum(CASE WHEN k = 'user-agent' AND coalesce(pk, '') <> 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY origin ORDER BY line) AS INTEGER) AS group_no FROM kp),
ag AS (SELECT origin, group_no, line, lower(v) AS agent FROM gr WHERE k = 'user-agent' AND group_no > 0),
ru AS (SELECT origin, group_no, line, k = 'allow' AS allow, v AS path FROM gr WHERE k <> 'user-agent' AND v <> '' AND group_no > 0)"""
ORACLE["robots_rules"] = f"WITH {ROBOTS} SELECT origin, group_no, (SELECT string_agg(agent, ',' ORDER BY line) FROM ag WHERE ag.origin = ru.origin AND ag.group_no = ru.group_no) AS agents, line, allow, path FROM ru"
ORACLE["robots_states"] = f"""WITH {ROBOTS} SELECT origin, robots_state, coalesce((SELECT string_agg(v, '|' ORDER BY line) FROM kv WHERE kv.origin = rs.origin AND k = 'sitemap'), '') AS sitemaps,
 coalesce((SELECT string_agg(DISTINCT k, '|') FROM kv WHERE kv.origin = rs.origin AND k NOT IN ('user-agent', 'allow', 'disallow', 'sitemap')), '') AS unsupported, CAST(coalesce((SELECT max(group_no) FROM gr WHERE gr.origin = rs.origin), 0) AS INTEGER) AS n_groups FROM rs"""
_TOKENS = [G.AUDITOR_TOKEN, *[b[0] for b in G.BOTS]]
DECIDED = f"""{CRAWL}, {ROBOTS}, tk AS (SELECT * FROM {values([(t,) for t in _TOKENS], 'token')}),
pt AS (SELECT crawl.page_id, site, url, token, lower(token) AS tok, substr(url, length(site) + 1) AS path, robots_state FROM crawl CROSS JOIN tk LEFT JOIN rs ON rs.origin = crawl.site),
own AS (SELECT DISTINCT origin, agent FROM ag),
hit AS (SELECT p.page_id, p.token, ru.* FROM pt p LEFT JOIN own o ON o.origin = p.site AND o.agent = p.tok JOIN ag ON ag.origin = p.site AND ag.agent = CASE WHEN o.agent IS NOT NULL THEN p.tok ELSE '*' END
  JOIN ru ON ru.origin = ag.origin AND ru.group_no = ag.group_no WHERE regexp_matches(p.path, '^' || replace(replace(regexp_replace(regexp_replace(ru.path, '([.?+()|\\[\\]{{}}^])', '\\\\\\1', 'g'), '\\$$', chr(1)), '*', '.*'), chr(1), '$'))),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY page_id, token ORDER BY length(path) DESC, allow DESC, line) = 1),
de AS (SELECT p.page_id, p.site, p.url, p.token, CASE WHEN robots_state = 'PARSED' THEN CASE WHEN b.allow IS NULL OR b.allow THEN 'ALLOW' ELSE 'DISALLOW' END WHEN robots_state = 'NO_RESTRICTIONS_4XX' THEN 'ALLOW' ELSE 'UNKNOWN' END AS decision,
  CASE WHEN b.path IS NULL THEN '' ELSE CASE WHEN b.allow THEN 'Allow: ' ELSE 'Disallow: ' END || b.path || ' (line ' || b.line || ')' END AS rule FROM pt p LEFT JOIN best b USING (page_id, token))"""
ORACLE["robots_decisions"] = f"WITH {DECIDED} SELECT page_id, url, token, decision, rule FROM de"
ORACLE["bot_summary"] = f"WITH {DECIDED} SELECT site, token, count(*) FILTER (decision = 'ALLOW') AS n_allow, count(*) FILTER (decision = 'DISALLOW') AS n_disallow, count(*) FILTER (decision = 'UNKNOWN') AS n_unknown FROM de GROUP BY ALL"
_OTHER = words([b[0] for b in G.BOTS if not b[3] and b[0] != "Googlebot"])
ORACLE["robots_checks"] = f"""WITH {DECIDED} SELECT origin AS site, 'C-1.1' AS check_id, CASE WHEN robots_state IN ('UNREACHABLE', 'CHALLENGED', 'RATE_LIMITED') THEN 'NOT_TESTABLE' WHEN robots_state = 'SERVER_ERROR' THEN 'WARN' ELSE 'PASS' END AS status, CASE WHEN robots_state = 'SERVER_ERROR' THEN 'ROBOTS_SERVER_ERROR' ELSE '' END AS reasons FROM rs
UNION ALL SELECT site, 'A-5.4', CASE WHEN bool_and(decision = 'UNKNOWN') THEN 'NOT_TESTABLE' ELSE 'PASS' END, '' FROM de WHERE token IN {_OTHER} GROUP BY site"""
_SCORED = words([b[0] for b in G.BOTS if b[3]])
ORACLE["access_checks"] = f"""WITH {DECIDED}, {CONF}, g AS (SELECT page_id, max(CASE WHEN token = 'Googlebot' THEN decision END) AS gd, bool_or(token IN {_SCORED} AND decision = 'DISALLOW') AS blocked, bool_or(token IN {_SCORED} AND decision = 'UNKNOWN') AS unknown, any_value(intentional) AS intentional, any_value(goal) AS goal FROM de JOIN cfg USING (site) GROUP BY page_id)
{unit('C-1.2', "CASE WHEN gd = 'UNKNOWN' THEN 'NOT_TESTABLE' ELSE '' END", [("gd = 'DISALLOW' AND NOT intentional", 'GOOGLEBOT_DISALLOWED')], 'g')} UNION ALL
{unit('A-5.3', "CASE WHEN goal <> 'search_ai_discovery' OR intentional THEN 'NOT_APPLICABLE' WHEN unknown AND NOT blocked THEN 'NOT_TESTABLE' ELSE '' END", [("blocked", 'SEARCH_CRAWLER_DISALLOWED')], 'g')}"""

# --- page rules -----------------------------------------------------------------------------------------------------------------------
_VP = meta("best", "viewport")
ORACLE["onpage_checks"] = f"WITH {ST} " + " UNION ALL ".join([
    unit("O-2.1", "gate", [(f"{_TITLE.format('best')} = ''", "TITLE_MISSING")]), unit("O-2.2", "gate", [(f"{meta('best', 'description')} = ''", "META_DESCRIPTION_MISSING")]),
    unit("O-2.3", "gate", [("NOT contains(best, '<h1>')", "H1_MISSING")]),
    unit("U-7.1", "gate", [(f"{_VP} = ''", "VIEWPORT_META_MISSING"), (f"{_VP} <> '' AND NOT contains({_VP}, 'width=device-width')", "VIEWPORT_NOT_DEVICE_WIDTH"), (f"contains({_VP}, 'user-scalable=no')", "VIEWPORT_ZOOM_DISABLED")]),
    unit("U-7.4", "gate", []),
])
ORACLE["internal_link_check"] = f"WITH {ST} " + unit("O-2.5", "gate", [("NOT contains(best, '<a href')", "NO_CRAWLABLE_INTERNAL_LINKS")])
_S = "coalesce(status, 0)"
ORACLE["http_status_check"] = f"WITH {ST}, {CONF}, h AS (SELECT gt.*, intentional FROM gt JOIN cfg USING (site)) " + unit(
    "C-1.3", f"CASE WHEN acquisition <> 'OK' OR raw_validity = 'ACCESS_CHALLENGE' OR {_S} = 429 THEN 'NOT_TESTABLE' ELSE '' END",
    [(f"{_S} IN (401, 403) AND NOT intentional", "ACCESS_DENIED_STATUS"), (f"{_S} IN (404, 410)", "NOT_FOUND_STATUS"), (f"{_S} >= 500", "SERVER_ERROR_STATUS"), (f"{_S} NOT IN (200, 429, 401, 403, 404, 410) AND {_S} < 500", "UNEXPECTED_STATUS")], "h")
ORACLE["redirect_check"] = f"WITH {ST} " + unit("C-1.5", "CASE WHEN acquisition NOT IN ('OK', 'REDIRECT_LOOP') THEN 'NOT_TESTABLE' ELSE '' END", [
    ("acquisition = 'REDIRECT_LOOP'", "acquisition"), ("acquisition = 'OK' AND hop_kind = 2", "HTTPS_DOWNGRADE_REDIRECT"), ("acquisition = 'OK' AND hop_kind = 3", "LONG_REDIRECT_CHAIN"), ("raw_valid AND ren_valid AND page_id % 29 = 8", "CLIENT_SIDE_REDIRECT")])
ORACLE["redirect_chains"] = f"""WITH {CRAWL}, h AS (SELECT page_id, hop_kind, url, site, 'http://' || host || path AS i FROM crawl)
SELECT page_id, CASE hop_kind WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS n_hops, false AS loops, hop_kind = 2 AS downgrade, false AS too_many,
 CASE hop_kind WHEN 1 THEN '301 ' || i || ' -> ' || url WHEN 2 THEN '302 ' || url || ' -> ' || i || ' | 301 ' || i || ' -> ' || url WHEN 3 THEN '301 ' || i || ' -> ' || site || '/step | 302 ' || site || '/step -> ' || site || '/step2 | 302 ' || site || '/step2 -> ' || url ELSE '' END AS chain FROM h"""
_DIRS = ", ".join([directives("html", "gt", "CASE WHEN raw_valid THEN page_id % 19 ELSE -1 END").replace("dir AS", "dr AS"), directives("dom", "gt", "CASE WHEN raw_valid THEN page_id % 19 ELSE -1 END").replace("dir AS", "dd AS")])
ORACLE["indexing_check"] = f"""WITH {ST}, {CONF}, {_DIRS}, x AS (SELECT dr.page_id, dr.gate, intentional, goal, (dr.raw_valid AND {_NOINDEX.replace('toks', 'dr.toks')}) OR (dr.ren_valid AND {_NOINDEX.replace('toks', 'dd.toks')}) AS ni,
 (dr.raw_valid AND {_NOFOLLOW.replace('toks', 'dr.toks')}) OR (dr.ren_valid AND {_NOFOLLOW.replace('toks', 'dd.toks')}) AS nf, CASE WHEN dr.ren_valid THEN {_NOSNIP.replace('toks', 'dd.toks')} ELSE {_NOSNIP.replace('toks', 'dr.toks')} END AS ns FROM dr JOIN dd USING (page_id) JOIN cfg ON cfg.site = dr.site)
{unit('C-1.8', 'gate', [('ni AND NOT intentional', 'UNEXPECTED_NOINDEX'), ('nf AND NOT intentional', 'PAGE_LEVEL_NOFOLLOW')], 'x')} UNION ALL {unit('C-1.9', 'gate', [("ns AND goal = 'search_ai_discovery' AND NOT intentional", 'SNIPPET_DISABLED')], 'x')}"""
ORACLE["hreflang_codes"] = "WITH k AS (SELECT * FROM " + values([("en", ""), ("EN-gb", ""), ("en-UK", "REGION"), ("xx", "LANGUAGE"), ("x-default", ""), ("", "EMPTY"), ("zh-Hant-TW", ""), ("gb", "LANGUAGE"), ("eng", "FORM"), ("de-AT-1", "FORM"), ("fr_CA", "FORM"), ("qq-US", "LANGUAGE"), ("pt-BR", ""), (" es ", "")], "code, problem") + ") SELECT page_id, code, problem FROM pages CROSS JOIN k"
# One response per address: the earliest page with it.
RESP = f"""re AS (SELECT url, status, acquisition, raw_validity, CASE hop_kind WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS n_hops, lower({_TITLE.format('html')}) AS title, html, page_id AS rid FROM gt QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1)"""
_ABS = "list_distinct(list_transform(list_filter({0}, lambda v: v NOT LIKE 'mailto:%'), lambda v: CASE WHEN v LIKE '/%' THEN site || v ELSE v END))"
CANONICAL = f"""{ST}, {RESP}, ca AS (SELECT *, CASE WHEN raw_valid THEN {_ABS.format(CANON.format('html'))} ELSE CAST([] AS VARCHAR[]) END AS rh, CASE WHEN raw_valid AND page_id % 19 = 10 THEN [site || '/hdr'] ELSE CAST([] AS VARCHAR[]) END AS ht,
  CASE WHEN ren_valid THEN {_ABS.format(CANON.format('dom'))} ELSE CAST([] AS VARCHAR[]) END AS nh, (raw_valid AND contains(html, 'href="mailto:x"')) OR (ren_valid AND contains(dom, 'href="mailto:x"')) AS bad, coalesce(CASE WHEN acquisition = 'OK' THEN url END, CASE WHEN page_id % 29 = 8 THEN site || '/moved' WHEN dom_acquisition = 'OK' THEN url END, url) AS du FROM gt),
cb AS (SELECT *, list_distinct(list_concat(rh, ht)) AS dc FROM ca), cc AS (SELECT *, CASE WHEN len(dc) = 1 THEN dc[1] WHEN len(dc) = 0 AND len(nh) = 1 THEN nh[1] END AS cn FROM cb),
cd AS (SELECT cc.*, cn IS NOT NULL AND cn <> du AND re.acquisition = 'OK' AND re.raw_validity <> 'ACCESS_CHALLENGE' AS known, re.status AS ts, re.n_hops AS th, re.raw_validity AS tv, re.title AS tt, lower({_TITLE.format('best')}) AS mt FROM cc LEFT JOIN re ON re.url = cn)"""
_CANON_RULES = [("len(dc) > 1", "CANONICAL_CONFLICT"), ("bad", "CANONICAL_INVALID_VALUE"), ("len(rh) = 1 AND len(nh) = 1 AND rh[1] <> nh[1]", "CANONICAL_CHANGED_BY_JAVASCRIPT"), ("len(dc) = 0 AND len(nh) = 0 AND NOT bad", "CANONICAL_MISSING"),
                ("known AND ts >= 400", "CANONICAL_TARGET_BROKEN"), ("known AND ts < 400 AND th > 0", "CANONICAL_TARGET_REDIRECTS"), ("known AND ts < 400 AND th = 0 AND tv = 'VALID_PAGE' AND mt <> '' AND tt <> '' AND mt <> tt", "CANONICAL_POINTS_TO_DIFFERENT_PAGE")]
ORACLE["canonical_check"] = f"WITH {CANONICAL} " + unit("C-1.7", "gate", _CANON_RULES, "cd")

# --- structured data --------------------------------------------------------------------------------------------------------------------
_LD = "regexp_extract_all({0}, '(?s)<script type=\"application/ld\\+json\">(.*?)</script>', 1)"
ORACLE["jsonld_blocks"] = f"WITH {CRAWL}, b AS (SELECT page_id, unnest({_LD.format('html')}) AS raw FROM crawl) SELECT page_id, 0 AS block_no, json_valid(raw) AS parses, true AS in_head, CAST(length(raw) AS INTEGER) AS n_chars FROM b"
_NODE_ROWS = [("\"@type\":\"Product\"", "Product", "Product snippet", "one of review / aggregateRating / offers", ""), ("\"@type\":\"Article\"", "Article", "Article", "", "dateModified,image"),
              ("\"@type\":\"BreadcrumbList\"", "BreadcrumbList", "Breadcrumb", "itemListElement[1].name", ""), ("[\"Organization\",\"Brand\"]", "Organization,Brand", "Organization", "", ""),
              ("\"@type\":\"SoftwareApplication\"", "SoftwareApplication", "Software app", "", "applicationCategory,operatingSystem")]
NODES = f"nd AS (SELECT * FROM {values(_NODE_ROWS, 'mark, types, feature, req, rec')})"
ORACLE["jsonld_nodes"] = f"WITH {CRAWL}, {NODES} SELECT page_id, types, feature, req AS missing_required, rec AS missing_recommended FROM crawl JOIN nd ON contains(html, mark)"
ORACLE["jsonld_checks"] = f"""WITH {ST}, {NODES}, n AS (SELECT page_id, list_sort(list(CASE WHEN req <> '' THEN 'MISSING_REQUIRED_' || upper(replace(feature, ' ', '_')) WHEN rec <> '' THEN 'MISSING_RECOMMENDED_' || upper(replace(feature, ' ', '_')) END) FILTER (req <> '' OR rec <> '')) AS codes, count(*) AS k FROM gt JOIN nd ON contains(best, mark) GROUP BY page_id),
j AS (SELECT gt.*, coalesce(codes, CAST([] AS VARCHAR[])) AS codes, coalesce(k, 0) AS k, coalesce(contains(best, 'application/ld+json'), false) AS has, coalesce(contains(best, '"name":}}'), false) AS broken FROM gt LEFT JOIN n USING (page_id)),
{'u1 AS (' + unit('S-3.1', "CASE WHEN gate <> '' THEN gate WHEN NOT has THEN 'NOT_APPLICABLE' ELSE '' END", [('broken', 'STRUCTURED_DATA_PARSE_ERROR')], 'j') + ')'}
SELECT * FROM u1 UNION ALL SELECT page_id, 'S-3.2', CASE WHEN gate <> '' THEN gate WHEN k = 0 THEN 'NOT_APPLICABLE' WHEN len(list_filter(codes, lambda c: c LIKE '%REQUIRED%')) > 0 THEN 'FAIL' WHEN len(codes) > 0 THEN 'WARN' ELSE 'PASS' END, CASE WHEN gate <> '' OR k = 0 THEN '' ELSE array_to_string(codes, ',') END FROM j"""
_PTU = page_type_sql(stems_of("url"))
ORACLE["markup_opportunities"] = f"""WITH {ST}, o AS (SELECT site, coalesce(bool_or(contains(best, '["Organization","Brand"]')), false) AS org FROM gt GROUP BY site), m AS (SELECT gt.*, org, {_PTU} AS pt FROM gt JOIN o USING (site))
{unit('S-3.4', 'gate', [("pt IN ('homepage', 'about') AND NOT org", 'MARKUP_OPPORTUNITY_ORGANIZATION'), ('''pt = 'article' AND NOT contains(best, '"@type":"Article"')''', 'MARKUP_OPPORTUNITY_ARTICLE'), ("pt = 'author'", 'MARKUP_OPPORTUNITY_PROFILE_PAGE')], 'm')}"""
_ASK = "'REQUIRES VERIFIED VALUE: {}'"
_HEAD_OF = f"""coalesce(nullif({text_sql("regexp_extract(best, '(?s)<h1>(.*?)</h1>', 1)")}, ''), nullif({text_sql("regexp_extract(best, '(?s)<title>(.*?)</title>', 1)")}, ''))"""
ORACLE["markup_templates"] = f"""WITH {ST}, o AS (SELECT site, coalesce(bool_or(contains(best, '["Organization","Brand"]')), false) AS org FROM gt GROUP BY site),
m AS (SELECT page_id, org, best, regexp_extract(url, '^https?://[^/]+') AS root, {_HEAD_OF} AS head, {_PTU} AS pt FROM gt JOIN o USING (site) WHERE best IS NOT NULL),
w AS (SELECT page_id, CAST(CASE
  WHEN pt IN ('homepage', 'about') AND NOT org THEN json_object('@context', 'https://schema.org', '@type', 'Organization', '@id', root || '/#organization', 'name', {_ASK.format('legal or brand name')}, 'url', root || '/',
    'logo', {_ASK.format('absolute logo URL')}, 'sameAs', [{_ASK.format('official profile URLs')}])
  WHEN pt = 'article' AND NOT contains(best, '"@type":"Article"') THEN json_object('@context', 'https://schema.org', '@type', 'Article', 'headline', coalesce(head, {_ASK.format('article headline')}),
    'author', json_object('@type', 'Person', 'name', {_ASK.format('author name')}, 'url', {_ASK.format('author page URL')}), 'datePublished', {_ASK.format('ISO 8601 date')}, 'dateModified', {_ASK.format('ISO 8601 date')}, 'image', [{_ASK.format('image URL')}])
  WHEN pt = 'author' THEN json_object('@context', 'https://schema.org', '@type', 'ProfilePage', 'mainEntity', json_object('@type', 'Person', 'name', coalesce(head, {_ASK.format('person name')}), 'description', {_ASK.format('byline or credential')}))
 END AS VARCHAR) AS template FROM m)
SELECT page_id, template FROM w WHERE template IS NOT NULL"""
ORACLE["mixed_content"] = f"""WITH {ST}, m AS (SELECT *, contains(dom, '<script src="http://') OR contains(dom, '<link rel="stylesheet" href="http://') AS act, contains(dom, '<img src="http://') AS pas FROM gt)
{unit('T-8.2', "CASE WHEN gate <> '' THEN gate WHEN NOT ren_valid THEN 'NOT_TESTABLE' ELSE '' END", [('act', 'MIXED_ACTIVE_CONTENT'), ('NOT act AND pas', 'MIXED_PASSIVE_CONTENT')], 'm')}"""
ORACLE["security_headers"] = f"""WITH {CRAWL}, f AS (SELECT site, min(page_id) FILTER (acquisition = 'OK' AND status = 200) AS p FROM crawl GROUP BY site)
SELECT site, CASE WHEN p IS NULL THEN 'NOT_TESTABLE' ELSE 'PASS' END AS status, CASE WHEN p IS NULL THEN '' ELSE 'absent: strict-transport-security, content-security-policy, x-content-type-options, ' || CASE WHEN p % 2 = 0 THEN '' ELSE 'referrer-policy, ' END || 'x-frame-options' END AS observed FROM f"""
ORACLE["site_facts"] = f"WITH {ST} SELECT site, coalesce({meta('min_by(html, page_id) FILTER (raw_valid)', 'generator')}, '') AS cms, count(*) FILTER (raw_valid AND ren_valid) AS compared_pages, bool_or(contains(html, 'hreflang=') OR contains(dom, 'hreflang=') OR page_id % 19 = 10) AS has_hreflang FROM gt GROUP BY site"

# --- site rules ---------------------------------------------------------------------------------------------------------------------------
ORACLE["origin_consolidation"] = f"""WITH {PROBES}, l AS (SELECT site, status = 200 AND validity = 'VALID_PAGE' AS live, rtrim(final_url, '/') AS f, rtrim(canonical, '/') AS c FROM pr WHERE kind = 'origin'),
g AS (SELECT site, count(*) FILTER (live) AS n, count(DISTINCT f) FILTER (live) AS nf, count(*) FILTER (live AND c IS NULL) AS bare, count(DISTINCT c) FILTER (live) AS nc FROM l GROUP BY site),
s AS (SELECT *, CASE WHEN n = 0 THEN 'NOT_TESTABLE' WHEN nf = 1 THEN 'PASS' ELSE 'WARN' END AS status FROM g)
SELECT site, 'C-1.6' AS check_id, status, CASE WHEN status <> 'WARN' THEN '' WHEN bare = 0 AND nc = 1 THEN 'DUPLICATE_ORIGINS_COHERENT_CANONICAL' WHEN nc > 1 THEN 'DUPLICATE_ORIGINS_CONFLICTING_CANONICAL' ELSE 'DUPLICATE_ORIGINS_NO_CANONICAL' END AS reasons FROM s"""
ORACLE["https_check"] = f"""WITH {PROBES}, o AS (SELECT site, max(CASE WHEN url LIKE 'https:%' THEN acquisition END) AS a, max(CASE WHEN url LIKE 'https:%' THEN final_url END) AS fs, max(CASE WHEN url LIKE 'http:%' THEN final_url END) AS fp FROM pr WHERE kind = 'origin' GROUP BY site),
p AS (SELECT *, coalesce(CASE WHEN a = 'OK' THEN fs END, fp, '') AS pref FROM o), r AS (SELECT *, CASE WHEN a = 'OK' AND pref LIKE 'https:%' THEN '' WHEN a = 'TLS_ERROR' THEN 'TLS_CERTIFICATE_ERROR' WHEN a = 'OK' AND pref LIKE 'http:%' THEN 'HTTPS_NOT_PREFERRED' WHEN pref LIKE 'http:%' AND a = 'NETWORK_ERROR' THEN 'NO_HTTPS' END AS reason FROM p)
SELECT site, 'T-8.1' AS check_id, CASE WHEN reason = '' THEN 'PASS' WHEN reason = 'HTTPS_NOT_PREFERRED' THEN 'WARN' WHEN reason IS NOT NULL THEN 'FAIL' ELSE 'NOT_TESTABLE' END AS status, coalesce(reason, '') AS reasons FROM r"""
_SM = "sm AS (SELECT *, CASE WHEN status = 200 AND content_type = 'text/html' THEN 'INCONCLUSIVE' WHEN status = 200 THEN 'OPEN' WHEN status = 429 THEN 'INCONCLUSIVE' ELSE 'NOT_OPEN' END AS result FROM pr WHERE kind = 'sitemap')"
ORACLE["sitemap_matrix"] = f"WITH {PROBES}, {_SM} SELECT site, url, result FROM sm"
ORACLE["sitemap_check"] = f"""WITH {PROBES}, {_SM}, {ROBOTS}, dc AS (SELECT origin AS site, min_by(v, line) AS d FROM kv WHERE k = 'sitemap' AND regexp_matches(v, '^https?://') GROUP BY origin),
s AS (SELECT site, min_by(url, CASE WHEN url LIKE '%/sitemap.xml' THEN 1 ELSE 2 END) FILTER (result = 'OPEN') AS f, bool_and(result = 'INCONCLUSIVE') AS inc FROM sm GROUP BY site), c AS (SELECT s.*, coalesce(d, f) AS chosen FROM s LEFT JOIN dc USING (site)),
j AS (SELECT c.*, coalesce(sm.result, 'INCONCLUSIVE') AS mr FROM c LEFT JOIN sm ON sm.site = c.site AND sm.url = chosen)
SELECT site, 'C-1.12' AS check_id, CASE WHEN chosen IS NULL AND inc THEN 'NOT_TESTABLE' WHEN chosen IS NULL THEN 'WARN' WHEN mr = 'OPEN' THEN 'PASS' WHEN mr = 'INCONCLUSIVE' THEN 'NOT_TESTABLE' ELSE 'FAIL' END AS status,
 CASE WHEN chosen IS NULL AND NOT inc THEN 'SITEMAP_NOT_DISCOVERED' WHEN chosen IS NOT NULL AND mr = 'NOT_OPEN' THEN 'DECLARED_SITEMAP_NOT_OPEN' ELSE '' END AS reasons FROM j"""
ORACLE["llms_state"] = f"WITH {PROBES} SELECT site, CASE WHEN acquisition <> 'OK' THEN 'UNAVAILABLE' WHEN status = 404 THEN 'ABSENT' WHEN status = 200 AND content_type = 'text/html' THEN 'HTML_FALLBACK' WHEN status = 200 THEN 'PRESENT_TEXT' ELSE 'UNAVAILABLE' END AS llms_state, true AS has_h1 FROM pr WHERE kind = 'llms'"
ORACLE["soft404"] = f"""WITH {PROBES} SELECT site, 'C-1.4' AS check_id, CASE WHEN acquisition <> 'OK' THEN 'NOT_TESTABLE' WHEN status IN (404, 410) THEN 'PASS' WHEN status >= 500 THEN 'WARN' WHEN regexp_matches(lower(title || ' | ' || h1), 'oops|page not found') THEN 'WARN' ELSE 'NOT_TESTABLE' END AS status,
 CASE WHEN acquisition <> 'OK' OR status IN (404, 410) THEN '' WHEN status >= 500 THEN 'MISSING_PAGE_RETURNS_5XX' WHEN regexp_matches(lower(title || ' | ' || h1), 'oops|page not found') THEN 'MISSING_PAGE_RETURNS_200' ELSE '' END AS reasons FROM pr WHERE kind = 'missing'"""
ORACLE["origin_variants"] = """WITH h AS (SELECT DISTINCT split_part(url, '/', 3) AS host FROM pages), v AS (SELECT host AS site, unnest(CASE WHEN regexp_matches(host, '^(blog|m)[.]') THEN [host] ELSE [regexp_replace(host, '^www[.]', ''), 'www.' || regexp_replace(host, '^www[.]', '')] END) AS h FROM h)
SELECT site, s || '://' || h || '/' AS url FROM v, (VALUES ('https'), ('http')) AS t(s)"""

# --- performance, logs, review ----------------------------------------------------------------------------------------------------------------
_GRADE = "CASE WHEN lcp_ms IS NULL AND inp_ms IS NULL AND cls IS NULL THEN 'UNAVAILABLE' WHEN lcp_ms > 4000 OR inp_ms > 500 OR cls > 0.25 THEN 'POOR' WHEN lcp_ms > 2500 OR inp_ms > 200 OR cls > 0.1 THEN 'NEEDS_IMPROVEMENT' WHEN lcp_ms IS NULL OR inp_ms IS NULL OR cls IS NULL THEN 'INCOMPLETE' ELSE 'GOOD' END"
ORACLE["field_vitals"] = f"WITH f AS ({D.FIELD_SQL}) SELECT page_id, {_GRADE} AS grade FROM f"


def p75_sql(metric: str) -> str:
    at = f"'$.record.metrics.{metric}.percentiles.p75'"
    text = f"trim(json_extract_string(j, {at}))"
    number = f"""CASE json_type(j, {at}) WHEN 'VARCHAR' THEN CASE WHEN {text} = '' THEN 0.0 WHEN {text} LIKE '0x%' THEN try_cast({text} AS BIGINT)::DOUBLE ELSE try_cast({text} AS DOUBLE) END
      WHEN 'BOOLEAN' THEN NULL WHEN 'NULL' THEN NULL WHEN 'ARRAY' THEN NULL WHEN 'OBJECT' THEN NULL ELSE try_cast({text} AS DOUBLE) END"""
    return f"CASE WHEN ok AND isfinite({number}) THEN {number} END"


def day_sql(name: str) -> str:
    part = lambda p: f"json_extract_string(j, '$.record.collectionPeriod.{name}.{p}')"
    return f"CASE WHEN ok AND json_exists(j, '$.record.collectionPeriod') THEN concat_ws('-', {part('year')}, lpad({part('month')}, 2, '0'), lpad({part('day')}, 2, '0')) ELSE '' END"


RECORDS = f"""fr AS (SELECT *, CASE WHEN json_valid(body) THEN body::JSON END AS j, CASE WHEN NOT configured THEN 'NOT_CONFIGURED' WHEN stopped IS NOT NULL THEN 'STOPPED:' || stopped WHEN error IS NOT NULL THEN 'FAILED:' || error
   WHEN status IS NULL THEN 'FAILED:no answer' WHEN status = 404 THEN 'NO_RECORD:' || scope WHEN status <> 200 THEN 'HTTP:' || status WHEN NOT json_valid(body) THEN 'FAILED:SyntaxError' ELSE '' END AS reason
  FROM ({D.FIELD_ANSWERS_SQL.replace('AS STRING', 'AS VARCHAR')})),
fo AS (SELECT *, reason = '' AS ok FROM fr),
rec AS (SELECT *, {p75_sql('largest_contentful_paint')} AS lcp_ms, {p75_sql('interaction_to_next_paint')} AS inp_ms, {p75_sql('cumulative_layout_shift')} AS cls FROM fo)"""
ORACLE["field_records"] = f"""WITH {RECORDS} SELECT page_id, scope, key, ok AS available, reason, CASE WHEN ok THEN coalesce(json_extract_string(j, '$.record.key.formFactor'), 'PHONE') ELSE '' END AS form_factor,
 {day_sql('firstDate')} AS period_first, {day_sql('lastDate')} AS period_last, coalesce(lcp_ms, -1.0)::DOUBLE AS lcp_ms, coalesce(inp_ms, -1.0)::DOUBLE AS inp_ms, coalesce(cls, -1.0)::DOUBLE AS cls, {_GRADE} AS assessment FROM rec"""
ORACLE["origin_field_check"] = f"""WITH {RECORDS}, o AS (SELECT key AS site, max(lcp_ms) AS lcp_ms, max(inp_ms) AS inp_ms, max(cls) AS cls FROM rec WHERE scope = 'ORIGIN' GROUP BY key),
s AS (SELECT DISTINCT regexp_extract(key, '^https?://[^/]+') AS site FROM rec), g AS (SELECT s.site, o.site IS NOT NULL AS met, {_GRADE} AS grade FROM s LEFT JOIN o USING (site))
SELECT site, 'P-4.2' AS check_id, CASE WHEN met AND grade <> 'UNAVAILABLE' THEN 'PASS' ELSE 'NOT_TESTABLE' END AS status, CASE WHEN met THEN grade ELSE '' END AS observed FROM g"""
ORACLE["field_check"] = f"WITH {ST}, f AS ({D.FIELD_SQL}), g AS (SELECT gt.*, {_GRADE} AS grade FROM gt JOIN f USING (page_id)) " + unit("P-4.1", "CASE WHEN NOT (raw_valid OR ren_valid) OR grade = 'UNAVAILABLE' THEN 'NOT_TESTABLE' ELSE '' END", [("grade = 'POOR'", "CWV_FIELD_POOR"), ("grade = 'NEEDS_IMPROVEMENT'", "CWV_FIELD_NEEDS_IMPROVEMENT")], "g", "grade = 'INCOMPLETE'")
_TASK = "CASE WHEN page_id * {0} % 900 >= page_id * 11 % 400 THEN greatest(page_id * ({0} + 3) % 180 - 50, 0) ELSE 0 END"
ORACLE["lab_summary"] = f"""WITH {ST}, k AS (SELECT page_id AS chosen FROM gt WHERE ren_valid QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id) <= 3)
SELECT page_id, 'P-4.3' AS check_id, CASE WHEN chosen IS NULL THEN 'NOT_APPLICABLE' WHEN page_id % 6 = 0 THEN 'NOT_TESTABLE' ELSE 'PASS' END AS status, '' AS reasons, CAST({_TASK.format(3)} + {_TASK.format(5)} + {_TASK.format(8)} AS DOUBLE) AS tbt_ms FROM gt LEFT JOIN k ON chosen = page_id"""
ORACLE["overflow_check"] = f"WITH {ST}, o AS (SELECT *, page_id * 13 % 60 + 400 > 414 AS over FROM gt) " + unit("U-7.2", "CASE WHEN gate <> '' THEN gate WHEN NOT ren_valid OR page_id % 9 = 4 OR (over AND page_id % 4 = 1) THEN 'NOT_TESTABLE' ELSE '' END", [("over", "HORIZONTAL_OVERFLOW")], "o")
ORACLE["a11y_check"] = f"WITH {ST} " + unit("U-7.3", "CASE WHEN gate <> '' THEN gate WHEN NOT ren_valid OR page_id % 8 = 3 THEN 'NOT_TESTABLE' ELSE '' END", [(f"page_id % {i + 5} = 1", f"A11Y_{r.upper().replace('-', '_')}") for i, r in enumerate(G.A11Y_RULES)])
LOG = f"lg AS ({D.FETCH_LOG_SQL.replace('AS STRING', 'AS VARCHAR')})"
ORACLE["stop_conditions"] = f"""WITH {LOG}, n AS (SELECT *, sum(CASE WHEN status = 429 THEN 1 ELSE 0 END) OVER w AS limited, len(list_distinct(list(CASE WHEN challenged THEN url END) OVER w)) AS stuck FROM lg WINDOW w AS (PARTITION BY site ORDER BY seq)),
s AS (SELECT site, min(seq) AS stop_seq, CASE WHEN min(seq) FILTER (stuck >= 3) = min(seq) THEN 'CHALLENGED' ELSE 'RATE_LIMITED' END AS stop_reason FROM n WHERE limited >= 2 OR stuck >= 3 GROUP BY site)
SELECT site, seq, stop_seq IS NULL OR seq <= stop_seq AS issued, coalesce(stop_reason, '') AS stop_reason FROM lg LEFT JOIN s USING (site)"""
ORACLE["politeness_gaps"] = f"WITH {LOG}, g AS (SELECT host, seq, (epoch_us(started_at) - epoch_us(lag(started_at) OVER (PARTITION BY host ORDER BY started_at, seq))) / 1000 AS gap FROM lg) SELECT host, seq, coalesce(gap < 60000, false) AS too_fast, coalesce(CAST(floor(gap) AS BIGINT), -1) AS gap_ms FROM g"
ORACLE["usage_counters"] = f"WITH {LOG} SELECT site, count(*) AS requests, " + ", ".join(f"count(*) FILTER (purpose = '{p}') AS {p}" for p in ("signup", "view", "error", "purchase", "click")) + " FROM lg GROUP BY site"
ORACLE["grounding_gate"] = f"WITH r AS ({D.REVIEW_SQL.replace('AS STRING', 'AS VARCHAR')}) SELECT page_id, evidence_id, CASE WHEN page_id >= 1000000000 THEN 'UNKNOWN_PAGE' ELSE CASE page_id % 8 WHEN 2 THEN 'UNKNOWN_EVIDENCE' WHEN 3 THEN 'EXCERPT_NOT_FOUND' WHEN 4 THEN 'CONTAINS_URL' WHEN 5 THEN 'INVENTED_METRIC' WHEN 6 THEN 'INVENTED_METRIC' ELSE 'ACCEPTED' END END AS verdict FROM r"
ORACLE["review_budget"] = f"""WITH t AS (SELECT page_id, {SITE_SQL} AS site, regexp_replace(html, '<[^>]*>', '', 'g') AS t, page_id % 90 AS h FROM pages), n AS (SELECT site, count(*) AS n_pages FROM t GROUP BY site), r AS (SELECT *, greatest(200, 9000 // n_pages - h - 120) AS room FROM t JOIN n USING (site))
SELECT page_id, n_pages, room, length(t) > room AS truncated, least(length(t), room) AS used_chars FROM r"""
ORACLE["reaudit_plan"] = f"""WITH p AS ({D.PREVIOUS_SQL}), g AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS k FROM p WHERE state = 'VALID' AND raw_validity = 'VALID_PAGE' AND dom_validity = 'VALID_PAGE'), c AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS fetch_key FROM pages)
SELECT page_id, fetch_key, CASE WHEN k IS NULL THEN 'evaluate' ELSE 'reuse' END AS plan FROM c LEFT JOIN g ON k = fetch_key"""
ORACLE["embedded_items"] = "SELECT page_id, 'Microdata' AS format, 'Product' AS type, 'name=Item ' || page_id || '|offers=@Offer' AS props FROM pages UNION ALL SELECT page_id, 'RDFa', 'Person', 'name=Ann' FROM pages"
ORACLE["scripted_controls"] = f"SELECT page_id, 'Go' AS text, {SITE_SQL} || '/go/' || page_id AS target FROM pages UNION ALL SELECT page_id, 'Js', {SITE_SQL} || '/js' FROM pages"
del ORACLE["profile_comparison"]
from verification.oracle import FINDINGS  # noqa: E402

ORACLE["narrative"] = f"""WITH {ST}, {FINDINGS}, c AS (SELECT replace(site, 'http://', 'https://') AS site, count(*) FILTER (classification = 'ISSUE' AND sev <= 2) AS u FROM issues GROUP BY 1),
v AS (SELECT site, count(*) FILTER (state = 'VALID') || ' of ' || count(*) || ' pages valid (0 blocked, ' || count(*) FILTER (state = 'CHALLENGED') || ' challenged, ' || count(*) FILTER (state = 'ERROR_PAGE') || ' error, ' || count(*) FILTER (state = 'UNAVAILABLE') || ' unavailable)' AS pages FROM gt GROUP BY site)
SELECT site, pages, CASE WHEN coalesce(u, 0) > 0 THEN u || ' critical or high issues' ELSE 'no critical or high issue' END AS urgent FROM v LEFT JOIN c USING (site)"""
BEST_LINKS = LINKS.replace(CRAWL, f"{ST}, {RESP}, doc_table AS (SELECT page_id, url, best AS html FROM gt WHERE best IS NOT NULL)").replace("FROM crawl))", "FROM doc_table))").replace("FROM crawl)),", "FROM doc_table)),")
ORACLE["link_target_check"] = f"""WITH {BEST_LINKS}, {ROLL}, {TOPK}, o AS (SELECT t.site, CASE WHEN re.url IS NULL OR re.acquisition <> 'OK' OR re.raw_validity = 'ACCESS_CHALLENGE' OR re.status = 429 THEN 'UNTESTED' WHEN re.status IN (404, 410) OR re.status >= 500 THEN 'BROKEN' WHEN re.n_hops > 0 AND re.status = 200 THEN 'REDIRECTED' ELSE 'OK' END AS oc FROM tr t LEFT JOIN re ON re.url = t.url),
s AS (SELECT site, count(*) AS n, count(*) FILTER (oc <> 'UNTESTED') AS t, count(*) FILTER (oc = 'BROKEN') AS b, count(*) FILTER (oc = 'REDIRECTED') AS r FROM o GROUP BY site), a AS (SELECT DISTINCT crawl.site, coalesce(n, 0) AS n, coalesce(t, 0) AS t, coalesce(b, 0) AS b, coalesce(r, 0) AS r FROM crawl LEFT JOIN s USING (site))
SELECT site, 'O-2.6' AS check_id, CASE WHEN n = 0 THEN 'NOT_APPLICABLE' WHEN t = 0 THEN 'NOT_TESTABLE' WHEN b > 0 THEN 'FAIL' WHEN r > 0 THEN 'WARN' ELSE 'PASS' END AS status,
 CASE WHEN n = 0 OR t = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN b > 0 THEN 'BROKEN_INTERNAL_LINK_TARGET' END, CASE WHEN r > 0 THEN 'INTERNAL_LINK_REDIRECTS' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM a"""
