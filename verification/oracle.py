"""SQL twins of the registered queries, written for DuckDB over the same tables."""

from __future__ import annotations

from crawlscope.functions import urls as U
from crawlscope.plans import catalog as C
from crawlscope.sources import derived as D

ORACLE: dict[str, str] = {}


def words(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def path_of(u: str) -> str:
    return f"regexp_extract({u}, '^https?://[^/?#]+([^?#]*)', 1)"


def query_of(u: str) -> str:
    return f"regexp_extract({u}, '[?]([^#]*)', 1)"


def segs_of(u: str) -> str:
    return f"list_filter(string_split({path_of(u)}, '/'), lambda s: s <> '')"


def keys_of(u: str) -> str:
    return f"list_transform(list_filter(string_split({query_of(u)}, '&'), lambda p: p <> ''), lambda p: split_part(p, '=', 1))"


ORACLE["url_keys"] = f"""
WITH k AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS fetch_key FROM pages)
SELECT page_id, fetch_key, regexp_extract(url, '^https?://[^/?#]+') AS origin,
  {path_of('fetch_key')} || CASE WHEN contains(fetch_key, '?') THEN '?' || split_part(fetch_key, '?', 2) ELSE '' END AS path_query,
  array_to_string({segs_of('url')}, '|') AS segments, array_to_string({keys_of('url')}, '|') AS query_keys, left(sha1(fetch_key), 10) AS url_hash
FROM k
"""

ORACLE["url_exclusions"] = f"""
WITH u AS ({C.URLS_SQL}), p AS (
  SELECT page_id, part, url, {segs_of('url')} AS segs, {keys_of('url')} AS keys, lower(regexp_extract({path_of('url')}, '[.]([A-Za-z0-9]+)$', 1)) AS ext FROM u),
f AS (SELECT *, list_filter(segs, lambda s: lower(s) IN {words(U.UTILITY_SEGMENTS)}) AS util, list_filter(segs, lambda s: lower(s) IN {words(U.LEGAL_SEGMENTS)}) AS legal,
  list_filter(keys, lambda k: lower(k) IN {words(U.FACET_KEYS)} OR regexp_matches(lower(k), '^utm_[a-z]+$')) AS facets,
  list_filter(keys, lambda k: lower(k) IN {words(U.SEARCH_KEYS)}) AS search FROM p)
SELECT page_id, part, url, CASE WHEN ext IN {words(U.NON_HTML_EXTENSIONS)} THEN 'NON_HTML' WHEN len(util) > 0 THEN 'UTILITY:' || util[1]
  WHEN len(legal) > 0 THEN 'LEGAL:' || legal[1] WHEN len(search) > 0 THEN 'INTERNAL_SEARCH'
  WHEN len(facets) > 0 AND len(facets) = len(keys) THEN 'FACET:' || array_to_string(facets, '&') END AS reason FROM f
"""


def page_type_sql(segs: str, text: str = "''") -> str:
    def at(ws):
        return f"coalesce(list_position(list_transform({segs}, lambda s: s IN {words(ws)}), true), 0)"

    n, last = f"len({segs})", f"{segs}[-1]"
    return f"""CASE WHEN {n} = 0 THEN 'homepage' WHEN {last} IN {words(U.PRICING_LEAVES)} THEN 'pricing' WHEN {last} IN {words(U.ABOUT_LEAVES)} THEN 'about'
 WHEN {last} IN {words(U.CONTACT_LEAVES)} THEN 'contact' WHEN {at(U.AUTHOR_ROOTS)} BETWEEN 1 AND {n} - 1 THEN 'author' WHEN {at(U.PRODUCT_ROOTS)} BETWEEN 1 AND {n} - 1 THEN 'product'
 WHEN {at(U.CATEGORY_ROOTS)} > 0 THEN 'category_hub' WHEN {at(U.HUB_ROOTS)} = {n} THEN 'category_hub' WHEN {at(U.HUB_ROOTS)} > 0 THEN 'article'
 WHEN {at(U.SERVICE_ROOTS)} > 0 THEN 'service' WHEN {at(U.PRODUCT_ROOTS)} > 0 THEN 'product' WHEN {at(U.AUTHOR_ROOTS)} > 0 THEN 'category_hub'
 WHEN regexp_matches({text}, '\\b(pricing|plans)\\b') THEN 'pricing' WHEN regexp_matches({text}, '^about\\b|\\babout us\\b') THEN 'about' WHEN regexp_matches({text}, '\\bcontact\\b') THEN 'contact'
 WHEN regexp_matches({text}, '\\b(services?|solutions?)\\b') AND {n} <= 2 THEN 'service' WHEN regexp_matches({text}, '\\b(products?|features?|platform)\\b') AND {n} <= 2 THEN 'product'
 WHEN regexp_matches({text}, '\\b(blog|news|resources|insights)\\b') AND {n} = 1 THEN 'category_hub' ELSE 'other' END"""


def stems_of(u: str) -> str:
    return f"list_transform({segs_of(u)}, lambda s: regexp_replace(lower(s), '[.](html?|php|aspx?)$', ''))"


ORACLE["page_types"] = f"""
WITH u AS ({C.URLS_SQL}), p AS (SELECT page_id, part, url, {stems_of('url')} AS segs FROM u), t AS (SELECT *, {page_type_sql('segs')} AS page_type FROM p)
SELECT page_id, part, url, page_type, len(segs) BETWEEN 1 AND 2 AND page_type IN ('category_hub', 'service', 'product') AS hub FROM t
"""

ORACLE["seed_admission"] = f"""
WITH s AS ({C.SEEDS_SQL.replace('AS STRING', 'AS VARCHAR')}), a AS (SELECT page_id, seed, trim(seed) AS t, regexp_matches(seed, '^[a-zA-Z][a-zA-Z0-9+.-]*:') AND NOT regexp_matches(seed, '^[^/:]+:[0-9]+(/|$)') AS scheme FROM s),
h AS (SELECT *, regexp_extract(CASE WHEN scheme THEN t ELSE 'https://' || t END, '^https?://(?:[^/@]*@)?(\\[[^]]*\\]|[^/:?#]*)', 1) AS host FROM a)
SELECT page_id, seed, CASE WHEN t = '' THEN 'EMPTY' WHEN regexp_matches(t, '\\s') THEN 'SPACES' WHEN scheme AND NOT regexp_matches(t, '^https?:', 'i') THEN 'SCHEME'
 WHEN regexp_matches(t, '^https?://[^/@]+@') THEN 'CREDENTIALS' WHEN NOT contains(host, '.') AND NOT contains(host, '[') THEN 'HOSTNAME'
 WHEN regexp_matches(host, '^(10[.]|127[.]|169[.]254[.]|192[.]168[.]|172[.](1[6-9]|2[0-9]|3[01])[.])') OR host = '[::1]' OR regexp_matches(host, '[.](localhost|local|internal|lan|home|corp)$') THEN 'NOT_PUBLIC'
 ELSE 'ADMITTED' END AS verdict FROM h
"""

ORACLE["resolved_links"] = """
WITH b AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS o, split_part(url, ':', 1) AS scheme, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p, regexp_extract(url, '[?][^#]*') AS q FROM pages),
d AS (SELECT *, regexp_replace(p, '[^/]*$', '') AS dir FROM b),
r AS (SELECT page_id, unnest(range(10)) AS form_no, unnest([o || '/abs/path', o || dir || 'rel/item.html', o || regexp_replace(dir, '[^/]+/$', '') || 'up/x', o || p || '?k=1', scheme || '://cdn.example/lib.js', o || p || q,
  'http://mixed.example/A%20b', 'mailto:x@y.example', o || '/f%C3%BCr/Stra%C3%9Fe', NULL]) AS resolved FROM d)
SELECT page_id, form_no, resolved, CASE WHEN resolved LIKE 'http%' THEN resolved END AS http_only FROM r
"""

# --- text of the given pages: only four named entities occur in them -----------------------------------------------------
def text_sql(x: str) -> str:
    t = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for a, b in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = f"replace({t}, '{a}', '{b}')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


ORACLE["page_titles"] = f"""
SELECT page_id, nullif({text_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '') AS title, CAST(len(regexp_extract_all(html, '<title>')) AS INTEGER) AS n_titles FROM pages
"""
ORACLE["page_h1"] = f"""
SELECT page_id, {text_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS h1, CAST(len(regexp_extract_all(html, '<h[1-6]>')) AS INTEGER) AS n_headings FROM pages
"""
ORACLE["page_lang"] = "SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, '' AS base_href, contains(html, '<noscript') AS noscript FROM pages"

# Tokens in document order with running counts of open landmarks.
TOKENS = """
tok AS (SELECT page_id, url, unnest(generate_series(1, len(toks))) AS pos, unnest(toks) AS tok FROM (
  SELECT page_id, url, regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)(<script[^>]*>).*?(</script>)', '\\1\\2', 'g'), '<[^>]+>|[^<]+') AS toks FROM {table})),
run AS (SELECT *, sum(CASE WHEN tok LIKE '<nav%' OR tok LIKE '<header%' THEN 1 WHEN tok IN ('</nav>', '</header>') THEN -1 ELSE 0 END) OVER w AS in_nav,
  sum(CASE WHEN tok LIKE '<footer%' THEN 1 WHEN tok = '</footer>' THEN -1 ELSE 0 END) OVER w AS in_footer,
  sum(CASE WHEN tok LIKE '<main%' OR tok LIKE '<article%' THEN 1 WHEN tok IN ('</main>', '</article>') THEN -1 ELSE 0 END) OVER w AS in_main,
  sum(CASE WHEN tok LIKE '<a %' OR tok = '<a>' THEN 1 ELSE 0 END) OVER w AS a_no, sum(CASE WHEN tok = '</a>' THEN 1 ELSE 0 END) OVER w AS a_closed
  FROM tok WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
anchor AS (SELECT page_id, any_value(url) AS url, a_no, max(CASE WHEN tok LIKE '<a%' AND tok NOT LIKE '<article%' THEN tok END) AS tag, string_agg(CASE WHEN tok NOT LIKE '<%' AND a_no > a_closed THEN tok ELSE '' END, '' ORDER BY pos) AS text,
  min_by(CASE WHEN in_nav > 0 THEN 'nav' WHEN in_footer > 0 THEN 'footer' WHEN in_main > 0 THEN 'main' ELSE 'other' END, pos) AS zone FROM run WHERE a_no > 0 GROUP BY page_id, a_no),
link AS (SELECT *, regexp_extract(tag, 'href="([^"]*)"', 1) AS href FROM anchor WHERE contains(tag, 'href='))
"""
ENCODE = "replace(regexp_replace(url_encode({x}), '\\+', '%20', 'g'), '%2F', '/')"
ORACLE["page_links"] = f"""
WITH {TOKENS.format(table='pages')}
SELECT page_id, CAST(a_no - 1 AS INTEGER) AS pos, href AS href_raw, regexp_extract(url, '^https?://[^/?#]+') || replace(replace(replace(replace(replace(replace(replace(replace({ENCODE.format(x='href')}, '%2C', ','), '%21', '!'), '%2A', '*'), '%24', '$'), '%40', '@'), '%3A', ':'), '%25', '%'), '%26', '&') AS url,
  {text_sql('text')} AS text, zone, true AS crawlable, true AS internal, '' AS reason FROM link
"""
ORACLE["structure_counts"] = """
SELECT page_id, 0 AS nosnippet_count, CAST(len(regexp_extract_all(html, '<img')) AS INTEGER) AS n_images, CAST(len(regexp_extract_all(html, '<[uo]l>')) AS INTEGER) AS lists,
  CAST(len(regexp_extract_all(html, '<table')) AS INTEGER) AS tables, 'nav|footer|article' AS landmarks, CAST(len(regexp_extract_all(html, '<a href')) AS INTEGER) AS n_links FROM pages
"""
ORACLE["visible_words"] = f"""
WITH t AS (SELECT page_id, lower({text_sql("regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)^.*?<body>', ''), '(?s)<(script|style)>.*?</(script|style)>', '', 'g')")}) AS t FROM pages)
SELECT page_id, CAST(length(t) AS INTEGER) AS n_chars, CAST(len(string_split(t, ' ')) AS INTEGER) AS n_words, md5(t) AS text_md5 FROM t
"""

CRAWL = f"crawl AS ({D.CRAWL_SQL})"

# --- units ---------------------------------------------------------------------------------------------------------------
from crawlscope import registry as G  # noqa: E402


def q(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def values(rows, cols) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows) + f") AS t({cols})"


SITE_SQL = "regexp_extract(url, '^https?://[^/?#]+')"
RULES_CTE = f"rules AS (SELECT * FROM {values([(i, r[0], r[2], r[4], r[5], r[6]) for i, r in enumerate(G.RULES)], 'ordinal, check_id, category, score, bucket, weight')})"
_SEV = {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 3, "LOW": 4}
REASONS_CTE = f"reasons AS (SELECT * FROM {values([(r[0], r[1], r[2], r[3], _SEV[r[3]], r[4], r[5]) for r in G.REASONS], 'reason_code, check_id, finding_status, severity, sev, classification, confidence')})"
UNITS = f"""{RULES_CTE}, {REASONS_CTE}, cats AS (SELECT * FROM {values(G.CATEGORIES, 'bucket, score, cat_weight')}),
first_reason AS (SELECT check_id, finding_status, min(reason_code) AS reason FROM reasons GROUP BY ALL),
drawn AS (SELECT page_id, {SITE_SQL} AS site, ordinal, (page_id * 31 + ordinal * 17 + (page_id // 10) * 7) % 10 AS pick FROM pages, range(39) AS r(ordinal)),
named AS (SELECT *, CASE WHEN pick < 5 THEN 'PASS' WHEN pick = 5 THEN 'WARN' WHEN pick = 6 THEN 'FAIL' WHEN pick = 7 THEN 'NOT_TESTABLE' WHEN pick = 8 THEN 'NOT_APPLICABLE' ELSE 'ERROR' END AS drawn_status FROM drawn),
units AS (SELECT n.site, n.page_id, r.*, CASE WHEN drawn_status IN ('WARN', 'FAIL') AND f.reason IS NULL THEN 'PASS' ELSE drawn_status END AS status, f.reason, drawn_status <> 'ERROR' AS seen,
  CASE WHEN drawn_status = 'NOT_TESTABLE' THEN 'limit ' || (n.page_id % 8) END AS limitation
  FROM named n JOIN rules r USING (ordinal) LEFT JOIN first_reason f ON f.check_id = r.check_id AND f.finding_status = drawn_status)"""
FINDINGS = UNITS + """,
findings AS (SELECT u.site, u.page_id, u.ordinal, u.category, s.* FROM units u JOIN reasons s ON s.reason_code = u.reason AND s.check_id = u.check_id WHERE u.status IN ('WARN', 'FAIL')),
grouped AS (SELECT site, check_id, reason_code, any_value(category) AS category, any_value(finding_status) AS finding_status, any_value(severity) AS severity, any_value(sev) AS sev, any_value(classification) AS classification, any_value(confidence) AS confidence,
  count(*) AS n_pages FROM findings GROUP BY site, check_id, reason_code),
issues AS (SELECT *, 'I-' || lpad(CAST(row_number() OVER (PARTITION BY site ORDER BY sev, classification <> 'ISSUE', n_pages DESC, check_id, reason_code) AS VARCHAR), 3, '0') AS issue_id,
  CASE WHEN classification = 'OPTIONAL' THEN 'P4' WHEN classification <> 'ISSUE' THEN 'P3' WHEN sev <= 2 THEN 'P1' WHEN sev = 3 THEN 'P2' ELSE 'P3' END AS priority FROM grouped)"""
SCORES = UNITS + """,
per_check AS (SELECT site, check_id, score, bucket, weight, count(*) AS applicable, count(*) FILTER (status IN ('PASS', 'WARN', 'FAIL')) AS evaluated,
  avg(CASE status WHEN 'PASS' THEN 1.0::DOUBLE WHEN 'WARN' THEN 0.5::DOUBLE WHEN 'FAIL' THEN 0.0::DOUBLE END) AS s FROM units WHERE status <> 'NOT_APPLICABLE' AND score IS NOT NULL GROUP BY ALL),
per_cat AS (SELECT site, p.score, p.bucket, any_value(cat_weight)::DOUBLE AS cw, floor(sum(s * weight::DOUBLE) / sum(CASE WHEN s IS NOT NULL THEN weight END)::DOUBLE * 100 * 10 + 0.5) / 10 AS cs, sum(evaluated) AS evaluated, sum(applicable) AS applicable
  FROM per_check p JOIN cats c ON c.bucket = p.bucket AND c.score = p.score GROUP BY ALL)"""

ORACLE["status_precedence"] = """
SELECT page_id, CASE WHEN page_id % 11 = 1 THEN 'NOT_APPLICABLE' WHEN page_id % 11 = 2 THEN 'NOT_TESTABLE' WHEN page_id % 11 = 3 THEN 'ERROR' WHEN page_id % 7 = 2 AND page_id % 2 = 1 THEN 'FAIL'
 WHEN page_id % 5 = 1 THEN 'FAIL' WHEN page_id % 3 = 1 THEN 'WARN' WHEN page_id % 13 = 4 THEN 'NOT_TESTABLE' WHEN page_id % 4 = 0 THEN 'ERROR' ELSE 'PASS' END AS status FROM pages
"""
_DOC = {s for s, label in G.SOURCES if label == "DOCUMENTED"}
_RULE_SOURCES = {r[0]: r[7] for r in G.RULES}
_BAD = [r[0] for r in G.REASONS if r[2] == "FAIL" and not _DOC & set((r[7] or _RULE_SOURCES[r[1]]).split())]
ORACLE["contract_violations"] = f"WITH {FINDINGS} SELECT site, page_id, check_id, reason_code FROM findings WHERE reason_code IN {words(_BAD or ['-'])}"
_DOCUMENTED = [f"{r[1]}|{r[0]}" for r in G.REASONS if r[0] >= "G" and _DOC & set((r[7] or _RULE_SOURCES[r[1]]).split())]
ORACLE["unit_errors"] = f"""
WITH {UNITS}, b AS (SELECT site, page_id, CASE WHEN page_id % 12 = 3 THEN 'Z-' ELSE '' END || check_id AS check_id, status, limitation, seen AND page_id % 6 <> 2 AS seen,
  list_concat(CASE WHEN reason IS NULL THEN CAST([] AS VARCHAR[]) ELSE [reason] END, CASE WHEN page_id % 6 = 1 THEN ['NO_SUCH_REASON'] ELSE CAST([] AS VARCHAR[]) END) AS rs FROM units),
t AS (SELECT *, status NOT IN ('NOT_APPLICABLE', 'ERROR') AS told, list_filter(rs, lambda x: (check_id || '|' || x) NOT IN {words([f"{r[1]}|{r[0]}" for r in G.REASONS])}) AS strange,
  list_filter(rs, lambda x: (check_id || '|' || x) IN {words([f"{r[1]}|{r[0]}" for r in G.REASONS if r[2] == 'FAIL'])} AND (check_id || '|' || x) NOT IN {words(_DOCUMENTED)}) AS bare FROM b),
n AS (SELECT *, CASE WHEN check_id LIKE 'Z-%' THEN 'UNKNOWN_CHECK: ' || check_id WHEN told AND len(strange) > 0 THEN 'UNKNOWN_REASON: ' || strange[1] WHEN told AND NOT seen AND len(rs) > 0 THEN 'NO_EVIDENCE: ' || rs[1]
  WHEN told AND len(bare) > 0 THEN 'UNDOCUMENTED_FAIL: ' || bare[1] WHEN status = 'PASS' AND NOT seen THEN 'PASS_WITHOUT_EVIDENCE' END AS note FROM t)
SELECT site, page_id, check_id, CASE WHEN note IS NULL THEN status ELSE 'ERROR' END AS status, CASE WHEN note IS NULL THEN array_to_string(rs, ',') ELSE '' END AS reasons, coalesce(note, '') AS note,
  CASE WHEN note IS NULL THEN coalesce(limitation, '') ELSE 'This is a tool defect, not a website defect.' END AS limitation FROM n
"""
ORACLE["check_scores"] = f"WITH {SCORES} SELECT site, check_id, evaluated, applicable, floor(s * 100 * 10 + 0.5) / 10 AS score_pct FROM per_check"
ORACLE["category_scores"] = f"WITH {SCORES} SELECT site, score, bucket, cs AS category_score, CAST(evaluated AS BIGINT) AS evaluated, CAST(applicable AS BIGINT) AS applicable FROM per_cat"
ORACLE["site_scores"] = f"""
WITH {SCORES}, v AS (SELECT {SITE_SQL} AS site, count(*) FILTER (page_id % 4 <> 0) AS valid FROM pages GROUP BY 1),
t AS (SELECT site, score, any_value(valid) AS valid, sum(cs * cw) / sum(CASE WHEN cs IS NOT NULL THEN cw END) AS raw, floor(CAST(sum(evaluated) AS DOUBLE) / CAST(sum(applicable) AS DOUBLE) * 100 * 10 + 0.5) / 10 AS pct FROM per_cat JOIN v USING (site) GROUP BY site, score),
s AS (SELECT *, CASE WHEN valid = 0 THEN 'NO_VALID_PAGE' WHEN raw IS NULL THEN 'NO_SCORED_CHECK' WHEN pct IS NULL OR pct < 50 THEN 'COVERAGE_BELOW_50' ELSE '' END AS suppressed FROM t)
SELECT site, score, CASE WHEN suppressed = '' THEN CAST(floor(raw + 0.5) AS BIGINT) ELSE -1 END AS value, suppressed, pct AS coverage_pct FROM s
"""
ORACLE["root_issues"] = f"WITH {FINDINGS} SELECT site, issue_id, check_id, reason_code, finding_status, severity, classification, priority, n_pages FROM issues"
ORACLE["issue_pages"] = f"WITH {FINDINGS} SELECT DISTINCT site, check_id, reason_code, page_id FROM findings"
ORACLE["related_issues"] = f"""
WITH {FINDINGS}, p AS (SELECT site, reason_code, list(DISTINCT page_id) AS pages FROM findings GROUP BY ALL)
SELECT a.site, a.reason_code, b.reason_code AS blocker, ia.issue_id, ib.issue_id AS related_issue_id FROM p a JOIN p b ON a.site = b.site AND a.reason_code <> b.reason_code AND list_has_all(b.pages, a.pages)
 JOIN issues ia ON ia.site = a.site AND ia.reason_code = a.reason_code JOIN issues ib ON ib.site = b.site AND ib.reason_code = b.reason_code
WHERE b.reason_code IN ('UNEXPECTED_NOINDEX', 'GOOGLEBOT_DISALLOWED', 'NOT_FOUND_STATUS', 'SERVER_ERROR_STATUS')
"""
ORACLE["page_issues"] = f"WITH {FINDINGS} SELECT f.site, f.page_id, string_agg(issue_id, ',' ORDER BY issue_id) AS issue_ids, count(*) AS n_issues FROM findings f JOIN issues i USING (site, reason_code) GROUP BY ALL"
ORACLE["issue_urls"] = f"WITH {FINDINGS} SELECT f.site, issue_id, f.page_id, url FROM findings f JOIN issues i USING (site, reason_code) JOIN pages p USING (page_id)"
_PHASE = "CASE WHEN classification = 'ISSUE' AND sev <= 2 THEN {0} WHEN classification = 'ISSUE' AND sev = 3 THEN {1} ELSE {2} END"
ORACLE["top_issues"] = f"""
WITH {FINDINGS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY {_PHASE.format(1, 2, 3)}, issue_id) AS INTEGER) AS rank FROM issues) SELECT site, rank, issue_id, reason_code FROM r WHERE rank <= 3
"""
ORACLE["severity_counts"] = f"WITH {FINDINGS} SELECT site, " + ", ".join(f"count(*) FILTER (classification = 'ISSUE' AND severity = '{s}') AS {s.lower()}" for s in _SEV) + ", count(*) FILTER (classification <> 'ISSUE') AS opportunities FROM issues GROUP BY site"
ORACLE["action_plan"] = f"WITH {FINDINGS}, p AS (SELECT *, " + _PHASE.format("'0-7 days'", "'1-2 weeks'", "'3-4 weeks'") + " AS phase FROM issues) SELECT site, phase, count(*) AS n_issues, string_agg(issue_id, ',' ORDER BY issue_id) AS issue_ids FROM p GROUP BY ALL"
ORACLE["issue_filter"] = f"WITH {FINDINGS} SELECT site, issue_id, reason_code FROM issues WHERE category = 'crawl_indexing' AND severity = 'HIGH' AND classification = 'ISSUE' AND finding_status = 'FAIL' AND confidence = 'OBSERVED'"
ORACLE["unit_search"] = f"WITH {UNITS} SELECT site, page_id, check_id FROM units WHERE status = 'WARN' AND contains(lower(concat_ws(' ', check_id, page_id, reason, 'seen', limitation)), 'canonical')"
ORACLE["strengths"] = f"WITH {UNITS} SELECT site, check_id, count(*) AS n_units FROM units WHERE status <> 'NOT_APPLICABLE' AND check_id IN ('C-1.2', 'C-1.3', 'C-1.8', 'C-1.7', 'O-2.1', 'A-5.1', 'A-5.3', 'T-8.1', 'U-7.1', 'C-1.12') GROUP BY ALL HAVING bool_and(status = 'PASS')"
_OMIT = f"WITH {UNITS}, o AS (SELECT site, check_id, page_id, status, coalesce(limitation, 'unavailable') AS reason FROM units WHERE status IN ('NOT_TESTABLE', 'ERROR')) "
ORACLE["omitted_checks"] = _OMIT + "SELECT * FROM o"
ORACLE["omitted_reasons"] = _OMIT + ", d AS (SELECT DISTINCT site, reason FROM o), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY reason) AS INTEGER) AS rank FROM d) SELECT site, rank, reason FROM r WHERE rank <= 5".lstrip(", ")
ORACLE["omitted_reasons"] = _OMIT.rstrip() + ", d AS (SELECT DISTINCT site, reason FROM o), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY reason) AS INTEGER) AS rank FROM d) SELECT site, rank, reason FROM r WHERE rank <= 5"
ORACLE["progress"] = f"WITH {UNITS} SELECT site, count(*) AS checks, CAST(sum(CASE WHEN reason IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS findings, count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (status = 'WARN') AS warn FROM units GROUP BY site"
ORACLE["category_tallies"] = f"WITH {UNITS} SELECT site, coalesce(category, '*') AS category, coalesce(status, '*') AS status, count(*) AS n_units FROM units GROUP BY GROUPING SETS ((site, category, status), (site, category), (site))"
ORACLE["status_matrix"] = f"""
WITH {UNITS}, k AS (SELECT *, dense_rank() OVER (PARTITION BY site ORDER BY page_id) AS slot FROM units)
SELECT site, check_id, """ + ", ".join(f"coalesce(max(CASE WHEN slot = {i} THEN status END), '') AS p0{i}" for i in range(1, 5)) + " FROM k WHERE slot <= 4 GROUP BY site, check_id"
_SRC_ROWS = [(r[0], r[1], s) for r in G.REASONS for s in (r[7] or _RULE_SOURCES[r[1]]).split()]
_RSRC_ROWS = [(r[0], s) for r in G.RULES for s in r[7].split()]
ORACLE["used_sources"] = f"""
WITH {FINDINGS} SELECT site, source_id FROM findings JOIN (SELECT * FROM {values(_SRC_ROWS, 'reason_code, check_id, source_id')}) s USING (reason_code, check_id)
UNION SELECT site, source_id FROM units JOIN (SELECT * FROM {values(_RSRC_ROWS, 'check_id, source_id')}) s USING (check_id) WHERE status IN ('PASS', 'WARN', 'FAIL')
"""
ORACLE["finding_ids"] = f"WITH {FINDINGS} SELECT site, page_id, reason_code, 'F-' || lpad(CAST(row_number() OVER (PARTITION BY site ORDER BY ordinal, page_id, reason_code) AS VARCHAR), 4, '0') AS finding_id FROM findings"
_EV = ", ev AS (SELECT site, page_id, check_id, 'EV-' || lpad(CAST(row_number() OVER (PARTITION BY site ORDER BY ordinal, page_id) AS VARCHAR), 4, '0') AS evidence_id, 'seen ' || page_id AS observed FROM units WHERE seen)"
ORACLE["evidence_rows"] = f"WITH {UNITS}{_EV} SELECT * FROM ev"
ORACLE["issue_evidence"] = f"WITH {FINDINGS}{_EV} SELECT f.site, issue_id, f.page_id, evidence_id FROM findings f JOIN issues i USING (site, reason_code) JOIN ev ON ev.site = f.site AND ev.check_id = f.check_id AND ev.page_id = f.page_id"
ORACLE["limitations"] = f"WITH {UNITS} SELECT DISTINCT site, limitation FROM units WHERE limitation IS NOT NULL"
ORACLE["run_history"] = """
WITH u AS (SELECT o_custkey AS tenant_id, 'a' || (o_orderkey % 5000) AS audit_id, o_orderdate AS updated_at, o_orderkey AS version, o_orderkey % 3 = 0 AS fresh FROM orders),
l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY tenant_id, audit_id ORDER BY updated_at DESC, fresh DESC, version DESC) = 1),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY updated_at DESC, version DESC) AS INTEGER) AS rank FROM l) SELECT tenant_id, rank, audit_id, version FROM r WHERE rank <= 2
"""
