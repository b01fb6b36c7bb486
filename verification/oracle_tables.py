"""SQL twins of the queries over inputs and outputs."""

from __future__ import annotations

from crawlscope.plans import catalog_tables as CT
from verification.oracle import ORACLE, SITE_SQL, TOKENS, UNITS, text_sql
from verification.oracle_crawl import _SM, CANON, CONF, EXCL, LINKS, PROBES, RESP, ROBOTS, ST, unit

ORACLE["header_names"] = f"""
WITH h AS ({CT.HEADERS_SQL.replace('AS STRING', 'AS VARCHAR')}), e AS (SELECT page_id, 1 AS k, lower(name_a) AS name, value_a AS v FROM h UNION ALL SELECT page_id, 2, lower(name_b), value_b FROM h)
SELECT page_id, name, string_agg(v, '|' ORDER BY k) AS value FROM e GROUP BY page_id, name
"""
ORACLE["decoded_bodies"] = """
WITH t AS (SELECT page_id, CASE WHEN page_id % 3 = 1 THEN '<meta charset="iso-8859-1">' ELSE '' END || '<p>éü ' || CASE WHEN page_id % 3 = 2 THEN html ELSE regexp_replace(html, '[^\\x00-\\xFF]', '?', 'g') END AS s FROM pages)
SELECT page_id, CAST(length(s) AS INTEGER) AS n_chars, md5(s) AS text_md5 FROM t
"""
ORACLE["url_universe"] = f"""
WITH p AS (SELECT page_id, {SITE_SQL} AS site, regexp_replace(url, '#.*$', '') AS url FROM pages)
SELECT site, url FROM p WHERE page_id % 3 = 0 OR page_id % 4 = 0 UNION SELECT site, site || '/' FROM p
"""
ORACLE["blocked_links"] = f"""
WITH {LINKS}, {ROBOTS}, c AS (SELECT site, url, substr(url, length(site) + 1) AS path FROM (SELECT DISTINCT site, url, {EXCL} AS ex FROM edge WHERE internal) WHERE ex = ''),
named AS (SELECT DISTINCT origin FROM ag WHERE agent = 'googlebot'),
hit AS (SELECT c.site, c.url, ru.allow, ru.path, ru.line FROM c JOIN rs ON rs.origin = c.site AND robots_state = 'PARSED' LEFT JOIN named n ON n.origin = c.site
  JOIN ag ON ag.origin = c.site AND ag.agent = CASE WHEN n.origin IS NULL THEN '*' ELSE 'googlebot' END JOIN ru ON ru.origin = ag.origin AND ru.group_no = ag.group_no
  WHERE regexp_matches(c.path, '^' || replace(replace(regexp_replace(regexp_replace(ru.path, '([.?+()|\\[\\]{{}}^])', '\\\\\\1', 'g'), '\\$$', chr(1)), '*', '.*'), chr(1), '$'))),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY length(path) DESC, allow DESC, line) = 1)
SELECT site, url, 'Disallow: ' || path || ' (line ' || line || ')' AS rule FROM best WHERE NOT allow
"""
ORACLE["llms_check"] = f"""
WITH {PROBES} SELECT site, 'X-9.1' AS check_id, CASE WHEN acquisition <> 'OK' THEN 'NOT_TESTABLE' WHEN status = 404 THEN 'NOT_APPLICABLE' WHEN status = 200 AND content_type = 'text/html' THEN 'NOT_APPLICABLE'
  WHEN status = 200 THEN 'PASS' ELSE 'NOT_TESTABLE' END AS status, '' AS reasons FROM pr WHERE kind = 'llms'
"""
ORACLE["stopped_runs"] = f"""
WITH {ST}, s AS (SELECT site, page_id, CASE WHEN page_id % 9 = 2 THEN 'BLOCKED' ELSE state END AS state FROM gt),
c AS (SELECT site, count(*) AS selected, count(*) FILTER (state = 'VALID') AS valid, count(*) FILTER (state = 'BLOCKED') AS blocked, count(*) FILTER (state = 'ERROR_PAGE') AS errors,
  count(*) FILTER (state = 'BLOCKED' AND page_id % 2 = 0) AS restricted, CASE min(page_id) % 7 WHEN 0 THEN 'CANCELLED' WHEN 1 THEN 'RATE_LIMITED' WHEN 2 THEN 'TIME_LIMIT' END AS stop FROM s GROUP BY site)
SELECT site, selected, valid, blocked, CASE WHEN valid = 0 THEN 'INSUFFICIENT' WHEN stop IS NOT NULL OR valid < selected - errors - restricted THEN 'PARTIAL' ELSE 'COMPLETE' END AS quality,
  CASE WHEN stop = 'CANCELLED' THEN 'CANCELLED' WHEN stop IS NOT NULL THEN 'PARTIAL' ELSE 'COMPLETED' END AS status FROM c
"""
ORACLE["saved_results"] = f"""
WITH {UNITS} SELECT 'a' AS run_id, site, status, count(*) AS n_units FROM units WHERE status <> 'PASS' GROUP BY site, status
UNION ALL SELECT 'b', site, status, count(*) FROM units WHERE status = 'FAIL' GROUP BY site, status
"""
ORACLE["site_document_parts"] = f"""
WITH {UNITS}, p AS (SELECT site, page_id, row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS no, count(*) OVER (PARTITION BY site) AS n FROM (SELECT DISTINCT site, page_id FROM units)),
a AS (SELECT site, count(*) AS n FROM units GROUP BY site)
SELECT p.site, CAST(no // 5 AS INTEGER) AS part, any_value((p.n + 4) // 5) AS n_parts, string_agg(page_id::VARCHAR, ',' ORDER BY page_id) AS pages, CAST(count(*) * 39 AS INTEGER) AS n_checks,
  CASE WHEN no // 5 = 0 THEN any_value(a.n) ELSE 0 END AS issue_pages FROM p JOIN a ON a.site = p.site GROUP BY p.site, no // 5
"""
ORACLE["tenant_runs"] = """
SELECT o_custkey % 10 AS tenant_id, 'a' || o_orderkey AS audit_id, o_orderkey AS version FROM orders WHERE o_custkey % 10 = 3 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50
"""
_SIDES = [("C-1.2", "access_checks"), ("C-1.3", "http_status_check"), ("C-1.7", "canonical_check"), ("C-1.8", "indexing_check")]
ORACLE["eligibility"] = f"""
WITH u AS ({' UNION ALL '.join(f"SELECT page_id, check_id, status, string_split(reasons, ',') AS r FROM ({ORACLE[name]}) WHERE check_id = '{check}'" for check, name in _SIDES)}),
g AS (SELECT page_id, max(status) FILTER (check_id = 'C-1.2') AS access, max(status) FILTER (check_id = 'C-1.3') AS http, max(status) FILTER (check_id = 'C-1.8') AS indexing, bool_or(list_contains(r, 'UNEXPECTED_NOINDEX')) AS noindex,
  bool_or(list_has_any(r, ['CANONICAL_POINTS_TO_DIFFERENT_PAGE', 'CANONICAL_TARGET_BROKEN', 'CANONICAL_CONFLICT'])) AS unclear FROM u GROUP BY page_id)
SELECT page_id, CASE WHEN access = 'FAIL' OR http = 'FAIL' OR noindex THEN 'NOT_ELIGIBLE' WHEN access = 'NOT_TESTABLE' OR http <> 'PASS' OR indexing = 'NOT_TESTABLE' OR unclear THEN 'UNCERTAIN' ELSE 'ELIGIBLE' END AS eligibility FROM g
"""
ORACLE["sitemap_variants"] = f"""
WITH {PROBES}, {_SM}, {ROBOTS}, dc AS (SELECT origin AS site, min_by(v, line) AS d FROM kv WHERE k = 'sitemap' AND regexp_matches(v, '^https?://') GROUP BY origin),
s AS (SELECT site, min_by(url, CASE WHEN url LIKE '%/sitemap.xml' THEN 1 ELSE 2 END) FILTER (result = 'OPEN') AS f FROM sm GROUP BY site), c AS (SELECT s.site, coalesce(d, f) AS chosen FROM s LEFT JOIN dc USING (site)),
p AS (SELECT *, regexp_replace(regexp_extract(chosen, '^https?://([^/?#]+)', 1), '^www[.]', '') AS bare, regexp_replace(regexp_extract(site, '^https?://([^/?#]+)', 1), '^www[.]', '') AS own, regexp_replace(chosen, '^https?://[^/?#]+', '') AS rest FROM c WHERE chosen IS NOT NULL),
v AS (SELECT site, chosen, unnest(list_distinct(CASE WHEN bare <> own THEN [chosen] ELSE [chosen, 'https://' || bare || rest, 'https://www.' || bare || rest, 'http://' || bare || rest, 'http://www.' || bare || rest] END)) AS url FROM p)
SELECT site, url, CASE WHEN url = chosen THEN 'main' ELSE 'variant' END AS role FROM v
"""
_DOM_LINKS = LINKS.replace(TOKENS.format(table="crawl"), TOKENS.format(table="(SELECT page_id, url, dom AS html FROM crawl)"))
ORACLE["rendered_only_links"] = f"""
WITH {ST}, raw_edge AS (SELECT * FROM (WITH {LINKS} SELECT page_id, url FROM edge WHERE crawlable)), dom_edge AS (SELECT * FROM (WITH {_DOM_LINKS} SELECT page_id, url FROM edge WHERE internal AND zone IN ('nav', 'main')))
SELECT DISTINCT d.page_id, d.url FROM dom_edge d JOIN gt ON gt.page_id = d.page_id AND gt.pair_gate = '' LEFT JOIN raw_edge r ON r.page_id = d.page_id AND r.url = d.url WHERE r.page_id IS NULL
"""


def signals_sql(source: str) -> str:
    """Title, first h1, first canonical and types of a derived document as one list; its robots tags are the same in both profiles."""
    types = f"array_to_string(list_sort(list_distinct(regexp_extract_all({source}, '\"@type\":\"([^\"]*)\"', 1))), ',')"
    return f"[{text_sql(f"regexp_extract({source}, '(?s)<title>(.*?)</title>', 1)")}, {text_sql(f"regexp_extract({source}, '(?s)<h1>(.*?)</h1>', 1)")}, coalesce({CANON.format(source)}[1], ''), {types}]"


ORACLE["raw_rendered_check"] = f"""
WITH {ST}, raw_edge AS (SELECT DISTINCT * FROM (WITH {LINKS} SELECT page_id, url FROM edge WHERE crawlable)), dom_edge AS (SELECT DISTINCT * FROM (WITH {_DOM_LINKS} SELECT page_id, url FROM edge WHERE internal AND zone IN ('nav', 'main'))),
n AS (SELECT d.page_id, count(*) AS n, count(*) FILTER (r.url IS NULL) AS gone FROM dom_edge d LEFT JOIN raw_edge r ON r.page_id = d.page_id AND r.url = d.url GROUP BY d.page_id),
m AS (SELECT gt.*, coalesce(n.n, 0) AS n, coalesce(gone, 0) AS gone, {signals_sql('html')} <> {signals_sql('dom')} AS differs FROM gt LEFT JOIN n ON n.page_id = gt.page_id)
{unit('A-5.2', "CASE WHEN pair_gate <> '' THEN 'NOT_TESTABLE' WHEN n = 0 THEN 'NOT_APPLICABLE' ELSE '' END", [('gone >= 3 AND 2 * gone > n', 'IMPORTANT_LINKS_REQUIRE_RENDERING')], 'm')}
UNION ALL {unit('A-5.5', "CASE WHEN pair_gate <> '' THEN 'NOT_TESTABLE' ELSE '' END", [('differs', 'SIGNALS_DIFFER_AFTER_RENDERING')], 'm')}
"""


def alternates_sql(source: str, header: str) -> str:
    """[code, address] of the alternates in a derived document and, where `header` holds, in its Link header."""
    found = f"regexp_extract_all({source}, '<link rel=\"alternate\" hreflang=\"[^\"]*\" href=\"[^\"]*\"')"
    return f"list_concat(list_transform({found}, lambda s: [split_part(s, chr(34), 4), split_part(s, chr(34), 6)]), CASE WHEN {header} AND page_id % 19 = 10 THEN [['it', site || '/about']] ELSE [] END)"


_FIRST_CANON = f"coalesce(CASE WHEN raw_valid THEN {CANON.format('html')}[1] END, {CANON.format('best')}[1])"
ORACLE["hreflang_check"] = f"""
WITH {ST}, {CONF}, {RESP},
pg AS (SELECT *, list_distinct(list_concat({alternates_sql('best', 'NOT ren_valid')}, CASE WHEN raw_valid THEN {alternates_sql('html', 'true')} ELSE [] END)) AS declared,
  [url, CASE WHEN ren_valid AND page_id % 29 = 8 THEN site || '/moved' ELSE url END, CASE WHEN {_FIRST_CANON} LIKE '/%' THEN site || {_FIRST_CANON} ELSE coalesce({_FIRST_CANON}, url) END] AS own FROM gt WHERE best IS NOT NULL),
an AS (SELECT page_id, own, d[1] AS code, d[2] AS href FROM (SELECT page_id, own, unnest(declared) AS d FROM pg)),
back AS (SELECT re.url, {alternates_sql('html', 'true')} AS alternates FROM (SELECT re.*, rid AS page_id, regexp_extract(url, '^https?://[^/?#]+') AS site FROM re) re),
jo AS (SELECT an.*, NOT list_contains(own, href) AS other, coalesce(NOT list_contains(own, href) AND re.acquisition = 'OK' AND re.raw_validity <> 'ACCESS_CHALLENGE', false) AS tested, re.status, re.raw_validity,
  coalesce(list_has_any(list_transform(back.alternates, lambda a: a[2]), own), false) AS returns FROM an LEFT JOIN re ON re.url = an.href LEFT JOIN back ON back.url = an.href),
pa AS (SELECT page_id, count(*) AS n, bool_or(code = 'en-UK') AS invalid, bool_or(NOT other) AS self, bool_or(other) AS others, bool_or(tested) AS tested, coalesce(bool_or(tested AND status >= 400), false) AS broken,
  coalesce(bool_or(tested AND status < 400 AND raw_validity = 'VALID_PAGE' AND NOT returns), false) AS one_way FROM jo GROUP BY page_id),
m AS (SELECT gt.*, cfg.multilingual, coalesce(pa.n, 0) AS n, invalid, self, others, pa.tested, broken, one_way FROM gt JOIN cfg USING (site) LEFT JOIN pa ON pa.page_id = gt.page_id)
{unit('S-3.5', "CASE WHEN gate <> '' THEN gate WHEN n = 0 AND multilingual THEN 'NOT_TESTABLE' WHEN n = 0 THEN 'NOT_APPLICABLE' ELSE '' END",
      [('invalid', 'HREFLANG_INVALID_CODE'), ('NOT self', 'HREFLANG_NO_SELF_REFERENCE'), ('broken', 'HREFLANG_TARGET_BROKEN'), ('one_way', 'HREFLANG_NO_RETURN_LINK')], 'm', 'others AND NOT tested')}
"""


def words_sql(source: str) -> str:
    bare = f"regexp_replace(regexp_replace(regexp_replace({source}, '(?s)<!--.*?-->', '', 'g'), '(?s)^.*?<body>', ''), '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g')"
    return f"len(list_filter(string_split({text_sql(bare)}, ' '), lambda w: w <> ''))"


ORACLE["profile_comparison"] = f"""
WITH {ST}, raw_n AS (SELECT page_id, count(*) AS n FROM (WITH {LINKS} SELECT page_id FROM edge) GROUP BY 1), dom_n AS (SELECT page_id, count(*) AS n FROM (WITH {_DOM_LINKS} SELECT page_id FROM edge) GROUP BY 1)
SELECT site, gt.page_id, CAST(CASE WHEN raw_valid THEN {words_sql('html')} ELSE -1 END AS INTEGER) AS raw_words, CAST(CASE WHEN raw_valid THEN coalesce(r.n, 0) ELSE -1 END AS INTEGER) AS raw_links,
  CAST(CASE WHEN ren_valid THEN {words_sql('dom')} ELSE -1 END AS INTEGER) AS dom_words, CAST(CASE WHEN ren_valid THEN coalesce(d.n, 0) ELSE -1 END AS INTEGER) AS dom_links
FROM gt LEFT JOIN raw_n r ON r.page_id = gt.page_id LEFT JOIN dom_n d ON d.page_id = gt.page_id WHERE raw_valid OR ren_valid
"""
