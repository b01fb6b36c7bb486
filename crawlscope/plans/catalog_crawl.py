"""Queries over the derived crawl: head signals, gates, robots, lookups, page and site rules."""

from __future__ import annotations

from crawlscope import registry
from crawlscope.functions import urls as U
from crawlscope.functions.expr import each
from crawlscope.functions.sql import F
from crawlscope.operators import directives as DIR
from crawlscope.operators import discovery as DISC
from crawlscope.operators import dom as DOM
from crawlscope.operators import facts as X
from crawlscope.operators import gates as G
from crawlscope.operators import logs as LOG
from crawlscope.operators import lookups as L
from crawlscope.operators import page_checks as PC
from crawlscope.operators import results as R
from crawlscope.operators import review as REV
from crawlscope.operators import robots as RB
from crawlscope.operators import site_checks as S
from crawlscope.operators import structured as SD
from crawlscope.operators.skew import join_on_hot_key
from crawlscope.plans.catalog import crawl_facts, crawl_pages, crawl_states, given_facts, joined, query, recorded_pages, sample_urls
from crawlscope.session import cut
from crawlscope.sources import derived as D
from crawlscope.sources import field
from crawlscope.sources.tables import read_pages

SITE = F.regexp_extract(F.col("url"), "^https?://[^/?#]+", 0)


def units(prepared, *checks):
    """Status and reasons of some rules, one row per page and rule."""
    rows = PC.evaluate(prepared, checks)
    return rows.select("page_id", "check_id", "status", joined(F.col("reasons"), ",").alias("reasons"))


def site_rows(unit_rows):
    return unit_rows.select("site", "check_id", "status", joined(F.col("reasons"), ",").alias("reasons"))


# --- signatures and candidates -------------------------------------------------------------------------------------
@query
def url_signatures(spark, root):
    urls = sample_urls(spark, root).select(SITE.alias("site"), U.fetch_key(F.col("url")).alias("url")).distinct()
    return DISC.signatures(cut(urls, "urls")).select("site", "url", "signature")


@query
def signature_groups(spark, root):
    facts = crawl_facts(spark, root, "hreflang")
    marks = facts.select("site", F.explode("hreflang").alias("h")).select("site", "h.*")
    extra = facts.select("site", F.concat("site", F.lit("/fr/a")).alias("href"), F.lit("fr-FR").alias("hreflang"), F.lit("HTML").alias("source"))
    locales = cut(DISC.locale_prefixes(marks.unionByName(extra)), "locales")
    urls = D.crawl(spark, root).select("site", F.explode(F.array("url", F.concat("site", F.lit("/fr/blog/x-"), F.col("page_id").cast("string"), F.lit(".html")))).alias("url")).distinct()
    urls = cut(urls, "urls")
    return DISC.signature_groups(DISC.signatures(urls, locales))


VARIANTS_SQL = """
SELECT page_id, 'https://' || split_part(url, '/', 3) AS site, 'https://' || split_part(url, '/', 3) || '/list' || CAST(page_id % 2 AS STRING) || '?v=' || CAST(page_id AS STRING) AS url,
  1 + page_id % 4 AS zone_rank, 10 AS type_rank, 1 + page_id % 2 AS depth FROM pages
"""


@query
def query_variant_cap(spark, root):
    rows = D.derived(spark, root, VARIANTS_SQL).withColumn("excluded", U.exclusion_reason(F.col("url")))
    return DISC.cap_query_variants(rows, 1).select("site", "url", F.coalesce("excluded", F.lit("")).alias("excluded"))


def crawl_edges(spark, root, *profiles):
    """Anchors of the RAW documents (and, if asked for, the RENDERED ones) as edges keyed by the document."""
    out = None
    for profile in profiles or ("RAW",):
        source = X.extract_into(crawl_states(spark, root), "f", "html" if profile == "RAW" else "dom", "url", "headers" if profile == "RAW" else None, ("links",))
        facts = source.withColumn("from_key", U.fetch_key(F.col("url")))
        links = each(facts, ["site", "page_id", "from_key"], F.col("f.links"), "l")
        edges = links.select("site", "page_id", "from_key", F.col("l.pos").alias("pos"), F.col("l.url").alias("url"), F.col("l.text").alias("text"), F.col("l.zone").alias("zone"), F.col("l.crawlable").alias("crawlable"), F.col("l.internal").alias("internal"), F.lit(profile).alias("profile"))
        out = edges if out is None else out.unionByName(edges)
    return out


@query
def crawl_links(spark, root):
    """EXT-7, EXT-8 with all zones, fragments, entities and dot segments."""
    links = X.links_of(crawl_facts(spark, root, "links"))
    return links.filter("zone <> 'nav'").select("page_id", "href_raw", "url", "text", "zone", "rel", "crawlable", "internal", F.coalesce("reason", F.lit("")).alias("reason"))


@query
def link_rollup(spark, root):
    return L.link_rollup(crawl_edges(spark, root)).select("site", "url", "n_links", "n_pages", "in_nav")


@query
def document_link_cap(spark, root):
    """WIN-2 with a small cap: navigation and main content first."""
    return DISC.usable_edges(crawl_edges(spark, root), 6).select("site", "page_id", "pos", "zone", "link_no")


@query
def link_target_topk(spark, root):
    crawl = D.crawl(spark, root)
    return L.top_targets(L.testable_targets(L.link_rollup(crawl_edges(spark, root))), crawl.select("site", "url"), 5).select("site", "rank", "url", "sampled", "n_links")


@query
def link_expansion(spark, root):
    homes = D.crawl(spark, root).filter(F.col("url") == F.concat("site", F.lit("/"))).select("site", U.fetch_key(F.col("url")).alias("home_key")).distinct()
    found = DISC.expand(cut(DISC.usable_edges(crawl_edges(spark, root)), "edges"), homes)
    return found.select("site", "url", "depth", "zone", "page_type", F.coalesce("excluded", F.lit("")).alias("excluded"), "in_raw", "in_rendered")


def index(spark, root):
    return cut(L.response_index(X.extract_into(crawl_states(spark, root), "raw_facts", "html", "url", "headers", ("title", "hreflang"))), "responses")


def candidates(spark, root):
    """(homepages, verified candidates): links of both profiles, nothing that the auditor may not fetch, and only pages with a genuine record."""
    homes = D.crawl(spark, root).filter(F.col("url") == F.concat("site", F.lit("/"))).select("site", U.fetch_key(F.col("url")).alias("home_key")).distinct()
    responses = index(spark, root)
    policies = cut(RB.policies(D.derived(spark, root, D.ROBOTS_SQL)), "policies")
    gate = lambda rows: RB.decisions(rows, policies, [registry.AUDITOR_TOKEN], ("site", "url")).withColumn("robots_auditor", F.col("decisions")[registry.AUDITOR_TOKEN]["decision"]).drop("decisions", "origin", "robots_state")
    # Each step reads its input several times, so the steps are written out in between.
    homes = cut(homes, "homes")
    edges = cut(DISC.usable_edges(crawl_edges(spark, root, "RAW", "RENDERED")), "edges")
    blocked = gate(edges.select("site", "url").distinct()).filter("robots_auditor = 'DISALLOW'")
    found = cut(DISC.expand(edges, homes, cut(blocked.select("site", "url"), "blocked")), "found")
    capped = cut(gate(DISC.cap_query_variants(DISC.with_fallback(found, responses, homes))), "capped")
    return homes, cut(DISC.verify(DISC.signatures(capped), responses, homes.select("site", F.col("home_key").alias("url"))), "candidates")


def sampled(spark, root):
    """(sample, verified candidates)."""
    homes, checked = candidates(spark, root)
    return DISC.sample(checked, homes), checked


@query
def candidate_verification(spark, root):
    _, checked = candidates(spark, root)
    return checked.select("site", "url", "verification", "final_key", "signature")


@query
def sample_pages(spark, root):
    return sampled(spark, root)[0].select("site", "slot", "sample_id", "url", "page_type", "signature", "reason")


# Candidates whose redirects end on few shared addresses and whose groups hold several page types.
_KINDS = "CASE page_id % 10 WHEN 0 THEN 'service' WHEN 1 THEN 'article' WHEN 2 THEN 'product' WHEN 3 THEN 'other' WHEN 4 THEN 'pricing' WHEN 5 THEN 'service' WHEN 6 THEN 'author' WHEN 7 THEN 'contact' WHEN 8 THEN 'category_hub' ELSE 'about' END"
CANDIDATES_SQL = f"""
SELECT site, url, CAST(page_id % 4 + 1 AS INT) AS zone_rank, CAST(page_id % 2 + 1 AS INT) AS depth, kind AS page_type, '/g' || CAST(page_id % 7 AS STRING) AS signature,
  CASE WHEN page_id % 11 = 4 THEN 'NON_HTML' END AS excluded, CASE WHEN page_id % 13 = 5 THEN 'failed' ELSE 'verified' END AS verification,
  CASE WHEN page_id % 17 = 2 THEN 'DISALLOW' ELSE 'ALLOW' END AS robots_auditor, CASE WHEN page_id % 3 = 1 THEN site || '/end/' || CAST(page_id % 5 AS STRING) ELSE url END AS final_key,
  page_id, page_id % 29 = 3 AS supplied
FROM (SELECT page_id, 'https://' || split_part(url, '/', 3) AS site, 'https://' || split_part(url, '/', 3) || '/c/' || CAST(page_id AS STRING) AS url, {_KINDS} AS kind FROM pages)
"""


@query
def sample_rounds(spark, root):
    """WIN-6 over candidates with redirects onto pages that are picked already."""
    rows = cut(D.derived(spark, root, CANDIDATES_SQL).withColumn("type_rank", U.type_rank(F.col("page_type"))), "candidates")
    homes = rows.select("site", F.concat("site", F.lit("/")).alias("home_key")).distinct()
    supplied = rows.filter("supplied").select("site", "url", F.col("page_id").alias("position"))
    return DISC.sample(rows, homes, supplied).select("site", "slot", "sample_id", "url", "page_type", "signature", "reason")


@query
def selection_review(spark, root):
    picked, checked = sampled(spark, root)
    return DISC.review_list(picked, checked)


@query
def operator_selection(spark, root):
    """JN-21: an operator list over crawled pages as earlier proposals and derived addresses as candidates."""
    crawl = D.crawl(spark, root)
    chosen = crawl.select("site", F.col("page_id").alias("position"), F.when(F.col("page_id") % 3 == 0, F.concat("site", F.lit("/new/"), F.col("page_id").cast("string"))).otherwise(F.col("url")).alias("url"))
    proposed = crawl.filter("page_id % 2 = 0").select("site", "url").distinct().select("site", "url", U.page_type(F.col("url")).alias("page_type"), U.path_of(F.col("url")).alias("signature"), F.lit("proposed").alias("reason"))
    candidates = crawl.filter("page_id % 2 = 1").select("site", "url").distinct().select("site", "url", U.page_type(F.col("url")).alias("page_type"), U.path_of(F.col("url")).alias("signature"))
    return DISC.apply_selection(chosen, proposed, candidates, 4)


@query
def preferred_origins(spark, root):
    probes = D.derived(spark, root, D.PROBES_SQL).filter("kind = 'origin'").select(F.col("site").alias("seed"), "url", "acquisition", "final_url")
    return DISC.preferred_origins(probes)


@query
def registrable_domains(spark, root):
    hosts = read_pages(spark, root).select(F.split_part(F.col("url"), F.lit("/"), F.lit(3)).alias("host"))
    # Suffix rules derived from the hosts seen: every two-label ending, plus one wildcard and one exception form.
    tail = F.substring_index(F.col("host"), ".", -2)
    suffixes = hosts.select(F.explode(F.array(tail, F.lit("com"), F.lit("net"), F.lit("*.example.org"), F.lit("!blog.example.org"))).alias("suffix")).filter("suffix <> 'example.org'").distinct()
    out = DISC.registrable_domains(hosts, suffixes)
    pair = U.apex_www_pair(F.col("host"), F.col("registrable"))
    return out.select("host", "registrable", F.coalesce(pair["www"], F.lit("")).alias("www_host"))


# --- head and directives ----------------------------------------------------------------------------------------------
@query
def head_signals(spark, root):
    f = crawl_facts(spark, root, "meta_description", "canonical_head", "canonical_http", "meta_robots", "viewport", "hreflang", "author_signals", "date_signals", "generator")
    return f.select(
        "page_id", F.coalesce("meta_description", F.lit("")).alias("description"), joined(F.col("canonical_head")).alias("canonical_head"), joined(F.col("canonical_http")).alias("canonical_http"),
        joined(F.transform(F.col("meta_robots"), lambda m: F.concat(m["name"], F.lit("="), m["content"]))).alias("robots"), F.coalesce("viewport", F.lit("")).alias("viewport"),
        joined(F.transform(F.col("hreflang"), lambda h: F.concat(h["hreflang"], F.lit(" "), h["href"], F.lit(" "), h["source"]))).alias("hreflang"),
        joined(F.col("author_signals")).alias("authors"), joined(F.col("date_signals")).alias("dates"), F.coalesce("generator", F.lit("")).alias("generator"),
    )


@query
def effective_directives(spark, root):
    f = crawl_facts(spark, root, "meta_robots", "x_robots").withColumn("d", DIR.effective(F.col("meta_robots"), F.col("x_robots")))
    return f.select("page_id", "d.noindex", "d.nofollow", "d.nosnippet", F.coalesce(F.col("d.max_snippet").cast("string"), F.lit("")).alias("max_snippet"))


@query
def source_validity(spark, root):
    return crawl_states(spark, root).select(
        "page_id", F.coalesce("raw_validity", F.lit("")).alias("raw_validity"), F.coalesce("dom_validity", F.lit("")).alias("dom_validity"), "raw_valid", "ren_valid", "state",
        F.coalesce("gate", F.lit("")).alias("gate"), F.coalesce("pair_gate", F.lit("")).alias("pair_gate"),
        G.profile_label(F.col("acquisition"), F.col("raw_validity"), F.col("status")).alias("label"),
    )


@query
def truncated_sources(spark, root):
    """FLT-4 over whole documents cut at different places."""
    cut = read_pages(spark, root).withColumn("cut", F.substring(F.col("html"), F.lit(1), F.length("html") - (F.col("page_id") % 40).cast("int")))
    return cut.select("page_id", G.looks_truncated(F.col("cut")).alias("truncated"))


@query
def error_states(spark, root):
    """FN-22 over recorded error codes."""
    code = "CASE page_id % 9 WHEN 0 THEN 'ENOTFOUND' WHEN 1 THEN 'ETIMEDOUT' WHEN 2 THEN 'CERT_HAS_EXPIRED' WHEN 3 THEN 'ECONNRESET' WHEN 4 THEN 'CANCELLED' WHEN 5 THEN 'UNSAFE_DESTINATION' WHEN 6 THEN 'EPROTO' ELSE '' END AS code"
    rows = D.derived(spark, root, f"SELECT page_id, {code}, CASE page_id % 9 WHEN 7 THEN 'self signed certificate in chain' ELSE 'socket hang up' END AS message FROM pages")
    return rows.select("page_id", G.acquisition_of_error(F.col("code"), F.col("message")).alias("acquisition"))


# --- duplicates ----------------------------------------------------------------------------------------------------------
@query
def duplicate_titles(spark, root):
    f = given_facts(spark, root, "title", "meta_description").withColumn("site", SITE)
    return S.duplicates(f).select("site", "field", "value", "n_pages", "first_page")


@query
def duplicate_check(spark, root):
    pages = cut(PC.with_best(PC.with_defaults(crawl_pages(spark, root, "title", "meta_description"))).filter("best IS NOT NULL").select("site", "page_id", "best.title", "best.meta_description"), "pages")
    return site_rows(S.duplicate_units(pages, S.duplicates(pages)))


@query
def duplicate_pages(spark, root):
    """Affected pages of duplicate titles in long form; heavy values are spread."""
    f = given_facts(spark, root, "title", "meta_description").withColumn("site", SITE)
    dups = S.duplicates(f).filter("field = 'title'").select("site", F.col("value").alias("title"), "n_pages")
    return join_on_hot_key(f.select("site", "page_id", "title"), dups, ["site", "title"], ["page_id"], "inner").select("site", "page_id", "title", "n_pages")


# --- robots ---------------------------------------------------------------------------------------------------------------
def policy(spark, root):
    return RB.policies(D.robots_files(spark, root))


@query
def robots_rules(spark, root):
    return RB.rules_table(policy(spark, root))


@query
def robots_states(spark, root):
    p = policy(spark, root)
    return p.select("origin", "robots_state", joined(F.col("sitemaps")).alias("sitemaps"), joined(F.col("unsupported")).alias("unsupported"), F.size("groups").alias("n_groups"))


TOKENS = [b[0] for b in registry.BOTS]


def decided(spark, root):
    pages = D.crawl(spark, root).select("page_id", "site", "url")
    return RB.decisions(pages, policy(spark, root), [registry.AUDITOR_TOKEN, *TOKENS], ("page_id",))


@query
def robots_decisions(spark, root):
    rows = each(decided(spark, root), ["page_id", "url"], F.map_entries("decisions"), "e").select("page_id", "url", F.col("e.key").alias("token"), F.col("e.value").alias("d"))
    return rows.select("page_id", "url", "token", "d.decision", F.coalesce("d.rule", F.lit("")).alias("rule"))


@query
def bot_summary(spark, root):
    return R.bot_summary(decided(spark, root)).select("site", "token", F.col("ALLOW").alias("n_allow"), F.col("DISALLOW").alias("n_disallow"), F.col("UNKNOWN").alias("n_unknown"))


@query
def robots_checks(spark, root):
    """C-1.1, A-5.4 per site."""
    return site_rows(S.robots_answer(policy(spark, root)).unionByName(S.other_tokens(decided(spark, root), [b[0] for b in registry.BOTS if not b[3] and b[0] != "Googlebot"])))


def configured(pages, spark, root):
    """Join the site settings; one row per site, heavy sites spread."""
    conf = D.derived(spark, root, D.CONFIG_SQL).withColumn("intentional", (F.col("environment") == "staging") | (F.col("goal") == "restricted"))
    return join_on_hot_key(pages, conf, ["site"], ["page_id"])


@query
def access_checks(spark, root):
    """C-1.2 and A-5.3 with site settings."""
    rows = configured(decided(spark, root), spark, root).withColumn("best_profile", F.lit("RAW"))
    return units(rows.withColumn("nodes", F.lit(None)), PC.check_googlebot, PC.check_search_crawlers)


# --- page rules ------------------------------------------------------------------------------------------------------------
def best_pages(spark, root, *only):
    return PC.with_best(PC.with_defaults(crawl_pages(spark, root, *only)))


def best_documents(spark, root, *only):
    """`best_pages` for rules that look at the best document alone: no other is read."""
    rows = PC.with_best(PC.with_defaults(crawl_states(spark, root).withColumns({"raw_facts": F.col("html"), "dom_facts": F.col("dom")}))).withColumnRenamed("best", "_html")
    rows = X.extract_into(rows.drop("html", "dom", "raw_facts", "dom_facts"), "_facts", "_html", "best_url", None, only)
    return rows.withColumn("best", F.when(F.col("best_profile").isNotNull(), F.col("_facts"))).drop("_html", "_facts")


@query
def onpage_checks(spark, root):
    rows = best_pages(spark, root, "title", "meta_description", "h1", "headings", "viewport", "landmarks").withColumn("nodes", F.lit(None))
    return units(rows, PC.check_title, PC.check_description, PC.check_h1, PC.check_viewport, PC.check_landmarks)


@query
def internal_link_check(spark, root):
    return units(best_pages(spark, root, "links").withColumn("nodes", F.lit(None)), PC.check_internal_links)


@query
def http_status_check(spark, root):
    return units(configured(crawl_states(spark, root), spark, root).withColumn("nodes", F.lit(None)), PC.check_status)


@query
def redirect_check(spark, root):
    return units(crawl_states(spark, root).withColumn("nodes", F.lit(None)), PC.check_redirects)


@query
def redirect_chains(spark, root):
    rows = D.crawl(spark, root)
    facts = L.response_after_redirect(rows)
    return facts.join(rows.select("site", "page_id", G.hops_text(F.col("hops")).alias("chain")), ["site", "page_id"]).select("page_id", "n_hops", "loops", "downgrade", "too_many", "chain")


@query
def canonical_check(spark, root):
    pages = cut(PC.canonical_facts(best_pages(spark, root, "title", "canonical_head", "canonical_body", "canonical_http", "base_href", "hreflang")), "pages")
    return units(L.with_canonical_targets(pages, L.response_index(pages)).withColumn("nodes", F.lit(None)), PC.check_canonical)


@query
def indexing_check(spark, root):
    rows = configured(crawl_pages(spark, root, "meta_robots", "x_robots", "nosnippet_count"), spark, root)
    return units(PC.with_best(PC.with_directives(PC.with_defaults(rows))).withColumn("nodes", F.lit(None)), PC.check_indexing, PC.check_snippets)


@query
def hreflang_codes(spark, root):
    rows = read_pages(spark, root).select("page_id", F.explode(F.array(*[F.lit(c) for c in ("en", "EN-gb", "en-UK", "xx", "x-default", "", "zh-Hant-TW", "gb", "eng", "de-AT-1", "fr_CA", "qq-US", "pt-BR", " es ")])).alias("code"))
    return rows.select("page_id", "code", F.coalesce(L.hreflang_problem(F.col("code")), F.lit("")).alias("problem"))


@query
def hreflang_check(spark, root):
    pages = cut(best_pages(spark, root, "title", "hreflang", "canonical_head", "base_href"), "pages")
    rows = L.with_hreflang(pages, L.response_index(pages))
    rows = join_on_hot_key(rows.drop("multilingual"), D.derived(spark, root, D.CONFIG_SQL).select("site", "multilingual"), ["site"], ["page_id"])
    return units(rows.withColumn("nodes", F.lit(None)), PC.check_hreflang)


@query
def link_target_check(spark, root):
    pages = cut(best_pages(spark, root, "title", "hreflang", "links"), "pages")
    outcomes = L.tested_targets(L.testable_targets(L.link_rollup(L.link_rows(pages))), L.response_index(pages))
    return site_rows(S.link_targets(L.link_target_units(outcomes, pages)))


@query
def raw_rendered_check(spark, root):
    """A-5.2 and A-5.5."""
    rows = PC.with_best(PC.with_defaults(crawl_pages(spark, root, "links", "title", "h1", "canonical_head", "meta_robots", "x_robots", "json_ld")))
    return units(rows.withColumn("nodes", F.lit(None)), PC.check_main_links, PC.check_parity)


@query
def rendered_only_links(spark, root):
    return L.extra_rendered_links(cut(crawl_pages(spark, root, "links"), "pages")).select("page_id", "url")


@query
def profile_comparison(spark, root):
    """AGG-29: words and links per profile, side by side."""
    from crawlscope.functions.text import word_count

    only = ("links", "visible_text")
    # A document that is not genuine is not compared, so it is not read.
    rows = crawl_states(spark, root).withColumns({
        "html": F.when(F.col("raw_valid"), F.col("html")), "dom": F.when(F.col("ren_valid"), F.col("dom")), "_raw_url": F.coalesce("final_url", "url"), "_dom_url": F.coalesce("dom_url", "url"),
    }).select("site", "page_id", "raw_valid", "ren_valid", "html", "dom", "_raw_url", "_dom_url")
    rows = X.extract_into(X.extract_into(rows, "raw_facts", "html", "_raw_url", None, only), "dom_facts", "dom", "_dom_url", None, only)
    side = lambda p, ok: F.when(F.col(ok), F.struct(F.lit(p).alias("profile"), word_count(F.col(f"{p}_facts")["visible_text"]).alias("words"), F.size(F.col(f"{p}_facts")["links"]).alias("n_links")))
    long = each(rows, ["site", "page_id"], F.array(side("raw", "raw_valid"), side("dom", "ren_valid")), "x").select("site", "page_id", "x.*")
    return long.groupBy("site", "page_id").pivot("profile", ["raw", "dom"]).agg(F.max("words").alias("words"), F.max("n_links").alias("links")).na.fill(-1)


@query
def mixed_content(spark, root):
    from crawlscope.functions import markup as M

    rows = crawl_states(spark, root).withColumn("insecure", PC.insecure_counts(M.tags_of(M.without_scripts(M.without_comments(F.col("dom"))))))
    return units(rows.withColumn("nodes", F.lit(None)), PC.check_mixed_content)


@query
def security_headers(spark, root):
    return S.security_headers(D.crawl(spark, root)).select("site", "status", F.coalesce("observed", F.lit("")).alias("observed"))


@query
def eligibility(spark, root):
    pages = configured(crawl_pages(spark, root, "title", "canonical_head", "canonical_body", "canonical_http", "base_href", "hreflang", "meta_robots", "x_robots"), spark, root)
    ready = cut(PC.canonical_facts(PC.with_directives(PC.with_best(PC.with_defaults(pages)))), "pages")
    ready = L.with_canonical_targets(ready, L.response_index(ready))
    decisions = decided(spark, root).select("site", "page_id", "decisions")
    rows = PC.evaluate(ready.join(decisions, ["site", "page_id"]).withColumn("nodes", F.lit(None)), [PC.check_googlebot, PC.check_status, PC.check_canonical, PC.check_indexing])
    return PC.eligibility(rows).select("page_id", "eligibility")


# --- structured data ---------------------------------------------------------------------------------------------------------
@query
def jsonld_blocks(spark, root):
    f = crawl_facts(spark, root, "json_ld").select("page_id", F.posexplode("json_ld").alias("block_no", "b"))
    return f.select("page_id", "block_no", F.try_parse_json(F.col("b.raw")).isNotNull().alias("parses"), "b.in_head", F.length("b.raw").alias("n_chars"))


@query
def jsonld_nodes(spark, root):
    rows = SD.exploded_nodes(crawl_facts(spark, root, "json_ld"))
    return rows.select("page_id", joined(F.col("types"), ",").alias("types"), F.coalesce("feature", F.lit("")).alias("feature"), joined(F.col("required"), ",").alias("missing_required"), joined(F.col("recommended"), ",").alias("missing_recommended"))


@query
def jsonld_checks(spark, root):
    """S-3.1 and S-3.2 from JSON-LD."""
    return units(PC.with_nodes(best_documents(spark, root, "json_ld")), PC.check_markup_syntax, PC.check_features)


def marked_up_pages(spark, root):
    return cut(PC.with_nodes(best_documents(spark, root, "json_ld", "title", "h1")), "pages")


@query
def markup_opportunities(spark, root):
    rows = marked_up_pages(spark, root)
    marked = join_on_hot_key(rows.drop("site_has_org"), S.sites_with_organisation(rows), ["site"], ["page_id"]).withColumn("page_type", U.page_type(F.col("url")))
    return units(marked, PC.check_opportunity)


@query
def markup_templates(spark, root):
    rows = marked_up_pages(spark, root)
    rows = join_on_hot_key(rows.drop("site_has_org"), S.sites_with_organisation(rows), ["site"], ["page_id"]).withColumn("page_type", U.page_type(F.col("url")))
    return rows.filter("best IS NOT NULL").select("page_id", PC.markup_template().alias("template")).filter("template IS NOT NULL")


# --- site rules ------------------------------------------------------------------------------------------------------------------
def probes(spark, root):
    return D.derived(spark, root, D.PROBES_SQL)


@query
def origin_consolidation(spark, root):
    return site_rows(S.origins(probes(spark, root)))


@query
def origin_variants(spark, root):
    hosts = read_pages(spark, root).select(F.split_part(F.col("url"), F.lit("/"), F.lit(3)).alias("host")).distinct()
    return S.origin_variants(hosts.select(F.col("host").alias("site"), "host", F.when(~F.col("host").rlike(r"^(blog|m)\."), F.regexp_replace("host", r"^www\.", "")).alias("registrable")))


@query
def https_check(spark, root):
    p = probes(spark, root)
    preferred = DISC.preferred_origins(p.filter("kind = 'origin'").select(F.col("site").alias("seed"), "url", "acquisition", "final_url")).select(F.col("seed").alias("site"), "preferred_origin")
    return site_rows(S.https(p, preferred))


@query
def sitemap_matrix(spark, root):
    return S.sitemap_rows(probes(spark, root)).select("site", "url", "result")


@query
def sitemap_check(spark, root):
    p = probes(spark, root)
    return site_rows(S.sitemap(p.select("site").distinct(), policy(spark, root), p))


@query
def sitemap_variants(spark, root):
    p = probes(spark, root)
    return S.sitemap_variants(S.sitemap_choice(p.select("site").distinct(), policy(spark, root), S.sitemap_rows(p))).select("site", "url", "role")


@query
def llms_state(spark, root):
    return S.llms_state(probes(spark, root)).select("site", "llms_state", "has_h1")


@query
def soft404(spark, root):
    return site_rows(S.missing_page(probes(spark, root)))


# --- performance and experience ---------------------------------------------------------------------------------------------------
@query
def field_vitals(spark, root):
    f = D.derived(spark, root, D.FIELD_SQL)
    return f.select("page_id", PC.vitals_grade(F.col("lcp_ms"), F.col("inp_ms"), F.col("cls")).alias("grade"))


@query
def field_records(spark, root):
    """SRC-4 from answers of all shapes."""
    out = field.field_records(D.derived(spark, root, D.FIELD_ANSWERS_SQL))
    texts = ["reason", "form_factor", "period_first", "period_last"]
    return out.select("page_id", "scope", "key", "available", *[F.coalesce(c, F.lit("")).alias(c) for c in texts], *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in field.METRICS], "assessment")


@query
def origin_field_check(spark, root):
    """P-4.2 with the records of whole origins."""
    answers = D.derived(spark, root, D.FIELD_ANSWERS_SQL)
    one = field.field_records(answers.filter("scope = 'ORIGIN'")).groupBy("scope", "key").agg(*[F.max(c).alias(c) for c in field.METRICS])
    sites = answers.select(F.regexp_extract("key", "^https?://[^/]+", 0).alias("site")).distinct()
    return S.origin_vitals(one, sites).select("site", "check_id", "status", F.coalesce("observed", F.lit("")).alias("observed"))


@query
def field_check(spark, root):
    f = D.derived(spark, root, D.FIELD_SQL)
    rows = crawl_states(spark, root).join(f.select("page_id", F.struct("lcp_ms", "inp_ms", "cls").alias("field")), "page_id", "left")
    return units(rows.withColumn("nodes", F.lit(None)), PC.check_field)


def lab_rows(spark, root):
    n = F.col("page_id")
    task = lambda k: F.struct((n * k % 900).cast("double").alias("start"), (n * (k + 3) % 180).cast("double").alias("duration"))
    return read_pages(spark, root).select("page_id", F.struct((n * 7 % 5000).cast("double").alias("lcp_ms"), (n * 11 % 400).cast("double").alias("fcp_ms"), (n % 6 != 0).alias("available"), F.array(task(3), task(5), task(8)).alias("long_tasks")).alias("lab"))


@query
def lab_summary(spark, root):
    states = crawl_states(spark, root)
    chosen = S.lab_pages(states).select("site", "page_id", F.lit(True).alias("lab_selected"))
    rows = states.join(lab_rows(spark, root), "page_id").join(chosen, ["site", "page_id"], "left").withColumn("nodes", F.lit(None))
    tbt = PC.blocking_time(F.col("lab")["long_tasks"], F.col("lab")["fcp_ms"])
    return units(rows, PC.check_lab).join(rows.select("page_id", tbt.alias("tbt_ms")), "page_id")


@query
def overflow_check(spark, root):
    n = F.col("page_id")
    off = lambda k: F.struct(F.concat(F.lit("div.o"), F.lit(str(k))).alias("selector"), (n * k % 300 + 412).cast("int").alias("right"), F.lit(9).alias("width"))
    o = F.when(n % 9 != 4, F.struct((n * 13 % 60 + 400).cast("int").alias("scroll_width"), F.lit(412).alias("viewport_width"), F.when(n % 4 == 1, F.array().cast("array<struct<selector:string,right:int,width:int>>")).otherwise(F.array(off(7), off(11), off(13))).alias("offenders")))
    return units(crawl_states(spark, root).withColumn("overflow", o).withColumn("nodes", F.lit(None)), PC.check_overflow)


@query
def a11y_check(spark, root):
    names = registry.A11Y_RULES
    pick = lambda m: F.filter(F.array(*[F.when(F.col("page_id") % (i + m) == 1, F.lit(r)) for i, r in enumerate(names)]), lambda x: x.isNotNull())
    a = F.when(F.col("page_id") % 8 != 3, F.struct(pick(5).alias("violations"), pick(3).alias("incomplete")))
    return units(crawl_states(spark, root).withColumn("a11y", a).withColumn("nodes", F.lit(None)), PC.check_accessibility)


# --- fetch log ---------------------------------------------------------------------------------------------------------------------
def fetch_log(spark, root):
    return D.with_events(spark, root, D.FETCH_LOG_SQL)


@query
def stop_conditions(spark, root):
    log = fetch_log(spark, root)
    return LOG.issued_requests(log, LOG.stop_points(log)).select("site", "seq", "issued", F.coalesce("stop_reason", F.lit("")).alias("stop_reason"))


@query
def politeness_gaps(spark, root):
    return LOG.gaps(fetch_log(spark, root), 3600, 60_000).select("host", "seq", "too_fast", F.coalesce(F.floor("gap_ms"), F.lit(-1)).alias("gap_ms"))


@query
def usage_counters(spark, root):
    return LOG.usage(fetch_log(spark, root), ["signup", "view", "error", "purchase", "click"])


# --- review and tree facts --------------------------------------------------------------------------------------------------------
@query
def grounding_gate(spark, root):
    supplied = read_pages(spark, root).select("page_id", F.concat(F.lit("EV-"), F.col("page_id").cast("string")).alias("evidence_id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return REV.gate(D.derived(spark, root, D.REVIEW_SQL), supplied).select("page_id", "evidence_id", "verdict")


@query
def review_budget(spark, root):
    rows = read_pages(spark, root).select("page_id", SITE.alias("site"), F.regexp_replace("html", "<[^>]*>", "").alias("text"), (F.col("page_id") % 90).alias("head_chars"))
    return REV.input_budget(rows, 9000).select("page_id", "n_pages", "room", "truncated", "used_chars")


@query
def reaudit_plan(spark, root):
    """JN-18: pages valid in both profiles are reused, all others are evaluated again."""
    now = read_pages(spark, root).select("page_id", U.fetch_key(F.col("url")).alias("fetch_key"))
    good = D.derived(spark, root, D.PREVIOUS_SQL).filter("state = 'VALID' AND raw_validity = 'VALID_PAGE' AND dom_validity = 'VALID_PAGE'").select(U.fetch_key(F.col("url")).alias("fetch_key")).distinct()
    return now.join(good, "fetch_key", "left_semi").withColumn("plan", F.lit("reuse")).unionByName(now.join(good, "fetch_key", "left_anti").withColumn("plan", F.lit("evaluate")))


def tree_facts(spark, root):
    return read_pages(spark, root).select("page_id", "url", DOM.document_facts(F.col("html"), "blocks", "method", "confidence").alias("tree"))


@query
def main_text(spark, root):
    from crawlscope.functions.text import word_count

    rows = tree_facts(spark, root)
    return rows.select("page_id", F.size("tree.blocks").alias("n_blocks"), word_count(F.array_join("tree.blocks", "\n")).alias("n_words"), F.md5(F.array_join("tree.blocks", "\n")).alias("text_md5"), "tree.method", "tree.confidence")


@query
def text_blocks(spark, root):
    return tree_facts(spark, root).select("page_id", F.posexplode("tree.blocks").alias("pos", "text")).select("page_id", "pos", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


@query
def question_answers(spark, root):
    """WIN-7 over block tables with question headings put in front of every third block."""
    blocks = tree_facts(spark, root).select("page_id", F.posexplode("tree.blocks").alias("pos", "text"))
    asked = blocks.withColumn("text", F.when(F.col("pos") % 3 == 0, F.concat(F.substring("text", 1, 30), F.lit("?"))).otherwise(F.col("text")))
    return REV.answers_by_window(asked).select("page_id", "pos", F.length("text").alias("n_chars"), F.coalesce(F.length("answer"), F.lit(-1)).alias("answer_chars"))


@query
def raw_content_check(spark, root):
    """A-5.1 and S-3.3 on the derived crawl."""
    only = ("visible_text", "json_ld", "title", "headings", "links", "images")
    rows = X.extract_profiles(DOM.profile_trees(X.genuine_documents(crawl_states(spark, root))), only)
    return units(PC.prepare_tree(rows), PC.check_main_text, PC.check_markup_visible)


@query
def content_observations(spark, root):
    facts = X.extract(read_pages(spark, root), keep=("page_id", "html"), only=("title", "h1", "headings", "author_signals", "date_signals"))
    rows = facts.withColumns({"site": SITE, "page_type": F.lit("article"), "blocks": DOM.document_facts(F.col("html"), "blocks")["blocks"]})
    return REV.observations(rows).select("site", "page_id", "area", F.md5("excerpt").alias("excerpt_md5"))


# Items and controls that only a tree shows, put into every page.
ITEMS_SQL = """
SELECT page_id, url, replace(html, '</article>', '<div itemscope itemtype="https://schema.org/Product"><b itemprop="name">Item ' || CAST(page_id AS STRING) || '</b><div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><i itemprop="price">5</i></div></div>'
  || '<div vocab="https://schema.org/" typeof="Person"><span property="name">Ann</span></div><button data-href="/go/' || CAST(page_id AS STRING) || '">Go</button><span onclick="location.href=&quot;/js&quot;">Js</span></article>') AS html
FROM pages
"""


@query
def embedded_items(spark, root):
    rows = D.derived(spark, root, ITEMS_SQL).select("page_id", F.explode(DOM.document_facts(F.col("html"), "items")["items"]).alias("i"))
    return rows.select("page_id", "i.format", "i.type", joined(F.array_sort(F.transform(F.map_entries("i.props"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))).alias("props"))


@query
def scripted_controls(spark, root):
    """EXT-19 and JN-9: script navigation whose destination no crawlable anchor of the page reaches."""
    src = D.derived(spark, root, ITEMS_SQL)
    controls = src.select("page_id", "url", F.explode(DOM.document_facts(F.col("html"), "controls")["controls"]).alias("c")).select("page_id", "url", "c.text", U.resolve_http(F.col("c.target"), F.col("url")).alias("target"))
    anchors = each(X.extract(src, only=("targets",)), ["page_id"], F.col("targets"), "target")
    own = U.alias_hosts(U.host_of(F.col("target")), U.host_of(F.col("url")))
    return controls.filter("target IS NOT NULL").filter(own).drop("url").join(anchors, ["page_id", "target"], "left_anti")


@query
def site_facts(spark, root):
    rows = S.site_facts(recorded_pages(spark, root, "generator", "hreflang"))
    return rows.select("site", F.coalesce("cms", F.lit("")).alias("cms"), "compared_pages", "has_hreflang")

