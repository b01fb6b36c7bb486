"""What keeps the cost of a query with its input: one evaluation per document."""

import re

from crawlscope.operators import gates
from crawlscope.plans import catalog_crawl, catalog_tables
from pyspark.sql import functions as P

ROOT = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_states_of_stopped_runs_are_found_once(spark):
    assert "challenge-form" not in plan(catalog_tables.stopped_runs(spark, ROOT))  # only the written states are read


def test_challenge_signals_keep_their_rules(spark):
    nav = "<nav>x</nav>"
    rows = [
        ("tag", f'<html><body>{nav}<div class="CF-Turnstile"></div>'), ("split", f'<html><body>{nav}<i id="px-cap<!-- x -->tcha">'), ("form", f'<body>{nav}<form action="/CHALLENGE">'),
        ("word", "<title>Just a moment</title><body>wait"), ("chrome", f"<title>Just a moment</title><body>{nav}wait"), ("script", f"<body>{nav}<script>captcha-form</script>"),
        ("links", "<title>Just a moment</title><body>" + '<a href="/x">x</a>' * 5), ("text", "<body>" + "w " * 100 + "security check"), ("long", "<body>" + "w " * 130 + "security check"), ("none", None),
    ]
    df = spark.createDataFrame(rows, "name string, html string")
    found = {r.name: r.n for r in df.select("name", P.size(gates.challenge_evidence(P.col("html"), None)).alias("n")).collect()}
    assert found == {"tag": 1, "split": 1, "form": 1, "word": 1, "chrome": 0, "script": 0, "links": 0, "text": 1, "long": 0, "none": 0}


def test_comparison_reads_genuine_documents_alone(spark):
    text = plan(catalog_crawl.profile_comparison(spark, ROOT))
    assert re.search(r"CASE WHEN raw_valid#\d+ THEN html#\d+ END", text) and re.search(r"CASE WHEN ren_valid#\d+ THEN dom#\d+ END", text)


def test_markup_rules_read_the_best_document_alone(spark):
    text = plan(catalog_crawl.jsonld_checks(spark, ROOT))
    assert "raw_facts" not in text and "dom_facts" not in text


def test_verified_candidates_need_no_sample(spark, monkeypatch):
    rows = spark.createDataFrame([("s", "u", "verified", "u", "/")], "site string, url string, verification string, final_key string, signature string")
    monkeypatch.setattr(catalog_crawl, "candidates", lambda *_: (None, rows), raising=False)
    monkeypatch.setattr(catalog_crawl.DISC, "sample", None)
    assert catalog_crawl.candidate_verification(spark, ROOT).count() == 1


def test_blocked_links_match_written_targets(spark):
    assert "<!--" not in plan(catalog_tables.blocked_links(spark, ROOT))  # documents are read once, before the robots rules


ODD = [
    "/abs", "rel/a.html", "../up/./x", "?k=1", "//cdn.example/x", "#frag", "", "HTTP://Mixed.EXAMPLE:80/A b", "https://u@h.example:8443/p?q=1#f", "mailto:x@y.example", "/für/Straße",
    "https://[bad/", "https:/one", "ftp://f.example/a", "\\\\share\\x", " /a\tb ", "javascript:go()", "https://www.site.example", "https://[::1]:443/x", "a:b",
]


def test_links_are_resolved_as_one_reference(spark):
    from crawlscope.functions import urls as U

    rows = spark.createDataFrame([(h, b) for h in ODD for b in ("https://site.example:444/d/e.html?z=1", "https://site.example", "junk", None)], "href string, base string")
    found = rows.select("href", "base", U.resolve(P.col("href"), P.col("base")).alias("url"), U.resolve_with_host(P.col("href"), U.url_parts(P.col("base"))).alias("r"))
    found = found.select("*", P.when(P.col("url").rlike("^https?://"), U.host_of(P.col("url"))).alias("host"))
    assert found.filter("NOT (url <=> r.url) OR NOT (host <=> r.host)").collect() == []


def test_targets_are_those_of_the_links(spark):
    from crawlscope.operators import facts

    html = "<base href='/in/'>" + "".join(f'<nav><a href="{h}">x</a></nav>' for h in ODD) + "<a title='<a href=/no>' href=/late>z</a><a>none</a><a href=/bare>y</a><a href='/cut"
    pages = spark.createDataFrame([(1, "https://site.example/p", html), (2, "https://site.example/q", "no links"), (3, "https://site.example/r", None)], "page_id bigint, url string, html string")
    row = {r.page_id: r for r in facts.extract(pages, only=("links", "targets")).collect()}
    assert row[1].targets == list(dict.fromkeys(x.url for x in row[1].links if x.crawlable)) and len(row[1].targets) > 8
    assert row[2].targets == [] and row[3].targets is None


def test_controls_need_no_other_fact(spark):
    text = plan(catalog_crawl.scripted_controls(spark, ROOT))
    assert "href_raw" not in text and "blocks" not in text


HEADERS = {"content-type": "text/html", "link": '<https://s.example/h>; rel="canonical", <https://s.example/it>; rel="alternate"; hreflang="it"', "x-robots-tag": "noindex"}
DOCUMENT = '<html><head><title>T</title><link rel="canonical" href="/c"><link rel="alternate" hreflang="en" href="/en"></head><body><nav><a href="x">x</a></nav></body></html>'


def recorded(spark):
    """Page 1 as rendered, 2 rendered elsewhere, 3 changed, 4 an error page, 5 not rendered, 6 challenged by header."""
    u = "https://s.example/a/"
    rows = [
        (1, u, DOCUMENT, DOCUMENT, 200, "OK", 200, "OK", u, u, HEADERS), (2, u, DOCUMENT, DOCUMENT, 200, "OK", 200, "OK", u, "https://s.example/b/", HEADERS),
        (3, u, DOCUMENT, DOCUMENT.replace("T<", "U<"), 200, "OK", None, "OK", u, u, HEADERS), (4, u, DOCUMENT, DOCUMENT, 404, "OK", 200, "OK", u, u, HEADERS),
        (5, u, DOCUMENT, DOCUMENT, 200, "OK", None, "RENDER_FAILED", u, None, HEADERS), (6, u, DOCUMENT, DOCUMENT, 200, "OK", 200, "OK", u, u, {**HEADERS, "cf-mitigated": "challenge"}),
    ]
    return spark.createDataFrame(rows, "page_id int, url string, html string, dom string, status int, acquisition string, dom_status int, dom_acquisition string, final_url string, dom_url string, headers map<string,string>")


def test_equal_documents_are_read_once_with_the_same_facts(spark):
    from crawlscope.operators import facts

    rows = gates.with_validity(recorded(spark))
    kept = {r.page_id: r for r in facts.genuine_documents(rows).collect()}
    assert {k: (r.html is not None, r.dom is not None, r._same) for k, r in kept.items()} == {
        1: (True, False, True), 2: (True, True, False), 3: (True, True, False), 4: (False, True, False), 5: (True, False, False), 6: (False, True, False)}
    once = {r.page_id: r for r in facts.extract_profiles(facts.genuine_documents(rows), plus=("insecure",)).collect()}
    twice = {r.page_id: r for r in facts.extract_into(facts.extract_into(rows, "raw_facts", "html", "final_url", "headers", None, ("insecure",)), "dom_facts", "dom", "dom_url", None, None, ("insecure",)).collect()}
    assert all(once[k].raw_facts == twice[k].raw_facts for k in (1, 2, 3, 5)) and all(once[k].dom_facts == twice[k].dom_facts for k in (1, 2, 3, 4, 6))
    assert once[1].raw_facts.x_robots == ["noindex"] and once[1].dom_facts.x_robots == [] and len(once[1].dom_facts.hreflang) == 1


def test_signals_of_equal_documents_are_found_once(spark):
    rows = gates.with_validity(recorded(spark))
    assert [(r.raw_validity, r.dom_validity) for r in rows.orderBy("page_id").collect()] == [("VALID_PAGE", "VALID_PAGE")] * 3 + [("ERROR_DOCUMENT", "VALID_PAGE"), ("VALID_PAGE", None), ("ACCESS_CHALLENGE", "VALID_PAGE")]
    assert re.search(r"CASE WHEN .*html#\d+ = dom#\d+", plan(rows))


def test_comparisons_see_nothing_of_other_documents(spark):
    from crawlscope.plans import audit

    crawl = recorded(spark).withColumn("site", P.lit("https://s.example")).withColumn("hops", P.array().cast("array<struct<url:string,status:int,location:string>>"))
    units = audit.page_checks.evaluate(audit.prepared_pages(audit.Inputs(crawl=crawl))).filter("check_id IN ('A-5.1', 'A-5.2', 'A-5.5')")
    seen = {(r.page_id, r.observed is not None) for r in units.collect()}
    assert seen == {(1, True), (2, True), (3, True), (4, False), (5, False), (6, False)}
