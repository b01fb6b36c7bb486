"""Skew helpers, scores, sample, tree facts, logs, review, sinks and streaming."""

import json

import pytest

from crawlscope import registry
from crawlscope.operators import discovery as DISC
from crawlscope.operators import dom, facts, gates
from crawlscope.operators import logs as LOG
from crawlscope.operators import results as R
from crawlscope.operators import review as REV
from crawlscope.operators import skew
from crawlscope.sources import decoding, sinks
from pyspark.sql import Window
from pyspark.sql import functions as P


def test_hot_key_join_equals_plain_join(spark):
    big = spark.range(3000).select(P.col("id"), P.when(P.col("id") % 3 == 0, P.lit("hot")).otherwise(P.concat(P.lit("k"), (P.col("id") % 50).cast("string"))).alias("k"))
    small = big.select("k").distinct().withColumn("v", P.length("k"))
    hot = skew.heavy_keys(big, ["k"], share=4, floor=10)
    assert [r.k for r in hot.collect()] == ["hot"]
    a = skew.join_on_hot_key(big, small, ["k"], ["id"], "left", hot, 7)
    assert sorted(a.select("id", "v").collect()) == sorted(big.join(small, "k", "left").select("id", "v").collect())


def test_numbering_equals_row_number(spark):
    df = spark.range(1000).select((P.col("id") % 3).alias("g"), (P.col("id") * 7919 % 1000).alias("x"))
    got = skew.numbered(df, ["g"], P.floor(P.col("x") / 40), [P.col("x")])
    want = df.withColumn("seq", P.row_number().over(Window.partitionBy("g").orderBy("x")))
    assert sorted(got.select("g", "x", "seq").collect()) == sorted(want.select("g", "x", "seq").collect())


def units(spark, rows):
    data = [("s", p, c, st, r, "seen", "RAW", None, "l") for c, p, st, r in rows]
    return spark.createDataFrame(data, "site string, page_id bigint, check_id string, status string, reasons array<string>, observed string, profile string, limitation string, locator string")


def test_scores_by_hand(spark):
    u = units(spark, [("C-1.2", 1, "PASS", []), ("C-1.2", 2, "FAIL", ["GOOGLEBOT_DISALLOWED"]), ("C-1.3", 1, "PASS", []), ("O-2.1", 1, "WARN", []), ("O-2.2", 1, "NOT_TESTABLE", []), ("O-2.3", 1, "NOT_APPLICABLE", [])])
    per_cat = R.category_scores(R.check_scores(u, registry.rules(spark)), registry.categories(spark))
    got = {r.bucket: r.category_score for r in per_cat.collect()}
    assert got == {"crawl_indexing": 75.0, "onpage_links": 50.0}
    valid = spark.createDataFrame([("s", 1)], "site string, valid bigint")
    s = R.site_scores(per_cat, valid).first()
    assert (s.value, s.suppressed, s.coverage_pct) == (66, None, 80.0)


def test_issue_order_and_relation(spark):
    u = units(spark, [("C-1.8", 1, "FAIL", ["UNEXPECTED_NOINDEX"]), ("C-1.8", 2, "FAIL", ["UNEXPECTED_NOINDEX"]), ("O-2.2", 1, "WARN", ["META_DESCRIPTION_MISSING"]), ("U-7.1", 3, "FAIL", ["VIEWPORT_META_MISSING"])])
    found = R.findings_of(u, registry.reasons(spark), registry.rules(spark))
    issues = R.root_issues(found)
    assert [(r.issue_id, r.reason_code, r.n_pages) for r in issues.orderBy("issue_no").collect()] == [("I-001", "UNEXPECTED_NOINDEX", 2), ("I-002", "VIEWPORT_META_MISSING", 1), ("I-003", "META_DESCRIPTION_MISSING", 1)]
    assert [(r.issue_id, r.related_issue_id) for r in R.related_issues(found, issues).collect()] == [("I-003", "I-001")]
    assert R.contract_violations(found, registry.reasons(spark), registry.sources(spark)).count() == 0


def test_sample_follows_plan(spark):
    def row(url, kind, sig, zone=1, depth=1):
        return ("s", url, zone, registry_rank(kind), depth, kind, sig, None, "verified", url)

    registry_rank = lambda k: ["homepage", "service", "product", "pricing", "category_hub", "article", "author", "about", "contact", "other"].index(k) + 1
    rows = [row("s/a1", "article", "/a/*"), row("s/a2", "article", "/a/*"), row("s/p", "pricing", "/p"), row("s/v1", "service", "/v/*"), row("s/v2", "service", "/v/*"), row("s/w", "service", "/w"), row("s/x", "other", "/x")]
    c = spark.createDataFrame(rows, "site string, url string, zone_rank int, type_rank int, depth int, page_type string, signature string, excluded string, verification string, final_key string")
    homes = spark.createDataFrame([("s", "s/")], "site string, home_key string")
    got = [(r.url, r.reason) for r in DISC.sample(c, homes).orderBy("slot").collect()]
    assert got == [("s/", "homepage"), ("s/v1", "service"), ("s/w", "service"), ("s/p", "pricing"), ("s/a1", "article"), ("s/x", "distinct group"), ("s/v2", "second page"), ("s/a2", "second page")]
    assert DISC.sample(c, homes, size=3).count() == 3


@pytest.mark.parametrize("html,method,confidence,n", [
    ("<body><header>h</header><main><p>" + "word " * 60 + "</p><nav>x</nav></main></body>", "landmark:main", "high", 1),
    ("<body><header>top</header><div><p>one</p><p>two<br>three</p></div><footer>f</footer></body>", "body", "medium", 3),
    ("<body><article>a</article><div>" + "text " * 200 + "</div></body>", "body (landmark nearly empty)", "low", 2),
    ("<body><p hidden>no</p><script>var a='<p>'</script><p>yes</p></body>", "body", "medium", 1),
])
def test_main_text(html, method, confidence, n):
    r = dom.read_document(html)
    assert (r["method"], r["confidence"], len(r["blocks"])) == (method, confidence, n)


def test_items_and_controls():
    r = dom.read_document('<div itemscope itemtype="https://schema.org/Product"><b itemprop="name">X</b><p itemprop="brand" itemscope itemtype="https://schema.org/Brand"><i itemprop="name">B</i></p></div><a href="/q"><span data-href="/q">in</span></a><button onclick="location.href=\'/z\'">Z</button>')
    assert r["items"] == [{"format": "Microdata", "type": "Product", "props": {"name": "X", "brand": "@Brand"}}]
    assert r["controls"] == [{"text": "Z", "target": "/z"}]


def test_stop_points_and_gaps(spark):
    rows = [("s", "h", i, f"u{i % 4}", 429 if i in (3, 7) else 200, i in (1, 2, 5), f"2024-01-01 00:{59 if i < 5 else 0:02d}:{i:02d}") for i in range(1, 10)]
    log = spark.createDataFrame(rows, "site string, host string, seq int, url string, status int, challenged boolean, started_at string").withColumn("started_at", P.col("started_at").cast("timestamp"))
    stop = LOG.stop_points(log).first()
    assert (stop.stop_seq, stop.stop_reason) == (7, "RATE_LIMITED")
    want = log.withColumn("w", P.lag("started_at").over(Window.partitionBy("host").orderBy("started_at", "seq"))).select("seq", ((P.unix_micros("started_at") - P.unix_micros("w")) / 1000).alias("gap_ms"))
    assert sorted(LOG.gaps(log, 600).select("seq", "gap_ms").collect(), key=str) == sorted(want.collect(), key=str)


def test_review_gate(spark):
    rows = spark.createDataFrame([(1, "E1", "Some  text", "fine", "ok"), (9, "E1", "x", "a", "b"), (1, "E2", "some", "a", "b"), (1, "E1", "absent words", "a", "b"), (1, "E1", "some text", "see www.x.example", "b"), (1, "E1", "some text", "up 20%", "b")], "page_id bigint, evidence_id string, excerpt string, observation string, suggestion string")
    given = spark.createDataFrame([(1, "E1", "here is some text indeed")], "page_id bigint, evidence_id string, text string")
    assert sorted(r.verdict for r in REV.gate(rows, given).collect()) == sorted(["ACCEPTED", "UNKNOWN_PAGE", "UNKNOWN_EVIDENCE", "EXCERPT_NOT_FOUND", "CONTAINS_URL", "INVENTED_METRIC"])


def test_decode_body(spark):
    rows = [(bytearray("é".encode("cp1252")), "text/html; charset=windows-1252"), (bytearray("é".encode()), None), (bytearray(b'<meta charset="koi8-r">' + "да".encode("koi8-r")), "text/html"), (bytearray(b"\xff"), "text/html; charset=utf-8")]
    df = spark.createDataFrame(rows, "b binary, t string")
    got = [r[0] for r in df.select(decoding.decode_body(P.col("b"), P.col("t"))).collect()]
    assert got == ["é", "é", '<meta charset="koi8-r">да', "�"]


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("s", i, f"u{i}", "VALID") for i in range(20)], "site string, page_id bigint, url string, state string")
    u = units(spark, [("O-2.1", i, "PASS", []) for i in range(20)])
    issues = spark.createDataFrame([("s", "I-001", "X", "LOW", 3)], "site string, issue_id string, reason_code string, severity string, n_pages bigint")
    scores = spark.createDataFrame([("s", "technical_health", 70, None)], "site string, score string, value bigint, suppressed string")
    docs = [json.loads(r.value) for r in sinks.site_documents(pages, issues, scores, u, size=8).orderBy("part").collect()]
    assert [len(d["pages"]) for d in docs] == [8, 8, 4] and [len(d["checks"]) for d in docs] == [8, 8, 4] and docs[0]["root_issues"][0]["issue_id"] == "I-001"
    assert [p["page_id"] for d in docs for p in d["pages"]] == list(range(20)) and "scores" not in docs[1] and {d["n_parts"] for d in docs} == {3}
    for run in ("a", "b", "a"):
        sinks.write_results({"check_results": u}, str(tmp_path), run)
    assert spark.read.parquet(f"{tmp_path}/check_results").groupBy("run_id").count().orderBy("run_id").collect() == [("a", 20), ("b", 20)]
    runs = spark.createDataFrame([("t1", "a", "2024-01-01", 1), ("t2", "b", "2024-01-02", 1)], "tenant_id string, audit_id string, updated_at string, version int")
    new = spark.createDataFrame([("t1", "a", "2024-01-03", 2)], "tenant_id string, audit_id string, updated_at string, version int")
    latest = sinks.latest_runs(runs, new)
    assert [r.version for r in sinks.for_tenant(latest, "t1").collect()] == [2]


def test_hot_site_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(40_000).select(P.when(P.col("id") % 10 < 9, P.lit("hot")).otherwise(P.concat(P.lit("s"), (P.col("id") % 100).cast("string"))).alias("site"), "id", P.sha2(P.col("id").cast("string"), 256).alias("x"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        sinks.write_results({"rows": rows.repartition(16)}, str(tmp_path), "r")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = spark.read.parquet(f"{tmp_path}/rows").groupBy("site", P.input_file_name().alias("f")).count()
    per_site = {r.site: r.n for r in files.groupBy("site").agg(P.count("*").alias("n")).collect()}
    others = sorted(n for s, n in per_site.items() if s != "hot")  # one may share the hot site's bucket
    assert per_site["hot"] >= 4 and others[len(others) // 2] == 1 and files.select("f").distinct().count() <= 64
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 40_000


def test_numbers_of_outlying_and_hashed_ids(spark):
    ids = [*range(3000), 1 << 62, -(1 << 62)]
    rows = [(f"s{i % 2}", 1 + i % 3, (i * 0x9E3779B97F4A7C15 % (1 << 63)) if i % 2 else i, "R") for i in ids] + [("s0", 1, None, "R")]
    df = spark.createDataFrame(rows, "site string, check_no int, page_id bigint, reason_code string")
    most = R.bucketed(df, 16).groupBy("check_no", "_at").count().agg(P.max("count")).first()[0]
    assert most <= 2 * len(rows) / (3 * 16)
    want = df.withColumn("finding_no", P.row_number().over(Window.partitionBy("site").orderBy("check_no", "page_id", "reason_code")))
    got = R.finding_ids(df, 16).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_broken_units_become_errors(spark):
    from pyspark.sql import Observation

    u = units(spark, [("C-1.2", 1, "FAIL", ["GOOGLEBOT_DISALLOWED"]), ("C-1.2", 2, "FAIL", ["O_NO"]), ("Q-1", 3, "PASS", []), ("C-1.3", 4, "PASS", []), ("C-1.3", 5, "NOT_APPLICABLE", ["O_NO"]), ("O-2.1", 6, "ERROR", [])])
    u = u.withColumn("observed", P.when(P.col("page_id") != 4, P.col("observed")))
    watch = Observation("w")
    got = {r.page_id: (r.status, r.note) for r in R.guarded(u, registry.rules(spark), registry.reasons(spark), registry.sources(spark), watch).collect()}
    assert got == {1: ("FAIL", None), 2: ("ERROR", "UNKNOWN_REASON: O_NO"), 3: ("ERROR", "UNKNOWN_CHECK: Q-1"), 4: ("ERROR", "PASS_WITHOUT_EVIDENCE"), 5: ("NOT_APPLICABLE", None), 6: ("ERROR", None)}
    assert watch.get == {"units": 6, "broken": 3, "errors": 1}


def test_streaming_skips_seen_pages(spark, tmp_path):
    from crawlscope.streaming import incremental as INC

    doc = "<!DOCTYPE html><html><head><title>T</title></head><body><h1>H</h1></body></html>"
    row = lambda i, u: (i, "s", u, doc, doc, 200, "OK", 200, "OK", [], {"content-type": "text/html"}, u, u)
    schema = INC.LANDING_SCHEMA.replace(", crawled_at timestamp", "")
    landing, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for batch in ([row(1, "https://s.example/a"), row(2, "https://s.example/b")], [row(3, "https://s.example/a#x"), row(4, "https://s.example/c")]):
        spark.createDataFrame(batch, schema).withColumn("crawled_at", P.lit("2024-01-01 00:00:00").cast("timestamp")).write.mode("append").parquet(landing)
        INC.start_units(INC.read_landing(spark, landing), out, check).awaitTermination()
    saved = spark.read.parquet(f"{out}/units")
    assert sorted({r.page_id for r in saved.select("page_id").collect()}) == [1, 2, 4]
    assert {(r.check_id, r.status) for r in saved.filter("page_id = 1").collect()} >= {("O-2.1", "PASS"), ("O-2.2", "WARN"), ("U-7.1", "FAIL")}


def test_nested_properties_have_dotted_names():
    r = dom.read_document('<div itemscope itemtype="https://schema.org/Product"><b itemprop="name">N</b><div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><i itemprop="price">5</i><p itemprop="seller" itemscope><i itemprop="name">S</i></p></div></div>')
    assert r["item_paths"] == [{"offers.price": "5", "offers.seller": "@", "offers.seller.name": "S"}]


def test_every_link_and_heading_is_kept(spark):
    html = "<html><body>" + "".join(f'<h2>t{i}</h2><a href="/p{i}">{"x" * 200}{i}</a>' for i in range(5000)) + "</body></html>"
    got = facts.extract(spark.createDataFrame([(1, "https://a.example/", html)], "page_id long, url string, html string"), only=("links", "headings")).first()
    assert len(got.links) == 5000 and len(got.headings) == 5000 and got.links[4999].text.endswith("4999")


def test_header_names_are_lowered(spark):
    df = spark.createDataFrame([({"X-Robots-Tag": "noindex", "x-robots-tag": "nofollow", "Link": "<a>"},)], "headers map<string,string>")
    assert df.select(gates.lowered_headers(P.col("headers")).alias("h")).first().h == {"x-robots-tag": "noindex\nnofollow", "link": "<a>"}


def test_audit_joins_and_site_units(spark):
    from crawlscope.plans import audit

    page = "<html><head><title>t</title></head><body><main><h1>h</h1><p>" + "text " * 80 + '</p><a href="next">n</a></main></body></html>'
    rows = [(i, f"https://s{i % 2}.example", f"https://s{i % 2}.example/old/{i}", page, page, 200, "OK", 200, "OK", [], {"Content-Type": "text/html"}, f"https://s{i % 2}.example/new/dir/{i}", None) for i in range(4)]
    schema = "page_id long, site string, url string, html string, dom string, status int, acquisition string, dom_status int, dom_acquisition string, hops array<struct<url:string,status:int,location:string>>, headers map<string,string>, final_url string, dom_url string"
    crawl = spark.createDataFrame(rows, schema)
    field = spark.createDataFrame([("URL", rows[0][11], 1000.0, 100.0, 0.05), ("URL", rows[0][11], 900.0, 90.0, 0.04)], "scope string, key string, lcp_ms double, inp_ms double, cls double")
    settings = spark.createDataFrame([("https://s0.example", "search_ai_discovery", "production", False, ["/old/2"])], "site string, goal string, environment string, multilingual boolean, intentional_restrictions array<string>")
    tables = audit.run_audit(spark, audit.Inputs(crawl=crawl, field=field, settings=settings))
    units = tables["check_results"]
    assert units.filter("page_id IS NOT NULL").groupBy("page_id", "check_id").count().filter("count > 1").count() == 0
    site = {(r.site, r.check_id): r.status for r in units.filter("page_id IS NULL").collect()}
    assert all(site[s, c] == "NOT_TESTABLE" for s in ("https://s0.example", "https://s1.example") for c in ("C-1.1", "C-1.4", "C-1.6", "X-9.1", "T-8.1", "C-1.12"))
    assert site["https://s0.example", "C-1.11"] == "NOT_APPLICABLE"
    status = {r.page_id: r.status for r in units.filter("check_id = 'C-1.10'").collect()}
    assert status[2] == "NOT_APPLICABLE" and status[1] != "NOT_APPLICABLE"
    issue = tables["root_issues"].filter("reason_code = 'DUPLICATE_TITLE_IN_SAMPLE'").collect()
    assert {r.n_pages for r in issue} == {2}
    assert tables["issue_pages"].filter("reason_code = 'DUPLICATE_TITLE_IN_SAMPLE'").count() == 4
