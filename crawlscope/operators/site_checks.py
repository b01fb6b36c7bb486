"""SITE and SAMPLE rules from recorded probes, policies and page rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from crawlscope.functions.sql import F

from crawlscope.functions.expr import choose
from crawlscope.functions.urls import alias_hosts, host_of, origin_of, path_and_query, url_parts
from crawlscope.operators.page_checks import SECURITY_HEADERS, vitals_grade
from crawlscope.operators.skew import best_per_group, join_on_hot_key

# Fixed value: wording of missing pages.
MISSING_WORDING = (
    r"(?i)\b(404|page (was )?not found|not found|page (does not|doesn'?t) exist|no longer (exists|available)|"
    r"couldn'?t find (that|the|this) page|can'?t be found|nothing (was )?found|error 404|oops)\b"
)


def site_unit(df: DataFrame, check: str | Column, status: Column, reason: Column | None = None, observed: Column | None = None) -> DataFrame:
    """Rows (site, page_id NULL, check_id, status, reasons, observed)."""
    none = F.lit(None).cast("string")
    codes = F.when(status.isin("FAIL", "WARN") & (reason if reason is not None else none).isNotNull(), F.array(reason if reason is not None else none)).otherwise(F.array().cast("array<string>"))
    return df.select("site", F.lit(None).cast("bigint").alias("page_id"), (F.lit(check) if isinstance(check, str) else check).alias("check_id"), status.alias("status"), codes.alias("reasons"),
                     F.lit("site probe").alias("locator"), (observed if observed is not None else none).alias("observed"), F.lit("RAW").alias("profile"), none.alias("limitation"))


def robots_answer(policy: DataFrame) -> DataFrame:
    """C-1.1."""
    state = F.col("robots_state")
    status = choose((state.isin("UNREACHABLE", "CHALLENGED", "RATE_LIMITED"), "NOT_TESTABLE"), (state == "SERVER_ERROR", "WARN"), default="PASS")
    return site_unit(policy.withColumnRenamed("origin", "site"), "C-1.1", status, F.lit("ROBOTS_SERVER_ERROR"), F.concat_ws(" ", F.lit("HTTP"), F.col("status").cast("string"), state))


def missing_page_outcome(probes: DataFrame) -> DataFrame:
    """Outcome of the nonexistent-path probe per site."""
    headline = F.concat_ws(" | ", "title", "h1")
    outcome = choose(
        (F.col("acquisition") != "OK", "NOT_TESTED"), (F.col("validity") == "ACCESS_CHALLENGE", "CHALLENGED"), (F.col("status").isin(404, 410), "CORRECT_STATUS"),
        (F.col("status") >= 500, "SERVER_ERROR"),
        ((F.col("status") == 200) & (F.col("validity") == "VALID_PAGE") & headline.rlike(MISSING_WORDING), "ERROR_CONTENT_WITH_200"),
        ((F.col("status") == 200) & (F.col("validity") == "VALID_PAGE"), "INCONCLUSIVE_200"), default="INCONCLUSIVE",
    )
    return probes.filter("kind = 'missing'").withColumn("outcome", outcome)


def missing_page(probes: DataFrame) -> DataFrame:
    """C-1.4."""
    o = F.col("outcome")
    status = choose((o == "CORRECT_STATUS", "PASS"), (o.isin("ERROR_CONTENT_WITH_200", "SERVER_ERROR"), "WARN"), default="NOT_TESTABLE")
    reason = F.when(o == "SERVER_ERROR", F.lit("MISSING_PAGE_RETURNS_5XX")).otherwise(F.lit("MISSING_PAGE_RETURNS_200"))
    return site_unit(missing_page_outcome(probes), "C-1.4", status, reason, o)


def origins(probes: DataFrame) -> DataFrame:
    """C-1.6. Probe rows per site are at most four."""
    rows = probes.filter("kind = 'origin'")
    live = (F.col("status") == 200) & (F.col("validity") == "VALID_PAGE") & F.col("final_url").isNotNull()
    g = rows.groupBy("site").agg(
        F.count_if(live).alias("live"), F.count_distinct(F.when(live, origin_of(F.col("final_url")))).alias("finals"),
        F.count_if(live & F.col("canonical").isNull()).alias("bare"), F.count_distinct(F.when(live, origin_of(F.col("canonical")))).alias("canonicals"),
    )
    coherent = (F.col("bare") == 0) & (F.col("canonicals") == 1)
    reason = choose((coherent, "DUPLICATE_ORIGINS_COHERENT_CANONICAL"), (F.col("canonicals") > 1, "DUPLICATE_ORIGINS_CONFLICTING_CANONICAL"), default="DUPLICATE_ORIGINS_NO_CANONICAL")
    status = choose((F.col("live") == 0, "NOT_TESTABLE"), (F.col("finals") == 1, "PASS"), default="WARN")
    return site_unit(g, "C-1.6", status, reason, F.format_string("%d live, %d final origins, %d canonical origins", "live", "finals", "canonicals"))


def origin_variants(sites: DataFrame) -> DataFrame:
    """Addresses to probe: both schemes on the apex/www pair, or on the host alone. Input: site, host, registrable."""
    pair = (F.col("host") == F.col("registrable")) | (F.col("host") == F.concat(F.lit("www."), F.col("registrable")))
    hosts = F.when(F.coalesce(pair, F.lit(False)), F.array(F.col("registrable"), F.concat(F.lit("www."), F.col("registrable")))).otherwise(F.array("host"))
    return sites.select("site", F.explode(F.array(F.lit("https"), F.lit("http"))).alias("scheme"), hosts.alias("hosts")).select("site", "scheme", F.explode("hosts").alias("host")).select("site", F.concat("scheme", F.lit("://"), "host", F.lit("/")).alias("url"))


def sitemap_rows(probes: DataFrame) -> DataFrame:
    """Classified sitemap endpoint rows."""
    html = F.coalesce(F.col("content_type").rlike("(?i)text/html"), F.lit(False)) | F.coalesce(F.lower(F.trim("body_prefix")).rlike(r"^<!doctype html|^<html[\s>]"), F.lit(False))
    result = choose(
        ((F.col("acquisition") != "OK") | (F.col("validity") == "ACCESS_CHALLENGE"), "INCONCLUSIVE"), ((F.col("status") == 200) & html, "INCONCLUSIVE"),
        (F.col("status") == 200, "OPEN"), (F.col("status") == 429, "INCONCLUSIVE"), default="NOT_OPEN",
    )
    return probes.filter("kind = 'sitemap'").withColumn("result", result)


def sitemap_choice(sites: DataFrame, policy: DataFrame, rows: DataFrame) -> DataFrame:
    """Chosen endpoint per site: first declared http(s) sitemap, else the first fallback path that opens."""
    web = F.filter("sitemaps", lambda s: s.rlike("(?i)^https?://"))
    declared = policy.select(F.col("origin").alias("site"), F.get(web, F.lit(0)).alias("declared"))
    secure = F.regexp_replace("site", "^http:", "https:")
    fallback = rows.filter("result = 'OPEN'").withColumn("order", F.array_position(F.array(F.concat(secure, F.lit("/sitemap.xml")), F.concat(secure, F.lit("/sitemap_index.xml"))), F.col("url"))).filter("order > 0")
    opened = fallback.groupBy("site").agg(F.min_by("url", "order").alias("fallback"))
    return sites.select("site").distinct().join(declared, "site", "left").join(opened, "site", "left").select(
        "site", F.coalesce("declared", "fallback").alias("chosen"), choose((F.col("declared").isNotNull(), "robots_declaration"), (F.col("fallback").isNotNull(), "fallback_probe"), default="none").alias("basis"),
    )


def sitemap_variants(choice: DataFrame) -> DataFrame:
    """Addresses of the endpoint matrix; an external host or an explicit port is tested exactly as declared."""
    p = url_parts(F.col("chosen"))
    host = F.regexp_replace(p["host"], r"^www\.", "")
    fixed = ~alias_hosts(p["host"], host_of(F.col("site"))) | (p["port"] != "")
    both = F.transform(F.array(F.lit("https"), F.lit("http")), lambda s: F.transform(F.array(host, F.concat(F.lit("www."), host)), lambda h: F.concat(s, F.lit("://"), h, path_and_query(F.col("chosen")))))
    urls = F.when(fixed, F.array("chosen")).otherwise(F.array_distinct(F.concat(F.array("chosen"), F.flatten(both))))
    return choice.filter("chosen IS NOT NULL").select("site", "chosen", F.explode(urls).alias("url")).withColumn("role", F.when(F.col("url") == F.col("chosen"), F.lit("main")).otherwise(F.lit("variant")))


def sitemap(sites: DataFrame, policy: DataFrame, probes: DataFrame) -> DataFrame:
    """C-1.12."""
    rows = sitemap_rows(probes)
    choice = sitemap_choice(sites, policy, rows)
    per_site = rows.groupBy("site").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("result") == "INCONCLUSIVE").alias("n_open_questions"))
    main = rows.select("site", F.col("url").alias("chosen"), F.col("result").alias("main_result"))
    joined = choice.join(per_site, "site", "left").join(main, ["site", "chosen"], "left")
    result = F.coalesce("main_result", F.lit("INCONCLUSIVE"))
    status = choose(
        (F.col("chosen").isNull() & F.coalesce(F.col("n_rows") == F.col("n_open_questions"), F.lit(True)), "NOT_TESTABLE"), (F.col("chosen").isNull(), "WARN"),
        (result == "OPEN", "PASS"), (result == "INCONCLUSIVE", "NOT_TESTABLE"), default="FAIL",
    )
    reason = F.when(F.col("chosen").isNull(), F.lit("SITEMAP_NOT_DISCOVERED")).otherwise(F.lit("DECLARED_SITEMAP_NOT_OPEN"))
    return site_unit(joined, "C-1.12", status, reason, F.concat_ws(" ", "basis", "chosen", result))


def https(probes: DataFrame, preferred: DataFrame) -> DataFrame:
    """T-8.1. `preferred`: site, preferred_origin."""
    rows = probes.filter("kind = 'origin' AND url LIKE 'https:%'")
    failed = F.col("acquisition") != "OK"
    g = rows.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count_if(~failed).alias("ok"), F.count_if(F.col("acquisition") == "TLS_ERROR").alias("tls"), F.count_if(F.col("acquisition") == "NETWORK_ERROR").alias("refused"))
    joined = preferred.select("site", "preferred_origin").join(g, "site", "left").na.fill(0, ["n", "ok", "tls", "refused"])
    secure, plain = F.coalesce(F.col("preferred_origin").startswith("https:"), F.lit(False)), F.coalesce(F.col("preferred_origin").startswith("http:"), F.lit(False))
    reason = choose(
        ((F.col("ok") > 0) & secure, None), (F.col("tls") > 0, "TLS_CERTIFICATE_ERROR"), ((F.col("ok") > 0) & plain, "HTTPS_NOT_PREFERRED"),
        (plain & (F.col("n") > 0) & (F.col("refused") == F.col("n")), "NO_HTTPS"),
    )
    status = choose((F.col("n") == 0, "NOT_TESTABLE"), ((F.col("ok") > 0) & secure, "PASS"), (reason == "HTTPS_NOT_PREFERRED", "WARN"), (reason.isNotNull(), "FAIL"), default="NOT_TESTABLE")
    return site_unit(joined, "T-8.1", status, reason, F.format_string("%d of %d HTTPS variants answered", "ok", "n"))


def first_answers(pages: DataFrame) -> DataFrame:
    """First page per site (lowest page id) that answered 200, with its response headers."""
    ok = pages.filter("acquisition = 'OK' AND status = 200")
    return ok.groupBy("site").agg(F.min_by("headers", "page_id").alias("headers"), F.min("page_id").alias("first_page"))


def missing_headers(headers: Column) -> Column:
    return F.array_except(F.array(*[F.lit(h) for h in SECURITY_HEADERS]), F.map_keys(headers))


def security_headers(pages: DataFrame) -> DataFrame:
    """T-8.3."""
    sites = pages.select("site").distinct().join(first_answers(pages), "site", "left")
    return site_unit(sites, "T-8.3", F.when(F.col("headers").isNull(), F.lit("NOT_TESTABLE")).otherwise(F.lit("PASS")), None, F.concat(F.lit("absent: "), F.array_join(missing_headers(F.col("headers")), ", ")))


def llms_state(probes: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("content_type").rlike("(?i)text/html"), F.lit(False)) | F.coalesce(F.lower(F.trim("body_prefix")).rlike(r"^<!doctype html|^<html[\s>]"), F.lit(False))
    state = choose(
        (F.col("acquisition") != "OK", "UNAVAILABLE"), (F.col("validity") == "ACCESS_CHALLENGE", "CHALLENGE"), (F.col("status").isin(404, 410), "ABSENT"),
        ((F.col("status") == 200) & html, "HTML_FALLBACK"), ((F.col("status") == 200) & (F.coalesce(F.trim("body_prefix"), F.lit("")) != ""), "PRESENT_TEXT"), default="UNAVAILABLE",
    )
    return probes.filter("kind = 'llms'").withColumn("llms_state", state).withColumn("has_h1", F.coalesce(F.col("body_prefix").rlike(r"(?m)^#\s+\S"), F.lit(False)))


def llms(probes: DataFrame) -> DataFrame:
    """X-9.1."""
    s = F.col("llms_state")
    return site_unit(llms_state(probes), "X-9.1", choose((s == "PRESENT_TEXT", "PASS"), (s.isin("ABSENT", "HTML_FALLBACK"), "NOT_APPLICABLE"), default="NOT_TESTABLE"), None, s)


def blocked_links(sites: DataFrame, counts: DataFrame) -> DataFrame:
    """C-1.11."""
    joined = sites.select("site").distinct().join(counts, "site", "left")
    n = F.coalesce("n_blocked", F.lit(0))
    return site_unit(joined, "C-1.11", F.when(n > 0, F.lit("WARN")).otherwise(F.lit("NOT_APPLICABLE")), F.lit("DISCOVERED_LINKS_BLOCKED_FOR_GOOGLEBOT"), F.format_string("%d discovered links closed to Googlebot", n))


def other_tokens(decided: DataFrame, tokens: list[str]) -> DataFrame:
    """A-5.4 from the first page of each site."""
    first = decided.groupBy("site").agg(F.min_by("decisions", "page_id").alias("decisions"))
    words = F.array(*[F.coalesce(F.col("decisions")[t]["decision"], F.lit("UNKNOWN")) for t in tokens])
    unknown = F.forall(words, lambda w: w == "UNKNOWN")
    return site_unit(first, "A-5.4", F.when(unknown, F.lit("NOT_TESTABLE")).otherwise(F.lit("PASS")), None, F.array_join(F.transform(F.arrays_zip(F.array(*[F.lit(t) for t in tokens]).alias("t"), words.alias("w")), lambda z: F.concat(z["t"], F.lit(": "), z["w"])), " | "))


def origin_vitals(field: DataFrame, sites: DataFrame) -> DataFrame:
    """P-4.2. `field`: scope, key, lcp_ms, inp_ms, cls."""
    rows = field.filter("scope = 'ORIGIN'").select(F.col("key").alias("site"), vitals_grade(F.col("lcp_ms"), F.col("inp_ms"), F.col("cls")).alias("grade"))
    joined = sites.select("site").distinct().join(rows, "site", "left")
    known = F.coalesce(F.col("grade") != "UNAVAILABLE", F.lit(False))
    return site_unit(joined, "P-4.2", F.when(known, F.lit("PASS")).otherwise(F.lit("NOT_TESTABLE")), None, F.col("grade"))


def link_targets(per_site: DataFrame) -> DataFrame:
    """O-2.6 from the outcome counts per site. Two findings may hold at once."""
    b, r = F.col("broken") > 0, F.col("redirected") > 0
    status = choose((F.col("targets") == 0, "NOT_APPLICABLE"), (F.col("tested") == 0, "NOT_TESTABLE"), (b, "FAIL"), (r, "WARN"), default="PASS")
    unit = site_unit(per_site, "O-2.6", status, None, F.format_string("%d of %d targets tested, %d broken, %d redirected", "tested", "targets", "broken", "redirected"))
    codes = per_site.select("site", F.filter(F.array(F.when(b, F.lit("BROKEN_INTERNAL_LINK_TARGET")), F.when(r, F.lit("INTERNAL_LINK_REDIRECTS"))), lambda c: c.isNotNull()).alias("_codes"))
    return unit.join(codes, "site").withColumn("reasons", F.when(F.col("status").isin("FAIL", "WARN"), F.col("_codes")).otherwise(F.col("reasons"))).drop("_codes")


def duplicates(pages: DataFrame) -> DataFrame:
    """Values of title and description that several pages of a site share. Input: site, page_id, title, meta_description."""
    fields = F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("value")), F.struct(F.lit("meta_description").alias("field"), F.col("meta_description").alias("value")))
    long = pages.select("site", "page_id", F.explode(fields).alias("f")).select("site", "page_id", "f.*").filter("value IS NOT NULL AND value <> ''")
    return long.groupBy("site", "field", "value").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page_id").alias("first_page")).filter("n_pages >= 2")


def pages_of_duplicates(pages: DataFrame) -> DataFrame:
    """O-2.4: every page that shares a value, with the reason."""
    fields = F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("value")), F.struct(F.lit("meta_description").alias("field"), F.col("meta_description").alias("value")))
    long = pages.select("site", "page_id", F.explode(fields).alias("f")).select("site", "page_id", "f.*")
    rows = join_on_hot_key(long, duplicates(pages).select("site", "field", "value"), ["site", "field", "value"], ["page_id"], "inner")  # a title may be that of a third of all pages
    code = F.when(F.col("field") == "title", F.lit("DUPLICATE_TITLE_IN_SAMPLE")).otherwise(F.lit("DUPLICATE_DESCRIPTION_IN_SAMPLE"))
    return rows.select("site", F.lit("O-2.4").alias("check_id"), code.alias("reason_code"), "page_id").distinct()


def duplicate_units(pages: DataFrame, dups: DataFrame) -> DataFrame:
    """O-2.4, one unit per site. `pages`: a row a page, or a row a site with their number `n`."""
    sizes = pages.select("site", "n") if "n" in pages.columns else pages.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    found = dups.groupBy("site").agg(F.count_if(F.col("field") == "title").alias("titles"), F.count_if(F.col("field") != "title").alias("descriptions"))
    joined = sizes.join(found, "site", "left").na.fill(0, ["titles", "descriptions"])
    t, d = F.col("titles") > 0, F.col("descriptions") > 0
    unit = site_unit(joined, "O-2.4", choose((F.col("n") < 2, "NOT_APPLICABLE"), (t | d, "WARN"), default="PASS"), None, F.format_string("%d shared titles, %d shared descriptions among %d pages", "titles", "descriptions", "n"))
    codes = joined.select("site", F.filter(F.array(F.when(t, F.lit("DUPLICATE_TITLE_IN_SAMPLE")), F.when(d, F.lit("DUPLICATE_DESCRIPTION_IN_SAMPLE"))), lambda c: c.isNotNull()).alias("_codes"))
    return unit.join(codes, "site").withColumn("reasons", F.when(F.col("status") == "WARN", F.col("_codes")).otherwise(F.col("reasons"))).drop("_codes")


def lab_pages(pages: DataFrame, k: int = 3) -> DataFrame:
    """First k rendered-valid pages per site; the others are not applicable."""
    return best_per_group(pages.filter("ren_valid").select("site", "page_id"), ["site"], [F.col("page_id")], k, "lab_no")


def sites_with_organisation(pages: DataFrame) -> DataFrame:
    org = F.exists("nodes", lambda n: F.coalesce(n["feature"].isin("Organization", "Local business"), F.lit(False)))
    return pages.groupBy("site").agg(F.bool_or(F.coalesce(org, F.lit(False))).alias("site_has_org"))


def site_facts(pages: DataFrame) -> DataFrame:
    """Generator, number of compared pages and hreflang presence per site."""
    return pages.groupBy("site").agg(
        F.min_by(F.col("raw_facts")["generator"], F.when(F.col("raw_valid"), F.col("page_id"))).alias("cms"),
        F.count_if(F.col("raw_valid") & F.col("ren_valid")).alias("compared_pages"),
        F.coalesce(F.bool_or((F.size(F.col("raw_facts")["hreflang"]) > 0) | (F.size(F.col("dom_facts")["hreflang"]) > 0)), F.lit(False)).alias("has_hreflang"),
    )
