"""The whole audit as one job: crawl tables in, result tables out, for all sites at once.

Page facts are extracted once and written out; everything after that reads narrow columns. Page rules are one
projection; the joins before it (robots, settings, canonical and hreflang targets) move a few columns per page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as P

from crawlscope import registry
from crawlscope.functions.expr import let
from crawlscope.functions.sql import F
from crawlscope.functions.urls import alias_hosts, exclusion_reason, host_of, page_type, resolve_http
from crawlscope.operators import discovery, dom, facts, gates, lookups, page_checks, results, robots, site_checks
from crawlscope.operators.skew import heavy_keys, join_on_hot_key
from crawlscope.session import cut
from crawlscope.sources.sinks import write_results

NARROW = ("site", "page_id")


@dataclass
class Inputs:
    """Recorded tables. Only `crawl` is required.

    crawl: page_id, site, url, html, dom, status, acquisition, dom_status, dom_acquisition, hops, headers, final_url, dom_url
    robots_files: origin, status, acquisition, challenge, text. probes: site, kind, url, acquisition, status, ...
    settings: site, goal, environment, multilingual, and optionally intentional_restrictions (prefixes of addresses or paths).
    field: scope, key, lcp_ms, inp_ms, cls; of several rows for an address one is used (the largest). recordings: page_id, optionally
    site, plus any of overflow, a11y, lab. Of several rows for a page or site the smallest is used.
    """

    crawl: DataFrame
    robots_files: DataFrame | None = None
    probes: DataFrame | None = None
    settings: DataFrame | None = None
    field: DataFrame | None = None
    recordings: DataFrame | None = None


def page_table(inputs: Inputs) -> DataFrame:
    """One wide row per page with facts of both profiles, as far as they are genuine; html does not go further."""
    rows = gates.with_validity(inputs.crawl.withColumn("headers", gates.lowered_headers(F.col("headers"))))
    rows = facts.extract_profiles(dom.profile_trees(facts.genuine_documents(rows)), plus=("insecure",))
    return rows.withColumn("insecure", F.col("dom_facts")["insecure"])


def with_decisions(pages: DataFrame, inputs: Inputs, hot: DataFrame) -> DataFrame:
    tokens = [registry.AUDITOR_TOKEN, *[b[0] for b in registry.BOTS]]
    if inputs.robots_files is None:
        unknown = F.struct(F.lit("UNKNOWN").alias("decision"), F.lit(None).cast("string").alias("rule"))
        return pages.withColumn("decisions", F.map_from_entries(F.array(*[F.struct(F.lit(t).alias("key"), unknown.alias("value")) for t in tokens]))).withColumn("auditor_decision", F.lit("ALLOW"))
    decided = robots.decisions(pages.select(*NARROW, "url"), robots.policies(inputs.robots_files), tokens, NARROW).select(*NARROW, "decisions")
    return pages.join(decided, list(NARROW)).withColumn("auditor_decision", F.col("decisions")[registry.AUDITOR_TOKEN]["decision"])


def with_settings(pages: DataFrame, inputs: Inputs, hot: DataFrame) -> DataFrame:
    if inputs.settings is None:
        return page_checks.with_defaults(pages)
    conf = inputs.settings
    if "intentional_restrictions" not in conf.columns:
        conf = conf.withColumn("intentional_restrictions", F.lit(None).cast("array<string>"))
    conf = conf.groupBy("site").agg(P.min(P.struct("goal", "environment", "multilingual", "intentional_restrictions")).alias("_c")).select("site", "_c.*")
    joined = join_on_hot_key(pages, conf, ["site"], ["page_id"], "left", hot)
    marked = joined.withColumn("intentional", gates.intentional(F.col("url"), F.col("intentional_restrictions"), F.col("environment"), F.col("goal")))
    return page_checks.with_defaults(marked.drop("environment", "intentional_restrictions").na.fill({"goal": "search_ai_discovery", "multilingual": False}))


def with_controls(pages: DataFrame) -> DataFrame:
    """Script controls of the best document that no crawlable anchor of the page reaches."""
    targets = F.transform(F.filter(F.col("best")["links"], lambda x: x["crawlable"]), lambda x: x["url"])
    controls = F.transform(F.col("best_tree")["controls"], lambda c: F.struct(c["text"].alias("text"), c["target"].alias("target")))
    base = F.coalesce(resolve_http(F.col("best")["base_href"], F.col("best_url")), F.col("best_url"))
    state = F.struct(F.coalesce(targets, F.array().cast("array<string>")).alias("links"), base.alias("base"), host_of(F.col("best_url")).alias("host"))
    kept = let(state, lambda s: F.filter(
        F.transform(controls, lambda c: F.struct(c["text"].alias("text"), resolve_http(c["target"], s["base"]).alias("target"))),
        lambda c: c["target"].isNotNull() & alias_hosts(host_of(c["target"]), s["host"]) & ~F.array_contains(s["links"], c["target"])))
    return pages.withColumn("scripted_controls", F.coalesce(kept, F.array().cast(page_checks.OPTIONAL["scripted_controls"])))


def prepared_pages(inputs: Inputs) -> DataFrame:
    """Everything the page rules look at, written out once."""
    base = cut(page_table(inputs), "facts")
    hot = cut(heavy_keys(base, ["site"]), "hot-sites")
    pages = gates.with_states(with_settings(with_decisions(base, inputs, hot), inputs, hot))
    if inputs.field is not None:
        per_url = inputs.field.filter("scope = 'URL'").groupBy(P.col("key").alias("_at")).agg(P.max(P.struct("lcp_ms", "inp_ms", "cls")).alias("field"))
        pages = join_on_hot_key(pages.drop("field").withColumn("_at", P.coalesce("final_url", "url")), per_url, ["_at"], ["page_id"], "left").drop("_at")  # many pages may end at one log-in page
    if inputs.recordings is not None:
        keys = [c for c in NARROW if c in inputs.recordings.columns]
        rest = [c for c in inputs.recordings.columns if c not in keys]
        one = inputs.recordings.groupBy(*keys).agg(P.min(P.struct(*rest)).alias("_r")).select(*keys, "_r.*")
        pages = pages.drop(*rest).join(one, keys, "left")
    lab = site_checks.lab_pages(pages).select(*NARROW, P.lit(True).alias("lab_selected"))
    pages = pages.drop("lab_selected").join(lab, list(NARROW), "left").withColumn("page_type", page_type(F.col("url")))
    ready = cut(page_checks.with_nodes(with_controls(page_checks.prepare(pages))), "prepared")
    responses = cut(lookups.response_index(ready), "responses")
    ready = lookups.with_hreflang(lookups.with_canonical_targets(ready, responses), responses)
    organisations = site_checks.sites_with_organisation(ready)
    return cut(join_on_hot_key(ready.drop("site_has_org"), organisations, ["site"], ["page_id"], "left", hot), "pages")


def site_units(pages: DataFrame, inputs: Inputs, blocked: DataFrame | None = None) -> DataFrame:
    """Units of SITE and SAMPLE rules. `blocked`: rows of `blocked_links`, if they are at hand."""
    sites = pages.select("site").distinct()
    best = pages.filter("best IS NOT NULL")
    values = best.select("site", "page_id", "best.title", "best.meta_description")
    responses = lookups.response_index(pages)
    targets = lookups.testable_targets(lookups.link_rollup(lookups.link_rows(best)))  # every recorded response counts
    outcomes = lookups.tested_targets(targets, responses)
    units = [
        site_checks.duplicate_units(values, site_checks.duplicates(values)), site_checks.link_targets(lookups.link_target_units(outcomes, sites)),
        site_checks.security_headers(pages), site_checks.other_tokens(pages, [b[0] for b in registry.BOTS if not b[3] and b[0] != "Googlebot"]),
    ]
    if inputs.robots_files is not None:
        units.append(site_checks.robots_answer(robots.policies(inputs.robots_files)).join(sites, "site", "left_semi"))
    if inputs.probes is not None:
        seeds = inputs.probes.filter("kind = 'origin'").select(P.col("site").alias("seed"), "url", "acquisition", "final_url")
        preferred = discovery.preferred_origins(seeds).select(P.col("seed").alias("site"), "preferred_origin")
        units += [site_checks.missing_page(inputs.probes), site_checks.origins(inputs.probes), site_checks.https(inputs.probes, preferred), site_checks.llms(inputs.probes)]
        if inputs.robots_files is not None:
            units.append(site_checks.sitemap(sites, robots.policies(inputs.robots_files), inputs.probes))
    if inputs.field is not None:
        units.append(site_checks.origin_vitals(inputs.field, sites))
    units.append(site_checks.blocked_links(sites, (blocked if blocked is not None else blocked_pages_links(pages, inputs)).groupBy("site").agg(P.count(P.lit(1)).alias("n_blocked"))))
    out = units[0]
    for u in units[1:]:
        out = out.unionByName(u)
    return out.unionByName(missing_units(sites, out))


def affected_pages(pages: DataFrame) -> DataFrame:
    """Pages behind findings of the SAMPLE rules: site, check_id, reason_code, page_id."""
    best = pages.filter("best IS NOT NULL")
    shared = site_checks.pages_of_duplicates(best.select("site", "page_id", "best.title", "best.meta_description"))
    links = lookups.link_rows(best)
    outcomes = lookups.tested_targets(lookups.testable_targets(lookups.link_rollup(links)), lookups.response_index(pages)).filter(P.col("outcome").isin("BROKEN", "REDIRECTED"))
    code = P.when(P.col("outcome") == "BROKEN", P.lit("BROKEN_INTERNAL_LINK_TARGET")).otherwise(P.lit("INTERNAL_LINK_REDIRECTS"))
    sources = lookups.sources_of(links, outcomes.select("site", "url", code.alias("reason_code")))
    return shared.unionByName(sources.select("site", P.lit("O-2.6").alias("check_id"), "reason_code", "page_id"))


def blocked_links(found: DataFrame, policies: DataFrame | None) -> DataFrame:
    """C-1.11 rows: site, url, rule of the internal targets of crawlable links, exclusions aside, that Googlebot may not fetch."""
    kept = found.filter("crawlable AND internal").select("site", P.col("url")).distinct().filter(exclusion_reason(F.col("url")).isNull())
    if policies is None:
        return kept.filter("false").withColumn("rule", P.lit(None).cast("string"))
    decided = robots.decisions(cut(kept, "targets"), policies, ["Googlebot"], ("site", "url"))  # read several times
    return decided.select("site", "url", P.col("decisions")["Googlebot"].alias("_d")).filter("_d.decision = 'DISALLOW'").select("site", "url", "_d.rule")


def blocked_pages_links(pages: DataFrame, inputs: Inputs) -> DataFrame:
    """Blocked links of the best documents."""
    return blocked_links(lookups.link_rows(pages.filter("best IS NOT NULL")), None if inputs.robots_files is None else robots.policies(inputs.robots_files))


#: Site rules that hang on records a site may lack.
RECORDED_RULES = ("C-1.1", "C-1.4", "C-1.6", "C-1.12", "P-4.2", "T-8.1", "X-9.1")


def missing_units(sites: DataFrame, units: DataFrame) -> DataFrame:
    """NOT_TESTABLE for every site and rule without a record."""
    expected = sites.select("site", P.explode(P.array(*[P.lit(c) for c in RECORDED_RULES])).alias("check_id"))
    absent = expected.join(units.select("site", "check_id"), ["site", "check_id"], "left_anti")
    return site_checks.site_unit(absent, P.col("check_id"), P.lit("NOT_TESTABLE"), None, P.lit("no record"))


def eligibility_units(page_units: DataFrame, pages: DataFrame) -> DataFrame:
    """C-1.10; not applicable to pages restricted on purpose."""
    facts_of = pages.select(*NARROW, "intentional", (P.col("best").isNotNull() & (P.concat(P.coalesce(P.trim(P.array_join(P.col("best_tree")["blocks"], "")), P.lit("")), P.coalesce(P.trim(P.col("best")["title"]), P.lit(""))) == "")).alias("_empty"))
    e = page_checks.eligibility(page_units).join(facts_of, list(NARROW))
    e = e.withColumn("eligibility", P.when(P.col("_empty") & (P.col("eligibility") == "ELIGIBLE"), P.lit("UNCERTAIN")).otherwise(P.col("eligibility")))
    status = P.when(P.col("intentional"), P.lit("NOT_APPLICABLE")).when(P.col("eligibility") == "NOT_ELIGIBLE", P.lit("FAIL")).when(P.col("eligibility") == "UNCERTAIN", P.lit("NOT_TESTABLE")).otherwise(P.lit("PASS"))
    return e.select("site", "page_id", P.lit("C-1.10").alias("check_id"), status.alias("status"), P.array().cast("array<string>").alias("reasons"), P.lit("derived").alias("locator"), P.col("eligibility").alias("observed"), P.lit("NONE").alias("profile"), P.lit(None).cast("string").alias("limitation"))


def run_audit(spark: SparkSession, inputs: Inputs, watch: Observation | None = None) -> dict[str, DataFrame]:
    """All result tables, lazily, over intermediate tables that are written once. `watch` observes units that break the contract."""
    rules, reasons, categories = results.registry_tables(spark)
    pages = prepared_pages(inputs)
    by_page = cut(page_checks.evaluate(pages), "page-units")
    blocked = cut(blocked_pages_links(pages, inputs), "blocked")
    every = by_page.unionByName(eligibility_units(by_page, pages)).unionByName(site_units(pages, inputs, blocked))
    units = cut(results.guarded(every, rules, reasons, registry.sources(spark), watch), "units")
    found = cut(results.findings_of(units, reasons, rules), "findings")
    affected = cut(affected_pages(pages), "affected")
    issues = cut(results.root_issues(found, affected), "issues")
    cover = results.coverage(pages)
    per_check = results.check_scores(units, rules)
    per_category = results.category_scores(per_check, categories)
    counts = results.severity_counts(issues)
    return {
        "pages": pages.select("site", "page_id", "url", "page_type", "state"), "check_results": units, "findings": results.finding_ids(found), "evidence": results.evidence_of(units, rules),
        "root_issues": issues, "issue_pages": results.issue_pages(found, affected), "related_issues": results.related_issues(found, issues, affected), "check_scores": per_check, "category_scores": per_category,
        "scores": results.site_scores(per_category, cover.select("site", "valid")), "coverage": cover, "run_quality": results.run_quality(cover), "severity_counts": counts,
        "top_issues": results.top_issues(issues), "action_plan": results.action_plan(issues), "strengths": results.strengths(units), "narrative": results.narrative(cover, counts),
        "blocked_links": blocked,
        "omitted_checks": results.omitted(units), "quarantine": units.filter("note IS NOT NULL").select("site", "page_id", "check_id", "note"),
        "violations": results.contract_violations(found, reasons, registry.sources(spark)),
    }


def save_audit(spark: SparkSession, inputs: Inputs, path: str, run_id: str) -> dict[str, int]:
    """Run the audit and write all result tables under one run id; a second call with it replaces the first one's rows. Returns what `run_audit` observed."""
    watch = Observation("contract")
    write_results(run_audit(spark, inputs, watch), path, run_id)
    return watch.get
