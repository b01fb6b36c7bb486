"""Queries over check units: statuses, issues, scores, summaries and report tables."""

from __future__ import annotations

from crawlscope import registry
from crawlscope.functions.sql import F
from crawlscope.operators import results as R
from crawlscope.plans.catalog import crawl_states, query
from crawlscope.plans.catalog_crawl import SITE
from crawlscope.session import cut
from crawlscope.sources.tables import read_pages


def recorded_units(spark, root):
    """One unit per page and rule with a status from arithmetic; reasons follow the registry."""
    rules = registry.rules(spark).select("check_id", "ordinal")
    first = registry.reasons(spark).groupBy("check_id", F.col("finding_status").alias("status")).agg(F.min("reason_code").alias("reason"))
    n, k = F.col("page_id"), F.col("ordinal")
    pick = (n * 31 + k * 17 + F.floor(n / 10) * 7) % 10
    drawn = F.when(pick < 5, F.lit("PASS")).when(pick == 5, F.lit("WARN")).when(pick == 6, F.lit("FAIL")).when(pick == 7, F.lit("NOT_TESTABLE")).when(pick == 8, F.lit("NOT_APPLICABLE")).otherwise(F.lit("ERROR"))
    rows = read_pages(spark, root).select("page_id", SITE.alias("site"), F.explode(F.sequence(F.lit(0), F.lit(len(registry.RULES) - 1))).alias("ordinal")).withColumn("status", drawn)
    rows = rows.join(F.broadcast(rules), "ordinal").join(F.broadcast(first), ["check_id", "status"], "left")
    bare = F.col("status").isin("WARN", "FAIL") & F.col("reason").isNull()
    return rows.select(
        "site", "page_id", "check_id", F.when(bare, F.lit("PASS")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("reason").isNull(), F.array().cast("array<string>")).otherwise(F.array("reason")).alias("reasons"),
        F.lit("unit").alias("locator"), F.when(F.col("status") != "ERROR", F.concat(F.lit("seen "), F.col("page_id").cast("string"))).alias("observed"), F.lit("RAW").alias("profile"),
        F.when(F.col("status") == "NOT_TESTABLE", F.concat(F.lit("limit "), (F.col("page_id") % 8).cast("string"))).alias("limitation"),
    )


def recorded_findings(spark, root):
    return R.findings_of(recorded_units(spark, root), registry.reasons(spark), registry.rules(spark))


def recorded_issues(spark, root):
    return R.root_issues(recorded_findings(spark, root))


@query
def status_precedence(spark, root):
    """AGG-9 over recorded parts of a unit."""
    n = F.col("page_id")
    explicit = F.when(n % 11 == 1, F.lit("NOT_APPLICABLE")).when(n % 11 == 2, F.lit("NOT_TESTABLE")).when(n % 11 == 3, F.lit("ERROR"))
    status = R.settle_status(explicit, F.when(n % 7 == 2, F.lit("FAIL")), n % 5 == 1, n % 3 == 1, n % 13 == 4, n % 4, n % 2 == 0)
    return read_pages(spark, root).select("page_id", status.alias("status"))


@query
def contract_violations(spark, root):
    out = R.contract_violations(recorded_findings(spark, root), registry.reasons(spark), registry.sources(spark))
    return out.select("site", "page_id", "check_id", "reason_code")


@query
def unit_errors(spark, root):
    """JN-14: recorded units of which some break the contract, over a registry in which some FAIL reasons cite no documented source."""
    n = F.col("page_id")
    broken = recorded_units(spark, root).withColumns({
        "reasons": F.when(n % 6 == 1, F.concat("reasons", F.array(F.lit("NO_SUCH_REASON")))).otherwise(F.col("reasons")),
        "observed": F.when(n % 6 != 2, F.col("observed")), "check_id": F.when(n % 12 == 3, F.concat(F.lit("Z-"), F.col("check_id"))).otherwise(F.col("check_id")),
    })
    reasons = registry.reasons(spark).withColumn("source_ids", F.when(F.substring("reason_code", 1, 1) < "G", F.array(F.lit("SRC-TOOL-POLICY"))).otherwise(F.col("source_ids")))
    out = R.guarded(broken, registry.rules(spark), reasons, registry.sources(spark))
    return out.select("site", "page_id", "check_id", "status", F.array_join("reasons", ",").alias("reasons"), F.coalesce("note", F.lit("")).alias("note"), F.coalesce("limitation", F.lit("")).alias("limitation"))


@query
def check_scores(spark, root):
    return R.check_scores(recorded_units(spark, root), registry.rules(spark)).select("site", "check_id", "evaluated", "applicable", R.round1(F.col("check_score") * 100).alias("score_pct"))


def scored(spark, root):
    return R.category_scores(R.check_scores(recorded_units(spark, root), registry.rules(spark)), registry.categories(spark))


@query
def category_scores(spark, root):
    return scored(spark, root).select("site", "score", "bucket", "category_score", "evaluated", "applicable")


@query
def site_scores(spark, root):
    valid = read_pages(spark, root).groupBy(SITE.alias("site")).agg(F.count_if(F.col("page_id") % 4 != 0).alias("valid"))
    return R.site_scores(scored(spark, root), valid).select("site", "score", F.coalesce("value", F.lit(-1)).alias("value"), F.coalesce("suppressed", F.lit("")).alias("suppressed"), "coverage_pct")


@query
def root_issues(spark, root):
    return recorded_issues(spark, root).select("site", "issue_id", "check_id", "reason_code", "finding_status", "severity", "classification", "priority", "n_pages")


@query
def issue_pages(spark, root):
    return R.issue_pages(recorded_findings(spark, root))


@query
def related_issues(spark, root):
    found = cut(recorded_findings(spark, root), "findings")
    return R.related_issues(found, R.root_issues(found)).select("site", "reason_code", "blocker", "issue_id", "related_issue_id")


@query
def page_issues(spark, root):
    found = cut(recorded_findings(spark, root), "findings")
    return R.issues_of_page(found, R.root_issues(found))


@query
def issue_urls(spark, root):
    found = cut(recorded_findings(spark, root), "findings")
    return R.issue_urls(found, read_pages(spark, root).select("page_id", "url", SITE.alias("site")), R.root_issues(found))


@query
def top_issues(spark, root):
    return R.top_issues(recorded_issues(spark, root))


@query
def severity_counts(spark, root):
    return R.severity_counts(recorded_issues(spark, root))


@query
def action_plan(spark, root):
    return R.action_plan(recorded_issues(spark, root))


@query
def issue_filter(spark, root):
    """FLT-15."""
    return R.filter_issues(recorded_issues(spark, root), category="crawl_indexing", severity="HIGH", status="FAIL", confidence="OBSERVED").select("site", "issue_id", "reason_code")


@query
def unit_search(spark, root):
    """FLT-16."""
    return R.search_units(recorded_units(spark, root), "WARN", "Canonical").select("site", "page_id", "check_id")


@query
def strengths(spark, root):
    return R.strengths(recorded_units(spark, root))


@query
def omitted_reasons(spark, root):
    return R.omitted_reasons(recorded_units(spark, root)).select("site", "rank", "reason")


@query
def omitted_checks(spark, root):
    return R.omitted(recorded_units(spark, root))


@query
def progress(spark, root):
    return R.progress(recorded_units(spark, root))


@query
def category_tallies(spark, root):
    rows = R.category_tallies(recorded_units(spark, root), registry.rules(spark))
    return rows.select("site", F.coalesce("category", F.lit("*")).alias("category"), F.coalesce("status", F.lit("*")).alias("status"), "n_units")


@query
def status_matrix(spark, root):
    rows = R.status_matrix(recorded_units(spark, root), 4)
    return rows.select("site", "check_id", *[F.coalesce(f"p0{i}", F.lit("")).alias(f"p0{i}") for i in range(1, 5)])


@query
def used_sources(spark, root):
    units = recorded_units(spark, root)
    return R.used_sources(R.findings_of(units, registry.reasons(spark), registry.rules(spark)), units, registry.rules(spark))


@query
def finding_ids(spark, root):
    return R.finding_ids(recorded_findings(spark, root), 64).select("site", "page_id", "reason_code", "finding_id")


@query
def evidence_rows(spark, root):
    return R.evidence_of(recorded_units(spark, root), registry.rules(spark), 64).select("site", "page_id", "check_id", "evidence_id", "observed")


@query
def issue_evidence(spark, root):
    units = cut(recorded_units(spark, root), "units")
    found = cut(R.findings_of(units, registry.reasons(spark), registry.rules(spark)), "findings")
    rows = R.issue_evidence(R.root_issues(found), found, R.evidence_of(units, registry.rules(spark), 64))
    return rows.select("site", "issue_id", "page_id", "evidence_id")


@query
def coverage(spark, root):
    return R.coverage(crawl_states(spark, root))


@query
def run_quality(spark, root):
    return R.run_quality(R.coverage(crawl_states(spark, root))).select("site", "quality", "status")


@query
def narrative(spark, root):
    return R.narrative(R.coverage(crawl_states(spark, root)), R.severity_counts(recorded_issues(spark, root).withColumn("site", F.regexp_replace("site", "^http:", "https:"))))


@query
def limitations(spark, root):
    units = recorded_units(spark, root)
    return R.limitations(units, units.filter("page_id % 2 = 0"))


# Sample audit runs, from orders: one run per order, tenants by customer.
RUNS_SQL = """
SELECT o_custkey AS tenant_id, 'a' || CAST(o_orderkey % 5000 AS STRING) AS audit_id, o_orderstatus AS status, o_orderdate AS updated_at, o_orderkey AS version FROM {orders}
"""


@query
def run_history(spark, root):
    from crawlscope.sources import sinks

    runs = spark.sql(RUNS_SQL, orders=spark.read.parquet(f"{root}/orders.parquet"))
    latest = sinks.latest_runs(runs.filter("version % 3 <> 0"), runs.filter("version % 3 = 0"))
    return sinks.history(latest, 2).select("tenant_id", "rank", "audit_id", "version")



def full_inputs(spark, root):
    from crawlscope.plans.audit import Inputs
    from crawlscope.sources import derived as D

    field = D.derived(spark, root, D.FIELD_SQL)
    per_url = D.crawl(spark, root).select("page_id", "url").join(field, "page_id").groupBy("url").agg(F.min_by(F.struct("lcp_ms", "inp_ms", "cls"), "page_id").alias("v"))
    return Inputs(crawl=D.crawl(spark, root), robots_files=D.robots_files(spark, root), probes=D.derived(spark, root, D.PROBES_SQL), settings=D.derived(spark, root, D.CONFIG_SQL),
                  field=per_url.select(F.lit("URL").alias("scope"), F.col("url").alias("key"), "v.*"))


@query
def full_audit_scores(spark, root):
    """Whole audit, from pages to scores, in one query."""
    from crawlscope.plans.audit import run_audit

    return run_audit(spark, full_inputs(spark, root))["scores"]
