"""From check units to statuses, findings, root issues, scores and summaries.

Everything is long form: an issue that touches a billion pages is one row plus a pages table, never one array.
Aggregations go from (site, check, status) counts upwards, so they combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as P

from crawlscope.functions.sql import F

from crawlscope import registry
from crawlscope.functions.expr import choose, each
from crawlscope.operators.skew import best_per_group, join_on_hot_key, numbered

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
BLOCKERS = ["UNEXPECTED_NOINDEX", "GOOGLEBOT_DISALLOWED", "NOT_FOUND_STATUS", "SERVER_ERROR_STATUS"]
VALUES = {"PASS": 1.0, "WARN": 0.5, "FAIL": 0.0}


def severity_rank(s: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), s)


def round1(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / F.lit(10.0)


def priority(classification: Column, severity: Column) -> Column:
    return choose((classification == "OPTIONAL", "P4"), (classification != "ISSUE", "P3"), (severity.isin("CRITICAL", "HIGH"), "P1"), (severity == "MEDIUM", "P2"), default="P3")


# --- status contract -----------------------------------------------------------------------------------------
def settle_status(explicit: Column, derived: Column, has_fail: Column, has_warn: Column, missing: Column, n_evidence: Column, scored: Column) -> Column:
    """Status precedence for recorded units."""
    return choose(
        (explicit.isin("NOT_APPLICABLE", "NOT_TESTABLE", "ERROR"), explicit),
        (derived.isNotNull() & ~scored, F.when((derived == "PASS") & (n_evidence == 0), F.lit("ERROR")).otherwise(derived)),
        (has_fail, "FAIL"), (has_warn, "WARN"), (missing, "NOT_TESTABLE"), (n_evidence == 0, "ERROR"), default="PASS",
    )


def contract_violations(findings: DataFrame, reasons: DataFrame, sources: DataFrame) -> DataFrame:
    """FAIL findings whose reason cites no documented source; an empty result is the contract."""
    documented = reasons.select("check_id", "reason_code", F.explode("source_ids").alias("source_id")).join(F.broadcast(sources.filter("label = 'DOCUMENTED'")), "source_id", "left_semi")
    failing = findings.join(F.broadcast(reasons.filter("finding_status = 'FAIL'").select("check_id", "reason_code")), ["check_id", "reason_code"], "left_semi")
    return failing.join(F.broadcast(documented.select("check_id", "reason_code").distinct()), ["check_id", "reason_code"], "left_anti")


#: What is said about a unit that broke the contract (fixed value).
DEFECT = "This is a tool defect, not a website defect."


def guarded(units: DataFrame, rules: DataFrame, reasons: DataFrame, sources: DataFrame, watch: Observation | None = None) -> DataFrame:
    """Units with `note`; a unit that breaks the contract becomes an ERROR without reasons, and its note names the breach.

    Breaches: an unknown rule, a reason that is not of the rule, a FAIL reason without a documented source, a reason or a PASS without anything observed.
    The registry is a fixed list of some two hundred codes, which enters the projection as hash sets: no join, no second scan.
    `watch` observes how many units were seen, broke the contract, and were errors anyway, while the result is written.
    """
    documented = {r.source_id for r in sources.filter("label = 'DOCUMENTED'").select("source_id").collect()}
    known = reasons.select("check_id", "reason_code", "finding_status", "source_ids").collect()
    checks = [r.check_id for r in rules.select("check_id").collect()]
    codes = [f"{r.check_id}|{r.reason_code}" for r in known]
    bare = [f"{r.check_id}|{r.reason_code}" for r in known if r.finding_status == "FAIL" and not documented & set(r.source_ids)]
    named = lambda x: P.concat(P.col("check_id"), P.lit("|"), x)
    given = P.coalesce("reasons", P.array().cast("array<string>"))
    told = ~P.col("status").isin("NOT_APPLICABLE", "ERROR")
    first = lambda name, kept: P.concat(P.lit(f"{name}: "), P.get(P.filter(given, kept), P.lit(0)))
    breach = P.coalesce(
        P.when(~P.col("check_id").isin(checks), P.concat(P.lit("UNKNOWN_CHECK: "), P.col("check_id"))),
        P.when(told, first("UNKNOWN_REASON", lambda x: ~named(x).isin(codes))),
        P.when(told & P.col("observed").isNull(), first("NO_EVIDENCE", lambda x: P.lit(True))),
        P.when(told, first("UNDOCUMENTED_FAIL", lambda x: named(x).isin(bare))),
        P.when((P.col("status") == "PASS") & P.col("observed").isNull(), P.lit("PASS_WITHOUT_EVIDENCE")),
    )
    out = units.withColumn("note", breach)
    if watch is not None:
        out = out.observe(watch, P.count(P.lit(1)).alias("units"), P.count("note").alias("broken"), P.count_if((P.col("status") == "ERROR") & P.col("note").isNull()).alias("errors"))
    broken = P.col("note").isNotNull()
    return out.withColumns({
        "status": P.when(broken, P.lit("ERROR")).otherwise(P.col("status")), "reasons": P.when(broken, P.array().cast("array<string>")).otherwise(P.col("reasons")),
        "limitation": P.when(broken, P.lit(DEFECT)).otherwise(P.col("limitation")),
    })


def findings_of(units: DataFrame, reasons: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per unit and reason, with the fixed attributes of the reason."""
    long = units.filter(~F.col("status").isin("NOT_APPLICABLE", "ERROR")).select("site", "page_id", "check_id", F.explode("reasons").alias("reason_code"))
    fixed = reasons.join(rules.select("check_id", "category", F.col("ordinal").alias("check_no"), (F.col("score").isNotNull()).alias("score_included")), "check_id")
    return long.join(F.broadcast(fixed), ["check_id", "reason_code"]).withColumn("priority", priority(F.col("classification"), F.col("severity")))


def splitters(rows: DataFrame, buckets: int = 128) -> DataFrame:
    """check_no, cuts: page ids that cut the rows of a rule into about equal parts, whatever ids look like. One row a rule, so few rows."""
    shares = P.array(*[P.lit(i / buckets) for i in range(1, buckets)])
    return rows.groupBy("check_no").agg(P.percentile_approx("page_id", shares, 20 * buckets).alias("cuts"))


def bucketed(rows: DataFrame, buckets: int = 128) -> DataFrame:
    """Add `_at`, a number that grows with the rule and, within it, with the page: how many cuts of its rule a page id has passed.

    The cuts are quantiles of the rows themselves, so one outlying id, or ids hashed over the whole range, leave all parts alike. The place
    among the cuts is found by halving. Rows without a page id come first.
    """
    halves = [1 << i for i in reversed(range((buckets - 1).bit_length()))]
    passed = P.aggregate(
        P.array(*[P.lit(h) for h in halves]), P.lit(0),
        lambda n, h: P.when((n + h <= P.size("cuts")) & (P.get("cuts", n + h - 1) < P.col("page_id")), n + h).otherwise(n),
    )
    marked = rows.join(P.broadcast(splitters(rows, buckets)), "check_no", "left")
    return marked.withColumn("_at", P.col("check_no") * buckets + P.when(P.col("page_id").isNull() | P.col("cuts").isNull(), 0).otherwise(passed)).drop("cuts")


def finding_ids(findings: DataFrame, buckets: int = 128) -> DataFrame:
    """F-0001... per site in the order rule, page, reason, numbered without gathering a site in one task."""
    order = [F.col("check_no"), F.col("page_id"), F.col("reason_code")]
    rows = numbered(bucketed(findings, buckets), ["site"], P.col("_at"), order, "finding_no").drop("_at")
    return rows.withColumn("finding_id", F.concat(F.lit("F-"), F.lpad(F.col("finding_no").cast("string"), 4, "0")))


def evidence_of(units: DataFrame, rules: DataFrame, buckets: int = 128) -> DataFrame:
    """Evidence rows of the units with ids EV-0001... per site."""
    seen = units.filter(F.col("observed").isNotNull()).join(F.broadcast(rules.select("check_id", F.col("ordinal").alias("check_no"))), "check_id")
    rows = numbered(bucketed(seen, buckets), ["site"], P.col("_at"), [F.col("check_no"), F.col("page_id")], "evidence_no")
    return rows.select("site", F.concat(F.lit("EV-"), F.lpad(F.col("evidence_no").cast("string"), 4, "0")).alias("evidence_id"), "check_id", "page_id", "profile", "locator", "observed")


# --- issues -----------------------------------------------------------------------------------------------------
def root_issues(findings: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    """One row per site, check and reason. Texts come from the first finding, severity from the worst.

    `affected` (site, check_id, reason_code, page_id) names the pages behind findings that are not of one page.
    """
    first = F.struct("check_no", F.coalesce("page_id", F.lit(-1)))
    grouped = findings.groupBy("site", "check_id", "reason_code").agg(
        F.min(severity_rank(F.col("severity"))).alias("sev"),
        F.max(F.when(F.col("finding_status") == "FAIL", 1).otherwise(0)).alias("fails"),
        F.min_by("title", first).alias("title"), F.min_by("classification", first).alias("classification"),
        F.min_by("category", first).alias("category"), F.min_by("confidence", first).alias("confidence"),
        F.min_by("priority", F.struct(severity_rank(F.col("severity")), "check_no", F.coalesce("page_id", F.lit(-1)))).alias("priority"),
        F.count("page_id").alias("n_pages"), F.count(F.lit(1)).alias("n_findings"),
    )
    if affected is not None:
        sizes = affected.groupBy("site", "check_id", "reason_code").agg(F.count_distinct("page_id").alias("_more"))
        grouped = grouped.join(sizes, ["site", "check_id", "reason_code"], "left").withColumn("n_pages", F.greatest("n_pages", F.coalesce("_more", F.lit(0)))).drop("_more")
    order = Window.partitionBy("site").orderBy("sev", F.col("classification") != "ISSUE", F.desc("n_pages"), "check_id", "reason_code")
    # At most one row per registered reason and site reaches this window.
    return grouped.withColumn("issue_no", F.row_number().over(order)).select(
        "site", F.concat(F.lit("I-"), F.lpad(F.col("issue_no").cast("string"), 3, "0")).alias("issue_id"), "issue_no", "check_id", "reason_code",
        F.when(F.col("fails") == 1, F.lit("FAIL")).otherwise(F.lit("WARN")).alias("finding_status"), "classification",
        F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("sev").cast("int")).alias("severity"),
        "confidence", "priority", "category",
        F.when(F.col("n_pages") > 1, F.regexp_replace("title", r"^\d+ ", "")).otherwise(F.col("title")).alias("title"), "n_pages", "n_findings",
    )


def issue_pages(findings: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    """Affected pages in long form."""
    columns = ["site", "check_id", "reason_code", "page_id"]
    own = findings.filter(F.col("page_id").isNotNull()).select(*columns)
    if affected is not None:
        own = own.unionByName(affected.join(findings.select(*columns[:3]).distinct(), columns[:3], "left_semi").select(*columns))
    return own.distinct()


def issues_of_page(findings: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues per page, numbered as in the report. Issues per page are bounded by the registry."""
    ids = issues.select("site", "check_id", "reason_code", "issue_id")
    return join_on_hot_key(issue_pages(findings), ids, ["site", "check_id", "reason_code"], ["page_id"], "inner").groupBy("site", "page_id").agg(F.array_join(F.array_sort(F.collect_list("issue_id")), ",").alias("issue_ids"), F.count(F.lit(1)).alias("n_issues"))


def related_issues(findings: DataFrame, issues: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    """Pairs (issue, blocker) of one site where every page of the issue is a page of the blocker.

    Containment is counted: the pages both have must be as many as the pages the issue has. The join key is the
    page, so pairs grow with issues per page, not with pages per issue.
    """
    pages = issue_pages(findings, affected)
    blockers = pages.filter(F.col("reason_code").isin(BLOCKERS)).select("site", "page_id", F.col("reason_code").alias("blocker"))
    shared = pages.join(blockers, ["site", "page_id"]).filter(F.col("reason_code") != F.col("blocker")).groupBy("site", "check_id", "reason_code", "blocker").agg(F.count(F.lit(1)).alias("shared"))
    named = issues.select("site", "check_id", "reason_code", "issue_id", "n_pages")
    return (
        shared.join(named, ["site", "check_id", "reason_code"]).filter("shared = n_pages")
        .join(issues.select("site", F.col("reason_code").alias("blocker"), F.col("issue_id").alias("blocker_id")), ["site", "blocker"])
        .select("site", "issue_id", "reason_code", F.col("blocker_id").alias("related_issue_id"), "blocker")
    )


def top_issues(issues: DataFrame, k: int = 3) -> DataFrame:
    real = F.col("classification") == "ISSUE"
    group = F.when(real & F.col("severity").isin("CRITICAL", "HIGH"), 1).when(real & (F.col("severity") == "MEDIUM"), 2).otherwise(3)
    return best_per_group(issues, ["site"], [group, F.col("issue_no")], k).select("site", "rank", "issue_id", "reason_code")


def severity_counts(issues: DataFrame) -> DataFrame:
    real = F.col("classification") == "ISSUE"
    return issues.groupBy("site").agg(*[F.count_if(real & (F.col("severity") == s)).alias(s.lower()) for s in SEVERITIES], F.count_if(~real).alias("opportunities"))


def action_plan(issues: DataFrame) -> DataFrame:
    real = F.col("classification") == "ISSUE"
    phase = F.when(real & F.col("severity").isin("CRITICAL", "HIGH"), F.lit("0-7 days")).when(real & (F.col("severity") == "MEDIUM"), F.lit("1-2 weeks")).otherwise(F.lit("3-4 weeks"))
    # Issues per site are bounded by the registry, so the list is too.
    return issues.withColumn("phase", phase).groupBy("site", "phase").agg(F.count(F.lit(1)).alias("n_issues"), F.array_join(F.array_sort(F.collect_list("issue_id")), ",").alias("issue_ids"))


def filter_issues(issues: DataFrame, category: str | None = None, severity: str | None = None, status: str | None = None, confidence: str | None = None, pages: DataFrame | None = None, page_id: int | None = None) -> DataFrame:
    """Report filter; severity 'OPPORTUNITY' selects everything that is not an issue."""
    out = issues
    if category:
        out = out.filter(F.col("category") == category)
    if severity == "OPPORTUNITY":
        out = out.filter(F.col("classification") != "ISSUE")
    elif severity:
        out = out.filter((F.col("severity") == severity) & (F.col("classification") == "ISSUE"))
    if status:
        out = out.filter(F.col("finding_status") == status)
    if confidence:
        out = out.filter(F.col("confidence") == confidence)
    if pages is not None and page_id is not None:
        out = out.join(pages.filter(F.col("page_id") == page_id), ["site", "check_id", "reason_code"], "left_semi")
    return out


def search_units(units: DataFrame, status: str | None, text: str) -> DataFrame:
    out = units.filter(F.col("status") == status) if status else units
    hay = F.lower(F.concat_ws(" ", "check_id", F.col("page_id").cast("string"), F.array_join("reasons", " "), "observed", "limitation"))
    return out.filter(hay.contains(text.lower()))


# --- scores -----------------------------------------------------------------------------------------------------
def check_scores(units: DataFrame, rules: DataFrame) -> DataFrame:
    """Mean unit value per site and scored check. Statuses are counted first, so each site sends one row per check
    and status."""
    counts = units.filter("status <> 'NOT_APPLICABLE'").groupBy("site", "check_id", "status").agg(F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("status") == "PASS", 1.0).when(F.col("status") == "WARN", 0.5).when(F.col("status") == "FAIL", 0.0)
    per_check = counts.groupBy("site", "check_id").agg(
        F.sum("n").alias("applicable"), F.sum(F.when(F.col("status").isin(*VALUES), F.col("n")).otherwise(0)).alias("evaluated"), F.sum(value * F.col("n")).alias("points"),
    )
    scored = F.broadcast(rules.filter("score IS NOT NULL").select("check_id", "score", "bucket", "weight"))
    return per_check.join(scored, "check_id").withColumn("check_score", F.when(F.col("evaluated") > 0, F.col("points") / F.col("evaluated")))


def category_scores(per_check: DataFrame, categories: DataFrame) -> DataFrame:
    grouped = per_check.groupBy("site", "score", "bucket").agg(
        F.sum("applicable").alias("applicable"), F.sum("evaluated").alias("evaluated"),
        F.sum(F.col("check_score") * F.col("weight")).alias("weighted"), F.sum(F.when(F.col("check_score").isNotNull(), F.col("weight"))).alias("weight"),
    )
    return grouped.join(F.broadcast(categories), ["bucket", "score"]).select(
        "site", "score", "bucket", "category_weight", round1(F.col("weighted") / F.col("weight") * 100).alias("category_score"), "evaluated", "applicable",
    )


def site_scores(by_category: DataFrame, valid_pages: DataFrame) -> DataFrame:
    """Two scores per site; NULL with a reason when the evidence is too thin."""
    grouped = by_category.groupBy("site", "score").agg(
        F.sum("applicable").alias("applicable"), F.sum("evaluated").alias("evaluated"),
        F.sum(F.col("category_score") * F.col("category_weight")).alias("weighted"), F.sum(F.when(F.col("category_score").isNotNull(), F.col("category_weight"))).alias("weight"),
    ).join(valid_pages.select("site", "valid"), "site", "left")
    coverage = round1(F.col("evaluated") / F.col("applicable") * 100)
    raw = F.col("weighted") / F.col("weight")
    suppressed = choose((F.coalesce("valid", F.lit(0)) == 0, "NO_VALID_PAGE"), (raw.isNull(), "NO_SCORED_CHECK"), (F.coalesce(coverage < 50, F.lit(True)), "COVERAGE_BELOW_50"))
    return grouped.withColumns({"coverage_pct": coverage, "suppressed": suppressed}).select(
        "site", "score", F.when(F.col("suppressed").isNull(), F.floor(raw + 0.5)).alias("value"), "suppressed", "coverage_pct", "evaluated", "applicable",
    )


# --- coverage and tallies ---------------------------------------------------------------------------------------
STATES = ["VALID", "BLOCKED", "UNAVAILABLE", "CHALLENGED", "ERROR_PAGE"]


def coverage(pages: DataFrame) -> DataFrame:
    fetched = (F.col("acquisition") == "OK") | (F.col("dom_acquisition") == "OK")
    return pages.groupBy("site").agg(F.count(F.lit(1)).alias("selected"), F.count_if(fetched).alias("fetched"), *[F.count_if(F.col("state") == s).alias(s.lower()) for s in STATES])


def run_quality(cover: DataFrame, stops: DataFrame | None = None, restricted: DataFrame | None = None) -> DataFrame:
    """INSUFFICIENT, PARTIAL or COMPLETE per site."""
    out = cover.join(stops.select("site", "stop_reason"), "site", "left") if stops is not None else cover.withColumn("stop_reason", F.lit(None).cast("string"))
    out = out.join(restricted.select("site", "restricted_blocked"), "site", "left") if restricted is not None else out.withColumn("restricted_blocked", F.lit(0))
    expected = F.col("selected") - F.col("error_page") - F.coalesce("restricted_blocked", F.lit(0))
    return out.withColumns({
        "quality": choose((F.col("valid") == 0, "INSUFFICIENT"), (F.col("stop_reason").isNotNull() | (F.col("valid") < expected), "PARTIAL"), default="COMPLETE"),
        "status": choose((F.col("stop_reason") == "CANCELLED", "CANCELLED"), (F.col("stop_reason").isNotNull(), "PARTIAL"), default="COMPLETED"),
    })


def narrative(cover: DataFrame, counts: DataFrame) -> DataFrame:
    joined = cover.join(counts, "site", "left")
    urgent = F.coalesce(F.col("critical") + F.col("high"), F.lit(0))
    return joined.select("site", F.format_string("%d of %d pages valid (%d blocked, %d challenged, %d error, %d unavailable)", "valid", "selected", "blocked", "challenged", "error_page", "unavailable").alias("pages"), F.when(urgent > 0, F.format_string("%d critical or high issues", urgent)).otherwise(F.lit("no critical or high issue")).alias("urgent"))


STRENGTH_CHECKS = ["C-1.2", "C-1.3", "C-1.8", "C-1.7", "O-2.1", "A-5.1", "A-5.3", "T-8.1", "U-7.1", "C-1.12"]


def strengths(units: DataFrame) -> DataFrame:
    applicable = units.filter(F.col("check_id").isin(STRENGTH_CHECKS) & (F.col("status") != "NOT_APPLICABLE"))
    return applicable.groupBy("site", "check_id").agg(F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("status") != "PASS").alias("_other")).filter("_other = 0").drop("_other")


def omitted(units: DataFrame) -> DataFrame:
    gone = units.filter(F.col("status").isin("NOT_TESTABLE", "ERROR"))
    return gone.select("site", "check_id", "page_id", "status", F.coalesce("limitation", F.lit("unavailable")).alias("reason"))


def omitted_reasons(units: DataFrame, k: int = 5) -> DataFrame:
    distinct = omitted(units).select("site", "reason").distinct()
    return best_per_group(distinct, ["site"], [F.col("reason")], k)


def category_tallies(units: DataFrame, rules: DataFrame) -> DataFrame:
    """Counts per site, category and status with totals per category and site."""
    return units.join(F.broadcast(rules.select("check_id", "category")), "check_id").rollup("site", "category", "status").agg(F.count(F.lit(1)).alias("n_units")).filter("site IS NOT NULL")


def progress(units: DataFrame) -> DataFrame:
    return units.groupBy("site").agg(F.count(F.lit(1)).alias("checks"), F.sum(F.size("reasons")).alias("findings"), F.count_if(F.col("status") == "FAIL").alias("fail"), F.count_if(F.col("status") == "WARN").alias("warn"))


def status_matrix(units: DataFrame, slots: int = 10) -> DataFrame:
    """Report matrix: rules down, the first pages of a site across. The report shows one audit's sample, so the
    number of columns is fixed; pages are ranked within their site."""
    pages = best_per_group(units.filter("page_id IS NOT NULL").select("site", "page_id").distinct(), ["site"], [F.col("page_id")], slots, "slot")
    placed = units.join(pages, ["site", "page_id"]).withColumn("slot", F.concat(F.lit("p"), F.lpad(F.col("slot").cast("string"), 2, "0")))
    return placed.groupBy("site", "check_id").pivot("slot", [f"p{i:02d}" for i in range(1, slots + 1)]).agg(F.max("status"))


def bot_summary(decided: DataFrame) -> DataFrame:
    """ALLOW, DISALLOW and UNKNOWN counts per site and token."""
    long = each(decided, ["site"], F.map_entries("decisions"), "e").select("site", F.col("e.key").alias("token"), F.col("e.value.decision").alias("decision"))
    return long.groupBy("site", "token").pivot("decision", ["ALLOW", "DISALLOW", "UNKNOWN"]).count().na.fill(0, ["ALLOW", "DISALLOW", "UNKNOWN"])


def used_sources(findings: DataFrame, units: DataFrame, rules: DataFrame) -> DataFrame:
    """Sources cited by issues or by evaluated rules, per site."""
    cited = findings.select("site", "check_id", "reason_code", "source_ids").dropDuplicates(["site", "check_id", "reason_code"]).select("site", F.explode("source_ids").alias("source_id"))
    evaluated = units.filter(F.col("status").isin(*VALUES)).select("site", "check_id").distinct().join(F.broadcast(rules.select("check_id", "source_ids")), "check_id").select("site", F.explode("source_ids").alias("source_id"))
    return cited.union(evaluated).distinct()


def issue_evidence(issues: DataFrame, findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence rows per issue in long form."""
    links = findings.select("site", "check_id", "reason_code", "page_id").distinct()
    met = links.join(evidence, (links.site == evidence.site) & (links.check_id == evidence.check_id) & links.page_id.eqNullSafe(evidence.page_id))
    rows = met.select(links.site, links.check_id, links.reason_code, links.page_id, "evidence_id", "profile", "locator", "observed")
    return join_on_hot_key(rows, issues.select("site", "check_id", "reason_code", "issue_id"), ["site", "check_id", "reason_code"], ["page_id", "evidence_id"], "inner")


def issue_urls(findings: DataFrame, pages: DataFrame, issues: DataFrame) -> DataFrame:
    rows = issue_pages(findings).join(pages.select("site", "page_id", "url"), ["site", "page_id"])
    return join_on_hot_key(rows, issues.select("site", "check_id", "reason_code", "issue_id"), ["site", "check_id", "reason_code"], ["page_id"], "inner").select("site", "issue_id", "page_id", "url")


def limitations(*tables: DataFrame) -> DataFrame:
    """Distinct (site, limitation) rows of several tables."""
    out = tables[0].select("site", "limitation")
    for t in tables[1:]:
        out = out.unionByName(t.select("site", "limitation"))
    return out.filter(F.col("limitation").isNotNull()).distinct()


def registry_tables(spark):
    return registry.rules(spark), registry.reasons(spark), registry.categories(spark)
