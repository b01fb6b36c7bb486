"""Queries over inputs and outputs of the audit: headers, bodies, addresses, saved tables, documents and runs."""

from __future__ import annotations

from crawlscope.functions import urls as U
from crawlscope.functions.expr import each
from crawlscope.functions.sql import F
from crawlscope.operators import discovery as DISC
from crawlscope.operators import gates as G
from crawlscope.operators import results as R
from crawlscope.operators import robots as RB
from crawlscope.operators import site_checks as S
from crawlscope.plans import audit
from crawlscope.plans.catalog import crawl_states, query
from crawlscope.plans.catalog_crawl import crawl_edges, probes, site_rows
from crawlscope.plans.catalog_results import recorded_units
from crawlscope.session import cut, shared_checkpoint_dir
from crawlscope.sources import decoding, sinks
from crawlscope.sources import derived as D
from crawlscope.sources.tables import read_pages, read_table

# Header names in several spellings.
HEADERS_SQL = """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'X-Robots-Tag' WHEN 1 THEN 'x-robots-tag' ELSE 'LINK' END AS name_a, 'v' || CAST(page_id % 7 AS STRING) AS value_a,
  CASE page_id % 4 WHEN 0 THEN 'X-ROBOTS-TAG' WHEN 1 THEN 'Content-Type' ELSE 'Server' END AS name_b, 'w' || CAST(page_id % 5 AS STRING) AS value_b FROM pages
"""


@query
def header_names(spark, root):
    """FN-25: values of one name in two spellings end up on two lines of one entry."""
    raw = D.derived(spark, root, HEADERS_SQL).withColumn("h", F.map_from_arrays(F.array("name_a", "name_b"), F.array("value_a", "value_b")))
    rows = each(raw.withColumn("h", G.lowered_headers(F.col("h"))), ["page_id"], F.map_entries("h"), "e")
    return rows.select("page_id", F.col("e.key").alias("name"), F.replace(F.col("e.value"), F.lit("\n"), F.lit("|")).alias("value"))


@query
def decoded_bodies(spark, root):
    """SRC-6: page sources as bytes in different charsets, read back."""
    n = F.col("page_id")
    text = F.concat(F.lit("<p>éü "), F.col("html"))
    raw = read_pages(spark, root).select(
        "page_id", F.when(n % 3 == 0, F.encode(text, "ISO-8859-1")).when(n % 3 == 1, F.encode(F.concat(F.lit('<meta charset="iso-8859-1">'), text), "ISO-8859-1")).otherwise(F.encode(text, "UTF-8")).alias("body"),
        F.when(n % 3 == 0, F.lit("text/html; charset=ISO-8859-1")).when(n % 3 == 1, F.lit("text/html")).alias("content_type"),
    )
    out = decoding.decode_body(F.col("body"), F.col("content_type"))
    return raw.select("page_id", F.length(out).alias("n_chars"), F.md5(out).alias("text_md5"))


@query
def url_universe(spark, root):
    """SET-1: candidates, homepages and supplied pages, each address once."""
    pages = read_pages(spark, root).withColumn("site", F.regexp_extract(F.col("url"), "^https?://[^/?#]+", 0))
    candidates = pages.filter("page_id % 3 = 0").select("site", U.fetch_key(F.col("url")).alias("url"))
    homes = pages.select("site", F.concat("site", F.lit("/")).alias("home_key")).distinct()
    supplied = pages.filter("page_id % 4 = 0").select("site", F.concat("url", F.lit("#part")).alias("url"))
    return DISC.url_universe(candidates, homes, supplied)


@query
def blocked_links(spark, root):
    """C-1.11: every internal link target that Googlebot may not fetch, with the rule."""
    return audit.blocked_links(crawl_edges(spark, root), RB.policies(D.derived(spark, root, D.ROBOTS_SQL)))


@query
def llms_check(spark, root):
    """X-9.1."""
    return site_rows(S.llms(probes(spark, root)))


@query
def stopped_runs(spark, root):
    """AGG-17, FLT-9 with stopped and cancelled runs, pages blocked by robots and restricted ones."""
    states = crawl_states(spark, root).withColumn("state", F.when(F.col("page_id") % 9 == 2, F.lit("BLOCKED")).otherwise(F.col("state")))
    # Three tables are made of the states, so they are found once and written out.
    states = cut(states.select("site", "page_id", "acquisition", "dom_acquisition", "state"), "states")
    cover = R.coverage(states)
    n = F.col("_first") % 7
    sites = states.groupBy("site").agg(F.min("page_id").alias("_first"))
    stops = sites.filter(n.isin(0, 1, 2)).select("site", F.when(n == 0, F.lit("CANCELLED")).when(n == 1, F.lit("RATE_LIMITED")).otherwise(F.lit("TIME_LIMIT")).alias("stop_reason"))
    restricted = states.filter("state = 'BLOCKED' AND page_id % 2 = 0").groupBy("site").agg(F.count(F.lit(1)).alias("restricted_blocked"))
    return R.run_quality(cover, stops, restricted).select("site", "selected", "valid", "blocked", "quality", "status")


@query
def saved_results(spark, root):
    """SNK-1: two runs saved, one of them twice, read back."""
    path = f"{shared_checkpoint_dir(spark)}/saved-{spark.sparkContext.applicationId}-{id(root)}"
    units = recorded_units(spark, root)
    for run, rows in (("a", units), ("b", units.filter("status = 'FAIL'")), ("a", units.filter("status <> 'PASS'"))):
        sinks.write_results({"check_results": rows}, path, run)
    return spark.read.parquet(f"{path}/check_results").groupBy("run_id", "site", "status").agg(F.count(F.lit(1)).alias("n_units"))


@query
def site_document_parts(spark, root):
    """SNK-2: documents of all pages of a site, five pages to a part."""
    units = recorded_units(spark, root)
    pages = units.select("site", "page_id").distinct().select("site", "page_id", F.concat("site", F.lit("/"), F.col("page_id").cast("string")).alias("url"), F.lit("VALID").alias("state"))
    issues = units.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages")).select("site", F.lit("I-001").alias("issue_id"), F.lit("R").alias("reason_code"), F.lit("LOW").alias("severity"), "n_pages")
    scores = issues.select("site", F.lit("technical_health").alias("score"), F.lit(50).cast("bigint").alias("value"), F.lit(None).cast("string").alias("suppressed"))
    docs = sinks.site_documents(pages, issues, scores, units, size=5)
    parsed = F.from_json("value", F.lit("n_parts bigint, pages array<struct<page_id:bigint>>, checks array<struct<check_id:string,page_id:bigint>>, root_issues array<struct<n_pages:bigint>>"))
    rows = docs.withColumn("d", parsed)
    return rows.select(
        "site", "part", "d.n_parts", F.array_join(F.transform(F.col("d.pages"), lambda x: x["page_id"].cast("string")), ",").alias("pages"), F.size("d.checks").alias("n_checks"),
        F.coalesce(F.get("d.root_issues", F.lit(0))["n_pages"], F.lit(0)).alias("issue_pages"),
    )


@query
def tenant_runs(spark, root):
    """FLT-17: one tenant's newest runs and nobody else's."""
    runs = read_table(spark, root, "orders").select(
        (F.col("o_custkey") % 10).alias("tenant_id"), F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("audit_id"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("version"),
    )
    return sinks.for_tenant(sinks.history(runs, 50), 3).select("tenant_id", "audit_id", "version")


