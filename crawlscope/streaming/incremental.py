"""The audit over pages as they land: page rules batch by batch, site and sample rules from running state.

The first query drops pages seen before and runs the page rules of the audit on each micro-batch; pages (without their html) and units are
saved under the batch's number, so a batch that is run again replaces its own rows. The second one keeps state by key over the saved
pages: how often a site uses a title or description, how its addresses are linked, how many units of a rule have which status. State is
updated in place by streaming aggregates and each trigger saves the groups that changed; `current` reads the newest row of each
group. Its size follows the different values and addresses, never the pages behind one of them. Start it when the first has ended.

Rules that look at other pages of the site (canonical and hreflang targets, the choice of lab pages, an organisation named somewhere) are
settled from the saved pages when asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlscope.functions.urls import fetch_key
from crawlscope.operators import lookups, page_checks, site_checks
from crawlscope.operators.skew import join_on_hot_key
from crawlscope.plans import audit

LANDING_SCHEMA = (
    "page_id bigint, site string, url string, html string, dom string, status int, acquisition string, dom_status int, dom_acquisition string, "
    "hops array<struct<url:string,status:int,location:string>>, headers map<string,string>, final_url string, dom_url string, crawled_at timestamp"
)
#: Rules that need other pages of the site.
CROSS = (page_checks.check_canonical, page_checks.check_hreflang, page_checks.check_lab, page_checks.check_opportunity)
RULES = [c for c in page_checks.ALL if c not in CROSS]
KEYS = {"values": ["site", "field", "value"], "links": ["site", "url"], "tallies": ["site", "check_id", "status"], "sites": ["site"]}


def read_landing(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(LANDING_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def once(pages: DataFrame, delay: str = "1 day") -> DataFrame:
    """Skip pages seen before. State only holds keys of the watermark interval."""
    keyed = pages.withColumn("fetch_key", fetch_key(F.col("url")))
    return keyed.withWatermark("crawled_at", delay).dropDuplicatesWithinWatermark(["site", "fetch_key"])


def start_units(pages: DataFrame, out: str, checkpoint: str, robots_files: DataFrame | None = None, settings: DataFrame | None = None) -> StreamingQuery:
    """Save prepared pages (`out`/pages) and units of the page rules (`out`/units) batch by batch."""

    def save(batch: DataFrame, batch_id: int) -> None:
        inputs = audit.Inputs(crawl=batch.drop("fetch_key", "crawled_at"), robots_files=robots_files, settings=settings)
        audit.prepared_pages(inputs).write.mode("overwrite").parquet(f"{out}/pages/batch={batch_id}")
        ready = batch.sparkSession.read.parquet(f"{out}/pages/batch={batch_id}")
        page_checks.evaluate(ready, RULES).write.mode("overwrite").parquet(f"{out}/units/batch={batch_id}")

    return once(pages).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def value_state(pages: DataFrame) -> DataFrame:
    """Pages of a site by title and by description."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"best.{c}").alias("value")) for c in ("title", "meta_description")])
    long = pages.filter("best IS NOT NULL").select("site", "page_id", F.explode(fields).alias("f")).select("site", "page_id", "f.*").filter("value IS NOT NULL AND value <> ''")
    return long.groupBy("site", "field", "value").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page_id").alias("first_page"))


def link_state(pages: DataFrame) -> DataFrame:
    """Internal links of a site by target: links, pages, whether in navigation, text of the first one."""
    usable = F.filter(F.col("best.links"), lambda x: x["crawlable"] & x["internal"])
    every = F.transform(usable, lambda x: F.struct(x["url"].alias("url"), F.lit(1).alias("link"), F.lit(0).alias("page"), (x["zone"] == "nav").alias("nav"), x["text"].alias("text"), x["pos"].alias("pos")))
    pages_of = F.transform(F.array_distinct(F.transform(usable, lambda x: x["url"])), lambda u: F.struct(
        u.alias("url"), F.lit(0).alias("link"), F.lit(1).alias("page"), F.lit(None).cast("boolean").alias("nav"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("pos"),
    ))
    rows = pages.filter("best IS NOT NULL").select("site", "page_id", F.explode(F.concat(every, pages_of)).alias("x")).select("site", "page_id", "x.*")
    first = F.when(F.col("link") == 1, F.struct("page_id", "pos"))
    return rows.groupBy("site", "url").agg(F.sum("link").alias("n_links"), F.sum("page").alias("n_pages"), F.max("nav").alias("in_nav"), F.min_by("text", first).alias("text"))


def tallies(units: DataFrame) -> DataFrame:
    return units.groupBy("site", "check_id", "status").agg(F.count(F.lit(1)).alias("n_units"))


def site_sizes(pages: DataFrame) -> DataFrame:
    return pages.groupBy("site").agg(F.count(F.lit(1)).alias("selected"), F.count("best").alias("n"))


def start_state(spark: SparkSession, out: str, checkpoint: str) -> list[StreamingQuery]:
    """Keep the state tables over what `start_units` saved; each saves its changed groups under `out`/state/name."""

    def keep(name: str, source: str, of: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
        saved = spark.read.parquet(f"{out}/{source}")
        rows = spark.readStream.schema(saved.schema).parquet(f"{out}/{source}")

        def save(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/state/{name}/batch={batch_id}")

        return of(rows).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()

    return [keep("values", "pages", value_state), keep("links", "pages", link_state), keep("tallies", "units", tallies), keep("sites", "pages", site_sizes)]


def current(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The newest row of each group of a state table."""
    rows = spark.read.parquet(f"{out}/state/{name}")
    rest = [c for c in rows.columns if c not in (*KEYS[name], "batch")]
    return rows.groupBy(*KEYS[name]).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*KEYS[name], "_r.*")


def site_units(spark: SparkSession, out: str) -> DataFrame:
    """Units of the rules over whole sites, from state: shared titles and descriptions, and link targets."""
    sizes = current(spark, out, "sites")
    shared = current(spark, out, "values").filter("n_pages >= 2")
    targets = lookups.testable_targets(current(spark, out, "links"))
    outcomes = lookups.tested_targets(targets, lookups.response_index(spark.read.parquet(f"{out}/pages")))
    links = site_checks.link_targets(lookups.link_target_units(outcomes, sizes.select("site")))
    return site_checks.duplicate_units(sizes.filter("n > 0"), shared).unionByName(links)


def settled_units(spark: SparkSession, out: str) -> DataFrame:
    """Units of the rules that look at other pages, over all pages saved so far."""
    pages = spark.read.parquet(f"{out}/pages").drop("batch", "canonical_target", "hreflang_result", "lab_selected", "site_has_org")
    lab = site_checks.lab_pages(pages).select("site", "page_id", F.lit(True).alias("lab_selected"))
    responses = lookups.response_index(pages)
    ready = lookups.with_hreflang(lookups.with_canonical_targets(pages, responses), responses).join(lab, ["site", "page_id"], "left")
    return page_checks.evaluate(join_on_hot_key(ready, site_checks.sites_with_organisation(pages), ["site"], ["page_id"]), CROSS)
