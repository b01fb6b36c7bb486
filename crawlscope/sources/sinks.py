"""Result tables, audit documents and run history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.operators.skew import best_per_group, numbered

BUCKETS = 64


def write_results(tables: dict[str, DataFrame], path: str, run_id: str, buckets: int = BUCKETS) -> None:
    """Write each table to `path`/name/run_id=.../site_bucket=..., in place of an earlier attempt of the same run.

    Rows are dealt evenly before the write: small buckets share a task, and a bucket with a large site is split over many, so files have
    about the size the session asks of a partition and their number follows the bytes, not tasks times buckets. Readers of the folder
    see `run_id` and `site_bucket` as columns; other runs are not touched.
    """
    for name, df in tables.items():
        dealt = df.withColumn("site_bucket", F.pmod(F.xxhash64("site"), F.lit(buckets)).cast("int")).hint("rebalance", F.col("site_bucket"))
        dealt.write.mode("overwrite").partitionBy("site_bucket").parquet(f"{path}/{name}/run_id={run_id}")


def in_chunks(pages: DataFrame, size: int) -> DataFrame:
    """Add `part`: pages of a site by id, `size` to a part. Numbered over quantile cuts, so no task sees a whole site."""
    cuts = pages.agg(F.percentile_approx("page_id", F.array(*[F.lit(i / 256) for i in range(1, 256)]), 10_000)).first()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c < F.col("page_id")))
    return numbered(pages, ["site"], bucket, [F.col("page_id")], "_no").withColumn("part", F.floor((F.col("_no") - 1) / size).cast("int")).drop("_no")


def site_documents(pages: DataFrame, issues: DataFrame, scores: DataFrame, units: DataFrame, size: int = 1000) -> DataFrame:
    """JSON documents of every site: site, part, value. All pages are exported, `size` to a part with all their units.

    Part 0 also holds what belongs to the site as a whole: issues, scores and units without a page. Every list is bounded by `size` and the registry.
    """
    rows = in_chunks(pages.select("site", "page_id", "url", "state"), size)
    lists = rows.groupBy("site", "part").agg(F.sort_array(F.collect_list(F.struct("page_id", "url", "state"))).alias("pages"))
    parts = rows.select("site", "page_id", "part")
    of_pages = units.filter("page_id IS NOT NULL").join(parts, ["site", "page_id"])
    of_site = units.filter("page_id IS NULL").withColumn("part", F.lit(0))
    of_part = of_pages.unionByName(of_site.select(of_pages.columns))
    checks = of_part.groupBy("site", "part").agg(F.sort_array(F.collect_list(F.struct("check_id", "page_id", "status", "reasons"))).alias("checks"))
    of_issues = issues.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("issue_id", "reason_code", "severity", "n_pages"))).alias("root_issues"))
    of_scores = scores.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("score", "value", "suppressed"))).alias("scores"))
    whole = of_issues.join(of_scores, "site", "full").withColumn("part", F.lit(0))
    sizes = lists.groupBy("site").agg(F.count(F.lit(1)).alias("n_parts"))
    joined = lists.join(sizes, "site").join(checks, ["site", "part"], "left").join(whole, ["site", "part"], "left")
    return joined.select("site", "part", F.to_json(F.struct("site", "part", "n_parts", "pages", "checks", "root_issues", "scores")).alias("value"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One line a part, parts of a site in order within its files."""
    documents.repartitionByRange("site", "part").sortWithinPartitions("site", "part").select("value").write.mode("overwrite").text(path)


def latest_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: the latest row per tenant and audit wins, new rows over old ones at the same time."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    row = F.struct(*old.columns)
    return both.groupBy("tenant_id", "audit_id").agg(F.max_by(row, F.struct("updated_at", "_new", "version")).alias("r")).select("r.*")


def history(runs: DataFrame, limit: int = 200) -> DataFrame:
    """Newest runs per tenant."""
    return best_per_group(runs, ["tenant_id"], [F.desc("updated_at"), F.desc("version")], limit)


def for_tenant(df: DataFrame, tenant_id) -> DataFrame:
    """The one reader of report tables: rows of other tenants do not exist for a caller."""
    return df.filter(F.col("tenant_id") == F.lit(tenant_id))

