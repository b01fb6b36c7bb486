"""Pages that land in pieces give the same units and site results as one batch."""

from pyspark.sql import functions as P

from crawlscope.operators import lookups, site_checks
from crawlscope.plans import audit
from crawlscope.streaming import incremental as INC


def landing_rows():
    rows = []
    for i in range(14):
        site = f"https://s{i % 2}.example"
        page = (
            f"<html><head><title>{'Shared' if i % 5 == 0 else f'T{i}'}</title><meta name='description' content='d{i % 6}'><link rel='canonical' href='{site}/p{(i + 2) % 14}'></head>"
            f"<body><nav><a href='/p{(i + 4) % 14}'>next</a></nav><main><h1>h</h1><p>{'text ' * 80}</p><a href='/p{(i + 2) % 14}'>a{i}</a><a href='/gone'>g</a></main></body></html>"
        )
        rows.append((i, site, f"{site}/p{i}", page, page, 200 if i != 6 else 404, "OK", 200 if i != 6 else 404, "OK", [], {"Content-Type": "text/html"}, f"{site}/p{i}", None))
    return rows


def test_stream_equals_batch(spark, tmp_path):
    schema = INC.LANDING_SCHEMA.replace(", crawled_at timestamp", "")
    rows, landing, out = landing_rows(), f"{tmp_path}/in", f"{tmp_path}/out"
    robots = spark.createDataFrame([("https://s0.example", 200, "OK", False, "User-agent: *\nDisallow: /p4")], "origin string, status int, acquisition string, challenge boolean, text string")
    again = (99, rows[0][1], rows[0][2] + "#again", *rows[0][3:])
    for part in (rows[:5], [again, *rows[5:9]], rows[9:]):
        spark.createDataFrame(part, schema).withColumn("crawled_at", P.lit("2024-01-01 00:00:00").cast("timestamp")).write.mode("append").parquet(landing)
        INC.start_units(INC.read_landing(spark, landing), out, f"{tmp_path}/c1", robots_files=robots).awaitTermination()
        for q in INC.start_state(spark, out, f"{tmp_path}/c2"):
            q.awaitTermination()
    pages = audit.prepared_pages(audit.Inputs(crawl=spark.createDataFrame(rows, schema), robots_files=robots))
    show = lambda df, *columns: sorted(map(str, df.select(*columns).collect()))
    unit = ("site", "page_id", "check_id", "status", "reasons")
    want = audit.page_checks.evaluate(pages)
    streamed = spark.read.parquet(f"{out}/units").select(*unit).unionByName(INC.settled_units(spark, out).select(*unit))
    assert show(streamed, *unit) == show(want, *unit) and len(INC.RULES) + len(INC.CROSS) == len(audit.page_checks.ALL)

    best = pages.filter("best IS NOT NULL")
    values = best.select("site", "page_id", "best.title", "best.meta_description")
    dups = site_checks.duplicates(values)
    assert dups.count() > 2 and show(INC.current(spark, out, "values").filter("n_pages > 1"), *dups.columns) == show(dups, *dups.columns)
    roll = lookups.link_rollup(lookups.link_rows(best))
    assert show(INC.current(spark, out, "links"), *roll.columns) == show(roll, *roll.columns)
    counts = spark.read.parquet(f"{out}/units").groupBy("site", "check_id", "status").agg(P.count("*").alias("n_units"))
    assert show(INC.current(spark, out, "tallies"), *counts.columns) == show(counts, *counts.columns)
    outcomes = lookups.tested_targets(lookups.testable_targets(roll), lookups.response_index(pages))
    sites = pages.select("site").distinct()
    batch = site_checks.duplicate_units(values, dups).unionByName(site_checks.link_targets(lookups.link_target_units(outcomes, sites)))
    assert show(INC.site_units(spark, out), *unit[:1], *unit[2:]) == show(batch, *unit[:1], *unit[2:])
