"""The whole audit saved under a run id."""

from crawlscope.plans import audit


def test_audit_is_saved(spark, tmp_path):
    page = "<html><head><title>t</title></head><body><main><h1>h</h1><p>" + "text " * 80 + '</p><a href="/closed/x">n</a></main></body></html>'
    rows = [(i, "https://s.example", f"https://s.example/p{i}", page, page, 200, "OK", 200, "OK", [], {"Content-Type": "text/html"}, None, None) for i in range(3)]
    schema = "page_id long, site string, url string, html string, dom string, status int, acquisition string, dom_status int, dom_acquisition string, hops array<struct<url:string,status:int,location:string>>, headers map<string,string>, final_url string, dom_url string"
    robots = spark.createDataFrame([("https://s.example", 200, "OK", False, "User-agent: *\nDisallow: /closed")], "origin string, status int, acquisition string, challenge boolean, text string")
    inputs = audit.Inputs(crawl=spark.createDataFrame(rows, schema), robots_files=robots)
    seen = audit.save_audit(spark, inputs, str(tmp_path), "r1")
    assert seen["broken"] == 0 and seen["units"] > 60
    saved = spark.read.parquet(f"{tmp_path}/check_results")
    assert saved.count() == seen["units"] and {r.run_id for r in saved.select("run_id").distinct().collect()} == {"r1"}
    assert [(r.url, r.rule) for r in spark.read.parquet(f"{tmp_path}/blocked_links").collect()] == [("https://s.example/closed/x", "Disallow: /closed (line 2)")]
    assert spark.read.parquet(f"{tmp_path}/check_results").filter("check_id = 'C-1.11'").first().status == "WARN"
