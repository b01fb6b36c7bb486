"""The sample in rounds against a walk over single picks, and suffix rules against a plain lookup."""

import random

import pytest
from pyspark.sql import functions as P

from crawlscope import registry
from crawlscope.functions.urls import PAGE_TYPES
from crawlscope.operators import discovery, sampling


def walked(rows, home, supplied, size):
    """Single picks of one site: (url, signature, reason)."""
    picked = [(home, "/", "homepage")]
    groups = {r["url"]: r["signature"] for r in rows}
    for u in supplied:
        if len(picked) < size and u not in {p[0] for p in picked}:
            picked.append((u, groups.get(u, "/" + u.split("/", 3)[-1]), "supplied"))
    rows = [r for r in rows if r["url"] not in supplied]
    order = lambda r: (r["zone_rank"], r["type_rank"], r["depth"], r["url"])

    def take(fit, key, reason):
        used = [p[1] for p in picked]
        left = [r for r in rows if r["final_key"] not in {p[0] for p in picked} and fit(r, used)]
        if left and len(picked) < size:
            best = min(left, key=key)
            picked.append((best["final_key"], best["signature"], reason))
            return True
        return False

    for kind in registry.SELECTION_PLAN:
        take(lambda r, used, kind=kind: r["page_type"] == kind and r["signature"] not in used, order, kind)
    while take(lambda r, used: r["signature"] not in used, lambda r: (r["type_rank"], *order(r)), "distinct group"):
        pass
    while take(lambda r, used: used.count(r["signature"]) == 1 and r["page_type"] not in ("other", "contact"), order, "second page"):
        pass
    return picked


@pytest.mark.parametrize("size", [1, 4, 10, 25])
def test_rounds_equal_single_picks(spark, size):
    dice, rows, supplied = random.Random(size), [], []
    for s in range(12):
        site = f"https://s{s}.example"
        ends = [f"{site}/end/{i}" for i in range(dice.randint(1, 6))]
        for i in range(dice.choice([0, 3, 30, 120])):
            kind, url = dice.choice(PAGE_TYPES[1:]), f"{site}/c/{i}"
            final = dice.choice([url, url, dice.choice(ends), f"{site}/"])
            rows.append({"site": site, "url": url, "zone_rank": dice.randint(1, 4), "type_rank": PAGE_TYPES.index(kind) + 1, "depth": dice.randint(1, 2), "page_type": kind,
                         "signature": f"/g{dice.randrange(dice.choice([2, 9, 40]))}", "excluded": None, "verification": "verified", "final_key": final, "robots_auditor": "ALLOW"})
        supplied += [(site, url, n) for n, url in enumerate(dice.sample([r["url"] for r in rows if r["site"] == site] + [f"{site}/", f"{site}/own"], 2))] if s % 3 else []
    skipped = [{**rows[0], "url": rows[0]["url"] + "x", "zone_rank": 0, **change} for change in ({"excluded": "NON_HTML"}, {"verification": "failed"}, {"robots_auditor": "DISALLOW"})]
    schema = "site string, url string, zone_rank int, type_rank int, depth int, page_type string, signature string, excluded string, verification string, final_key string, robots_auditor string"
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in rows + skipped], schema)
    homes = spark.createDataFrame([(f"https://s{s}.example", f"https://s{s}.example/") for s in range(12)], "site string, home_key string")
    given = spark.createDataFrame(supplied, "site string, url string, position int")
    got = {}
    for r in sampling.sample(df, homes, given, size).orderBy("site", "slot").collect():
        got.setdefault(r.site, []).append((r.url, r.signature, r.reason))
    for s in range(12):
        site = f"https://s{s}.example"
        own = [u for x, u, _ in sorted(supplied, key=lambda g: g[2]) if x == site]
        assert got[site] == walked([r for r in rows if r["site"] == site], f"{site}/", own, size)


def test_registrable_domain_is_a_projection(spark):
    rules = ["com", "co.uk", "uk", "*.ck", "!www.ck", "github.io", "*.compute.example", "jp", "*.kawasaki.jp", "!city.kawasaki.jp"]
    want = {
        "a.b.example.com": "example.com", "com": None, "x.co.uk": "x.co.uk", "co.uk": None, "y.uk": "y.uk", "a.b.ck": "a.b.ck", "b.ck": None, "ck": None, "www.ck": "www.ck", "q.www.ck": "www.ck",
        "me.github.io": "me.github.io", "github.io": None, "unknown.zone": "unknown.zone", "zone": None, "a.x.kawasaki.jp": "a.x.kawasaki.jp", "x.kawasaki.jp": None, "b.city.kawasaki.jp": "city.kawasaki.jp",
        "1.2.3.4": None, "[::1]": None, "UP.Example.COM": "example.com", "a.z.compute.example": "a.z.compute.example", None: None,
    }
    hosts = spark.createDataFrame([(h,) for h in want] * 2, "host string")
    out = discovery.with_registrable(hosts, spark.createDataFrame([(r,) for r in rules], "suffix string"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.host: r.registrable for r in out.collect()} == want and out.count() == 2 * len(want)
    with pytest.raises(ValueError):
        discovery.with_registrable(hosts, spark.range(20).select(P.concat(P.lit("s"), "id").alias("suffix")), most=10)


def test_text_of_a_place_recorded_twice_is_that_of_the_smallest_page(spark):
    row = lambda page, text: ("s", "https://s.example/x", page, "https://s.example/", 3, text, 1, 1, "RAW")
    for pages in ([7, 2, 5], [5, 7, 2], [2, 5, 7]):
        rows = spark.createDataFrame([row(p, f"text {p}") for p in pages], "site string, url string, page_id bigint, from_key string, pos int, text string, zone_rank int, depth int, profile string").coalesce(1)
        assert discovery.merge_candidates(rows).first().text == "text 2"
