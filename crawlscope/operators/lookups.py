"""Joins of a page's outgoing references to recorded responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window

from crawlscope.functions.sql import F

from crawlscope import registry
from crawlscope.functions.expr import choose, each, let
from crawlscope.functions.urls import exclusion_reason, fetch_key, resolve_http, same_url
from crawlscope.operators.skew import best_per_group, join_on_hot_key


def response_index(pages: DataFrame) -> DataFrame:
    """One recorded response per fetch key (the earliest), small columns only."""
    keyed = pages.select(
        fetch_key(F.col("url")).alias("fetch_key"), "page_id", "acquisition", "status", F.size("hops").alias("n_hops"), "final_url",
        F.col("raw_validity").alias("validity"), F.col("raw_facts")["title"].alias("title"),
        F.transform(F.col("raw_facts")["hreflang"], lambda h: fetch_key(h["href"])).alias("alternates"),
    )
    value = F.struct(*[c for c in keyed.columns if c not in ("fetch_key", "page_id")])
    return keyed.groupBy("fetch_key").agg(F.min_by(value, "page_id").alias("r")).select("fetch_key", "r.*")


def with_canonical_targets(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """Look up the response of each page's canonical; many pages may name one target, so the join splits it."""
    wanted = pages.filter(F.col("canonical").isNotNull() & ~F.col("canonical_is_self")).select("site", "page_id", fetch_key(F.col("canonical")).alias("fetch_key"))
    target = responses.select("fetch_key", F.struct("acquisition", "status", "n_hops", "validity", "title").alias("canonical_target"))
    found = join_on_hot_key(wanted, target, ["fetch_key"], ["page_id"]).drop("fetch_key")
    return pages.drop("canonical_target").join(found, ["site", "page_id"], "left")


# --- hreflang -----------------------------------------------------------------------------------------------------
def hreflang_problem(value: Column) -> Column:
    """EMPTY, FORM, LANGUAGE or REGION; NULL for a valid code."""

    def test(v: Column) -> Column:
        form = r"^([A-Za-z]{2})(?:-([A-Za-z]{4}))?(?:-([A-Za-z]{2}))?$"
        language, region = F.lower(F.regexp_extract(v, form, 1)), F.upper(F.regexp_extract(v, form, 3))
        return choose(
            (v == "", "EMPTY"), (F.lower(v) == "x-default", None), (~v.rlike(form), "FORM"), (~language.isin(*registry.LANGUAGES), "LANGUAGE"),
            ((region != "") & ~region.rlike(registry.REGION_PATTERN), "REGION"),
        )

    return let(F.trim(value), test)


def annotations(pages: DataFrame) -> DataFrame:
    """Hreflang rows of the best profile and of RAW, each pair of code and address once."""
    none = F.array().cast("array<struct<hreflang:string,href:string,source:string>>")
    both = F.concat(F.coalesce(F.col("best")["hreflang"], none), F.coalesce(F.when(F.col("raw_valid"), F.col("raw_facts")["hreflang"]), none))
    pairs = F.array_distinct(F.transform(both, lambda h: F.struct(h["hreflang"].alias("hreflang"), h["href"].alias("href"))))
    canonical = F.coalesce(F.get(F.when(F.col("raw_valid"), F.col("raw_facts")["canonical_head"]), F.lit(0)), F.get(F.col("best")["canonical_head"], F.lit(0)))
    base = F.coalesce(resolve_http(F.col("best")["base_href"], F.col("best_url")), F.col("best_url"))
    keyed = pages.filter(F.col("best_url").isNotNull()).withColumn("self_keys", F.filter(F.array(fetch_key(F.col("best_url")), fetch_key(F.col("url")), fetch_key(resolve_http(canonical, base))), lambda k: k.isNotNull()))
    return each(keyed, ["site", "page_id", "self_keys"], pairs, "h").select(
        "site", "page_id", "self_keys", "h.*", hreflang_problem(F.col("h.hreflang")).alias("problem"), fetch_key(F.col("h.href")).alias("fetch_key"),
        F.coalesce(F.array_contains("self_keys", fetch_key(F.col("h.href"))), F.lit(False)).alias("is_self"),
    )


def hreflang_results(rows: DataFrame, responses: DataFrame) -> DataFrame:
    """Per page: declared, invalid, self, alternates, tested, broken, no_return."""
    target = responses.select("fetch_key", F.struct("acquisition", "status", "validity", "alternates").alias("t"))
    joined = join_on_hot_key(rows, target, ["fetch_key"], ["page_id"])
    alternate = ~F.col("is_self") & F.col("href").rlike("(?i)^https?:")
    tested = alternate & F.coalesce((F.col("t.acquisition") == "OK") & (F.col("t.validity") != "ACCESS_CHALLENGE"), F.lit(False))
    broken = tested & (F.col("t.status") >= 400)
    readable = tested & ~broken & (F.col("t.validity") == "VALID_PAGE")
    back = F.coalesce(F.arrays_overlap("t.alternates", "self_keys"), F.lit(False))
    # One address may be annotated with several codes; alternates are counted by address.
    once = joined.groupBy("site", "page_id", "href").agg(
        F.count(F.lit(1)).alias("declared"), F.count_if(F.col("problem").isNotNull()).alias("invalid"), F.max("is_self").alias("is_self"),
        F.max(alternate).alias("alternate"), F.max(tested).alias("tested"), F.max(broken).alias("broken"), F.max(readable & ~back).alias("no_return"),
    )
    flag = lambda c: F.count_if(F.col(c)).alias
    return once.groupBy("site", "page_id").agg(
        F.sum("declared").alias("declared"), F.sum("invalid").alias("invalid"), flag("is_self")("self"), flag("alternate")("alternates"),
        flag("tested")("tested"), flag("broken")("broken"), flag("no_return")("no_return"),
    )


def with_hreflang(pages: DataFrame, responses: DataFrame) -> DataFrame:
    found = hreflang_results(annotations(pages), responses)
    fields = [c for c in found.columns if c not in ("site", "page_id")]
    return pages.drop("hreflang_result").join(found.select("site", "page_id", F.struct(*fields).alias("hreflang_result")), ["site", "page_id"], "left")


# --- internal link targets -----------------------------------------------------------------------------------------
def link_rows(pages: DataFrame, facts: str = "best") -> DataFrame:
    return each(pages, ["site", "page_id"], F.col(facts)["links"], "l").select("site", "page_id", "l.*")


def link_rollup(links: DataFrame) -> DataFrame:
    """One row per site and target: links, pages, any navigation link, text of the first anchor.

    Rows are combined per (site, target, page) first, so a target linked from every page arrives at its final
    task as one small row per map task.
    """
    usable = links.filter(F.col("crawlable") & F.col("internal"))
    per_page = usable.groupBy("site", "url", "page_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("zone") == "nav").alias("nav"), F.min_by("text", "pos").alias("text"))
    return per_page.groupBy("site", "url").agg(
        F.sum("n").alias("n_links"), F.count(F.lit(1)).alias("n_pages"), F.max("nav").alias("in_nav"), F.min_by("text", "page_id").alias("text"),
    )


def sources_of(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Pages that link to `targets` (site, url, ...), with the targets' columns."""
    rows = links.filter("crawlable AND internal").select("site", "page_id", fetch_key(F.col("url")).alias("url")).distinct()
    return join_on_hot_key(rows, targets.withColumn("url", fetch_key(F.col("url"))).distinct(), ["site", "url"], ["page_id"], "inner")  # every page links home


def testable_targets(rollup: DataFrame) -> DataFrame:
    """Targets worth testing: utility, search and file addresses are not, legal pages are."""
    why = exclusion_reason(F.col("url"))
    return rollup.withColumn("_why", why).filter(F.col("_why").isNull() | F.col("_why").startswith("LEGAL")).drop("_why")


def top_targets(rollup: DataFrame, sampled: DataFrame, k: int = registry.BUDGETS["max_internal_link_targets"]) -> DataFrame:
    """First k targets per site: sampled pages, then navigation, then most linked, then by address."""
    keys = sampled.select("site", fetch_key(F.col("url")).alias("url")).distinct().withColumn("sampled", F.lit(1))
    marked = rollup.join(keys, ["site", "url"], "left").na.fill(0, ["sampled"])
    return best_per_group(marked, ["site"], [F.desc("sampled"), F.desc("in_nav"), F.desc("n_links"), F.col("url")], k)


def tested_targets(targets: DataFrame, responses: DataFrame) -> DataFrame:
    """Outcome per chosen target: BROKEN, REDIRECTED, OK or UNTESTED."""
    r = responses.select("fetch_key", "acquisition", "status", "n_hops", "validity")
    joined = targets.withColumn("fetch_key", fetch_key(F.col("url"))).join(r, "fetch_key", "left")
    out = choose(
        (F.col("acquisition").isNull() | (F.col("acquisition") != "OK") | (F.col("validity") == "ACCESS_CHALLENGE") | (F.col("status") == 429), "UNTESTED"),
        (F.col("status").isin(404, 410) | (F.col("status") >= 500), "BROKEN"), ((F.col("n_hops") > 0) & (F.col("status") == 200), "REDIRECTED"), default="OK",
    )
    return joined.withColumn("outcome", out)


def link_target_units(outcomes: DataFrame, sites: DataFrame) -> DataFrame:
    """O-2.6, one unit per site."""
    per_site = outcomes.groupBy("site").agg(
        F.count(F.lit(1)).alias("targets"), F.count_if(F.col("outcome") != "UNTESTED").alias("tested"),
        F.count_if(F.col("outcome") == "BROKEN").alias("broken"), F.count_if(F.col("outcome") == "REDIRECTED").alias("redirected"),
    )
    return sites.select("site").distinct().join(per_site, "site", "left").na.fill(0, ["targets", "tested", "broken", "redirected"])


def extra_rendered_links(pages: DataFrame) -> DataFrame:
    """Links of the rendered navigation or main part that RAW lacks, in long form (anti join per page)."""
    important = link_rows(pages.filter(F.col("pair_gate").isNull()), "dom_facts").filter(F.col("crawlable") & F.col("internal") & F.col("zone").isin("nav", "main")).select("site", "page_id", "url").distinct()
    raw = link_rows(pages, "raw_facts").filter("crawlable").select("site", "page_id", "url").distinct()
    return important.join(raw, ["site", "page_id", "url"], "left_anti")


def response_after_redirect(pages: DataFrame) -> DataFrame:
    """Window form of redirect facts: hop count, loop, downgrade."""
    hops = pages.select("site", "page_id", F.posexplode_outer("hops").alias("hop_no", "h"))
    w = Window.partitionBy("site", "page_id").orderBy("hop_no")
    rows = hops.select("site", "page_id", "hop_no", F.col("h.url").alias("url"), F.col("h.location").alias("location"), F.lead("h.url").over(w).alias("next_url"))
    return rows.groupBy("site", "page_id").agg(
        F.count("url").alias("n_hops"), (F.count("url") > F.count_distinct("url")).alias("loops"),
        F.max(F.coalesce(F.col("url").startswith("https:") & F.col("location").startswith("http:"), F.lit(False))).alias("downgrade"),
        (F.count("url") > registry.BUDGETS["max_redirects"]).alias("too_many"),
        F.count_if(F.col("next_url").isNotNull() & ~same_url(F.col("location"), F.col("next_url"))).alias("broken_steps"),
    )
