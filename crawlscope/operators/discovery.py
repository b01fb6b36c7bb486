"""Candidates, path signatures and the representative sample of every site, all sites in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as P

from crawlscope.functions.sql import F

from crawlscope import registry
from crawlscope.functions.expr import choose, let
from crawlscope.functions.urls import (
    ZONES, alias_hosts, exclusion_reason, fetch_key, host_of, is_section_hub, origin_of, page_type, path_of, query_keys, segments, split_extension,
    type_rank, url_parts, zone_rank,
)
from crawlscope.operators.sampling import sample  # noqa: F401
from crawlscope.operators.skew import best_per_group, heavy_from_counts, join_on_hot_key

B = registry.BUDGETS
ORDER = ["zone_rank", "type_rank", "depth", "url"]


# --- preferred origin ------------------------------------------------------------------------------------------
def preferred_origins(responses: DataFrame) -> DataFrame:
    """Homepage responses per seed -> preferred origin with a note.

    Input: seed, url, acquisition, final_url. An HTTPS answer wins over the HTTP fallback.
    """
    home = responses.filter((path_of(F.col("url")) == "/") & (F.coalesce(url_parts(F.col("url"))["query"], F.lit("")) == ""))
    answered = F.col("acquisition") == "OK"
    rank = F.struct(F.when(answered & F.col("final_url").isNotNull(), 0).otherwise(1), F.when(F.col("url").startswith("https:"), 0).otherwise(1), F.col("url"))
    best = home.groupBy("seed").agg(F.min_by(F.struct("url", "acquisition", "final_url"), rank).alias("r")).select("seed", "r.*")
    target = F.when(answered & F.col("final_url").isNotNull(), origin_of(F.col("final_url")))
    note = choose(
        (F.col("preferred_origin").isNull(), "NO_ORIGIN"), (F.col("preferred_origin") == origin_of(F.col("url")), "DIRECT"),
        (alias_hosts(host_of(F.col("preferred_origin")), host_of(F.col("url"))), "REDIRECT_SAME_SITE"), default="REDIRECT_OTHER_HOST",
    )
    return best.withColumn("preferred_origin", target).select("seed", "url", "preferred_origin", note.alias("origin_note"), F.col("url").startswith("http:").alias("http_fallback"))


def by_suffix(host: Column, rules: list[str]) -> Column:
    """Registrable domain of a host by the longest public suffix, from rules with *. and ! forms.

    The rules are three hash sets inside the projection, so nothing is joined and no ending is a hot key.
    """
    sets = [[r.removeprefix(form).lower() for r in rules if r.startswith(form) and (form or r[:1] not in "*!")] for form in ("!", "*.", "")]
    low = P.lower(host)
    labels = P.split(low, r"\.")
    n = P.size(labels)
    tails = P.transform(P.sequence(P.lit(1), n), lambda i: P.struct((n - i + 1).alias("size"), P.array_join(P.slice(labels, i, n), ".").alias("name")))
    longest = lambda names, more: P.array_max(P.transform(P.filter(tails, lambda t: t["name"].isin(names)), lambda t: t["size"] + more))
    # A wildcard takes one label more, an exception one label less and goes before all others.
    wild = P.array_max(P.filter(P.array(longest(sets[1], 1)), lambda w: w <= n))
    width = P.coalesce(longest(sets[0], -1), P.greatest(wild, longest(sets[2], 0)), P.lit(1)) + 1
    address = low.rlike(r"^\[|^\d{1,3}(\.\d{1,3}){3}$")
    return P.when(~address & (n >= width), P.array_join(P.slice(labels, n - width + 1, width), "."))


def with_registrable(rows: DataFrame, suffixes: DataFrame, host: str = "host", most: int = 1 << 16) -> DataFrame:
    """Add `registrable` in a projection. `suffixes` has one rule per row; the list is fixed and far below `most` rules, beyond which this stops."""
    rules = [r.suffix for r in suffixes.select("suffix").filter("suffix IS NOT NULL").distinct().limit(most + 1).collect()]
    if len(rules) > most:
        raise ValueError(f"more than {most} suffix rules")
    return rows.withColumn("registrable", by_suffix(P.col(host), sorted(rules)))


def registrable_domains(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """host, registrable of each host name once; addresses are left out."""
    names = hosts.select(P.lower("host").alias("host")).filter(~P.col("host").rlike(r"^\[|^\d{1,3}(\.\d{1,3}){3}$")).distinct()
    return with_registrable(names, suffixes)


# --- candidates --------------------------------------------------------------------------------------------------
def usable_edges(links: DataFrame, cap: int = B["max_links_per_document"]) -> DataFrame:
    """Internal crawlable links per document and profile, navigation and main content first, at most `cap`."""
    inner = links.filter(F.col("crawlable") & F.col("internal")).withColumn("zone_rank", zone_rank(F.col("zone")))
    tie = [F.col("page_id")] if "page_id" in links.columns else []
    return best_per_group(inner, ["site", "from_key", "profile"], [F.col("zone_rank"), F.col("pos"), *tie], cap, "link_no")


def merge_candidates(found: DataFrame) -> DataFrame:
    """One row per site and URL: best zone, first non-empty text, smallest depth, profiles it was seen in."""
    # A document recorded several times has several links at one place; the smallest page is the first.
    tie = ["page_id"] if "page_id" in found.columns else []
    first = F.struct("depth", F.when(F.col("profile") == "RAW", 0).otherwise(1), "from_key", "pos", *tie)
    merged = found.groupBy("site", "url").agg(
        F.min("zone_rank").alias("zone_rank"), F.min_by(F.nullif("text", F.lit("")), F.when(F.col("text") != "", first)).alias("text"),
        F.min("depth").alias("depth"), F.bool_or(F.col("profile") == "RAW").alias("in_raw"), F.bool_or(F.col("profile") == "RENDERED").alias("in_rendered"),
        F.min_by("from_key", first).alias("discovered_from"),
    )
    kind = page_type(F.col("url"), F.col("text"))
    return merged.withColumns({"text": F.coalesce("text", F.lit("")), "page_type": kind, "excluded": exclusion_reason(F.col("url"))}).withColumns({
        "zone": F.element_at(F.array(*[F.lit(z) for z in ZONES]), F.col("zone_rank").cast("int")), "type_rank": type_rank(F.col("page_type")),
    })


def ordered(col: str = "url") -> list[Column]:
    return [F.col("zone_rank"), F.col("type_rank"), F.col("depth"), F.col(col)]


def expand(edges: DataFrame, homes: DataFrame, blocked: DataFrame | None = None, hubs: int = B["max_section_hubs"]) -> DataFrame:
    """Homepage links (depth 1) and links of the best section hubs (depth 2), merged per URL.

    `homes`: site, home_key. `blocked`: (site, url) the auditor may not fetch. The edge table is read twice by its
    document key; hubs are at most `hubs` per site.
    """
    # The homepage itself and the bare root are not candidates.
    targets = edges.filter(F.col("from_key").isNotNull() & ((path_of(F.col("url")) != "/") | (F.coalesce(url_parts(F.col("url"))["query"], F.lit("")) != "")))
    first = targets.join(homes.select("site", F.col("home_key").alias("from_key")), ["site", "from_key"], "left_semi").withColumn("depth", F.lit(1))
    level1 = merge_candidates(first)
    open_hubs = level1.filter(F.col("excluded").isNull() & (F.col("zone") != "footer") & is_section_hub(F.col("url"), F.col("page_type")))
    if blocked is not None:
        open_hubs = open_hubs.join(blocked.select("site", "url"), ["site", "url"], "left_anti")
    chosen = best_per_group(open_hubs, ["site"], ordered(), hubs, "hub_no").select("site", F.col("url").alias("from_key"))
    second = targets.join(chosen, ["site", "from_key"], "left_semi").withColumn("depth", F.lit(2))
    return merge_candidates(first.unionByName(second)).join(homes.select("site", F.col("home_key").alias("url")), ["site", "url"], "left_anti")


def with_fallback(candidates: DataFrame, responses: DataFrame, sites: DataFrame, minimum: int = 4) -> DataFrame:
    """Add fixed paths that answered with a genuine page, for sites with fewer than `minimum` usable candidates."""
    usable = candidates.groupBy("site").agg(F.count_if(F.col("excluded").isNull()).alias("n"))
    poor = sites.select("site").distinct().join(usable, "site", "left").filter(F.coalesce("n", F.lit(0)) < minimum)
    probes = poor.select("site", F.explode(F.array(*[F.concat("site", F.lit(p)) for p in registry.FALLBACK_PATHS])).alias("probe"))
    genuine = responses.filter("acquisition = 'OK' AND status = 200 AND validity = 'VALID_PAGE'").select(F.col("fetch_key").alias("probe"), "final_url")
    found = probes.join(genuine, "probe").select("site", fetch_key(F.coalesce("final_url", "probe")).alias("url")).distinct().join(candidates, ["site", "url"], "left_anti")
    kind = page_type(F.col("url"))
    added = found.select(
        "site", "url", F.lit(4).alias("zone_rank"), F.lit("").alias("text"), F.lit(1).alias("depth"), F.lit(False).alias("in_raw"), F.lit(False).alias("in_rendered"),
        F.lit("fixed path").alias("discovered_from"), kind.alias("page_type"), exclusion_reason(F.col("url")).alias("excluded"), F.lit("other").alias("zone"), type_rank(kind).alias("type_rank"),
    )
    return candidates.unionByName(added)


def cap_query_variants(candidates: DataFrame, k: int = B["max_query_variants_per_path"]) -> DataFrame:
    """Exclude all but the first k query variants of a path. Excluded rows count towards k as well."""
    keyed = candidates.withColumn("_path", F.when(F.coalesce(url_parts(F.col("url"))["query"], F.lit("")).rlike(r"^\?."), F.concat(origin_of(F.col("url")), path_of(F.col("url")))))
    kept = best_per_group(keyed.filter("_path IS NOT NULL"), ["site", "_path"], ordered(), k, "_no").select("site", "url", F.lit(True).alias("_within"))
    marked = keyed.join(kept, ["site", "url"], "left")
    over = F.col("_path").isNotNull() & F.col("_within").isNull()
    return marked.withColumn("excluded", F.coalesce("excluded", F.when(over, F.lit("QUERY_VARIANT")))).drop("_path", "_within")


# --- signatures --------------------------------------------------------------------------------------------------
def locale_prefixes(annotations: DataFrame) -> DataFrame:
    """First path segments that hreflang annotations prove to be locales. Input: site, hreflang, href."""
    seg = F.lower(F.get(segments(F.col("href")), F.lit(0)))
    rows = annotations.withColumn("locale", seg).filter(F.col("locale").rlike("^[a-z]{2,3}(-[a-z0-9]{2,4})?$") & F.lower("hreflang").startswith(F.substring("locale", 1, 2)))
    # The pattern bounds a locale to a handful of letters; per site the set is a few entries.
    return rows.groupBy("site").agg(F.array_sort(F.collect_set("locale")).alias("locales"))


def _wildcard(seg: Column, i: Column, locales: Column) -> Column:
    def by_stem(parts: Column) -> Column:
        stem, ext = parts["stem"], parts["ext"]
        return choose(
            ((i == 0) & F.coalesce(F.array_contains(locales, F.lower(seg)), F.lit(False)), "{locale}"),
            (stem.rlike(r"^\d+$"), F.concat(F.lit("{n}"), ext)),
            (stem.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.concat(F.lit("{uuid}"), ext)),
            (stem.rlike(r"(?i)^[0-9a-f]{16,}$"), F.concat(F.lit("{hash}"), ext)),
            default=seg,
        )

    return let(split_extension(seg), by_stem)


def signatures(urls: DataFrame, locales: DataFrame | None = None) -> DataFrame:
    """Add `signature` to a table with site and url (each URL once).

    A final slug becomes a wildcard when its parent has two distinct leaves. Two leaves differ exactly when the
    smallest and the largest do, so the test is one combinable aggregate; it is joined back on the parent, which
    may be hot, with that key spread.
    """
    none = F.array().cast("array<string>")
    with_locales = join_on_hot_key(urls, locales, ["site"], ["url"]) if locales is not None else urls.withColumn("locales", none)
    shaped = with_locales.withColumn("_segs", let(F.struct(segments(F.col("url")).alias("s"), F.coalesce("locales", none).alias("l")), lambda x: F.transform(x["s"], lambda seg, i: _wildcard(seg, i, x["l"]))))
    shaped = shaped.withColumns({
        "_parent": F.when(F.size("_segs") >= 2, F.concat(origin_of(F.col("url")), F.lit("/"), F.array_join(F.slice("_segs", 1, F.size("_segs") - 1), "/"))),
        "_leaf": F.try_element_at(F.col("_segs"), F.lit(-1)),
        "_query": let(F.array_sort(F.array_distinct(query_keys(F.col("url")))), lambda k: F.when(F.size(k) > 0, F.concat(F.lit("?"), F.array_join(k, "&"))).otherwise(F.lit(""))),
    })
    parents = shaped.filter("_parent IS NOT NULL").groupBy("site", "_parent").agg((F.min("_leaf") != F.max("_leaf")).alias("_many"), F.count(F.lit(1)).alias("_rows"))
    # The aggregate knows how many rows each parent has, so heavy parents need no pass of their own.
    hot = heavy_from_counts(parents, ["site", "_parent"])
    joined = join_on_hot_key(shaped, parents.drop("_rows"), ["site", "_parent"], ["url"], "left", hot)
    slug = F.col("_parent").isNotNull() & F.coalesce("_many", F.lit(False)) & ~F.col("_leaf").startswith("{")
    last = F.when(slug, F.concat(F.lit("{slug}"), split_extension(F.col("_leaf"))["ext"])).otherwise(F.col("_leaf"))
    body = F.when(F.size("_segs") > 0, F.array_join(F.concat(F.slice("_segs", 1, F.size("_segs") - 1), F.array(last)), "/")).otherwise(F.lit(""))
    return joined.withColumn("signature", F.concat(F.lit("/"), body, F.col("_query"))).drop("_segs", "_parent", "_leaf", "_query", "_many", "locales")


def signature_groups(signed: DataFrame, examples: int = 3) -> DataFrame:
    """Size and first example URLs per signature."""
    counts = signed.groupBy("site", "signature").agg(F.count(F.lit(1)).alias("n_urls"))
    first = best_per_group(signed.select("site", "signature", "url"), ["site", "signature"], [F.col("url")], examples)
    shown = first.groupBy("site", "signature").agg(F.array_join(F.array_sort(F.collect_list("url")), " ").alias("examples"))
    return counts.join(shown, ["site", "signature"])


def url_universe(candidates: DataFrame, homes: DataFrame, supplied: DataFrame) -> DataFrame:
    return candidates.select("site", "url").union(homes.select("site", F.col("home_key"))).union(supplied.select("site", fetch_key(F.col("url")))).distinct()


# --- verification and sample -----------------------------------------------------------------------------------------
def verify(candidates: DataFrame, responses: DataFrame, taken: DataFrame) -> DataFrame:
    """Add verification (verified, failed, alias, unverified) and final_key. `taken`: site, url already in the sample."""
    r = responses.select(F.col("fetch_key").alias("url"), "acquisition", "status", "validity", "final_url")
    joined = candidates.join(r, "url", "left").withColumn("final_key", F.coalesce(fetch_key(F.col("final_url")), F.col("url")))
    known = taken.select("site", fetch_key(F.col("url")).alias("final_key")).distinct().withColumn("_taken", F.lit(True))
    joined = join_on_hot_key(joined, known, ["site", "final_key"], ["url"], "left")  # many links may redirect to one page
    moved = F.col("final_key") != F.col("url")
    state = choose(
        (F.col("acquisition").isNull(), "unverified"), (F.coalesce(F.col("validity") == "ACCESS_CHALLENGE", F.lit(False)), "verified"),
        ((F.col("acquisition") != "OK") | F.coalesce(F.col("status") != 200, F.lit(True)) | (F.col("validity") != "VALID_PAGE"), "failed"),
        (moved & ~alias_hosts(host_of(F.col("final_key")), host_of(F.col("site"))), "failed"), (F.coalesce("_taken", F.lit(False)), "alias"), default="verified",
    )
    return joined.withColumn("verification", state).drop("acquisition", "status", "validity", "final_url", "_taken")


def review_list(sampled: DataFrame, candidates: DataFrame) -> DataFrame:
    """Proposed pages, then candidates not proposed and not aliases."""
    proposed = sampled.select("site", "url", F.lit("proposed").alias("source"), "reason")
    rest = candidates.filter("verification <> 'alias'").join(sampled.select("site", "url"), ["site", "url"], "left_anti")
    return proposed.unionByName(rest.select("site", "url", F.lit("candidate").alias("source"), F.coalesce("excluded", "verification").alias("reason")))


def apply_selection(chosen: DataFrame, proposed: DataFrame, candidates: DataFrame, size: int = B["max_selected_pages"]) -> DataFrame:
    """Operator's list merged with earlier proposals. `chosen`: site, position, url."""
    keyed = chosen.withColumn("url", fetch_key(F.col("url"))).filter("url IS NOT NULL").groupBy("site", "url").agg(F.min("position").alias("position"))
    first = best_per_group(keyed, ["site"], [F.col("position"), F.col("url")], size, "slot")
    p = proposed.select("site", "url", F.struct("page_type", "signature", "reason").alias("p"))
    c = candidates.select("site", "url", F.struct("page_type", "signature").alias("c"))
    joined = first.join(p, ["site", "url"], "left").join(c, ["site", "url"], "left")
    return joined.select(
        "site", "slot", "url", F.coalesce("p.page_type", "c.page_type", page_type(F.col("url"))).alias("page_type"),
        F.coalesce("p.signature", "c.signature", path_of(F.col("url"))).alias("signature"),
        choose((F.col("p").isNotNull(), F.col("p.reason")), (F.col("c").isNotNull(), "candidate chosen by the operator"), default="added by the operator").alias("reason"),
    )

