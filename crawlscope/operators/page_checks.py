"""All PAGE rules as one projection: a wide page row in, an array of check units out, exploded once.

Facts of both profiles, states, robots decisions and looked-up targets sit in the row already, so evaluating the
rules costs no shuffle however many rules there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from crawlscope.functions.sql import F

from crawlscope import registry
from crawlscope.functions.expr import choose, let, when_array
from crawlscope.functions.text import norm, truncate
from crawlscope.functions.urls import fetch_key, page_type, resolve_http, same_url
from crawlscope.operators import directives, structured
from crawlscope.operators.facts import insecure_counts  # noqa: F401
from crawlscope.operators.gates import hops_text, profile_label

FAIL_CODES = [r[0] for r in registry.REASONS if r[2] == "FAIL"]
NONE = F.lit(None).cast("string")
SIGNIFICANT = 40
SECURITY_HEADERS = ["strict-transport-security", "content-security-policy", "x-content-type-options", "referrer-policy", "x-frame-options"]


def unit(
    check: str, *, gate: Column | None = None, reasons: Column | None = None, observed: Column | None = None, locator: str = "",
    profile: Column | str = "RAW", limitation: Column | None = None, missing: Column | None = None, derived: Column | None = None,
) -> Column:
    """One check unit. `gate` holds NOT_APPLICABLE / NOT_TESTABLE, or NULL when the check can run.

    Precedence: explicit status, derived status of unscored composites, FAIL, WARN, missing evidence, then PASS;
    a PASS without an observation is an ERROR of the tool.
    """
    codes = reasons if reasons is not None else F.array().cast("array<string>")
    seen = observed if observed is not None else NONE

    def build(p: Column) -> Column:
        status = choose(
            (p["gate"].isNotNull(), p["gate"]),
            (p["derived"].isNotNull(), p["derived"]),
            (F.exists(p["codes"], lambda c: c.isin(*FAIL_CODES)), "FAIL"),
            (F.size(p["codes"]) > 0, "WARN"),
            (F.coalesce(p["missing"], F.lit(False)), "NOT_TESTABLE"),
            (p["seen"].isNull(), "ERROR"),
            default="PASS",
        )
        keep = F.when(p["gate"].isNull(), p["codes"]).otherwise(F.array().cast("array<string>"))
        return F.struct(
            F.lit(check).alias("check_id"), status.alias("status"), keep.alias("reasons"),
            F.lit(locator).alias("locator"), truncate(p["seen"], 1200).alias("observed"),
            (profile if isinstance(profile, Column) else F.lit(profile)).alias("profile"), p["limitation"].alias("limitation"),
        )

    return let(F.struct(
        (gate if gate is not None else NONE).alias("gate"), (derived if derived is not None else NONE).alias("derived"),
        codes.alias("codes"), (missing if missing is not None else F.lit(False)).alias("missing"), seen.alias("seen"),
        (limitation if limitation is not None else NONE).alias("limitation"),
    ), build)


def with_best(pages: DataFrame) -> DataFrame:
    """Add `best`: facts of the rendered document when genuine, else of the raw one."""
    return pages.withColumns({
        "best": F.when(F.col("ren_valid"), F.col("dom_facts")).when(F.col("raw_valid"), F.col("raw_facts")),
        "best_url": F.when(F.col("ren_valid"), F.coalesce("dom_url", "url")).when(F.col("raw_valid"), F.coalesce("final_url", "url")),
        "best_profile": F.when(F.col("ren_valid"), F.lit("RENDERED")).when(F.col("raw_valid"), F.lit("RAW")),
    })


def _text(v: Column, default: str = "(none)") -> Column:
    return F.coalesce(v, F.lit(default))


# --- crawl and indexing ----------------------------------------------------------------------------------
def check_googlebot() -> Column:
    d = F.col("decisions")["Googlebot"]
    return unit(
        "C-1.2", gate=F.when(F.coalesce(d["decision"], F.lit("UNKNOWN")) == "UNKNOWN", F.lit("NOT_TESTABLE")),
        reasons=when_array(((d["decision"] == "DISALLOW") & ~F.col("intentional"), F.lit("GOOGLEBOT_DISALLOWED"))),
        observed=F.concat_ws(" ", d["decision"], d["rule"]), locator="robots.txt decision for Googlebot",
    )


def check_status() -> Column:
    s = F.coalesce(F.col("status"), F.lit(0))
    return unit(
        "C-1.3",
        gate=choose(
            (F.col("state") == "BLOCKED", "NOT_TESTABLE"), (F.col("acquisition") != "OK", "NOT_TESTABLE"),
            (F.coalesce(F.col("raw_validity") == "ACCESS_CHALLENGE", F.lit(False)), "NOT_TESTABLE"), (s == 429, "NOT_TESTABLE"),
        ),
        reasons=when_array(
            (s.isin(401, 403) & ~F.col("intentional"), F.lit("ACCESS_DENIED_STATUS")), (s.isin(404, 410), F.lit("NOT_FOUND_STATUS")),
            (s >= 500, F.lit("SERVER_ERROR_STATUS")), (~s.isin(200, 429, 401, 403, 404, 410) & (s < 500), F.lit("UNEXPECTED_STATUS")),
        ),
        observed=F.concat(F.lit("HTTP "), s.cast("string"), F.when(F.size("hops") > 0, F.concat(F.lit(" after "), hops_text(F.col("hops")))).otherwise(F.lit(""))),
        locator="HTTP status line",
    )


def check_redirects() -> Column:
    hops, n = F.col("hops"), F.size("hops")
    ok = F.col("acquisition") == "OK"
    ended = F.col("acquisition").isin("REDIRECT_LOOP", "TOO_MANY_REDIRECTS")
    downgrade = F.exists(hops, lambda h: h["url"].startswith("https:") & F.coalesce(h["location"].startswith("http:"), F.lit(False)))
    a, b = F.col("final_url"), F.col("dom_url")
    upgraded = a.startswith("http://") & (F.concat(F.lit("https://"), F.substring(a, 8, 1 << 20)) == b)
    moved = F.coalesce(F.col("raw_valid") & F.col("ren_valid") & ~upgraded & (fetch_key(a) != fetch_key(b)), F.lit(False))
    return unit(
        "C-1.5", gate=F.when((F.col("state") == "BLOCKED") | (~ok & ~ended), F.lit("NOT_TESTABLE")),
        reasons=when_array((ended, F.col("acquisition")), (ok & downgrade, F.lit("HTTPS_DOWNGRADE_REDIRECT")), (ok & (n > 2), F.lit("LONG_REDIRECT_CHAIN")), (ok & moved, F.lit("CLIENT_SIDE_REDIRECT"))),
        observed=F.concat_ws("; ", F.when(n > 0, hops_text(hops)).otherwise(F.lit("no server redirect")), F.col("acquisition"), a), locator="redirect chain",
    )


def canonical_facts(pages: DataFrame) -> DataFrame:
    """Resolved canonicals per page: declared_raw, raw_body, ren_head, invalid and the one to compare (`canonical`)."""
    doc = F.coalesce("final_url", "dom_url", "url")
    none = F.array().cast("array<string>")
    raw = F.when(F.col("raw_valid"), F.col("raw_facts"))
    dom = F.when(F.col("ren_valid"), F.col("dom_facts"))

    def resolved(values: Column, base: Column) -> Column:
        bound = let(F.struct(F.coalesce(values, none).alias("v"), base.alias("b")), lambda s: F.transform(s["v"], lambda v: resolve_http(v, s["b"])))
        return F.array_distinct(F.filter(bound, lambda u: u.isNotNull()))

    based = lambda facts: F.coalesce(resolve_http(facts["base_href"], doc), doc)
    out = pages.withColumns({
        "_raw_head": resolved(raw["canonical_head"], based(raw)), "_http": resolved(raw["canonical_http"], doc),
        "raw_body_canonicals": resolved(raw["canonical_body"], based(raw)), "ren_head_canonicals": resolved(dom["canonical_head"], based(dom)),
        "invalid_canonicals": let(doc, lambda d: F.filter(F.concat(F.coalesce(raw["canonical_head"], none), F.coalesce(dom["canonical_head"], none)), lambda v: resolve_http(v, d).isNull())),
        "doc_url": doc,
    })
    out = out.withColumn("declared_canonicals", F.array_distinct(F.concat("_raw_head", "_http")))
    chosen = choose(
        (F.size("declared_canonicals") == 1, F.get("declared_canonicals", F.lit(0))),
        ((F.size("declared_canonicals") == 0) & (F.size("ren_head_canonicals") == 1), F.get("ren_head_canonicals", F.lit(0))),
    )
    return out.withColumn("canonical", chosen).withColumn("canonical_is_self", same_url(F.col("canonical"), F.col("doc_url")))


def check_canonical() -> Column:
    declared, body, ren = F.col("declared_canonicals"), F.col("raw_body_canonicals"), F.col("ren_head_canonicals")
    raw_head, bad = F.col("_raw_head"), F.col("invalid_canonicals")
    away = F.col("canonical").isNotNull() & ~F.col("canonical_is_self")
    t = F.col("canonical_target")
    known = away & F.coalesce((t["acquisition"] == "OK") & (t["validity"] != "ACCESS_CHALLENGE"), F.lit(False))
    broken = known & (t["status"] >= 400)
    redirects = known & ~broken & (t["n_hops"] > 0)
    mine, theirs = F.lower(_text(F.col("best")["title"], "")), F.lower(_text(t["title"], ""))
    other = known & ~broken & ~redirects & (t["validity"] == "VALID_PAGE") & (mine != "") & (theirs != "") & (mine != theirs)
    return unit(
        "C-1.7", gate=F.col("gate"),
        reasons=when_array(
            (F.size(declared) > 1, F.lit("CANONICAL_CONFLICT")), ((F.size(raw_head) == 0) & (F.size(body) > 0), F.lit("CANONICAL_OUTSIDE_HEAD")),
            (F.size(bad) > 0, F.lit("CANONICAL_INVALID_VALUE")),
            ((F.size(raw_head) == 1) & (F.size(ren) == 1) & ~same_url(F.get(raw_head, F.lit(0)), F.get(ren, F.lit(0))), F.lit("CANONICAL_CHANGED_BY_JAVASCRIPT")),
            ((F.size(declared) == 0) & (F.size(body) == 0) & (F.size(ren) == 0) & (F.size(bad) == 0), F.lit("CANONICAL_MISSING")),
            (F.coalesce(broken, F.lit(False)), F.lit("CANONICAL_TARGET_BROKEN")), (F.coalesce(redirects, F.lit(False)), F.lit("CANONICAL_TARGET_REDIRECTS")),
            (F.coalesce(other, F.lit(False)), F.lit("CANONICAL_POINTS_TO_DIFFERENT_PAGE")),
        ),
        observed=F.concat(F.lit("declared: "), F.array_join(declared, ", "), F.lit(" | body: "), F.array_join(body, ", "), F.lit(" | rendered: "), F.array_join(ren, ", ")),
        locator="link[rel=canonical] / Link header", profile=F.col("best_profile"),
        limitation=F.when(away & ~known, F.lit("the canonical target has no usable recorded response")),
    )


def with_directives(pages: DataFrame) -> DataFrame:
    x = F.coalesce(F.when(F.col("raw_valid"), F.col("raw_facts")["x_robots"]), F.col("dom_facts")["x_robots"])
    raw = F.when(F.col("raw_valid"), directives.effective(F.col("raw_facts")["meta_robots"], x))
    dom = F.when(F.col("ren_valid"), directives.effective(F.col("dom_facts")["meta_robots"], x))
    return pages.withColumns({"raw_directives": raw, "dom_directives": dom, "best_directives": F.when(F.col("ren_valid"), dom).otherwise(raw)})


def check_indexing() -> Column:
    raw, dom = F.col("raw_directives"), F.col("dom_directives")
    either = lambda k: F.coalesce(raw[k], F.lit(False)) | F.coalesce(dom[k], F.lit(False))
    return unit(
        "C-1.8", gate=F.col("gate"),
        reasons=when_array((either("noindex") & ~F.col("intentional"), F.lit("UNEXPECTED_NOINDEX")), (either("nofollow") & ~F.col("intentional"), F.lit("PAGE_LEVEL_NOFOLLOW"))),
        observed=F.concat(F.lit("RAW "), _text(F.to_json(raw), "n/a"), F.lit(" | RENDERED "), _text(F.to_json(dom), "n/a")),
        locator="robots meta / X-Robots-Tag", profile=F.col("best_profile"),
    )


def check_snippets() -> Column:
    d = F.col("best_directives")
    wanted = (F.col("goal") == "search_ai_discovery") & ~F.col("intentional")
    return unit(
        "C-1.9", gate=F.col("gate"), reasons=when_array((F.coalesce(d["nosnippet"], F.lit(False)) & wanted, F.lit("SNIPPET_DISABLED"))),
        observed=F.concat(F.lit("nosnippet "), d["nosnippet"].cast("string"), F.lit("; max-snippet "), _text(d["max_snippet"].cast("string"), "not set"), F.lit("; data-nosnippet "), F.col("best")["nosnippet_count"].cast("string")),
        locator="snippet controls", profile=F.col("best_profile"),
    )


# --- on-page ----------------------------------------------------------------------------------------------
def check_title() -> Column:
    t = F.col("best")["title"]
    return unit("O-2.1", gate=F.col("gate"), reasons=when_array((t.isNull(), F.lit("TITLE_MISSING"))), observed=_text(t), locator="head > title", profile=F.col("best_profile"),
                limitation=F.when((F.length(t) > 70) | (F.length(t) < 15), F.format_string("length %d, advisory only", F.length(t))))


def check_description() -> Column:
    d = F.col("best")["meta_description"]
    return unit("O-2.2", gate=F.col("gate"), reasons=when_array((d.isNull(), F.lit("META_DESCRIPTION_MISSING"))), observed=_text(d), locator="meta[name=description]", profile=F.col("best_profile"))


def check_h1() -> Column:
    h = F.filter(F.col("best")["h1"], lambda x: x != "")
    return unit("O-2.3", gate=F.col("gate"), reasons=when_array((F.size(h) == 0, F.lit("H1_MISSING"))), observed=F.concat(F.lit("h1: "), F.array_join(h, ", ")), locator="h1", profile=F.col("best_profile"))


def internal_targets(facts: Column, zones: tuple[str, ...] | None = None) -> Column:
    """Distinct crawlable internal link targets of a fact struct."""
    hit = F.filter(facts["links"], lambda x: x["crawlable"] & x["internal"] & (x["zone"].isin(*zones) if zones else F.lit(True)))
    return F.array_distinct(F.transform(hit, lambda x: x["url"]))


def check_internal_links() -> Column:
    own = fetch_key(F.col("best_url"))
    targets = let(own, lambda me: F.filter(internal_targets(F.col("best")), lambda u: u != me))
    controls = F.size("scripted_controls")
    return let(targets, lambda t: unit(
        "O-2.5", gate=F.col("gate"),
        reasons=when_array((controls > 0, F.lit("NAVIGATION_WITHOUT_HREF")), ((F.size(t) == 0) & (controls <= 0), F.lit("NO_CRAWLABLE_INTERNAL_LINKS"))),
        observed=F.concat(F.size(t).cast("string"), F.lit(" crawlable internal targets: "), F.array_join(F.slice(t, 1, 4), ", ")), locator="a[href]", profile=F.col("best_profile"),
    ))


# --- structured data ---------------------------------------------------------------------------------------
def with_nodes(pages: DataFrame) -> DataFrame:
    """Add `nodes` (graded JSON-LD nodes plus microdata and RDFa types) of the best document."""
    ld = F.coalesce(F.col("best")["json_ld"], F.array().cast("array<struct<raw:string,in_head:boolean>>"))
    tree = F.when(F.col("ren_valid"), F.col("dom_tree")).when(F.col("raw_valid"), F.col("raw_tree"))
    items = F.coalesce(tree["items"], F.array().cast("array<struct<format:string,type:string,props:map<string,string>>>"))
    paths = tree["item_paths"]
    other = F.transform(items, lambda i, at: let(structured.feature_of(F.array(i["type"])), lambda f: F.struct(
        F.array(i["type"]).alias("types"), f.alias("feature"),
        *[_missing_in_map(F.map_concat(i["props"], F.get(paths, at)), f, k) for k in (3, 5)],
        F.coalesce(*[F.when(f == d[0], F.element_at(i["props"], d[7])) for d in registry.FEATURES if d[7]]).alias("label"),
    )))
    return pages.withColumns({
        "nodes": F.concat(structured.graded_nodes(ld), other),
        "n_blocks": F.size(ld) + F.size(items), "n_broken_blocks": F.size(structured.broken_blocks(ld)),
    })


def _missing_in_map(props: Column, feature: Column, column: int) -> Column:
    out = F.lit(None).cast("array<string>")
    for d in registry.FEATURES:
        names = d[column].split()
        absent = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: ~F.coalesce(F.trim(F.element_at(props, n)) != "", F.lit(False))) if names else F.array().cast("array<string>")
        if column == 3 and d[4]:
            options = d[4].split()
            absent = F.concat(absent, F.when(~F.arrays_overlap(F.map_keys(props), F.array(*[F.lit(o) for o in options])), F.array(F.lit("one of " + " / ".join(options)))).otherwise(F.array().cast("array<string>")))
        out = F.when(feature == d[0], absent).otherwise(out)
    return F.coalesce(out, F.array().cast("array<string>")).alias("required" if column == 3 else "recommended")


def check_markup_syntax() -> Column:
    return unit("S-3.1", gate=F.coalesce(F.col("gate"), F.when(F.col("n_blocks") == 0, F.lit("NOT_APPLICABLE"))),
                reasons=when_array((F.col("n_broken_blocks") > 0, F.lit("STRUCTURED_DATA_PARSE_ERROR"))),
                observed=F.format_string("%d block(s), %d broken", "n_blocks", "n_broken_blocks"), locator="structured data", profile=F.col("best_profile"))


def check_features() -> Column:
    known = F.filter(F.col("nodes"), lambda n: n["feature"].isNotNull())
    code = lambda kind, n: F.concat(F.lit(f"MISSING_{kind}_"), F.upper(F.replace(n["feature"], F.lit(" "), F.lit("_"))))
    codes = F.array_distinct(F.filter(F.transform(known, lambda n: F.when(F.size(n["required"]) > 0, code("REQUIRED", n)).when(F.size(n["recommended"]) > 0, code("RECOMMENDED", n))), lambda c: c.isNotNull()))
    seen = F.array_join(F.transform(known, lambda n: F.concat(n["feature"], F.lit(": missing "), F.array_join(F.concat(n["required"], n["recommended"]), ", "))), " | ")
    return unit("S-3.2", gate=F.coalesce(F.col("gate"), F.when(F.size(known) == 0, F.lit("NOT_APPLICABLE"))), reasons=codes, observed=seen, locator="typed markup", profile=F.col("best_profile"))


def visible_haystack() -> Column:
    b = F.col("best")
    return F.lower(norm(F.concat_ws(" ", b["title"], F.transform(b["headings"], lambda h: h["text"]), F.array_join(F.coalesce(F.col("best_tree")["blocks"], F.array().cast("array<string>")), " "),
                                     F.transform(b["links"], lambda x: x["text"]), F.transform(b["images"], lambda i: F.coalesce(i["alt"], F.lit(""))))))


def check_markup_visible() -> Column:
    labels = F.filter(F.transform(F.col("nodes"), lambda n: n["label"]), lambda v: v.isNotNull() & (F.trim(v) != ""))
    hidden = let(visible_haystack(), lambda hay: F.filter(labels, lambda v: ~F.coalesce(hay.contains(F.lower(norm(v))), F.lit(False))))
    return let(F.struct(labels.alias("all"), hidden.alias("hidden")), lambda s: unit(
        "S-3.3", gate=F.coalesce(F.col("gate"), F.when(F.size(s["all"]) == 0, F.lit("NOT_APPLICABLE"))),
        reasons=when_array((F.size(s["hidden"]) > 0, F.lit("MARKUP_NOT_VISIBLE_ON_PAGE"))),
        observed=F.concat(F.lit("values: "), F.array_join(s["all"], " | "), F.lit("; not visible: "), F.array_join(s["hidden"], " | ")), locator="marked-up value versus visible text", profile=F.col("best_profile"),
    ))


def opportunity() -> Column:
    """Markup that a page of this type could carry and lacks, else NULL."""
    have = F.transform(F.col("nodes"), lambda n: n["feature"])
    kind = F.col("page_type")
    return choose(
        (kind.isin("homepage", "about") & ~F.coalesce(F.col("site_has_org"), F.lit(False)), "ORGANIZATION"),
        ((kind == "article") & ~F.coalesce(F.array_contains(have, "Article"), F.lit(False)), "ARTICLE"),
        ((kind == "author") & ~F.coalesce(F.array_contains(have, "Profile page"), F.lit(False)), "PROFILE_PAGE"),
    )


def check_opportunity() -> Column:
    want, kind = opportunity(), F.col("page_type")
    return unit("S-3.4", gate=F.col("gate"), reasons=when_array((want.isNotNull(), F.concat(F.lit("MARKUP_OPPORTUNITY_"), want))), observed=F.concat(F.lit("page type "), kind), locator="page type and markup", profile=F.col("best_profile"))


def markup_template() -> Column:
    """JSON template offered with S-3.4; values that must be checked by a person are named as such."""
    ask = lambda what: F.lit(f"REQUIRES VERIFIED VALUE: {what}")
    root = F.regexp_extract("best_url", "^https?://[^/]+", 0)
    head = F.coalesce(F.get(F.col("best")["h1"], F.lit(0)), F.col("best")["title"])
    context, kind = F.lit("https://schema.org").alias("@context"), F.col("page_type")
    person = F.struct(F.lit("Person").alias("@type"), F.coalesce(head, ask("person name")).alias("name"), ask("byline or credential").alias("description"))
    return (
        F.when(~F.coalesce(opportunity().isNotNull(), F.lit(False)), F.lit(None).cast("string"))
        .when(kind.isin("homepage", "about"), F.to_json(F.struct(context, F.lit("Organization").alias("@type"), F.concat(root, F.lit("/#organization")).alias("@id"), ask("legal or brand name").alias("name"), F.concat(root, F.lit("/")).alias("url"), ask("absolute logo URL").alias("logo"), F.array(ask("official profile URLs")).alias("sameAs"))))
        .when(kind == "article", F.to_json(F.struct(context, F.lit("Article").alias("@type"), F.coalesce(head, ask("article headline")).alias("headline"), F.struct(F.lit("Person").alias("@type"), ask("author name").alias("name"), ask("author page URL").alias("url")).alias("author"), ask("ISO 8601 date").alias("datePublished"), ask("ISO 8601 date").alias("dateModified"), F.array(ask("image URL")).alias("image"))))
        .when(kind == "author", F.to_json(F.struct(context, F.lit("ProfilePage").alias("@type"), person.alias("mainEntity"))))
    )


def check_hreflang() -> Column:
    h = F.col("hreflang_result")
    n = F.coalesce(h["declared"], F.lit(0))
    gate = F.coalesce(F.col("gate"), F.when((n == 0) & F.col("multilingual"), F.lit("NOT_TESTABLE")), F.when(n == 0, F.lit("NOT_APPLICABLE")))
    return unit(
        "S-3.5", gate=gate,
        reasons=when_array((h["invalid"] > 0, F.lit("HREFLANG_INVALID_CODE")), (h["self"] == 0, F.lit("HREFLANG_NO_SELF_REFERENCE")), (h["broken"] > 0, F.lit("HREFLANG_TARGET_BROKEN")), (h["no_return"] > 0, F.lit("HREFLANG_NO_RETURN_LINK"))),
        observed=F.concat(F.lit("hreflang "), F.to_json(h)), locator="hreflang annotations", profile=F.col("best_profile"),
        missing=(h["alternates"] > 0) & (h["tested"] == 0),
        limitation=F.when(h["tested"] < h["alternates"], F.format_string("%d of %d alternates tested", h["tested"].cast("int"), h["alternates"].cast("int"))),
    )


# --- rendering pair ------------------------------------------------------------------------------------------
def _compared(observed: Column) -> Column:
    """What a comparison saw; nothing unless both documents are genuine."""
    return F.when(F.col("pair_gate").isNull(), observed)


def check_main_text() -> Column:
    blocks = F.filter(F.transform(F.col("dom_tree")["blocks"], norm), lambda b: F.length(b) >= SIGNIFICANT)
    chars = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + F.length(b))
    # Containing the whole block implies containing its first 60 characters.
    absent = let(F.col("raw_facts")["visible_text"], lambda hay: F.filter(blocks, lambda b: ~hay.contains(F.substring(F.lower(b), 1, 60))))
    return let(F.struct(chars(blocks).alias("total"), chars(absent).alias("absent"), F.size(blocks).alias("n")), lambda s: unit(
        "A-5.1", gate=choose((F.col("pair_gate").isNotNull(), "NOT_TESTABLE"), (F.col("dom_tree")["confidence"] == "low", "NOT_TESTABLE")),
        reasons=when_array(((s["total"] >= 200) & (s["absent"] >= 300) & (s["absent"] > s["total"] * 0.5), F.lit("PRIMARY_CONTENT_REQUIRES_RENDERING"))),
        observed=_compared(F.format_string("%d of %d characters in %d rendered blocks absent from RAW", s["absent"], s["total"], s["n"])), locator="main text, RAW versus RENDERED",
    ))


def check_main_links() -> Column:
    important = internal_targets(F.col("dom_facts"), ("nav", "main"))
    raw = F.transform(F.filter(F.col("raw_facts")["links"], lambda x: x["crawlable"]), lambda x: x["url"])
    return let(F.struct(F.size(important).alias("n"), F.size(F.array_except(important, raw)).alias("missing")), lambda s: unit(
        "A-5.2", gate=choose((F.col("pair_gate").isNotNull(), "NOT_TESTABLE"), (s["n"] <= 0, "NOT_APPLICABLE")),
        reasons=when_array(((s["missing"] >= 3) & (s["missing"] > s["n"] * 0.5), F.lit("IMPORTANT_LINKS_REQUIRE_RENDERING"))),
        observed=_compared(F.format_string("%d of %d targets absent from RAW", s["missing"], s["n"])), locator="main links, RAW versus RENDERED",
    ))


def check_search_crawlers() -> Column:
    scored = [b[0] for b in registry.BOTS if b[3]]
    d = {t: F.coalesce(F.col("decisions")[t]["decision"], F.lit("UNKNOWN")) for t in scored}
    blocked = F.greatest(*[(v == "DISALLOW") for v in d.values()])
    unknown = F.greatest(*[(v == "UNKNOWN") for v in d.values()])
    off = (F.col("goal") != "search_ai_discovery") | F.col("intentional")
    return unit(
        "A-5.3", gate=choose((off, "NOT_APPLICABLE"), (unknown & ~blocked, "NOT_TESTABLE")), reasons=when_array((blocked, F.lit("SEARCH_CRAWLER_DISALLOWED"))),
        observed=F.concat_ws(" | ", *[F.concat(F.lit(t + ": "), v) for t, v in d.items()]), locator="robots.txt decisions for search crawlers",
    )


def check_parity() -> Column:
    raw, dom = F.col("raw_facts"), F.col("dom_facts")
    types = lambda f: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(f["json_ld"], lambda b: F.flatten(F.transform(structured.typed_nodes(F.try_parse_json(b["raw"])), lambda n: n["types"])))))), ",")
    x = raw["x_robots"]
    pairs = {
        "title": (_text(raw["title"]), _text(dom["title"])), "h1": (_text(F.get(raw["h1"], F.lit(0))), _text(F.get(dom["h1"], F.lit(0)))),
        "canonical": (_text(F.get(raw["canonical_head"], F.lit(0))), _text(F.get(dom["canonical_head"], F.lit(0)))),
        "noindex": (directives.effective(raw["meta_robots"], x)["noindex"].cast("string"), directives.effective(dom["meta_robots"], x)["noindex"].cast("string")),
        "types": (types(raw), types(dom)),
    }
    return let(when_array(*[(a != b, F.lit(name)) for name, (a, b) in pairs.items()]), lambda diff: unit(
        "A-5.5", gate=F.when(F.col("pair_gate").isNotNull(), F.lit("NOT_TESTABLE")), reasons=when_array((F.size(diff) > 0, F.lit("SIGNALS_DIFFER_AFTER_RENDERING"))),
        observed=_compared(F.concat(F.lit("different: "), F.array_join(diff, ", "))), locator="signals, RAW versus RENDERED",
    ))


# --- experience and transport ----------------------------------------------------------------------------------
def viewport_reasons(v: Column) -> Column:
    device = F.coalesce(v.rlike(r"(?i)width\s*=\s*device-width"), F.lit(False))
    locked = F.coalesce(v.rlike(r"(?i)user-scalable\s*=\s*(no|0)") | v.rlike(r"(?i)maximum-scale\s*=\s*1(\.0)?(\s|,|$)"), F.lit(False))
    empty = F.coalesce(v, F.lit("")) == ""
    return when_array((empty, F.lit("VIEWPORT_META_MISSING")), (~empty & ~device, F.lit("VIEWPORT_NOT_DEVICE_WIDTH")), (~empty & device & locked, F.lit("VIEWPORT_ZOOM_DISABLED")))


def check_viewport() -> Column:
    v = F.col("best")["viewport"]
    return unit("U-7.1", gate=F.col("gate"), reasons=viewport_reasons(v), observed=_text(v, "(absent)"), locator="meta[name=viewport]", profile=F.col("best_profile"))


def _render_gate(extra: Column | None = None) -> Column:
    return F.coalesce(F.col("gate"), F.when(~F.col("ren_valid"), F.lit("NOT_TESTABLE")), *([extra] if extra is not None else []))


def check_overflow() -> Column:
    o = F.col("overflow")
    over = F.coalesce(o["scroll_width"] > o["viewport_width"] + 2, F.lit(False))
    worst = F.get(F.slice(F.array_sort(o["offenders"], lambda a, b: F.when(a["right"] > b["right"], -1).when(a["right"] < b["right"], 1).otherwise(0)), 1, 5), F.lit(0))
    gate = _render_gate(F.when(o.isNull() | (over & (F.size(o["offenders"]) <= 0)), F.lit("NOT_TESTABLE")))
    return unit("U-7.2", gate=gate, reasons=when_array((over, F.lit("HORIZONTAL_OVERFLOW"))), observed=F.concat_ws(" ", F.format_string("%d px in %d px", o["scroll_width"], o["viewport_width"]), worst["selector"]), locator="scroll width", profile="RENDERED")


def check_accessibility() -> Column:
    a = F.col("a11y")
    codes = F.transform(a["violations"], lambda r: F.concat(F.lit("A11Y_"), F.upper(F.replace(r, F.lit("-"), F.lit("_")))))
    return unit("U-7.3", gate=_render_gate(F.when(a.isNull(), F.lit("NOT_TESTABLE"))), reasons=F.coalesce(codes, F.array().cast("array<string>")), observed=F.concat(F.lit("violations: "), F.array_join(a["violations"], ", "), F.lit("; for review: "), F.array_join(a["incomplete"], ", ")), locator="accessibility rules", profile="RENDERED")


def check_landmarks() -> Column:
    b = F.col("best")
    outline = F.array_join(F.transform(F.slice(b["headings"], 1, 8), lambda h: F.concat(F.lit("h"), h["level"].cast("string"))), " ")
    return unit("U-7.4", gate=F.col("gate"), observed=F.concat(F.lit("landmarks: "), F.array_join(b["landmarks"], ", "), F.lit("; headings: "), outline), locator="landmarks and outline", profile=F.col("best_profile"))


def check_mixed_content() -> Column:
    m = F.col("insecure")
    plain = F.when(~F.coalesce("dom_url", "url").startswith("https:"), F.lit("NOT_APPLICABLE"))
    return unit("T-8.2", gate=_render_gate(plain), reasons=when_array((m["active"] > 0, F.lit("MIXED_ACTIVE_CONTENT")), ((m["active"] == 0) & (m["passive"] > 0), F.lit("MIXED_PASSIVE_CONTENT"))), observed=F.when(F.col("ren_valid"), F.format_string("%d active, %d passive http:// references", m["active"], m["passive"])), locator="http:// references", profile="RENDERED")


# --- performance ----------------------------------------------------------------------------------------------------
def vitals_grade(lcp: Column, inp: Column, cls: Column) -> Column:
    known = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in (lcp, inp, cls)), F.lit(0))
    above = lambda a, b, c: F.coalesce(lcp > a, F.lit(False)) | F.coalesce(inp > b, F.lit(False)) | F.coalesce(cls > c, F.lit(False))
    return choose((known == 0, "UNAVAILABLE"), (above(4000, 500, 0.25), "POOR"), (above(2500, 200, 0.1), "NEEDS_IMPROVEMENT"), (known == 3, "GOOD"), default="INCOMPLETE")


def check_field() -> Column:
    f = F.col("field")
    grade = vitals_grade(f["lcp_ms"], f["inp_ms"], f["cls"])
    return unit("P-4.1", gate=F.when(~(F.col("raw_valid") | F.col("ren_valid")) | f.isNull() | (grade == "UNAVAILABLE"), F.lit("NOT_TESTABLE")),
                reasons=when_array((grade == "POOR", F.lit("CWV_FIELD_POOR")), (grade == "NEEDS_IMPROVEMENT", F.lit("CWV_FIELD_NEEDS_IMPROVEMENT"))),
                observed=F.concat(grade, F.lit(" "), F.to_json(f)), locator="field p75", profile="NONE", missing=grade == "INCOMPLETE")


def blocking_time(tasks: Column, first_paint: Column) -> Column:
    """Sum of task time beyond 50 ms after the first paint."""
    late = F.filter(tasks, lambda t: t["start"] >= F.coalesce(first_paint, F.lit(0.0)))
    return F.aggregate(late, F.lit(0.0), lambda acc, t: acc + F.greatest(t["duration"] - 50, F.lit(0.0)))


def check_lab() -> Column:
    lab = F.col("lab")
    return unit("P-4.3", gate=choose((~F.coalesce(F.col("lab_selected"), F.lit(False)), "NOT_APPLICABLE"), (lab.isNull() | ~F.coalesce(lab["available"], F.lit(False)), "NOT_TESTABLE")),
                observed=F.concat(F.lit("LCP "), lab["lcp_ms"].cast("string"), F.lit(" TBT "), blocking_time(lab["long_tasks"], lab["fcp_ms"]).cast("string")), locator="lab run", profile="RENDERED", derived=F.lit("PASS"))


# Columns of optional recordings; a page table without them is evaluated as "not recorded".
OPTIONAL = {
    "canonical_target": "struct<acquisition:string,status:int,n_hops:int,validity:string,title:string>",
    "hreflang_result": "struct<declared:bigint,invalid:bigint,self:bigint,alternates:bigint,tested:bigint,broken:bigint,no_return:bigint>",
    "overflow": "struct<scroll_width:int,viewport_width:int,offenders:array<struct<selector:string,right:int,width:int>>>",
    "a11y": "struct<violations:array<string>,incomplete:array<string>>",
    "field": "struct<lcp_ms:double,inp_ms:double,cls:double>",
    "lab": "struct<lcp_ms:double,fcp_ms:double,available:boolean,long_tasks:array<struct<start:double,duration:double>>>",
    "lab_selected": "boolean", "site_has_org": "boolean",
    "scripted_controls": "array<struct<text:string,target:string>>",
    "dom_tree": "struct<blocks:array<string>,method:string,confidence:string,items:array<struct<format:string,type:string,props:map<string,string>>>,item_paths:array<map<string,string>>,controls:array<struct<text:string,target:string>>>",
    "raw_tree": "struct<blocks:array<string>,method:string,confidence:string,items:array<struct<format:string,type:string,props:map<string,string>>>,item_paths:array<map<string,string>>,controls:array<struct<text:string,target:string>>>",
}
CONFIG = {"goal": "search_ai_discovery", "intentional": False, "multilingual": False}


def with_defaults(pages: DataFrame) -> DataFrame:
    absent = {c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in pages.columns}
    absent |= {c: F.lit(v) for c, v in CONFIG.items() if c not in pages.columns}
    out = pages.withColumns(absent) if absent else pages
    return out.withColumn("scripted_controls", F.coalesce("scripted_controls", F.array().cast(OPTIONAL["scripted_controls"])))


ALL = [
    check_googlebot, check_status, check_redirects, check_canonical, check_indexing, check_snippets, check_title, check_description, check_h1,
    check_internal_links, check_markup_syntax, check_features, check_markup_visible, check_opportunity, check_hreflang, check_main_text, check_main_links,
    check_search_crawlers, check_parity, check_viewport, check_overflow, check_accessibility, check_landmarks, check_mixed_content, check_field, check_lab,
]


def prepare(pages: DataFrame) -> DataFrame:
    """Add everything the rules look at besides looked-up targets."""
    out = with_defaults(pages)
    if "page_type" not in out.columns:
        out = out.withColumn("page_type", page_type(F.col("url")))
    out = with_best(out).withColumn("best_tree", F.when(F.col("ren_valid"), F.col("dom_tree")).otherwise(F.col("raw_tree")))
    return canonical_facts(with_directives(out))


def prepare_tree(pages: DataFrame) -> DataFrame:
    """The part of `prepare` that text and markup rules need."""
    out = with_best(with_defaults(pages))
    return with_nodes(out.withColumn("best_tree", F.when(F.col("ren_valid"), F.col("dom_tree")).when(F.col("raw_valid"), F.col("raw_tree"))))


def evaluate(prepared: DataFrame, checks=ALL, keys: tuple[str, ...] = ("site", "page_id")) -> DataFrame:
    """One row per page and rule."""
    out = with_nodes(prepared) if "nodes" not in prepared.columns else prepared
    return out.select(*keys, F.explode(F.array(*[c() for c in checks])).alias("u")).select(*keys, "u.*")


def eligibility(units: DataFrame) -> DataFrame:
    """C-1.10 from four other units of the same page."""
    of = lambda check, field: F.max(F.when(F.col("check_id") == check, F.col(field)))
    has = lambda *codes: F.max(F.coalesce(F.arrays_overlap("reasons", F.array(*[F.lit(c) for c in codes])), F.lit(False)))
    side = units.filter(F.col("check_id").isin("C-1.2", "C-1.3", "C-1.7", "C-1.8")).groupBy("site", "page_id").agg(
        of("C-1.2", "status").alias("access"), of("C-1.3", "status").alias("http"), of("C-1.8", "status").alias("indexing"),
        has("UNEXPECTED_NOINDEX").alias("noindex"), has("CANONICAL_POINTS_TO_DIFFERENT_PAGE", "CANONICAL_TARGET_BROKEN", "CANONICAL_CONFLICT").alias("unclear"),
    )
    blocker = (F.col("access") == "FAIL") | (F.col("http") == "FAIL") | F.col("noindex")
    unknown = (F.col("access") == "NOT_TESTABLE") | (F.col("http") != "PASS") | (F.col("indexing") == "NOT_TESTABLE") | F.col("unclear")
    return side.withColumn("eligibility", F.when(F.coalesce(blocker, F.lit(False)), F.lit("NOT_ELIGIBLE")).when(F.coalesce(unknown, F.lit(True)), F.lit("UNCERTAIN")).otherwise(F.lit("ELIGIBLE")))
