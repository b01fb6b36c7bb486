"""Response validity, page states and the gates that decide which checks may run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from crawlscope.functions.sql import F

from crawlscope.functions import markup as M
from crawlscope.functions.expr import choose, let, when_array
from crawlscope.functions.text import inner_text, word_count

# ---------------------------------------------------------------------------------------------------------
# Signals of access challenges.
# ---------------------------------------------------------------------------------------------------------
CHALLENGE_HEADERS = {
    "cf-mitigated": "(?i)challenge", "x-amzn-waf-action": "(?i)challenge|captcha", "x-datadome": "(?i)protected|blocked",
    "x-sucuri-block": ".", "x-px-block": ".", "x-akamai-challenge": ".",
}
_ID = r"""(?i)\sid\s*=\s*["']?"""
_CLASS = r"""(?i)\sclass\s*=\s*["']?(?:[^"'>]*\s)?"""
CHALLENGE_TAGS = {
    "cloudflare element": _ID + r"""(challenge-form|challenge-running|cf-challenge-running|challenge-stage|cf-please-wait)["'\s>]""",
    "cloudflare script": r"""(?i)^<script\b[^>]*\ssrc\s*=\s*["']?[^"'>]*/cdn-cgi/challenge-platform/""",
    "cloudflare turnstile": r"""(?i)^<iframe\b[^>]*\ssrc\s*=\s*["']?[^"'>]*challenges\.cloudflare\.com|""" + _CLASS[4:] + r"""cf-turnstile["'\s>]""",
    "perimeterx": _ID + "px-captcha",
    "datadome": r"""(?i)^<(?:script|iframe)\b[^>]*\ssrc\s*=\s*["']?[^"'>]*captcha-delivery\.com""",
    "akamai": _ID + r"""(sec-if-cpt-container|sec-cpt-if)["'\s>]""",
    "imperva": r"""(?i)^<(?:script|iframe)\b[^>]*\ssrc\s*=\s*["']?[^"'>]*_Incapsula_Resource""",
    "captcha form": r"""(?i)^<form\b[^>]*(\sid\s*=\s*["']?captcha-form["'\s>]|\saction\s*=\s*["']?[^"'>]*(captcha|/challenge))""",
}
# Every pattern above needs one of these words; a document without them has no such tag. The first letters stand apart, so most places fail at once.
CHALLENGE_WORDS = r"[cCsS_](?i:hallenge|aptcha|f-please-wait|f-turnstile|ec-if-cpt|ec-cpt-if|incapsula_resource)"
CHALLENGE_PHRASES = (
    r"(?i)just a moment|checking your browser|verify(ing)? (that )?you are (a )?human|attention required|pardon our interruption|"
    r"security check|are you a robot|unusual traffic|enable javascript and cookies to continue|bot verification|"
    r"please wait while we verify|ddos protection"
)
STRUCTURE = r"(?i)<html[\s>]|<body[\s>]|<head[\s>]|<!doctype html"


def looks_truncated(source: Column) -> Column:
    def test(s: Column) -> Column:
        tail = F.substring(s, -4000, 4000)
        return (
            (F.length(s) >= 200) & s.rlike(r"(?i)<body[\s>]")
            & ~F.when(F.length(s) > 4000, tail).otherwise(s).rlike(r"(?i)</body\s*>|</html\s*>") & ~s.endswith(">")
        )

    return let(F.btrim(source, F.lit(" \t\n\x0b\f\r")), test)


def _on_interstitial(plain: Column) -> Column:
    """True when a document without comments is short and bare and its title or opening words are those of a challenge.

    The tests stand in the order of their cost: an ordinary page leaves at its first landmark, and only bare pages have their text read.
    """
    body = F.regexp_replace(plain, r"(?is)^.*?(?=<body[\s>])", "")
    for name in ("script", "style", "noscript", "template", "title"):
        body = F.regexp_replace(body, rf"(?is)<{name}\b.*?</{name}\s*>", "")
    return (
        ~plain.rlike(r"(?i)<(nav|main|article|footer)[\s>]")
        & (F.size(F.regexp_extract_all(plain, F.lit(r"(?i)<a\s[^>]*?\bhref\b"), F.lit(0))) <= 4)
        & let(inner_text(body), lambda text: (word_count(text) < 120) & (
            F.coalesce(F.get(M.titles_of(plain), F.lit(0)).rlike(CHALLENGE_PHRASES), F.lit(False)) | F.substring(text, 1, 1500).rlike(CHALLENGE_PHRASES)))
    )


def challenge_evidence(source: Column, headers: Column | None) -> Column:
    """Names of the challenge signals found; empty when there are none."""
    by_header = [] if headers is None else [
        (F.coalesce(F.element_at(headers, name).rlike(pattern), F.lit(False)), F.lit(name)) for name, pattern in CHALLENGE_HEADERS.items()
    ]

    def strong(tags: Column) -> Column:
        return when_array(*by_header, *[(F.exists(tags, lambda t: t.rlike(pattern)), F.lit(label)) for label, pattern in CHALLENGE_TAGS.items()])

    def found(plain: Column) -> Column:
        tags = F.when(plain.rlike(CHALLENGE_WORDS), M.tags_of(M.without_scripts(plain))).otherwise(F.array().cast("array<string>"))
        return let(let(tags, strong), lambda signals: F.when(F.size(signals) > 0, signals)
                   .when(F.coalesce(_on_interstitial(plain), F.lit(False)), F.array(F.lit("wording on an interstitial"))).otherwise(signals))

    return let(M.without_comments(F.coalesce(source, F.lit(""))), found)


def validity(
    status: Column, source: Column, challenge: Column, complete: Column | None = None, content_type: Column | None = None,
    expect_html: bool = True, raw_source: bool = False,
) -> Column:
    """One of the five validity classes, tested in a fixed order."""
    html_rules: list[tuple[Column, str]] = []
    if expect_html:
        kind = F.lower(F.coalesce(content_type, F.lit(""))) if content_type is not None else F.lit("")
        html_rules = [
            ((kind != "") & ~kind.rlike("html|xml"), "UNKNOWN_RESPONSE"),
            (~source.rlike(STRUCTURE), "UNKNOWN_RESPONSE"),
        ]
        if raw_source:
            html_rules.append((looks_truncated(source), "EMPTY_OR_TRUNCATED"))
    return choose(
        (status.isNull(), "UNKNOWN_RESPONSE"),
        (F.size(challenge) > 0, "ACCESS_CHALLENGE"),
        (status >= 400, "ERROR_DOCUMENT"),
        (status >= 300, "UNKNOWN_RESPONSE"),
        (F.coalesce(F.trim(source), F.lit("")) == "", "EMPTY_OR_TRUNCATED"),
        (~F.coalesce(complete, F.lit(True)) if complete is not None else F.lit(False), "EMPTY_OR_TRUNCATED"),
        *html_rules,
        default="VALID_PAGE",
    )


def acquisition_of_error(code: Column, message: Column) -> Column:
    """State of a failed fetch from its recorded error code and text."""
    return choose(
        (code == "UNSAFE_DESTINATION", "UNSAFE_DESTINATION"),
        (code == "CANCELLED", "CANCELLED"),
        (code.isin("DNS_ERROR", "ENOTFOUND", "EAI_AGAIN"), "DNS_ERROR"),
        (code.isin("CONNECT_TIMEOUT", "READ_TIMEOUT", "ETIMEDOUT"), "TIMEOUT"),
        (
            F.coalesce(code.rlike("(?i)CERT|TLS|SSL|SELF_SIGNED|ALTNAME|UNABLE_TO_VERIFY|EPROTO"), F.lit(False))
            | F.coalesce(message.rlike(r"(?i)certificate|self[- ]signed|SSL routines|alert"), F.lit(False)),
            "TLS_ERROR",
        ),
        default="NETWORK_ERROR",
    )


def profile_label(acquisition: Column, valid: Column, status: Column) -> Column:
    """Short text on what a profile returned."""
    answered = F.concat(F.coalesce(valid, F.lit("UNKNOWN")), F.coalesce(F.format_string(" (HTTP %d)", status), F.lit("")))
    return F.when(acquisition != "OK", acquisition).otherwise(answered)


def hops_text(hops: Column) -> Column:
    return F.array_join(F.transform(hops, lambda h: F.concat_ws(" ", h["status"].cast("string"), h["url"], F.lit("->"), F.coalesce(h["location"], F.lit("null")))), " | ")


def lowered_headers(headers: Column) -> Column:
    """Header map with lower-case names. Values of a name written in several ways are kept one per line, as of a repeated one."""
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(
        n.alias("key"), F.array_join(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == n), lambda e: e["value"]), "\n").alias("value"))))


def with_validity(crawl: DataFrame) -> DataFrame:
    """Add raw_validity and dom_validity to RAW and RENDERED records.

    Signals are looked for in documents that were acquired; one that rendering left as it was is searched once.
    """
    raw, dom, same = F.col("acquisition") == "OK", F.col("dom_acquisition") == "OK", F.col("html") == F.col("dom")
    by_header = F.coalesce(F.greatest(F.lit(False), *[F.coalesce(F.element_at("headers", F.lit(name)).rlike(pattern), F.lit(False)) for name, pattern in CHALLENGE_HEADERS.items()]), F.lit(False))
    marked = crawl.withColumns({
        "_in_html": F.when(raw | (dom & same), challenge_evidence(F.col("html"), None)),
        "_in_dom": F.when(dom & ~F.coalesce(same, F.lit(False)), challenge_evidence(F.col("dom"), None)),
    })
    marked = marked.withColumns({
        "_raw_challenge": F.when(by_header, F.array(F.lit("header"))).otherwise(F.col("_in_html")),
        "_dom_challenge": F.when(F.coalesce(same, F.lit(False)), F.col("_in_html")).otherwise(F.col("_in_dom")),
    }).drop("_in_html", "_in_dom")
    return marked.withColumns({
        "raw_validity": F.when(F.col("acquisition") == "OK", validity(F.col("status"), F.col("html"), F.col("_raw_challenge"), content_type=F.element_at("headers", "content-type"), raw_source=True)),
        "dom_validity": F.when(F.col("dom_acquisition") == "OK", validity(F.coalesce(F.col("dom_status"), F.lit(200)), F.col("dom"), F.col("_dom_challenge"))),
    }).drop("_raw_challenge", "_dom_challenge")


def with_states(pages: DataFrame, auditor: str = "auditor_decision") -> DataFrame:
    """Add raw_valid, ren_valid, state, gate and pair_gate."""
    raw = (F.col("acquisition") == "OK") & (F.col("raw_validity") == "VALID_PAGE") & (F.col("status") == 200)
    ren = (F.col("dom_acquisition") == "OK") & (F.col("dom_validity") == "VALID_PAGE") & (F.col("dom_status").isNull() | F.col("dom_status").isin(200, 304))
    decision = F.col(auditor) if auditor in pages.columns else F.lit("ALLOW")
    out = pages.withColumns({"raw_valid": F.coalesce(raw, F.lit(False)), "ren_valid": F.coalesce(ren, F.lit(False))})
    challenged = (F.col("raw_validity") == "ACCESS_CHALLENGE") | (F.col("dom_validity") == "ACCESS_CHALLENGE")
    out = out.withColumn("state", choose(
        (decision != "ALLOW", "BLOCKED"),
        (F.col("raw_valid") | F.col("ren_valid"), "VALID"),
        (F.coalesce(challenged, F.lit(False)), "CHALLENGED"),
        ((F.col("acquisition") == "OK") & (F.col("raw_validity") == "ERROR_DOCUMENT"), "ERROR_PAGE"),
        default="UNAVAILABLE",
    ))
    return out.withColumns({"gate": content_gate(), "pair_gate": pair_gate()})


def content_gate() -> Column:
    """NOT_TESTABLE or NOT_APPLICABLE when content checks cannot run, else NULL."""
    return choose(
        (F.col("raw_valid") | F.col("ren_valid"), None),
        (F.col("state") == "ERROR_PAGE", "NOT_APPLICABLE"),
        default="NOT_TESTABLE",
    )


def pair_gate() -> Column:
    """Why RAW and RENDERED cannot be compared, else NULL."""
    return choose(
        (F.col("raw_valid") & F.col("ren_valid"), None),
        (F.col("state") == "BLOCKED", "NOT_FETCHED"),
        (F.col("ren_valid"), "RAW_UNAVAILABLE"),
        (F.col("raw_valid"), "RENDERED_UNAVAILABLE"),
        default="BOTH_UNAVAILABLE",
    )


def intentional(url: Column, prefixes: Column, environment: Column, goal: Column) -> Column:
    """Page or site marked as restricted on purpose."""
    from crawlscope.functions.urls import path_of

    listed = F.exists(prefixes, lambda p: (p != "") & (url.startswith(p) | path_of(url).startswith(p)))
    return F.coalesce(listed, F.lit(False)) | F.coalesce(environment == "staging", F.lit(False)) | F.coalesce(goal == "restricted", F.lit(False))
