"""Effective indexing directives for Googlebot, most restrictive value first."""

from __future__ import annotations

from pyspark.sql import Column

from crawlscope.functions.sql import F

from crawlscope.functions.expr import let

# Fixed value: X-Robots-Tag names that are directives, not crawler tokens.
DIRECTIVE_NAMES = (
    "(?i)^(noindex|nofollow|none|nosnippet|noarchive|notranslate|noimageindex|indexifembedded|all|max-snippet|"
    "max-image-preview|max-video-preview|unavailable_after)$"
)


def applicable_contents(meta_robots: Column, x_robots: Column) -> Column:
    """Directive lists that apply to Googlebot."""
    meta = F.transform(F.filter(meta_robots, lambda m: m["name"].isin("robots", "googlebot")), lambda m: m["content"])
    scoped = r"(?is)^([a-z0-9_-]+)\s*:\s*(.*)$"

    def header(h: Column) -> Column:
        name = F.regexp_extract(h, scoped, 1)
        foreign = h.rlike(scoped) & ~name.rlike(DIRECTIVE_NAMES)
        return F.when(~foreign, h).when(F.lower(name) == "googlebot", F.regexp_extract(h, scoped, 2))

    return F.concat(meta, F.filter(F.transform(x_robots, header), lambda v: v.isNotNull()))


def effective(meta_robots: Column, x_robots: Column) -> Column:
    """Struct(noindex, nofollow, nosnippet, max_snippet)."""
    tokens = F.flatten(F.transform(applicable_contents(meta_robots, x_robots), lambda c: F.transform(F.split(F.lower(c), ","), lambda x: F.trim(x))))

    def build(t: Column) -> Column:
        limits = F.filter(F.transform(F.filter(t, lambda x: x.startswith("max-snippet:")), lambda x: F.trim(F.split_part(x, F.lit(":"), F.lit(2))).try_cast("int")), lambda n: n.isNotNull())
        return let(limits, lambda n: F.struct(
            (F.array_contains(t, "noindex") | F.array_contains(t, "none")).alias("noindex"),
            (F.array_contains(t, "nofollow") | F.array_contains(t, "none")).alias("nofollow"),
            (F.array_contains(t, "nosnippet") | F.coalesce(F.array_contains(n, 0), F.lit(False))).alias("nosnippet"),
            F.coalesce(F.array_min(F.filter(n, lambda x: x >= 0)), F.get(n, F.lit(0))).alias("max_snippet"),
        ))

    return let(tokens, build)
