"""Reading HTML source with array expressions: one row per page, no explode, no shuffle, no Python.

A document becomes an array of tags; attributes are read left to right, so text inside a value is never taken
for an attribute. Questions that need ancestors (link zone, hidden headings) are answered by one fold over the
few relevant tags of the page.
"""

from __future__ import annotations

from pyspark.sql import Column

from crawlscope.functions.sql import F

from crawlscope.functions.expr import let
from crawlscope.functions.text import decode_entities, inner_text, norm

COMMENT = r"(?s)<!--.*?-->"
SCRIPT_BODY = r"(?is)(<script\b[^>]*>).*?(</script\s*>)"
STYLE_BODY = r"(?is)(<style\b[^>]*>).*?(</style\s*>)"
TAG = r"""<[a-zA-Z/](?:=\s*"[^"]*+"|=\s*'[^']*+'|[^>=]++|=)*+>"""
ATTRIBUTE = r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?"""
HEAD_END = (
    r"(?i)</head\s*>|<body[\s>]|"
    r"<(?!/?(?:html|head|title|meta|link|script|style|base|noscript|template)[\s>/])[a-z]"
)
JSON_LD = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""

# Landmark elements and roles that decide the zone of a link.
LANDMARKS = {"nav": "nav", "header": "nav", "footer": "footer", "main": "main", "article": "main"}
LANDMARK_ROLES = {"navigation": "nav", "banner": "nav", "contentinfo": "footer", "main": "main"}
# Fixed value: attribute a renderer leaves on computed-hidden subtrees.
HIDDEN_MARK = "data-rendered-hidden"  # a renderer may mark elements that style sheets hide
VOID = "area base br col embed hr img input link meta source track wbr".split()


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, COMMENT, "")


def without_scripts(html: Column) -> Column:
    """Script and style bodies emptied, their tags kept."""
    return F.regexp_replace(F.regexp_replace(html, SCRIPT_BODY, "$1$2"), STYLE_BODY, "$1$2")


def head_of(markup: Column) -> Column:
    """Source up to where a parser would leave <head>."""
    return F.get(F.split(markup, HEAD_END, 2), F.lit(0))


def tags_of(markup: Column) -> Column:
    return F.regexp_extract_all(markup, F.lit(TAG), F.lit(0))


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))


def named(tags: Column, *names: str) -> Column:
    """Opening tags with one of the given names."""
    return F.filter(tags, lambda t: t.rlike(rf"(?i)^<(?:{'|'.join(names)})[\s>/]"))


def parse_tag(tag: Column) -> Column:
    """Struct(keys, vals) of a tag; the first of a repeated attribute wins on lookup."""
    rest = F.regexp_replace(tag, r"^</?[a-zA-Z][^\s/>]*|/?>$", "")
    return F.struct(
        F.transform(F.regexp_extract_all(rest, F.lit(ATTRIBUTE), F.lit(1)), lambda x: F.lower(x)).alias("keys"),
        F.regexp_extract_all(rest, F.lit(ATTRIBUTE), F.lit(2)).alias("vals"),
    )


def raw_attr(parsed: Column, name: str) -> Column:
    return F.get(parsed["vals"], F.array_position(parsed["keys"], name).cast("int") - 1)


def attr(parsed: Column, name: str) -> Column:
    """Attribute value with quotes removed and entities decoded; NULL when absent, '' when it has no value."""
    return decode_entities(F.regexp_replace(raw_attr(parsed, name), r"""^["']|["']$""", ""))


def has_attr(parsed: Column, name: str) -> Column:
    return F.array_contains(parsed["keys"], name)


def word_in(value: Column, word: str) -> Column:
    """True when the space-separated list holds the word, ignoring case."""
    return F.coalesce(F.array_contains(F.split(F.lower(value), r"\s+"), word), F.lit(False))


def titles_of(markup: Column) -> Column:
    """Texts of all <title> elements outside inline SVG."""
    plain = F.regexp_replace(markup, r"(?is)<svg[\s>].*?</svg\s*>", "")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"), F.lit(1)), lambda t: norm(decode_entities(t)))


def pieces_from(markup: Column, opener: str) -> Column:
    """The source cut so that each piece starts at an opening tag matched by `opener`."""
    cut = F.split(markup, rf"(?i)(?=<(?:{opener})[\s>])")
    return let(cut, lambda parts: F.slice(F.when(markup.rlike(rf"(?i)^<(?:{opener})[\s>]"), F.concat(F.array(F.lit("")), parts)).otherwise(parts), F.lit(2), F.size(parts) + 1))


_NAMES = ", ".join(f"'{n}'" for n in LANDMARKS)
_OWN_ZONE = "CASE " + " ".join(f"WHEN role = '{r}' THEN '{z}'" for r, z in LANDMARK_ROLES.items()) + " " + " ".join(
    f"WHEN name = '{n}' THEN '{z}'" for n, z in LANDMARKS.items()
) + " END"


#: Zones by number (fixed values); a segment of a page is one digit, its zone and four more if it is hidden.
_ZONES = sorted(set(LANDMARKS.values()))
#: Tags that are folded together.
_BLOCK = 256
#: Links and headings that open, landmarks that open or close.
_CONTEXT_TAGS = rf"(?i)^<(?:(?:a|h[1-6])|/?(?:{'|'.join(LANDMARKS)}))(?![a-z0-9])"


def contexts_of(tags: Column) -> Column:
    """For every opening <a> and <h1>..<h6>, in document order: struct(name, zone, hidden) from its ancestors.

    Tags that open or close a landmark, or an element of a name that carries a role or hidden mark on this page, cut the page
    into segments of one context. A fold over these tags alone makes the table of segments, a digit each; a link or heading finds
    its segment by halving. A fold copies its state at every step, so tags are folded in blocks and only whole blocks of digits are put together:
    the work grows with the tags.
    """
    # Only names that carry a mark on this page, landmarks, links and headings matter; their order is all that is asked of their places.
    marks = F.array_distinct(F.transform(F.filter(tags, lambda t: t.rlike(rf"(?i)\s(?:role\s*=|{HIDDEN_MARK}[\s=>/])")), tag_name))
    kept = let(marks, lambda m: F.filter(tags, lambda t: t.rlike(_CONTEXT_TAGS) | ((F.size(m) > 0) & F.array_contains(m, tag_name(t)))))
    entries = F.transform(
        kept,
        lambda t, i: F.struct(
            tag_name(t).alias("name"),
            t.startswith("</").alias("closing"),
            F.when(t.rlike(r"(?i)\srole\s*="), F.lower(F.regexp_extract(t, r"""(?i)\srole\s*=\s*["']?([a-z]+)""", 1))).otherwise(F.lit("")).alias("role"),
            t.rlike(rf"(?i)\s{HIDDEN_MARK}[\s=>/]").alias("hidden"),
            i.alias("at"),
        ),
    )
    is_marker = lambda e: e["name"].rlike("^(a|h[1-6])$")
    zone_of = lambda e: F.coalesce(
        *[F.when(e["role"] == r, F.lit(z)) for r, z in LANDMARK_ROLES.items()],
        *[F.when(e["name"] == n, F.lit(z)) for n, z in LANDMARKS.items()],
    )

    def edges_of(all_entries: Column) -> Column:
        marked = F.array_distinct(F.transform(F.filter(all_entries, lambda e: e["hidden"] | e["role"].isin(*LANDMARK_ROLES)), lambda e: e["name"]))
        return let(marked, lambda m: F.filter(all_entries, lambda e: ~is_marker(e) & ~e["name"].isin(*VOID) & (e["name"].isin(*LANDMARKS) | F.array_contains(m, e["name"]))))

    none = F.array().cast("array<struct<name:string,zone:string,hidden:boolean>>")
    digit = lambda top: (F.coalesce(F.array_position(F.array(*[F.lit(z) for z in _ZONES]), top["zone"]), F.lit(0)) + F.when(top["hidden"], 4).otherwise(0)).cast("string")

    def step(acc: Column, e: Column) -> Column:
        top = F.try_element_at(acc["stack"], F.lit(-1))
        opened = F.struct(e["name"].alias("name"), F.coalesce(zone_of(e), top["zone"]).alias("zone"), (e["hidden"] | F.coalesce(top["hidden"], F.lit(False))).alias("hidden"))
        back = F.array_position(F.reverse(F.transform(acc["stack"], lambda s: s["name"])), e["name"]).cast("int")
        stack = (
            F.when(e["closing"] & (back > 0), F.slice(acc["stack"], F.lit(1), F.size(acc["stack"]) - back))
            .when(e["closing"], acc["stack"])
            .otherwise(F.concat(acc["stack"], F.array(opened)))
        )
        now = F.when(e["closing"] & (back > 0), F.get(acc["stack"], F.size(acc["stack"]) - back - 1)).when(e["closing"], top).otherwise(opened)
        return F.struct(stack.alias("stack"), F.concat(acc["digits"], F.coalesce(digit(now), F.lit("0"))).alias("digits"))

    def folded(edges: Column) -> Column:
        last = F.floor((F.size(edges) - 1) / F.lit(_BLOCK)).cast("int")
        blocks = F.when(F.size(edges) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(edges, b * _BLOCK + 1, F.lit(_BLOCK)))).otherwise(F.array(F.slice(edges, F.lit(1), F.lit(0))))
        whole = lambda acc, block: let(
            F.aggregate(block, F.struct(acc["stack"].alias("stack"), F.lit("").alias("digits")), step),
            lambda own: F.struct(own["stack"].alias("stack"), F.concat(acc["digits"], own["digits"]).alias("digits")),
        )
        return F.split(F.aggregate(blocks, F.struct(none.alias("stack"), F.lit("0").alias("digits")), whole, lambda acc: acc["digits"]), "")

    def placed(all_entries: Column) -> Column:
        def found(edges: Column) -> Column:
            places = F.transform(edges, lambda e: e["at"])
            halves = F.filter(F.array(*[F.lit(1 << i) for i in reversed(range(24))]), lambda h: h <= F.size(edges))

            def looked_up(t: Column) -> Column:
                before = lambda e: F.aggregate(t["halves"], F.lit(0), lambda n, h: F.when((n + h <= F.size(t["places"])) & (F.get(t["places"], n + h - 1) < e["at"]), n + h).otherwise(n))
                zone = lambda d: F.get(F.array(F.lit(None).cast("string"), *[F.lit(z) for z in _ZONES]), d % 4)
                return F.transform(
                    F.filter(all_entries, lambda e: is_marker(e) & ~e["closing"]),
                    lambda e: let(F.get(t["segments"], before(e)).cast("int"), lambda d: F.struct(e["name"].alias("name"), F.coalesce(zone_of(e), zone(d)).alias("zone"), (e["hidden"] | (d >= 4)).alias("hidden"))),
                )

            segments = folded(edges)
            return let(F.struct(places.alias("places"), halves.alias("halves"), segments.alias("segments")), looked_up)

        return let(edges_of(all_entries), found)

    return let(entries, placed)


def heading_text(piece: Column) -> Column:
    """Text of a piece that starts at a heading tag."""
    return inner_text(F.get(F.split(piece, r"(?i)</h[1-6]\s*>", 2), F.lit(0)))


def link_header(value: Column) -> Column:
    """array<struct(url, rel, hreflang)> of an HTTP Link header; repeated headers are separate lines."""
    parts = F.split(F.coalesce(value, F.lit("")), r"\n|,(?=\s*<)")
    targets = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda p: p.rlike(r"<[^>]*>"))

    def param(p: Column, name: str) -> Column:
        return F.regexp_extract(F.regexp_extract(p, r"(?s)<[^>]*>\s*(.*)$", 1), rf'(?i)(?:^|;)\s*{name}\s*=\s*"?([^";]*)"?\s*(?:;|$)', 1)

    return F.transform(
        targets,
        lambda p: F.struct(
            F.trim(F.regexp_extract(p, r"<([^>]*)>", 1)).alias("url"),
            param(p, "rel").alias("rel"),
            param(p, "hreflang").alias("hreflang"),
        ),
    )


def visible_text(markup_with_scripts: Column) -> Column:
    """Lower-case text of the body, used as a haystack."""
    body = F.regexp_replace(markup_with_scripts, r"(?is)^.*?<body[^>]*>", "")
    for name in ("script", "style", "noscript", "template"):
        body = F.regexp_replace(body, rf"(?is)<{name}\b.*?</{name}\s*>", "")
    return F.lower(inner_text(body))
