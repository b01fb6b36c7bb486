"""Page extraction: html in, one row of nested facts per page out. A projection over the scan, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from crawlscope.functions.sql import F

from crawlscope.functions import markup as M
from crawlscope.functions.expr import choose, each, let
from crawlscope.functions.text import inner_text, norm
from crawlscope.functions.urls import alias_hosts, host_of, resolve, resolve_with_host, url_parts

# Fixed value: addresses that lead to no page.
NON_PAGE_SCHEMES = r"(?i)^(mailto|tel|sms|javascript|data|blob|about|file):"


def read_source(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add the cleaned source, its tags, and those of them that name a fact by themselves."""
    return (
        pages.withColumn("_plain", M.without_comments(F.col(html)))
        .withColumn("_markup", M.without_scripts(F.col("_plain")))
        .withColumn("_tags", M.tags_of(F.col("_markup")))
        .withColumn("_few", M.named(F.col("_tags"), "meta", "link", "base", "html", "img", "time"))
    )


def first_non_empty(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v != ""), F.lit(0))


def metas(tags: Column) -> Column:
    return F.transform(
        M.named(tags, "meta"),
        lambda t: let(M.parse_tag(t), lambda p: F.struct(
            F.lower(F.trim(F.coalesce(M.attr(p, "name"), F.lit("")))).alias("name"),
            F.coalesce(M.attr(p, "property"), F.lit("")).alias("property"),
            F.coalesce(M.attr(p, "content"), F.lit("")).alias("content"),
        )),
    )


def link_tags(tags: Column) -> Column:
    return F.transform(
        M.named(tags, "link"),
        lambda t: let(M.parse_tag(t), lambda p: F.struct(
            F.lower(F.coalesce(M.attr(p, "rel"), F.lit(""))).alias("rel"),
            F.trim(F.coalesce(M.attr(p, "href"), F.lit(""))).alias("href"),
            F.trim(M.attr(p, "hreflang")).alias("hreflang"),
        )),
    )


def base_url(tags: Column, doc_url: Column) -> tuple[Column, Column]:
    """(raw base href, URL that links resolve against)."""
    raw = F.get(F.filter(F.transform(M.named(tags, "base"), lambda t: M.attr(M.parse_tag(t), "href")), lambda h: h.isNotNull()), F.lit(0))
    base = let(resolve(raw, doc_url), lambda b: F.when(b.rlike("^https?://"), b))
    return raw, F.coalesce(base, doc_url)


def no_page(href: Column) -> Column:
    """Why a reference leads to no page, as far as it shows before it is resolved."""
    return choose(
        (href == "", "empty href"),
        (href.startswith("#"), "fragment-only link"),
        (href.rlike(NON_PAGE_SCHEMES), F.concat(F.lower(F.split_part(href, F.lit(":"), F.lit(1))), F.lit(": link"))),
    )


def targets(markup: Column, base: Column) -> Column:
    """Addresses of the crawlable anchors, as in `anchors`, without their texts and zones."""
    page = F.struct(M.pieces_from(markup, "a").alias("pieces"), url_parts(base).alias("base"))

    def target(href: Column, parts: Column) -> Column:
        return F.when(href.isNotNull() & no_page(href).isNull(), let(resolve_with_host(href, parts)["url"], lambda u: F.when(u.rlike("^https?://"), u)))

    found = let(page, lambda page: F.transform(
        page["pieces"], lambda piece: let(F.trim(M.attr(M.parse_tag(F.regexp_extract(piece, M.TAG, 0)), "href")), lambda href: target(href, page["base"]))))
    return F.array_distinct(F.filter(found, lambda u: u.isNotNull()))


def anchors(markup: Column, contexts: Column, base: Column, doc_host: Column) -> Column:
    """array<struct> of all anchors with an href, in document order."""
    # Bound once per page: a column used inside the lambda would be evaluated again for every anchor.
    page = F.struct(
        M.pieces_from(markup, "a").alias("pieces"),
        F.transform(F.filter(contexts, lambda c: c["name"] == "a"), lambda c: c["zone"]).alias("zones"),
        url_parts(base).alias("base"),
        doc_host.alias("doc_host"),
    )
    raw = let(page, lambda page: F.transform(
        page["pieces"],
        lambda piece, i: let(
            F.struct(
                M.parse_tag(F.regexp_extract(piece, M.TAG, 0)).alias("tag"),
                F.get(F.split(F.regexp_replace(piece, f"^{M.TAG}", ""), r"(?i)</a\s*>", 2), F.lit(0)).alias("inner"),
            ),
            lambda a: F.struct(
                i.alias("pos"),
                F.trim(M.attr(a["tag"], "href")).alias("href"),
                F.coalesce(
                    F.nullif(inner_text(a["inner"]), F.lit("")),
                    F.nullif(norm(F.coalesce(M.attr(a["tag"], "aria-label"), F.lit(""))), F.lit("")),
                    norm(F.coalesce(first_alt(a["inner"]), F.lit(""))),
                ).alias("text"),
                F.lower(F.coalesce(M.attr(a["tag"], "rel"), F.lit(""))).alias("rel"),
                F.coalesce(F.get(page["zones"], i), F.lit("other")).alias("zone"),
                page["base"].alias("base"),
                page["doc_host"].alias("doc_host"),
            ),
        ),
    ))
    with_href = F.filter(raw, lambda a: a["href"].isNotNull())

    def resolved(a: Column) -> Column:
        skip = no_page(a["href"])

        def finish(found: Column) -> Column:
            target = found["url"]
            reason = F.coalesce(
                skip,
                F.when(target.isNull(), F.lit("unparseable href")),
                F.when(~target.rlike("^https?://"), F.concat(F.lower(F.split_part(target, F.lit(":"), F.lit(1))), F.lit(": link"))),
            )
            return let(reason, lambda why: F.struct(
                a["pos"].alias("pos"),
                a["href"].alias("href_raw"),
                F.when(why.isNull(), target).alias("url"),
                a["text"].alias("text"),
                a["zone"].alias("zone"),
                a["rel"].alias("rel"),
                why.isNull().alias("crawlable"),
                F.when(why.isNull(), alias_hosts(found["host"], a["doc_host"])).otherwise(F.lit(False)).alias("internal"),
                why.alias("reason"),
            ))

        return let(F.when(skip.isNull(), resolve_with_host(a["href"], a["base"])), finish)

    return F.transform(with_href, resolved)


def first_alt(fragment: Column) -> Column:
    alts = F.transform(M.named(M.tags_of(fragment), "img"), lambda t: M.attr(M.parse_tag(t), "alt"))
    return F.get(F.filter(alts, lambda a: a.isNotNull()), F.lit(0))


def headings(markup: Column, contexts: Column) -> Column:
    """array<struct(level, text)> without hidden ones; empty texts kept out."""
    page = F.struct(
        M.pieces_from(markup, "h[1-6]").alias("pieces"),
        F.transform(F.filter(contexts, lambda c: c["name"] != "a"), lambda c: c["hidden"]).alias("hidden"),
    )
    found = let(page, lambda page: F.transform(
        page["pieces"],
        lambda piece, i: F.struct(
            F.substring(piece, 3, 1).cast("int").alias("level"),
            M.heading_text(piece).alias("text"),
            F.coalesce(F.get(page["hidden"], i), F.lit(False)).alias("hidden"),
        ),
    ))
    shown = F.filter(found, lambda h: ~h["hidden"] & (h["text"] != ""))
    return F.transform(shown, lambda h: F.struct(h["level"].alias("level"), h["text"].alias("text")))


def json_ld(plain: Column) -> Column:
    """array<struct(raw, in_head)> of JSON-LD script blocks."""
    in_head = F.size(F.regexp_extract_all(F.get(F.split(plain, r"(?i)</head\s*>|<body[\s>]", 2), F.lit(0)), F.lit(M.JSON_LD), F.lit(1)))
    blocks = F.regexp_extract_all(plain, F.lit(M.JSON_LD), F.lit(1))
    return let(in_head, lambda n: F.transform(blocks, lambda raw, i: F.struct(raw.alias("raw"), (i < n).alias("in_head"))))


def hreflang(links: Column, headers_link: Column, base: Column, doc_url: Column) -> Column:
    html = let(base, lambda base: F.transform(
        F.filter(links, lambda x: M.word_in(x["rel"], "alternate") & x["hreflang"].isNotNull()),
        lambda x: F.struct(x["hreflang"].alias("hreflang"), F.coalesce(resolve(x["href"], base), x["href"]).alias("href"), F.lit("HTML").alias("source")),
    ))
    http = F.transform(
        F.filter(headers_link, lambda x: x["rel"].rlike(r"(?i)\balternate\b") & (x["hreflang"] != "")),
        lambda x: F.struct(x["hreflang"].alias("hreflang"), F.coalesce(resolve(x["url"], doc_url), x["url"]).alias("href"), F.lit("HTTP").alias("source")),
    )
    return F.concat(html, http)


def _marked_texts(markup: Column, attribute_pattern: str) -> Column:
    """Texts of elements whose opening tag matches, by element name (nearest closing tag of that name)."""
    pattern = rf"(?is)<([a-z][a-z0-9]*)\b[^>]*?{attribute_pattern}[^>]*>(.*?)</\1\s*>"
    return F.transform(F.regexp_extract_all(markup, F.lit(pattern), F.lit(2)), inner_text)


# Insecure references; scripts, stylesheets and frames are active content.
ACTIVE = r"""(?i)^<(?:script|iframe)\b[^>]*\ssrc\s*=\s*["']?http://|^<link\b(?=[^>]*\brel\s*=\s*["']?[^"'>]*stylesheet)[^>]*\shref\s*=\s*["']?http://"""
PASSIVE = r"""(?i)^<(?:img|video|audio|source)\b[^>]*\ssrc\s*=\s*["']?http://"""


def insecure_counts(tags: Column) -> Column:
    """Struct(active, passive) numbers of http:// references among tags."""
    return F.struct(F.size(F.filter(tags, lambda t: t.rlike(ACTIVE))).alias("active"), F.size(F.filter(tags, lambda t: t.rlike(PASSIVE))).alias("passive"))


BYLINE = r"""(?:\srel\s*=\s*["']?(?:[^"'>]*\s)?author\b|\sitemprop\s*=\s*["']?author["'\s>]|\sclass\s*=\s*["'](?:[^"']*\s)?(?:author|byline)(?:\s[^"']*)?["']|\sclass\s*=\s*["'][^"']*author-name)"""


# Helper columns each fact is read from.
NEEDS = {
    "titles": ("_titles",), "title": ("_titles",), "meta_description": ("_metas",), "headings": ("_headings",), "h1": ("_headings",),
    "canonical_head": ("_head_links",), "canonical_body": ("_head_links", "_all_canonicals"), "canonical_http": ("_link_header",), "meta_robots": ("_metas",),
    "viewport": ("_metas",), "links": ("_contexts", "_base", "_host"), "targets": ("_base",), "hreflang": ("_links", "_link_header", "_base"), "generator": ("_metas",),
    "author_signals": ("_metas", "_json"), "date_signals": ("_metas", "_json"), "json_ld": ("_json",),
    "_headings": ("_contexts",), "_head_links": ("_head",), "_all_canonicals": ("_links",),
}


#: Facts that are extracted only when they are named.
ON_DEMAND = ("targets", "insecure")


def extract(
    pages: DataFrame, html: str = "html", url: str = "url", headers: str | None = None, keep: tuple[str, ...] = ("page_id",), only: tuple[str, ...] | None = None,
    plus: tuple[str, ...] = (),
) -> DataFrame:
    """All natively readable facts of a page and those of `ON_DEMAND` named in `plus`, or those named in `only`.

    `headers` is a MAP column with lower-case names.
    """
    header = (lambda name: F.element_at(F.col(headers), name)) if headers else (lambda name: F.lit(None).cast("string"))
    src = read_source(pages.select(*dict.fromkeys([*keep, url, html, *([headers] if headers else [])])), html)
    own_url = [] if "url" in keep else [F.col(url).alias("url")]
    tags, few, markup = F.col("_tags"), F.col("_few"), F.col("_markup")
    stages = [
        {
            "_metas": lambda: metas(few), "_links": lambda: link_tags(few), "_head": lambda: M.head_of(markup), "_contexts": lambda: M.contexts_of(tags),
            "_base": lambda: base_url(few, F.col(url))[1], "_host": lambda: host_of(F.col(url)), "_titles": lambda: M.titles_of(markup),
            "_link_header": lambda: M.link_header(header("link")), "_json": lambda: json_ld(F.col("_plain")),
        },
        {
            "_head_links": lambda: F.transform(F.filter(link_tags(M.tags_of(F.col("_head"))), lambda x: M.word_in(x["rel"], "canonical")), lambda x: x["href"]),
            "_all_canonicals": lambda: F.transform(F.filter(F.col("_links"), lambda x: M.word_in(x["rel"], "canonical")), lambda x: x["href"]),
            "_headings": lambda: headings(markup, F.col("_contexts")),
        },
    ]
    by_name = lambda name: F.transform(F.filter(F.col("_metas"), lambda m: m["name"] == name), lambda m: m["content"])
    by_property = lambda p: F.get(F.filter(F.transform(F.filter(F.col("_metas"), lambda m: m["property"] == p), lambda m: m["content"]), lambda v: v != ""), F.lit(0))
    ld_value = lambda path: F.filter(F.transform(F.transform(F.col("_json"), lambda j: F.try_parse_json(j["raw"])), lambda v: F.try_variant_get(v, path, "string")), lambda v: v.isNotNull())
    count_tags = lambda source, names: F.size(F.regexp_extract_all(source, F.lit(rf"(?i)<(?:{names})[\s>/]"), F.lit(0)))
    content_area = F.array_join(F.regexp_extract_all(markup, F.lit(r"(?is)<main[\s>].*?</main\s*>|<article[\s>].*?</article\s*>"), F.lit(0)), "")
    facts = {
        "titles": lambda: F.col("_titles"),
        "title": lambda: first_non_empty(F.col("_titles")),
        "meta_description": lambda: first_non_empty(F.transform(by_name("description"), norm)),
        "headings": lambda: F.col("_headings"),
        "h1": lambda: F.transform(F.filter(F.col("_headings"), lambda h: h["level"] == 1), lambda h: h["text"]),
        "canonical_head": lambda: F.col("_head_links"),
        "canonical_body": lambda: F.slice(F.col("_all_canonicals"), F.size("_head_links") + 1, F.size("_all_canonicals")),
        "canonical_http": lambda: F.transform(F.filter(F.col("_link_header"), lambda x: x["rel"].rlike(r"(?i)\bcanonical\b")), lambda x: x["url"]),
        "meta_robots": lambda: F.transform(
            F.filter(F.col("_metas"), lambda m: (m["name"] == "robots") | m["name"].rlike("bot$|^googlebot-news$")),
            lambda m: F.struct(m["name"].alias("name"), F.lower(norm(m["content"])).alias("content")),
        ),
        "x_robots": lambda: F.filter(F.transform(F.split(F.coalesce(header("x-robots-tag"), F.lit("")), "\n"), lambda x: F.trim(x)), lambda s: s != ""),
        "viewport": lambda: F.get(by_name("viewport"), F.lit(0)),
        "lang": lambda: F.get(F.transform(M.named(few, "html"), lambda t: M.attr(M.parse_tag(t), "lang")), F.lit(0)),
        "base_href": lambda: base_url(few, F.col(url))[0],
        "links": lambda: anchors(markup, F.col("_contexts"), F.col("_base"), F.col("_host")),
        "hreflang": lambda: hreflang(F.col("_links"), F.col("_link_header"), F.col("_base"), F.col(url)),
        "nosnippet_count": lambda: F.size(F.filter(tags, lambda t: t.rlike(r"(?i)\sdata-nosnippet[\s=>/]"))),
        "nosnippet_excerpts": lambda: _marked_texts(markup, r"\sdata-nosnippet\b"),
        "images": lambda: F.transform(M.named(few, "img"), lambda t: let(M.parse_tag(t), lambda p: F.struct(
            F.coalesce(M.attr(p, "src"), M.attr(p, "data-src"), F.lit("")).alias("src"), M.attr(p, "alt").alias("alt")))),
        "lists": lambda: let(count_tags(content_area, "ul|ol"), lambda n: F.when(n > 0, n).otherwise(count_tags(markup, "ul|ol"))),
        "tables": lambda: count_tags(markup, "table"),
        "landmarks": lambda: let(F.array_distinct(F.transform(tags, M.tag_name)), lambda names: F.array_intersect(F.array(*[F.lit(x) for x in ("header", "nav", "main", "footer", "article", "aside")]), names)),
        "noscript": lambda: count_tags(markup, "noscript") > 0,
        "generator": lambda: F.get(by_name("generator"), F.lit(0)),
        "author_signals": lambda: F.array_distinct(F.concat(
            F.transform(F.filter(F.transform(by_name("author"), norm), lambda a: a != ""), lambda a: F.concat(F.lit("meta author: "), a)),
            F.transform(F.filter(_marked_texts(markup, BYLINE), lambda t: t != ""), lambda t: F.concat(F.lit("byline: "), t)),
            F.transform(ld_value("$.author.name"), lambda a: F.concat(F.lit("JSON-LD author: "), a)),
            F.transform(ld_value("$.author[0].name"), lambda a: F.concat(F.lit("JSON-LD author: "), a)),
        )),
        "date_signals": lambda: F.array_distinct(F.concat(
            F.transform(F.filter(F.transform(M.named(few, "time"), lambda t: M.attr(M.parse_tag(t), "datetime")), lambda d: d.isNotNull()), lambda d: F.concat(F.lit("time: "), d)),
            *[F.filter(F.array(F.concat(F.lit(f"{p}: "), by_property(p))), lambda d: d.isNotNull()) for p in ("article:published_time", "article:modified_time")],
            F.transform(ld_value("$.datePublished"), lambda d: F.concat(F.lit("JSON-LD datePublished: "), d)),
            F.transform(ld_value("$.dateModified"), lambda d: F.concat(F.lit("JSON-LD dateModified: "), d)),
        )),
        "json_ld": lambda: F.col("_json"),
        "visible_text": lambda: M.visible_text(F.col("_plain")),
        "targets": lambda: targets(markup, F.col("_base")),
        "insecure": lambda: insecure_counts(tags),
    }
    wanted = list(only) if only else [f for f in facts if f not in ON_DEMAND or f in plus]
    needed = {n for f in wanted for n in NEEDS.get(f, ())}
    needed |= {n for f in needed for n in NEEDS.get(f, ())}
    for stage in stages:
        columns = {name: make() for name, make in stage.items() if name in needed}
        src = src.withColumns(columns) if columns else src
    return src.select(*keep, *own_url, *[facts[f]().alias(f) for f in wanted])


def extract_into(df: DataFrame, into: str, html: str, url: str, headers: str | None = None, only: tuple[str, ...] | None = None, plus: tuple[str, ...] = ()) -> DataFrame:
    """`extract`, with the facts packed into one struct column next to all columns of `df`."""
    keep = tuple(df.columns)
    wide = extract(df, html, url, headers, keep, only, plus)
    facts = [c for c in wide.columns if c not in keep and c != "url"]
    return wide.select(*keep, F.struct(*facts).alias(into))


#: What a Link or X-Robots-Tag header adds to a fact is not in the document itself.
WITHOUT_HEADERS = {
    "canonical_http": lambda v: F.array().cast("array<string>"), "x_robots": lambda v: F.array().cast("array<string>"),
    "hreflang": lambda v: F.filter(v, lambda h: h["source"] == "HTML"),
}


def genuine_documents(rows: DataFrame) -> DataFrame:
    """Leave `html` and `dom` only where they are to be read: no document that is not genuine, and none that rendering left as it was (`_same`).

    Links resolve where each profile ended: `_raw_url`, `_dom_url`.
    """
    out = rows.withColumns({
        "html": F.when(F.col("raw_validity") == "VALID_PAGE", F.col("html")), "dom": F.when(F.col("dom_validity") == "VALID_PAGE", F.col("dom")),
        "_raw_url": F.coalesce("final_url", "url"), "_dom_url": F.coalesce("dom_url", "url"),
    })
    out = out.withColumn("_same", F.coalesce((F.col("html") == F.col("dom")) & (F.col("_raw_url") == F.col("_dom_url")), F.lit(False)))
    return out.withColumn("dom", F.when(~F.col("_same"), F.col("dom")))


def extract_profiles(rows: DataFrame, only: tuple[str, ...] | None = None, plus: tuple[str, ...] = ()) -> DataFrame:
    """`raw_facts` and `dom_facts` of `genuine_documents`; the documents and what led to them do not go further."""
    out = extract_into(extract_into(rows, "raw_facts", "html", "_raw_url", "headers", only, plus), "_own", "dom", "_dom_url", None, only, plus)
    names = out.schema["_own"].dataType.names
    shared = F.struct(*[WITHOUT_HEADERS.get(n, lambda v: v)(F.col("raw_facts")[n]).alias(n) for n in names])
    return out.withColumn("dom_facts", F.when(F.col("_same"), shared).otherwise(F.col("_own"))).drop("html", "dom", "_own", "_raw_url", "_dom_url", "_same")


def links_of(facts: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Child table: one row per anchor."""
    return each(facts, list(keys), F.col("links"), "l").select(*keys, "l.*")
