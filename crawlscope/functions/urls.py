"""URL identity, resolution and classification as native Columns (no Python on the workers)."""

from __future__ import annotations

from pyspark.sql import Column

from crawlscope.functions.sql import F

from crawlscope.functions.expr import choose, in_words, let

# ---------------------------------------------------------------------------------------------------------
# Word lists and patterns of the URL rules.
# ---------------------------------------------------------------------------------------------------------
NON_HTML_EXTENSIONS = (
    "pdf jpg jpeg png gif webp avif svg ico zip gz rar 7z mp4 mp3 mov avi webm wav doc docx xls xlsx ppt pptx csv "
    "xml json rss atom txt css js woff woff2 ttf eot dmg exe apk"
).split()
UTILITY_SEGMENTS = (
    "login log-in signin sign-in signup sign-up register registration account my-account cart basket checkout "
    "dashboard admin wp-admin wp-login.php search logout log-out auth oauth password reset-password "
    "forgot-password wishlist compare preview feed cdn-cgi"
).split()
LEGAL_SEGMENTS = (
    "privacy privacy-policy terms terms-of-service terms-and-conditions terms-of-use cookie-policy cookies legal "
    "disclaimer imprint impressum gdpr accessibility-statement sitemap html-sitemap refund-policy shipping-policy"
).split()
SEARCH_KEYS = ["s", "q", "query", "search"]
FACET_KEYS = (
    "sort sortby orderby order filter filters color colour size price min_price max_price brand page p paged "
    "per_page limit view display dir facet refine q s query search gclid fbclid ref replytocom share sessionid sid"
).split()
FACET_PREFIX = r"^utm_[a-z]+$"

HUB_ROOTS = (
    "blog blogs news resources insights articles guides learn library case-studies case-study stories press "
    "knowledge-base kb help docs academy journal magazine updates posts whitepapers webinars events"
).split()
CATEGORY_ROOTS = "category categories collections collection shop store catalog catalogue tag tags topics topic departments".split()
SERVICE_ROOTS = (
    "services service solutions solution what-we-do capabilities industries industry use-cases use-case expertise "
    "practice-areas treatments offerings tours destinations programs courses"
).split()
PRODUCT_ROOTS = "products product software features feature platform tools tool apps app integrations item items p".split()
AUTHOR_ROOTS = "author authors team people profile profiles staff experts contributors writers".split()
PRICING_LEAVES = "pricing plans price prices plans-pricing pricing-plans".split()
ABOUT_LEAVES = "about about-us company who-we-are our-story about-company our-company".split()
CONTACT_LEAVES = "contact contact-us get-in-touch contacts".split()

PAGE_TYPES = ["homepage", "service", "product", "pricing", "category_hub", "article", "author", "about", "contact", "other"]
ZONES = ["nav", "main", "footer", "other"]


# ---------------------------------------------------------------------------------------------------------
# Parsing
# ---------------------------------------------------------------------------------------------------------
_ABSOLUTE = r"(?is)^(https?):[/\\]{2}([^/\\?#]*)([^?#]*)(\?[^#]*)?"
_NON_ASCII_RUNS = r"[\x00-\x7F]+|[^\x00-\x7F]+"


def percent_encode(s: Column) -> Column:
    """Percent-encode the characters a URL parser encodes in paths and queries; existing escapes stay."""

    def slow(v: Column) -> Column:
        runs = F.regexp_extract_all(v, F.lit(_NON_ASCII_RUNS), F.lit(0))
        out = F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"[^\x00-\x7F]"), F.url_encode(r)).otherwise(r)), "")
        for char, code in ((" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("`", "%60"), ("{", "%7B"), ("}", "%7D")):
            out = F.replace(out, F.lit(char), F.lit(code))
        return out

    return let(s, lambda v: F.when(v.rlike(r'[^\x00-\x7F]|[ "<>`{}]'), slow(v)).otherwise(v))


def _drop_dot_segments(path: Column) -> Column:
    """Resolve . and .. segments the way a URL parser does."""

    def folded(parts: Column) -> Column:
        return F.aggregate(
            F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
            lambda acc: F.concat(F.lit("/"), F.array_join(acc, "/"), F.when((F.element_at(parts, -1).isin(".", "..")) & (F.size(acc) > 0), F.lit("/")).otherwise(F.lit(""))),
        )

    return let(path, lambda p: F.when(p.rlike(r"/\.{1,2}(/|$)"), let(F.split(p, "/"), folded)).otherwise(p))


def url_parts(u: Column) -> Column:
    """Struct(scheme, host, port, path, query, userinfo) of an http(s) URL; NULL when it cannot be parsed."""

    def tail(x: Column) -> Column:
        authority = F.regexp_extract(x, _ABSOLUTE, 2)
        path = percent_encode(_drop_dot_segments(F.replace(F.regexp_extract(x, _ABSOLUTE, 3), F.lit("\\"), F.lit("/"))))
        raw = F.struct(
            F.lower(F.regexp_extract(x, _ABSOLUTE, 1)).alias("scheme"),
            F.lower(F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)(?::(\d*))?$", 1)).alias("host"),
            F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)(?::(\d*))?$", 2).alias("port"),
            path.alias("path"),
            percent_encode(F.regexp_extract(x, _ABSOLUTE, 4)).alias("query"),
            F.regexp_extract(authority, r"^(.*)@", 1).alias("userinfo"),
        )
        return let(raw, checked)

    def checked(p: Column) -> Column:
        default = ((p["scheme"] == "https") & (p["port"] == "443")) | ((p["scheme"] == "http") & (p["port"] == "80"))
        return F.when(
            p["host"].rlike(r"^(\[[0-9a-f:.]+\]|[^\s<>\[\]^|%\\:@#?]+)$"),
            F.struct(
                p["scheme"].alias("scheme"), p["host"].alias("host"),
                F.when(default, F.lit("")).otherwise(p["port"]).alias("port"),
                F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]).alias("path"),
                p["query"].alias("query"), p["userinfo"].alias("userinfo"),
            ),
        )

    return let(F.regexp_replace(F.trim(u), r"[\t\r\n]", ""), lambda x: F.when(F.coalesce(x.rlike(_ABSOLUTE), F.lit(False)), tail(x)))


def _serialise(p: Column) -> Column:
    return F.concat(p["scheme"], F.lit("://"), F.when(p["userinfo"] != "", F.concat(p["userinfo"], F.lit("@"))).otherwise(F.lit("")), p["host"], F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(F.lit("")), p["path"], p["query"])


def fetch_key(u: Column) -> Column:
    """Canonical form of a URL without its fragment; NULL when it is not an http(s) URL."""
    return let(url_parts(u), _serialise)


def origin_of(u: Column) -> Column:
    return let(url_parts(u), lambda p: F.concat(p["scheme"], F.lit("://"), p["host"], F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(F.lit(""))))


def host_of(u: Column) -> Column:
    return url_parts(u)["host"]


def path_of(u: Column) -> Column:
    return url_parts(u)["path"]


def path_and_query(u: Column) -> Column:
    return let(url_parts(u), lambda p: F.concat(p["path"], F.when(p["query"] == "?", F.lit("")).otherwise(p["query"])))


def same_url(a: Column, b: Column) -> Column:
    return F.coalesce(fetch_key(a) == fetch_key(b), F.lit(False))


def url_hash(u: Column) -> Column:
    return F.substring(F.sha1(fetch_key(u)), 1, 10)


def _joined(h: Column, b: Column) -> Column:
    """A relative reference put after the parts of its base."""
    root = F.concat(b["scheme"], F.lit("://"), b["host"], F.when(b["port"] != "", F.concat(F.lit(":"), b["port"])).otherwise(F.lit("")))
    return choose(
        (h.rlike(r"^[/\\]{2}"), F.concat(b["scheme"], F.lit(":"), h)),
        (h.rlike(r"^[/\\]"), F.concat(root, h)),
        (h.startswith("?"), F.concat(root, b["path"], h)),
        (h.startswith("#") | (h == ""), F.concat(root, b["path"], b["query"])),
        default=F.concat(root, F.regexp_replace(b["path"], r"[^/]*$", ""), h),
    )


_OTHER_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"


def resolve(href: Column, base: Column) -> Column:
    """Absolute form of `href` against `base`, fragment dropped. Other schemes come back as written, junk as NULL."""

    def build(h: Column) -> Column:
        return choose(
            (h.rlike(r"(?i)^https?:"), fetch_key(h)),
            (h.rlike(_OTHER_SCHEME), h),
            default=fetch_key(let(url_parts(base), lambda b: _joined(h, b))),
        )

    return let(F.regexp_replace(F.trim(href), r"[\t\r\n]", ""), build)


def resolve_with_host(href: Column, base_parts: Column) -> Column:
    """Struct(url, host): `resolve` against a base given by its parts, and the host of the result; for many references of one document."""

    def build(h: Column) -> Column:
        absolute = F.when(h.rlike(r"(?i)^https?:"), h).when(~h.rlike(_OTHER_SCHEME), _joined(h, base_parts))
        return let(url_parts(absolute), lambda p: F.struct(
            F.when(p.isNotNull(), _serialise(p)).when(h.rlike(_OTHER_SCHEME) & ~h.rlike(r"(?i)^https?:"), h).alias("url"), p["host"].alias("host")))

    return let(F.regexp_replace(F.trim(href), r"[\t\r\n]", ""), build)


def resolve_http(href: Column, base: Column) -> Column:
    """`resolve`, keeping only http(s) results (canonical and link targets)."""
    return let(resolve(href, base), lambda u: F.when(u.rlike(r"^https?://"), u))


def segments(u: Column) -> Column:
    return F.filter(F.split(path_of(u), "/"), lambda s: s != "")


def query_keys(u: Column) -> Column:
    pairs = F.filter(F.split(F.regexp_replace(url_parts(u)["query"], r"^\?", ""), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: let(F.split_part(p, F.lit("="), F.lit(1)), lambda k: F.coalesce(F.try_url_decode(k), k)))


# ---------------------------------------------------------------------------------------------------------
# Hosts
# ---------------------------------------------------------------------------------------------------------
def alias_hosts(a: Column, b: Column, registrable: Column | None = None) -> Column:
    """Same host, or the apex/www pair of one registrable domain.

    Without a registrable-domain column the apex is taken as the host with one leading `www.` removed, which
    names the same pairs for every host that is itself registrable.
    """

    def compare(p: Column) -> Column:
        bare_x, bare_y = F.regexp_replace(p["x"], r"^www\.", ""), F.regexp_replace(p["y"], r"^www\.", "")
        pair = (bare_x == bare_y) if registrable is None else (bare_x == bare_y) & (bare_x == registrable)
        return F.coalesce((p["x"] == p["y"]) | pair, F.lit(False))

    return let(F.struct(F.lower(a).alias("x"), F.lower(b).alias("y")), compare)


def apex_www_pair(host: Column, registrable: Column) -> Column:
    """Struct(apex, www), or NULL for a distinct subdomain, an IP or an unknown suffix."""
    h = F.lower(host)
    return F.when(
        (h == registrable) | (h == F.concat(F.lit("www."), registrable)),
        F.struct(registrable.alias("apex"), F.concat(F.lit("www."), registrable).alias("www")),
    )


# ---------------------------------------------------------------------------------------------------------
# Classification
# ---------------------------------------------------------------------------------------------------------
def exclusion_reason(u: Column) -> Column:
    """Why a URL is left out of automatic selection: CODE or CODE:detail; NULL when it is kept."""

    def by_path(p: Column) -> Column:
        extension = F.lower(F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1))
        segs = F.filter(F.split(p, "/"), lambda s: s != "")
        first = lambda xs, words: F.get(F.filter(xs, lambda s: in_words(F.lower(s), words)), F.lit(0))
        return F.when(in_words(extension, NON_HTML_EXTENSIONS), F.lit("NON_HTML")).otherwise(
            let(segs, lambda xs: F.coalesce(F.concat(F.lit("UTILITY:"), first(xs, UTILITY_SEGMENTS)), F.concat(F.lit("LEGAL:"), first(xs, LEGAL_SEGMENTS))))
        )

    def by_keys(keys: Column) -> Column:
        facets = F.filter(keys, lambda k: in_words(F.lower(k), FACET_KEYS) | F.lower(k).rlike(FACET_PREFIX))
        return choose(
            (F.exists(keys, lambda k: in_words(F.lower(k), SEARCH_KEYS)), "INTERNAL_SEARCH"),
            ((F.size(facets) >= 1) & (F.size(facets) == F.size(keys)), F.concat(F.lit("FACET:"), F.array_join(facets, "&"))),
        )

    return F.coalesce(let(path_of(u), by_path), let(query_keys(u), by_keys))


def page_type(u: Column, link_text: Column | None = None) -> Column:
    """Heuristic page type from the path, then from the link text."""
    stems = F.transform(segments(u), lambda s: F.regexp_replace(F.lower(s), r"\.(html?|php|aspx?)$", ""))
    text = F.lower(F.coalesce(link_text, F.lit(""))) if link_text is not None else F.lit("")

    def classify(segs: Column) -> Column:
        n = F.size(segs)
        last = F.try_element_at(segs, F.lit(-1))

        def at(words: list[str]) -> Column:
            return F.array_position(F.transform(segs, lambda s: in_words(s, words)), F.lit(True))

        author, product, hub = at(AUTHOR_ROOTS), at(PRODUCT_ROOTS), at(HUB_ROOTS)
        return choose(
            (n == 0, "homepage"),
            (in_words(last, PRICING_LEAVES), "pricing"),
            (in_words(last, ABOUT_LEAVES), "about"),
            (in_words(last, CONTACT_LEAVES), "contact"),
            ((author > 0) & (author < n), "author"),
            ((product > 0) & (product < n), "product"),
            (at(CATEGORY_ROOTS) > 0, "category_hub"),
            ((hub > 0) & (hub == n), "category_hub"),
            (hub > 0, "article"),
            (at(SERVICE_ROOTS) > 0, "service"),
            (product > 0, "product"),
            (author > 0, "category_hub"),
            (text.rlike(r"\b(pricing|plans)\b"), "pricing"),
            (text.rlike(r"^about\b|\babout us\b"), "about"),
            (text.rlike(r"\bcontact\b"), "contact"),
            (text.rlike(r"\b(services?|solutions?)\b") & (n <= 2), "service"),
            (text.rlike(r"\b(products?|features?|platform)\b") & (n <= 2), "product"),
            (text.rlike(r"\b(blog|news|resources|insights)\b") & (n == 1), "category_hub"),
            default="other",
        )

    return let(stems, classify)


def is_section_hub(u: Column, kind: Column) -> Column:
    return F.size(segments(u)).between(1, 2) & kind.isin("category_hub", "service", "product")


def type_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in PAGE_TYPES]), kind)


def zone_rank(zone: Column) -> Column:
    return F.array_position(F.array(*[F.lit(z) for z in ZONES]), zone)


def split_extension(seg: Column) -> Column:
    """Struct(stem, ext) of a path segment; ext keeps its dot."""
    ext = F.regexp_extract(seg, r"^.*?(\.[A-Za-z0-9]{2,5})$", 1)
    return F.struct(F.substring(seg, F.lit(1), F.length(seg) - F.length(ext)).alias("stem"), ext.alias("ext"))


# ---------------------------------------------------------------------------------------------------------
# Seeds
# ---------------------------------------------------------------------------------------------------------
def admission_reason(raw: Column) -> Column:
    """Why a submitted seed is refused; NULL when it may be audited."""
    s = F.trim(F.coalesce(raw, F.lit("")))

    def schemed(p: Column) -> Column:
        has_scheme = p.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:") & ~p.rlike(r"^[^/:]+:\d+(/|$)")
        parts = url_parts(F.when(has_scheme, p).otherwise(F.concat(F.lit("https://"), p)))
        return let(F.struct(p.alias("s"), has_scheme.alias("has_scheme"), parts["host"].alias("raw_host"), parts["userinfo"].alias("userinfo"), F.regexp_replace(parts["host"], r"^\[|\]$", "").alias("host")), judge)

    def judge(p: Column) -> Column:
        host = p["host"]
        a, b, c = [F.try_element_at(F.split(host, r"\."), F.lit(i)).try_cast("int") for i in (1, 2, 3)]
        # IPv4 ranges that are not globally routable unicast.
        special_v4 = (
            (a == 0) | (a == 10) | (a == 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254))
            | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & c.isin(0, 2))
            | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)) | ((a == 192) & (b == 88) & (c == 99))
        )
        # IPv6 prefixes that are not globally routable unicast.
        special_v6 = host.rlike(r"^(::1?$|::ffff:|f[cd][0-9a-f]{2}:|fe[89a-f][0-9a-f]:|ff[0-9a-f]{2}:|64:ff9b:|2001:0?:|2001:db8:|2002:)")
        local_name = (host == "localhost") | host.rlike(r"\.(localhost|local|internal|lan|home|corp)$")
        ipv4 = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
        return choose(
            (p["s"] == "", "EMPTY"),
            (p["s"].rlike(r"\s"), "SPACES"),
            (p["has_scheme"] & ~p["s"].rlike(r"(?i)^https?:"), "SCHEME"),
            (p["raw_host"].isNull(), "INVALID"),
            (p["userinfo"] != "", "CREDENTIALS"),
            (~host.contains(".") & ~host.contains(":"), "HOSTNAME"),
            (F.when(ipv4, F.coalesce(special_v4, F.lit(True))).when(host.contains(":"), special_v6).otherwise(local_name), "NOT_PUBLIC"),
        )

    return let(s, schemed)
