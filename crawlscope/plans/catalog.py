"""Named queries over the given tables: one per operator or report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from crawlscope.functions.sql import F

from crawlscope import registry
from crawlscope.functions import urls as U
from crawlscope.operators import facts as X
from crawlscope.operators import lookups as L
from crawlscope.sources import derived as D
from crawlscope.sources.tables import read_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def joined(arr: Column, sep: str = "|") -> Column:
    return F.array_join(F.coalesce(arr, F.array().cast("array<string>")), sep)


# Addresses of all shapes: as crawled, as derived, and with utility, legal, file, search and facet forms.
URLS_SQL = f"""
SELECT page_id, 0 AS part, url FROM pages
UNION ALL SELECT page_id, 1 AS part, url FROM ({D.CRAWL_SQL})
UNION ALL SELECT page_id, 2 AS part, 'https://' || split_part(url, '/', 3) || CASE page_id % 9
  WHEN 0 THEN '/Cart/x' WHEN 1 THEN '/files/doc.PDF' WHEN 2 THEN '/find?q=a&z=1' WHEN 3 THEN '/help/Terms' WHEN 4 THEN '/list?b=1&page=2'
  WHEN 5 THEN '/wp-login.php' WHEN 6 THEN '/store/shoes/index.html' WHEN 7 THEN '/authors' ELSE '/industries/food/' END AS url FROM pages
"""


def sample_urls(spark: SparkSession, root: str) -> DataFrame:
    return D.derived(spark, root, URLS_SQL)


# --- URL functions -------------------------------------------------------------------------------------------------
@query
def url_keys(spark, root):
    u = F.col("url")
    return read_pages(spark, root).select(
        "page_id", U.fetch_key(u).alias("fetch_key"), U.origin_of(u).alias("origin"), U.path_and_query(u).alias("path_query"),
        joined(U.segments(u)).alias("segments"), joined(U.query_keys(u)).alias("query_keys"), U.url_hash(u).alias("url_hash"),
    )


@query
def url_exclusions(spark, root):
    return sample_urls(spark, root).select("page_id", "part", "url", U.exclusion_reason(F.col("url")).alias("reason"))


@query
def page_types(spark, root):
    return sample_urls(spark, root).select("page_id", "part", "url", U.page_type(F.col("url")).alias("page_type"), U.is_section_hub(F.col("url"), U.page_type(F.col("url"))).alias("hub"))


SEEDS_SQL = """
SELECT page_id, CASE page_id % 14 WHEN 0 THEN url WHEN 1 THEN split_part(url, '/', 3) WHEN 2 THEN 'http://10.0.' || CAST(page_id % 250 AS STRING) || '.1/'
  WHEN 3 THEN 'ftp://' || split_part(url, '/', 3) WHEN 4 THEN 'https://me:pw@' || split_part(url, '/', 3) || '/' WHEN 5 THEN 'http://localhost:8080/x'
  WHEN 6 THEN split_part(url, '/', 3) || ' /x' WHEN 7 THEN 'http://intranet.corp/' WHEN 8 THEN '' WHEN 9 THEN 'https://172.20.1.' || CAST(page_id % 200 AS STRING)
  WHEN 10 THEN 'http://93.184.216.' || CAST(page_id % 250 AS STRING) || '/a' WHEN 11 THEN 'http://[::1]/' WHEN 12 THEN 'https://[2606:4700::1111]/' ELSE 'http://169.254.169.254/latest' END AS seed
FROM pages
"""


@query
def seed_admission(spark, root):
    return D.derived(spark, root, SEEDS_SQL).select("page_id", "seed", F.coalesce(U.admission_reason(F.col("seed")), F.lit("ADMITTED")).alias("verdict"))


@query
def resolved_links(spark, root):
    """FN-2, FN-17 over every kind of reference a page can make."""
    forms = ["/abs/path", "rel/item.html", "../up/./x", "?k=1", "//cdn.example/lib.js", "#frag", "HTTP://Mixed.EXAMPLE:80/A b", "mailto:x@y.example", "/für/Straße", "https://[bad/"]
    rows = read_pages(spark, root).select("page_id", "url", F.posexplode(F.array(*[F.lit(f) for f in forms])).alias("form_no", "href"))
    return rows.select("page_id", "form_no", U.resolve(F.col("href"), F.col("url")).alias("resolved"), U.resolve_http(F.col("href"), F.col("url")).alias("http_only"))


# --- extraction on the given pages ------------------------------------------------------------------------------------
def given_facts(spark, root, *only):
    return X.extract(read_pages(spark, root), only=only)


@query
def page_titles(spark, root):
    return given_facts(spark, root, "title", "titles").select("page_id", "title", F.size("titles").alias("n_titles"))


@query
def page_h1(spark, root):
    return given_facts(spark, root, "h1", "headings").select("page_id", joined(F.col("h1")).alias("h1"), F.size("headings").alias("n_headings"))


@query
def page_lang(spark, root):
    return given_facts(spark, root, "lang", "base_href", "noscript").select("page_id", "lang", F.coalesce("base_href", F.lit("")).alias("base_href"), "noscript")


@query
def page_links(spark, root):
    links = X.links_of(given_facts(spark, root, "links"))
    return links.select("page_id", "pos", "href_raw", "url", "text", "zone", "crawlable", "internal", F.coalesce("reason", F.lit("")).alias("reason"))


@query
def structure_counts(spark, root):
    f = given_facts(spark, root, "nosnippet_count", "images", "lists", "tables", "landmarks", "links")
    return f.select("page_id", "nosnippet_count", F.size("images").alias("n_images"), "lists", "tables", joined(F.col("landmarks")).alias("landmarks"), F.size("links").alias("n_links"))


@query
def visible_words(spark, root):
    """FN-19 on the given pages."""
    from crawlscope.functions.text import word_count

    f = given_facts(spark, root, "visible_text")
    return f.select("page_id", F.length("visible_text").alias("n_chars"), word_count(F.col("visible_text")).alias("n_words"), F.md5("visible_text").alias("text_md5"))


# --- shared audit tables of the derived crawl ---------------------------------------------------------------------------
def crawl_states(spark, root):
    from crawlscope.operators import gates as G

    return G.with_states(G.with_validity(D.crawl(spark, root)))


def crawl_facts(spark, root, *only):
    """RAW facts of the derived crawl."""
    return X.extract(D.crawl(spark, root), headers="headers", keep=("page_id", "site", "host"), only=only)


def crawl_pages(spark, root, *only):
    """RAW and RENDERED facts of the genuine documents with states, each resolved against the address where its profile ended; no html behind this point."""
    return X.extract_profiles(X.genuine_documents(crawl_states(spark, root)), only)


def recorded_pages(spark, root, *only):
    """`crawl_pages` with facts of every recorded document, error pages and challenges too."""
    rows = crawl_states(spark, root).withColumns({"_raw_url": F.coalesce("final_url", "url"), "_dom_url": F.coalesce("dom_url", "url")})
    rows = X.extract_into(rows, "raw_facts", "html", "_raw_url", "headers", only)
    return X.extract_into(rows, "dom_facts", "dom", "_dom_url", None, only).drop("html", "dom", "_raw_url", "_dom_url")


__all__ = ["QUERIES", "registry", "L"]
