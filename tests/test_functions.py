"""URL, text and markup functions on small literal rows."""

from pyspark.sql import functions as P

from crawlscope.functions import text as T
from crawlscope.functions import urls as U
from crawlscope.functions.sql import F
from crawlscope.operators import facts as X


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_resolve(spark):
    base = "https://A.example:443/x/y?q#z"
    cases = {"/für": "https://a.example/f%C3%BCr", "../b/./c": "https://a.example/b/c", "?k=1": "https://a.example/x/y?k=1", "//c.d/e": "https://c.d/e", "mailto:x": "mailto:x", "http://[bad": None, "a b": "https://a.example/x/a%20b", "": "https://a.example/x/y?q"}
    got = one(spark, [(h, base) for h in cases], "h string, b string", "h", U.resolve(F.col("h"), F.col("b")).alias("r"))
    assert dict(got) == cases


def test_functions_take_ordinary_columns(spark):
    rows = spark.createDataFrame([("HTTP://A.example:80/p#f",)], "u string")
    assert rows.select(U.fetch_key(P.col("u"))).first()[0] == "http://a.example/p"


def test_seed_admission(spark):
    cases = {"example.com:8080/a": None, "localhost:1/x": "HOSTNAME", "http://192.168.1.1/": "NOT_PUBLIC", "https://u:p@x.example/": "CREDENTIALS", "a b.example": "SPACES", "": "EMPTY", "ftp://x.example": "SCHEME", "http://8.8.8.8/": None, "printer.local": "NOT_PUBLIC"}
    got = one(spark, [(s,) for s in cases], "s string", "s", U.admission_reason(F.col("s")).alias("r"))
    assert dict(got) == cases


def test_entities(spark):
    got = one(spark, [("a &amp; b &#233; &#x1F600; &bogus;",)], "s string", T.decode_entities(F.col("s")))
    assert got == [("a & b é \U0001F600 &bogus;",)]


DOC = """<!DOCTYPE html><html lang="de"><head><title>A &amp; B</title><meta name="Description" content=" d &quot;x&quot; "><link rel="canonical" href="/c">
<meta name=robots content="NoIndex, follow"></head><body><svg><title>icon</title></svg><div role="navigation"><div><a href="/n1">N1</a></div></div><a href="/o1">O</a><header><a href="x.html"><img src=a alt="Pic"></a></header>
<main><h1>Hi <b>you</b></h1><nav><a href=#f>f</a></nav><a href='mailto:q'>m</a><a href="http://other.example/x" aria-label="lab"></a></main><div data-rendered-hidden="1"><h2>hid</h2></div><h2>seen</h2>
<footer><a href="//www.a.example/f">F</a></footer><p data-x="<a href='/no'>">t</p><!-- <a href="/comment">c</a> --><link rel=canonical href=/late></body></html>"""


def test_extract(spark):
    r = X.extract(spark.createDataFrame([(1, "https://a.example/d/p", DOC)], "page_id bigint, url string, html string")).first()
    assert (r.title, r.meta_description, r.lang, r.h1) == ("A & B", 'd "x"', "de", ["Hi you"])
    assert [h.text for h in r.headings] == ["Hi you", "seen"]
    assert (r.canonical_head, r.canonical_body) == (["/c"], ["/late"])
    assert [(x.name, x.content) for x in r.meta_robots] == [("robots", "noindex, follow")]
    links = {x.href_raw: (x.zone, x.internal, x.reason, x.text) for x in r.links}
    assert links["/n1"] == ("nav", True, None, "N1") and links["/o1"][0] == "other" and links["x.html"] == ("nav", True, None, "Pic")
    assert links["#f"][2] == "fragment-only link" and links["mailto:q"][2] == "mailto: link" and links["http://other.example/x"] == ("main", False, None, "lab")
    assert links["//www.a.example/f"][:2] == ("footer", True) and "/comment" not in links


def test_body_element_ends_the_head(spark):
    html = '<html><head><div></div><link rel="canonical" href="/c"></head><body></body></html>'
    r = X.extract(spark.createDataFrame([(1, "https://a.example/", html)], "page_id bigint, url string, html string"), only=("canonical_head", "canonical_body")).first()
    assert (r.canonical_head, r.canonical_body) == ([], ["/c"])
