"""Robots decisions against a plain model of the same rules."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from crawlscope.operators import robots as RB

PATHS = ["/", "/a", "/a/b", "/a/b.html", "/shop?x=1", "/caf%c3%a9", "/robots.txt"]
LINES = st.lists(st.sampled_from(["User-agent: *", "User-agent: Googlebot", "User-agent: GPTBot/1.0", "Disallow: /a", "Disallow: /", "Allow: /a/b", "Allow: /a/*.html$", "Disallow: /*?", "Disallow:", "Crawl-delay: 3", "# note", "Disallow: /café", "Allow: /$", "Sitemap: https://x.example/s.xml"]), max_size=9)


def model(lines, token, path):
    if path == "/robots.txt":
        return "ALLOW"
    groups, last = [], None
    for no, line in enumerate(lines, 1):
        key, _, value = line.partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if last != "user-agent":
                groups.append(([], []))
            groups[-1][0].append("*" if value == "*" else re.match("[a-zA-Z_-]+", value).group().lower())
        elif key in ("allow", "disallow"):
            if groups and value:
                groups[-1][1].append((value, key == "allow", no))
        else:
            continue
        last = key
    mine = [g for g in groups if token.lower() in g[0]] or [g for g in groups if "*" in g[0]]
    encode = lambda s: re.sub("%[0-9a-fA-F]{2}", lambda m: m.group().upper(), "".join(c if ord(c) < 128 else "".join(f"%{b:02X}" for b in c.encode()) for c in s))
    hits = []
    for value, allow, no in (r for g in mine for r in g[1]):
        p = encode(value)
        end = p.endswith("$")
        body = ".*".join(map(re.escape, (p[:-1] if end else p).split("*")))
        if re.match(body + ("$" if end else ""), encode(path), re.S):
            hits.append((len(value), allow, -no))
    return "ALLOW" if not hits or max(hits)[1] else "DISALLOW"


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LINES, min_size=3, max_size=6))
def test_decisions(spark, files):
    table = spark.createDataFrame([(f"https://h{i}.example", 200, "OK", False, "\r\n".join(f)) for i, f in enumerate(files)], "origin string, status int, acquisition string, challenge boolean, text string")
    pages = spark.createDataFrame([(i * 100 + k, f"https://h{i}.example{p}") for i in range(len(files)) for k, p in enumerate(PATHS)], "page_id bigint, url string")
    rows = RB.decisions(pages, RB.policies(table), ["Googlebot", "GPTBot", "Other"]).collect()
    for r in rows:
        i, k = divmod(r.page_id, 100)
        for token, d in r.decisions.items():
            assert d.decision == model(files[i], token, PATHS[k]), (files[i], token, PATHS[k], d)


def test_states(spark):
    rows = [("https://a.example", 503, "OK", False, ""), ("https://b.example", 404, "OK", False, ""), ("https://c.example", None, "TIMEOUT", False, None), ("https://d.example", 200, "OK", True, ""), ("https://e.example", 429, "OK", False, "")]
    table = spark.createDataFrame(rows, "origin string, status int, acquisition string, challenge boolean, text string")
    got = {r.origin[8]: r.robots_state for r in RB.policies(table).collect()}
    assert got == {"a": "SERVER_ERROR", "b": "NO_RESTRICTIONS_4XX", "c": "UNREACHABLE", "d": "CHALLENGED", "e": "RATE_LIMITED"}


def test_a_page_is_matched_once_with_each_different_list(spark):
    text = "User-agent: *\nDisallow: /a\n\nUser-agent: GPTBot\nUser-agent: ClaudeBot\nDisallow: /b\n\nUser-agent: CCBot\nDisallow: /b"
    policy = RB.policies(spark.createDataFrame([("https://a.example", 200, "OK", False, text)], "origin string, status int, acquisition string, challenge boolean, text string"))
    tokens = ["Googlebot", "Bingbot", "Other", "GPTBot", "ClaudeBot"]
    row = RB.compiled(policy, tokens).first()
    assert len(row.rule_sets) == 2 and row.set_of == [1, 1, 1, 2, 2]
    pages = spark.createDataFrame([(1, "https://a.example/a/x"), (2, "https://a.example/b")], "page_id bigint, url string")
    plan = RB.decisions(pages, policy, tokens)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_like") <= 1 or plan.count("RLIKE") <= 1
    got = {r.page_id: {t: d.decision for t, d in r.decisions.items()} for r in RB.decisions(pages, policy, tokens).collect()}
    assert got[1] == {"Googlebot": "DISALLOW", "Bingbot": "DISALLOW", "Other": "DISALLOW", "GPTBot": "ALLOW", "ClaudeBot": "ALLOW"}
    assert got[2] == {"Googlebot": "ALLOW", "Bingbot": "ALLOW", "Other": "ALLOW", "GPTBot": "DISALLOW", "ClaudeBot": "DISALLOW"}
