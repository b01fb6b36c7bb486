"""Contexts of links and headings against a plain stack, and their cost on long pages."""

import random
import re
import time

from pyspark.sql import functions as P

from crawlscope.functions import markup as M
from crawlscope.functions.sql import F

ZONES = {**{("name", k): v for k, v in M.LANDMARKS.items()}, **{("role", k): v for k, v in M.LANDMARK_ROLES.items()}}


def plain_contexts(tags):
    parsed = []
    for t in tags:
        role = re.search(r"""\srole\s*=\s*["']?([a-z]+)""", t)
        parsed.append((re.match(r"</?([a-z0-9]+)", t).group(1), t.startswith("</"), role.group(1) if role else "", M.HIDDEN_MARK in t))
    marked = {n for n, _, role, hidden in parsed if hidden or role in M.LANDMARK_ROLES}
    stack, out = [], []
    for name, closing, role, hidden in parsed:
        zone = ZONES.get(("role", role)) or ZONES.get(("name", name))
        top = stack[-1] if stack else (None, None, False)
        own = (name, zone or top[1], hidden or top[2])
        if re.fullmatch("a|h[1-6]", name):
            out += [] if closing else [own]
        elif name in M.LANDMARKS or name in marked:
            if closing:
                names = [s[0] for s in stack]
                if name in names:
                    del stack[len(names) - 1 - names[::-1].index(name) :]
            elif name not in M.VOID:
                stack.append(own)
    return out


def test_contexts_equal_a_plain_stack(spark):
    dice, rows = random.Random(1), []
    some = ["<nav>", "</nav>", "<main>", "</main>", "<footer>", "</footer>", '<div role="navigation">', "<div>", "</div>", f"<p {M.HIDDEN_MARK}>", "<p>", "</p>", '<a href="x">', "</a>", '<a role="main">', "<h2>", "</h2>",
            f"<h3 {M.HIDDEN_MARK}=1>", "<span>", "<br>", f"<img {M.HIDDEN_MARK}>", '<section role="banner">', "</section>", "<article>", "</article>"]
    for i in range(150):
        rows.append((i, [dice.choice(some) for _ in range(dice.choice([0, 5, 40, 900]))]))
    df = spark.createDataFrame(rows, "id int, tags array<string>").repartition(4)
    for r in df.select("id", M.contexts_of(F.col("tags")).alias("c")).collect():
        assert [(c.name, c.zone, c.hidden) for c in r.c] == plain_contexts(rows[r.id][1])


def test_contexts_grow_linearly(spark):
    took = {}
    for n in (10_000, 10_000, 80_000):  # the first warms up
        tags = ["<nav>", '<a href="x">', "</a>", "</nav>", "<h2>", "</h2>", '<div role="main">', '<a href="y">', "</a>", "</div>"] * (n // 2)
        df = spark.createDataFrame([(tags,)], "tags array<string>")
        start = time.perf_counter()
        got = df.select(P.size(M.contexts_of(F.col("tags")))).first()[0]
        took[n] = time.perf_counter() - start
        assert got == n // 2 * 3
    assert took[80_000] < 8 * took[10_000] * 2 + 2
