"""robots.txt as data: one policy row per origin, decisions as one join and array work.

Parsing is a projection over the file table, and so is the compilation of its groups into the few different rule lists that
matter. Pages meet their origin's lists in a single join on the origin; rules are matched inside arrays, once a page and list,
so pages x rules is never materialised and nothing is shuffled twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as P

from crawlscope.functions.sql import F

from crawlscope.functions.expr import choose, let
from crawlscope.functions.urls import origin_of, path_and_query
from crawlscope.operators.skew import join_on_hot_key

# Fixed value: size limit of a robots file.
MAX_BYTES = 500 * 1024


def file_state() -> Column:
    return choose(
        ((F.col("acquisition") != "OK") | F.col("status").isNull(), "UNREACHABLE"),
        (F.col("challenge"), "CHALLENGED"),
        (F.col("status") == 429, "RATE_LIMITED"),
        (F.col("status") >= 500, "SERVER_ERROR"),
        (F.col("status") >= 300, "NO_RESTRICTIONS_4XX"),
        default="PARSED",
    )


def product_token(value: Column) -> Column:
    return F.when(F.trim(value) == "*", F.lit("*")).otherwise(
        F.lower(F.coalesce(F.nullif(F.regexp_extract(F.trim(value), "^[a-zA-Z_-]+", 0), F.lit("")), F.trim(value)))
    )


def encode_path(path: Column) -> Column:
    """Upper-case escapes and percent-encode non-ASCII characters, so both spellings compare equal."""
    pieces = F.regexp_extract_all(path, F.lit(r"%[0-9a-fA-F]{2}|[^\x00-\x7F]+|[^%\x00-\x1F\x7F-\x{10FFFF}]+|[\x00-\x7F]"), F.lit(0))
    encoded = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^%[0-9a-fA-F]{2}$"), F.upper(p)).when(p.rlike(r"[^\x00-\x7F]"), F.url_encode(p)).otherwise(p)), "")
    return F.when(path.rlike(r"%|[^\x00-\x7F]"), encoded).otherwise(path)


def pattern_of(rule_path: Column) -> Column:
    """Struct(prefix, regex): a plain prefix when the rule has no wildcard, else an anchored regex."""

    def build(p: Column) -> Column:
        anchored = p.endswith("$")
        body = F.when(anchored, F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)
        # \Q..\E quotes each literal part; rule text cannot contain \E after its own backslashes are doubled.
        quoted = F.array_join(F.transform(F.split(body, r"\*"), lambda part: F.regexp_replace(part, r"([\\.\[\]{}()+?^$|])", r"\\$1")), ".*")
        regex = F.concat(F.lit("(?s)^"), quoted, F.when(anchored, F.lit("$")).otherwise(F.lit("")))
        plain = ~anchored & ~p.contains("*")
        return F.struct(F.when(plain, p).alias("prefix"), F.when(~plain, regex).alias("regex"))

    return let(encode_path(rule_path), build)


def policies(files: DataFrame) -> DataFrame:
    """One row per robots file: state, groups of (agents, rules), sitemaps and unsupported fields.

    The text is bounded by the size limit, so every array here is bounded too.
    """
    # The limit is in bytes; only a file longer than that is cut.
    raw = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "^﻿", "")
    text = F.when(F.octet_length(raw) > MAX_BYTES, F.decode(F.substring(F.encode(raw, "UTF-8"), 1, MAX_BYTES), "UTF-8")).otherwise(raw)
    lines = F.transform(
        F.split(text, r"\r\n|\r|\n"),
        lambda line, i: let(F.trim(F.regexp_replace(line, "#.*$", "")), lambda s: F.struct(
            F.lower(F.trim(F.substring_index(s, ":", 1))).alias("key"),
            F.trim(F.regexp_replace(s, "^[^:]*:", "")).alias("value"),
            (i + 1).alias("line"),
            (F.instr(s, ":") > 1).alias("keyed"),
        )),
    )
    parsed = files.withColumn("robots_state", file_state()).withColumn(
        "_lines", F.when(F.col("robots_state") == "PARSED", F.filter(lines, lambda x: x["keyed"])).otherwise(F.array().cast("array<struct<key:string,value:string,line:int,keyed:boolean>>"))
    )
    parsed = parsed.withColumn("_kept", F.filter("_lines", lambda x: x["key"].isin("user-agent", "allow", "disallow")))

    def groups(kept: Column) -> Column:
        # A user-agent line opens a group unless the line kept before it is a user-agent line too.
        starts = F.filter(
            F.transform(kept, lambda x, i: F.when((x["key"] == "user-agent") & ((i == 0) | (F.get(kept, i - 1)["key"] != "user-agent")), i)),
            lambda i: i.isNotNull(),
        )
        return let(starts, lambda s: F.transform(s, lambda at, k: let(
            F.slice(kept, at + 1, F.coalesce(F.get(s, k + 1), F.size(kept)) - at),
            lambda block: F.struct(
                F.transform(F.filter(block, lambda x: x["key"] == "user-agent"), lambda x: product_token(x["value"])).alias("agents"),
                F.transform(
                    F.filter(block, lambda x: (x["key"] != "user-agent") & (x["value"] != "")),
                    lambda x: F.struct((x["key"] == "allow").alias("allow"), x["value"].alias("path"), x["line"].alias("line"), pattern_of(x["value"]).alias("match")),
                ).alias("rules"),
            ),
        )))

    return parsed.select(
        "origin", "robots_state", "status",
        let(F.col("_kept"), groups).alias("groups"),
        F.transform(F.filter("_lines", lambda x: (x["key"] == "sitemap") & (x["value"] != "")), lambda x: x["value"]).alias("sitemaps"),
        F.array_distinct(F.transform(F.filter("_lines", lambda x: ~x["key"].isin("user-agent", "allow", "disallow", "sitemap")), lambda x: x["key"])).alias("unsupported"),
    )


def rules_table(policy: DataFrame) -> DataFrame:
    """Long form: origin, group number, agents, rule."""
    return (
        policy.select("origin", F.posexplode("groups").alias("group_no", "g"))
        .select("origin", (F.col("group_no") + 1).alias("group_no"), F.array_join("g.agents", ",").alias("agents"), F.explode("g.rules").alias("r"))
        .select("origin", "group_no", "agents", "r.line", "r.allow", "r.path")
    )


def compiled(policy: DataFrame, tokens: list[str]) -> DataFrame:
    """Add `rule_sets`, the different rule lists that govern any of `tokens`, and `set_of`, the list (from 1) of each token.

    Done once a file, before pages are joined. Groups of one token are merged; tokens of the same groups, and all that no group names
    (they have the `*` groups), share one list. A list is in order of precedence: longest rule, then allow, then the first line.
    """

    def rules_of(token: str) -> Column:
        mine = P.filter("groups", lambda g: P.array_contains(g["agents"], token.lower()))
        chosen = P.when(P.size(mine) > 0, mine).otherwise(P.filter("groups", lambda g: P.array_contains(g["agents"], "*")))
        ranked = P.transform(P.flatten(P.transform(chosen, lambda g: g["rules"])), lambda r: P.struct(
            (-P.length(r["path"])).alias("size"), (~r["allow"]).alias("deny"), r["line"].alias("line"), r["path"].alias("path"), r["match"]["prefix"].alias("prefix"), r["match"]["regex"].alias("regex"),
        ))
        return P.array_sort(ranked)

    lists = policy.withColumn("_lists", P.array(*[rules_of(t) for t in tokens]))
    sets = lists.withColumn("rule_sets", P.array_distinct("_lists"))
    return sets.withColumn("set_of", P.transform("_lists", lambda x: P.array_position("rule_sets", x).cast("int"))).drop("_lists")


def matched(rules: Column, target: Column) -> Column:
    """Struct(decision, rule) of the first rule in order of precedence that matches."""
    hit = lambda r: P.coalesce(target.startswith(r["prefix"]), P.regexp_like(target, r["regex"]), P.lit(False))
    first = P.get(P.filter(rules, hit), P.lit(0))
    name = P.concat(P.when(first["deny"], P.lit("Disallow: ")).otherwise(P.lit("Allow: ")), first["path"], P.format_string(" (line %d)", first["line"]))
    return P.struct(P.when(first["deny"], P.lit("DISALLOW")).otherwise(P.lit("ALLOW")).alias("decision"), P.when(first.isNotNull(), name).alias("rule"))


def decisions(pages: DataFrame, policy: DataFrame, tokens: list[str], keys: tuple[str, ...] = ("page_id",), hot: DataFrame | None = None) -> DataFrame:
    """Add `decisions`: MAP token -> struct(decision, rule) to pages with a `url` column.

    A page's path is encoded once and matched once with each different rule list of its file; tokens read the outcome of their list.
    """
    narrow = pages.withColumn("origin", origin_of(F.col("url")))
    ready = compiled(policy.select("origin", "robots_state", "groups"), tokens).drop("groups")
    joined = join_on_hot_key(narrow, ready, ["origin"], list(keys), "left", hot)
    located = joined.withColumn("_path", path_and_query(F.col("url")))
    state, path = P.col("robots_state"), P.col("_path")
    fixed = lambda d: P.struct(P.lit(d).alias("decision"), P.lit(None).cast("string").alias("rule"))
    open_file = (state == "NO_RESTRICTIONS_4XX") | ((state == "PARSED") & (path == "/robots.txt"))
    located = located.withColumn("_target", P.when((state == "PARSED") & (path != "/robots.txt"), encode_path(F.col("_path"))))
    located = located.withColumn("_outcomes", P.when(P.col("_target").isNotNull(), P.transform("rule_sets", lambda rules: matched(rules, P.col("_target")))))
    of_token = lambda i: P.when(P.col("_target").isNotNull(), P.get("_outcomes", P.get("set_of", P.lit(i)) - 1)).when(open_file, fixed("ALLOW")).otherwise(fixed("UNKNOWN"))
    by_token = P.map_from_arrays(P.array(*[P.lit(t) for t in tokens]), P.array(*[of_token(i) for i in range(len(tokens))]))
    return located.withColumn("decisions", by_token).drop("_path", "_target", "_outcomes", "rule_sets", "set_of")
