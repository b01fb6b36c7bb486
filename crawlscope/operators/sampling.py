"""The representative sample of every site, picked greedily in rounds over all sites at once.

Slots are filled in order: homepage, supplied pages, one page for each step of the plan from a group not used so far, further unused
groups, a second page of groups used once. Each slot takes the first fitting candidate in link order whose address after redirects is
not in the sample yet. What is picked so far is one short row a site (`size` pages at most); candidates never leave their own table.

A round asks for the best candidate of every open step (or group) under what is picked so far, with one aggregate that combines before
the shuffle, and takes the answers in order until one is no longer fit because of an answer just taken: removing candidates can't change
which of the rest is first, so all answers before that point are what a walk over single picks would take. Only the remainder needs
another round. Two to four rounds a phase are usual; there can't be more than `size`, as the first answer of a round always counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope import registry
from crawlscope.functions.urls import fetch_key, page_type, path_of
from crawlscope.operators.skew import best_per_group, heavy_keys, join_on_hot_key
from crawlscope.session import cut

PICK = "struct<url:string,page_type:string,signature:string,reason:string>"
ROW = ["final_key", "page_type", "signature"]
LINK_ORDER = ["zone_rank", "type_rank", "depth", "url"]
PLAN = len(registry.SELECTION_PLAN)
#: Types that get no second page (fixed values).
SINGLE = ("other", "contact")


def keys_of(picked: Column) -> Column:
    return F.transform(picked, lambda p: p["url"])


def groups_of(picked: Column) -> Column:
    return F.transform(picked, lambda p: p["signature"])


def pick(row: Column, reason: Column) -> Column:
    return F.array(F.struct(row["final_key"].alias("url"), row["page_type"].alias("page_type"), row["signature"].alias("signature"), reason.alias("reason")))


def starting(homes: DataFrame, candidates: DataFrame, supplied: DataFrame | None, size: int) -> DataFrame:
    """site, picked, step: homepage and supplied pages in their order (column `position`, else by address)."""
    first = F.array(F.struct(F.col("home_key").alias("url"), F.lit("homepage").alias("page_type"), F.lit("/").alias("signature"), F.lit("homepage").alias("reason")))
    base = homes.groupBy("site").agg(F.min("home_key").alias("home_key")).select("site", first.cast(f"array<{PICK}>").alias("picked"))
    if supplied is not None:
        own = supplied_pages(supplied).join(homes.select("site", F.col("home_key").alias("url")), ["site", "url"], "left_anti")
        own = best_per_group(own, ["site"], [F.col("position"), F.col("url")], size, "_no")
        known = candidates.select("site", "url", F.col("signature").alias("_group")).dropDuplicates(["site", "url"])
        own = own.join(known, ["site", "url"], "left")
        row = F.struct(F.col("url"), page_type(F.col("url")).alias("page_type"), F.coalesce("_group", path_of(F.col("url"))).alias("signature"), F.lit("supplied").alias("reason"))
        listed = own.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("_no", row.alias("p")))).alias("_own"))  # at most `size` a site
        given = F.transform(F.coalesce("_own", F.array().cast(listed.schema["_own"].dataType)), lambda x: x["p"]).cast(f"array<{PICK}>")
        base = base.join(listed, "site", "left").select("site", F.slice(F.concat("picked", given), 1, size).alias("picked"))
    return base.withColumn("step", F.lit(0))


def supplied_pages(supplied: DataFrame) -> DataFrame:
    """site, url (as a key), position: each page once."""
    place = F.col("position") if "position" in supplied.columns else F.lit(0)
    return supplied.select("site", fetch_key(F.col("url")).alias("url"), place.alias("position")).filter("url IS NOT NULL").groupBy("site", "url").agg(F.min("position").alias("position"))


def fitting(eligible: DataFrame, state: DataFrame, hot: DataFrame, groups: Column, inside: bool) -> DataFrame:
    """Candidates of the open sites whose address is not picked and whose group is (`inside`) or is not among `groups`."""
    open_sites = state.select("site", "step", keys_of(F.col("picked")).alias("_keys"), groups.alias("_groups"))
    rows = join_on_hot_key(eligible, open_sites, ["site"], ["url"], "inner", hot)
    within = F.array_contains("_groups", F.col("signature"))
    return rows.filter(~F.array_contains("_keys", F.col("final_key")) & (within if inside else ~within))


def taken(answers: Column, reason: str, size: int) -> Column:
    """The picked pages with the answers up to the first that no longer fits; `again` tells that there was one."""

    def step(acc: Column, row: Column) -> Column:
        full = F.size(acc["picked"]) >= size
        clash = F.array_contains(keys_of(acc["picked"]), row["final_key"])
        grown = F.struct(F.concat(acc["picked"], pick(row, F.lit(reason))).cast(f"array<{PICK}>").alias("picked"), F.lit(False).alias("again"))
        stopped = F.struct(acc["picked"].alias("picked"), F.lit(True).alias("again"))
        return F.when(acc["again"] | full, acc).when(clash, stopped).otherwise(grown)

    return F.aggregate(answers, F.struct(F.col("picked").alias("picked"), F.lit(False).alias("again")), step)


def planned(best: Column, size: int) -> Column:
    """Steps of the plan from `step` on, taken while their best candidates stay fit."""
    plan = F.array(*[F.lit(t) for t in registry.SELECTION_PLAN])

    def step(acc: Column, s: Column) -> Column:
        kind = F.get(plan, s)
        row = F.get(F.filter(best, lambda b: b["page_type"] == kind), F.lit(0))
        clash = F.array_contains(keys_of(acc["picked"]), row["final_key"]) | F.array_contains(groups_of(acc["picked"]), row["signature"])
        state = lambda p, n, stop: F.struct(p.alias("picked"), n.cast("int").alias("step"), F.lit(stop).alias("stop"))
        done = acc["stop"] | (F.size(acc["picked"]) >= size)
        grown = F.concat(acc["picked"], pick(row, kind)).cast(f"array<{PICK}>")
        return F.when(done, acc).when(row.isNull(), state(acc["picked"], s + 1, False)).when(clash, state(acc["picked"], s, True)).otherwise(state(grown, s + 1, False))

    start = F.struct(F.col("picked").alias("picked"), F.col("step").cast("int").alias("step"), F.lit(False).alias("stop"))
    return F.aggregate(F.sequence(F.col("step").cast("int"), F.lit(PLAN - 1)), start, step)


def plan_round(eligible: DataFrame, state: DataFrame, hot: DataFrame, size: int) -> DataFrame:
    plan = F.array(*[F.lit(t) for t in registry.SELECTION_PLAN])
    rows = fitting(eligible, state, hot, groups_of(F.col("picked")), inside=False)
    rows = rows.filter(F.array_contains(F.slice(plan, F.col("step") + 1, F.lit(PLAN)), F.col("page_type")))
    best = rows.groupBy("site", "page_type").agg(F.min_by(F.struct(*ROW), F.struct(*LINK_ORDER)).alias("_b"))
    best = best.groupBy("site").agg(F.collect_list("_b").alias("_best"))  # one row a type
    none = F.array().cast(best.schema["_best"].dataType)
    return state.join(best, "site", "left").select("site", planned(F.coalesce("_best", none), size).alias("_s")).select("site", "_s.picked", "_s.step")


def group_round(eligible: DataFrame, state: DataFrame, hot: DataFrame, size: int, second: bool) -> DataFrame:
    """`step` becomes `PLAN` + 1 for sites that need another round of this phase, else `PLAN` + 2."""
    used = groups_of(F.col("picked"))
    once = F.filter(used, lambda g: F.size(F.filter(used, lambda x: x == g)) == 1)
    rows = fitting(eligible, state, hot, once if second else used, inside=second)
    if second:
        rows = rows.filter(~F.col("page_type").isin(*SINGLE))
    order = LINK_ORDER if second else ["type_rank", *LINK_ORDER]  # further groups go by page type first
    rank = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])
    best = rows.groupBy("site", "signature").agg(F.min_by(F.struct(*ROW), rank).alias("_b"), F.min(rank).alias("_rank"))
    best = best_per_group(best, ["site"], [F.col("_rank")], size, "_no")
    best = best.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("_no", "_b"))).alias("_best"))  # at most `size` a site
    answers = F.transform(F.coalesce("_best", F.array().cast(best.schema["_best"].dataType)), lambda x: x["_b"])
    done = state.join(best, "site", "left").select("site", taken(answers, "second page" if second else "distinct group", size).alias("_s"))
    return done.select("site", "_s.picked", F.when(F.col("_s.again"), PLAN + 1).otherwise(PLAN + 2).alias("step"))


def sample(candidates: DataFrame, homes: DataFrame, supplied: DataFrame | None = None, size: int = registry.BUDGETS["max_selected_pages"]) -> DataFrame:
    """Up to `size` pages per site: site, slot, url, page_type, signature, reason, sample_id.

    Candidates count if they are not excluded, verified, and allowed for the auditor where `robots_auditor` says so.
    """
    fit = candidates.filter("excluded IS NULL AND verification = 'verified'")
    if "robots_auditor" in candidates.columns:
        fit = fit.filter("robots_auditor = 'ALLOW'")
    if supplied is not None:
        fit = fit.join(supplied_pages(supplied).select("site", "url"), ["site", "url"], "left_anti")
    eligible = cut(fit.select("site", *LINK_ORDER, *ROW), "eligible")
    hot = cut(heavy_keys(eligible, ["site"]), "hot-sites")
    state = cut(starting(homes, candidates, supplied, size), "sample-state")
    phases = [
        (F.col("step") < PLAN, lambda s: plan_round(eligible, s, hot, size)),
        (F.col("step") < PLAN + 2, lambda s: group_round(eligible, s, hot, size, second=False)),
        (F.col("step") < PLAN + 2, lambda s: group_round(eligible, s, hot, size, second=True)),
    ]
    for number, (unfinished, run) in enumerate(phases):
        if number == 2:
            state = state.withColumn("step", F.lit(PLAN))
        while True:
            open_sites = unfinished & (F.size("picked") < size)
            if state.filter(open_sites).isEmpty():
                break
            state = cut(run(state.filter(open_sites)).unionByName(state.filter(~open_sites)), "sample-state")
    rows = state.select("site", F.posexplode("picked").alias("_slot", "p")).select("site", (F.col("_slot") + 1).alias("slot"), "p.*")
    return rows.withColumn("sample_id", F.concat(F.lit("P"), F.lpad(F.col("slot").cast("string"), 2, "0")))
