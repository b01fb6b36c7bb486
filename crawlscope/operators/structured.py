"""JSON-LD as VARIANT: typed nodes, features and missing properties, all inside the page row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from crawlscope.functions.sql import F

from crawlscope import registry
from crawlscope.functions.expr import each, let

DEPTH = 4


def type_names(node: Column) -> Column:
    """@type of a node as a list of strings."""
    listed = F.try_variant_get(node, '$["@type"]', "array<variant>")
    texts = F.transform(F.filter(listed, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    single = F.try_variant_get(node, '$["@type"]', "variant")
    return F.when(listed.isNotNull(), texts).when(F.schema_of_variant(single) == "STRING", F.array(F.try_variant_get(node, '$["@type"]', "string"))).otherwise(F.array().cast("array<string>"))


def typed_nodes(root: Column) -> Column:
    """All typed nodes reachable through lists and @graph, four levels deep."""
    none = F.array().cast("array<variant>")
    list_of = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), none)
    graph_of = lambda v: F.coalesce(F.array(F.try_variant_get(v, '$["@graph"]', "variant")), none)

    def level(nodes: Column) -> Column:
        return F.filter(F.flatten(F.transform(nodes, lambda n: F.concat(list_of(n), graph_of(n)))), lambda n: n.isNotNull())

    def walk(nodes: Column, left: int) -> Column:
        return let(nodes, lambda here: F.concat(here, walk(level(here), left - 1))) if left else nodes

    everything = walk(F.filter(F.array(root), lambda n: n.isNotNull()), DEPTH)
    shaped = F.transform(everything, lambda n: F.struct(n.alias("node"), type_names(n).alias("types")))
    return F.filter(shaped, lambda x: F.size(x["types"]) > 0)


def value_at(node: Column, path: str) -> Column:
    """Text of a property path; on lists the first element counts."""
    first, *rest = path.split(".")
    if not rest:
        return F.try_variant_get(node, f"$.{first}", "string")
    tail = ".".join(rest)
    return F.coalesce(F.try_variant_get(node, f"$.{first}.{tail}", "string"), F.try_variant_get(node, f"$.{first}[0].{tail}", "string"))


def present(text: Column) -> Column:
    return F.coalesce(~F.trim(text).isin("", "[]"), F.lit(False))


def missing(node: Column, feature: tuple) -> tuple[Column, Column]:
    """(missing required, missing recommended) property names for one feature definition."""
    name, _, _, required, one_of, recommended, _, _ = feature
    absent = lambda names: F.filter(F.array(*[F.when(~present(value_at(node, p)), F.lit(p)) for p in names]), lambda p: p.isNotNull()) if names else F.array().cast("array<string>")
    need = absent(required.split())
    if one_of:
        options = one_of.split()
        none_present = ~F.greatest(*[present(value_at(node, p)) for p in options], F.lit(False))
        need = F.concat(need, F.when(none_present, F.array(F.lit("one of " + " / ".join(options)))).otherwise(F.array().cast("array<string>")))
    if name == "Breadcrumb":
        single = F.try_variant_get(node, "$.itemListElement", "variant")
        items = F.coalesce(F.try_variant_get(node, "$.itemListElement", "array<variant>"), F.array(single))

        def holes(all_items: Column) -> Column:
            return F.flatten(F.transform(all_items, lambda li, i: F.filter(F.array(
                F.when(~present(value_at(li, "name")) & ~present(value_at(li, "item.name")), F.format_string("itemListElement[%d].name", i)),
                F.when(~present(value_at(li, "position")), F.format_string("itemListElement[%d].position", i)),
                F.when((i < F.size(all_items) - 1) & ~present(value_at(li, "item")), F.format_string("itemListElement[%d].item", i)),
            ), lambda x: x.isNotNull())))

        need = F.concat(need, F.when(present(value_at(node, "itemListElement")), let(items, holes)).otherwise(F.array().cast("array<string>")))
    return need, absent(recommended.split())


def feature_of(types: Column) -> Column:
    """First registered feature among the types of a node; NULL when none is."""
    name = F.coalesce(*[F.when(t.isNotNull(), t) for t in [F.get(F.filter(F.transform(types, _feature_name), lambda x: x.isNotNull()), F.lit(0))]])
    return name


def _feature_name(t: Column) -> Column:
    out = F.lit(None).cast("string")
    for f in registry.FEATURES:
        out = F.when(t.isin(*f[1].split()), F.lit(f[0])).otherwise(out)
    return out


def graded_nodes(json_ld: Column) -> Column:
    """array<struct(types, feature, required, recommended, label)> over all JSON-LD blocks of a page."""
    empty = F.array().cast("array<string>")

    def grade(n: Column) -> Column:
        return let(feature_of(n["types"]), lambda feature: F.struct(
            n["types"].alias("types"),
            feature.alias("feature"),
            _by_feature(feature, lambda f: missing(n["node"], f)[0], empty).alias("required"),
            _by_feature(feature, lambda f: missing(n["node"], f)[1], empty).alias("recommended"),
            _by_feature(feature, lambda f: F.coalesce(*[F.try_variant_get(n["node"], f"$.{v}", "string") for v in f[7].split()]) if f[7] else F.lit(None).cast("string"), F.lit(None).cast("string")).alias("label"),
        ))

    nodes = F.flatten(F.transform(json_ld, lambda b: typed_nodes(F.try_parse_json(b["raw"]))))
    return F.transform(nodes, grade)


def _by_feature(feature: Column, value, default: Column) -> Column:
    out = None
    for f in registry.FEATURES:
        out = F.when(feature == f[0], value(f)) if out is None else out.when(feature == f[0], value(f))
    return out.otherwise(default)


def broken_blocks(json_ld: Column) -> Column:
    return F.filter(json_ld, lambda b: F.try_parse_json(b["raw"]).isNull())


def exploded_nodes(facts: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    numbered = F.transform(graded_nodes(F.col("json_ld")), lambda n, i: F.struct(i.alias("node_no"), n.alias("n")))
    return each(facts, list(keys), numbered, "x").select(*keys, "x.node_no", "x.n.*")
