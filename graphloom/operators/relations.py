"""Imports, exports, callers and usages, and the rollups between crates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import CONTAINERS, Graph, declared_visibility, visibility_label
from graphloom.operators.traverse import ancestors

CATEGORIES = ("Write", "Read", "Test", "Other")


def enrich_bindings(g: Graph, b: DataFrame) -> DataFrame:
    """Names in place of ids; a binding whose nodes are missing is an error."""
    out = b.join(g.names("from_module", "module_name"), "from_module", "left").join(g.names("target", "target_name"), "target", "left")
    out = out.join(g.names("vis_node", "vis_name"), "vis_node", "left")
    name = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit("binding refers to a missing node"))).otherwise(F.col(c)).alias(c)
    return out.select(name("module_name"), "visible_name", name("target_name"), "namespace", "kind", visibility_label().alias("visibility"))


def imports_of(g: Graph, module: str) -> DataFrame:
    return enrich_bindings(g, g.at(g.bindings, "from_module", module, "Module").where("kind <> 'Declared'"))


def who_imports(g: Graph, target: str) -> DataFrame:
    return enrich_bindings(g, g.at(g.bindings, "target", target).where("kind <> 'Declared'"))


def declared_reexports(g: Graph, module: str) -> DataFrame:
    return enrich_bindings(g, g.at(g.bindings, "from_module", module, "Module").where("kind <> 'Declared' AND is_explicit_pub_use"))


def visible_bindings(g: Graph, module: str, consumer: str) -> DataFrame:
    """Bindings of ``module`` that ``consumer`` may name."""
    own = g.find(consumer, "Module").select(F.col("crate_id").alias("consumer_crate"))
    above = ancestors(g.nodes, g.find(consumer, "Module").select("id")).select(F.col("ancestor").alias("vis_node"), F.lit(True).alias("above"))
    rows = g.at(g.bindings, "from_module", module, "Module").join(above, "vis_node", "left").crossJoin(F.broadcast(own))  # one row
    seen = (F.col("vis_tag") == "Public") | ((F.col("vis_tag") == "Crate") & (F.col("vis_node") == F.col("consumer_crate"))) | ((F.col("vis_tag") == "RestrictedTo") & F.coalesce("above", F.lit(False)))
    return rows.where(seen).drop("consumer_crate", "above")


def exports_of(g: Graph, module: str, consumer: str) -> DataFrame:
    return enrich_bindings(g, visible_bindings(g, module, consumer))


def reexports_of(g: Graph, module: str, consumer: str) -> DataFrame:
    return enrich_bindings(g, visible_bindings(g, module, consumer).where("kind <> 'Declared'"))


def who_uses(g: Graph, target: str) -> DataFrame:
    rows = g.at(g.usages, "target", target)
    return rows.join(g.names("consumer_module", "module_name"), "consumer_module").select("module_name", "file", "start", "stop", "category")


def who_uses_summary(g: Graph, target: str) -> DataFrame:
    """Usages of a target by consumer module and category."""
    rows = g.at(g.usages, "target", target).groupBy("consumer_module")
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col("category") == c).alias(f"n_{c.lower()}") for c in CATEGORIES])
    return counts.join(g.names("consumer_module", "module_name"), "consumer_module").drop("consumer_module")


def who_calls(g: Graph, target: str) -> DataFrame:
    rows = g.at(g.usages, "target", target).where("consumer_function IS NOT NULL")
    return rows.join(g.names("consumer_function", "caller"), "consumer_function", "left").select("caller", "file", "start", "stop", "category")


def calls_from(g: Graph, caller: str) -> DataFrame:
    rows = g.at(g.usages, "consumer_function", caller)
    return rows.join(g.names("target", "callee"), "target", "left").select(F.coalesce("callee", F.lit("")).alias("callee"), "file", "start", "stop", "category")


def callers_in_crate(g: Graph, target: str, crate: str) -> DataFrame:
    """Calls of a target from functions of one crate."""
    inside = g.nodes.join(g.crates().where(F.col("crate_name") == crate), "crate_id").select(F.col("id").alias("consumer_function"), F.col("qualified_name").alias("caller"), "crate_name")
    return g.at(g.usages, "target", target).join(inside, "consumer_function").select("caller", "crate_name", "file", "start", "stop")


def containers(g: Graph) -> DataFrame:
    """(id, container): each node's module, crate or external symbol.

    Items lie at most two levels below one, so two lookups settle all.
    """
    up = g.nodes.select(F.col("id").alias("parent_id"), F.col("kind").alias("pkind"), F.col("parent_id").alias("ppid"))
    rows = g.nodes.where("kind <> 'Workspace'").join(up, "parent_id", "left")
    own = F.col("kind").isin(*CONTAINERS)
    return rows.select("id", F.when(own, F.col("id")).when(F.col("pkind").isin(*CONTAINERS), F.col("parent_id")).otherwise(F.col("ppid")).alias("container"))


def module_dependencies(g: Graph, module: str) -> DataFrame:
    """What a module imports and uses, by container of the target."""
    home = containers(g).withColumnsRenamed({"id": "target", "container": "dep"})
    imports = g.at(g.bindings, "from_module", module, "Module").where("kind <> 'Declared'").select("target", F.lit(1).alias("i"), F.lit(0).alias("u"), F.col("kind").alias("bk"))
    usages = g.at(g.usages, "consumer_module", module, "Module").select("target", F.lit(0).alias("i"), F.lit(1).alias("u"), F.lit(None).cast("string").alias("bk"))
    me = g.find(module, "Module").select(F.col("id").alias("dep"))
    rows = imports.unionByName(usages).join(home, "target").join(F.broadcast(me), "dep", "left_anti")  # one row
    out = rows.groupBy("dep").agg(F.sum("i").alias("imports"), F.sum("u").alias("usages"), F.count_distinct("target").alias("symbols"), F.array_join(F.array_sort(F.collect_set("bk")), ",").alias("binding_kinds"))
    return out.join(g.nodes.select(F.col("id").alias("dep"), F.col("qualified_name").alias("dependency"), "kind"), "dep").drop("dep")


def crate_symbols(g: Graph) -> DataFrame:
    """(consumer, producer, target, imports, usages, kind) between unlike crates."""
    home = g.nodes.where("crate_id IS NOT NULL").select("id", "crate_id")
    produced = home.select(F.col("id").alias("target"), F.col("crate_id").alias("producer"))
    imports = g.bindings.where("kind <> 'Declared'").groupBy("from_module", "target").agg(F.count("*").alias("imports"), F.min("kind").alias("kind"))
    imports = imports.select(F.col("from_module").alias("m"), "target", "imports", F.lit(0).cast("long").alias("usages"), "kind")
    usages = g.usages.groupBy("consumer_module", "target").agg(F.count("*").alias("usages"))
    usages = usages.select(F.col("consumer_module").alias("m"), "target", F.lit(0).cast("long").alias("imports"), "usages", F.lit(None).cast("string").alias("kind"))
    rows = imports.unionByName(usages).join(home.select(F.col("id").alias("m"), F.col("crate_id").alias("consumer")), "m").join(produced, "target").where("consumer <> producer")
    return rows.groupBy("consumer", "producer", "target").agg(F.sum("imports").alias("imports"), F.sum("usages").alias("usages"), F.min("kind").alias("kind"))


def crate_edges(g: Graph) -> DataFrame:
    """Dependency rollup: symbols, imports and usages from crate to crate."""
    rows = crate_symbols(g).groupBy("consumer", "producer").agg(F.count("*").alias("symbols"), F.sum("imports").alias("imports"), F.sum("usages").alias("usages"))
    c, p = g.names("consumer", "consumer_crate"), g.names("producer", "producer_crate")
    return rows.join(c, "consumer").join(p, "producer").select("consumer_crate", "producer_crate", "symbols", "imports", "usages")


def top_symbols(g: Graph) -> DataFrame:
    """The most referenced symbol of each crate edge, the first by name on ties."""
    rows = crate_symbols(g).join(g.names("target", "symbol"), "target")
    best = F.min_by(F.struct("symbol", "imports", "usages", "kind"), F.struct(-(F.col("imports") + F.col("usages")), "symbol"))
    rows = rows.groupBy("consumer", "producer").agg(best.alias("b")).select("consumer", "producer", "b.*")
    return rows.join(g.names("consumer", "consumer_crate"), "consumer").join(g.names("producer", "producer_crate"), "producer").drop("consumer", "producer")


def dependency_metric(g: Graph) -> DataFrame:
    """Coupling, instability and abstractness of every crate."""
    edges = crate_edges(g)
    out = edges.groupBy(F.col("consumer_crate").alias("crate_name")).agg(F.count_distinct("producer_crate").alias("efferent"))
    inc = edges.groupBy(F.col("producer_crate").alias("crate_name")).agg(F.count_distinct("consumer_crate").alias("afferent"))
    vis = declared_visibility(g).select(F.col("target").alias("id"), "vis_tag")
    abstract = (F.col("item_kind") == "Trait") | ((F.col("item_kind") == "TypeAlias") & (F.col("vis_tag") == "Public"))
    items = g.nodes.where("kind = 'Item'").join(vis, "id", "left").groupBy("crate_id").agg(F.count("*").alias("item_count"), F.count_if(abstract).alias("abstract_count"))
    rows = g.crates().join(out, "crate_name", "left").join(inc, "crate_name", "left").join(items, "crate_id", "left").na.fill(0, ["efferent", "afferent", "item_count", "abstract_count"])
    ratio = lambda a, b: F.round(F.when(b == 0, F.lit(0.0)).otherwise(a / b), 6)
    return rows.select("crate_name", "efferent", "afferent", "item_count", ratio(F.col("efferent"), F.col("efferent") + F.col("afferent")).alias("instability"), ratio(F.col("abstract_count"), F.col("item_count")).alias("abstractness"))


def rank_metric(metric: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """The metric's rows by one of its numbers, descending, then by name."""
    if key not in ("instability", "abstractness", "item_count", "afferent", "efferent"):
        raise ValueError(f"unknown sort key {key!r}")
    rows = metric.orderBy(F.desc(key), "crate_name")
    return rows if top is None else rows.limit(top)


def glob_pattern(glob: str) -> str:
    """The LIKE pattern, with escape ``\\``, of a glob that knows only ``*``."""
    return "".join({"*": "%", "%": "\\%", "_": "\\_", "\\": "\\\\"}.get(c, c) for c in glob)


def glob_match(text: Column, glob: str) -> Column:
    return text.like(glob_pattern(glob))


def forbidden_dependencies(g: Graph, rules: Sequence[dict]) -> DataFrame:
    """Crate edges that break a rule, with their most used symbol.

    A rule has consumer and producer globs and may have kinds (of the consuming
    crate; default lib and bin, ``*`` for any), except_ (a consumer glob) and
    severity. Rules are a short list that becomes part of the plan.
    """
    edges = top_symbols(g).join(g.crates().select(F.col("crate_name").alias("consumer_crate"), "crate_target_kind"), "consumer_crate")
    out = []
    for i, r in enumerate(rules):
        kinds = [{"custom-build": "build"}.get(k, k) for k in r.get("kinds", ["lib", "bin"])]
        hit = glob_match(F.col("consumer_crate"), r["consumer"]) & glob_match(F.col("producer_crate"), r["producer"])
        if "*" not in kinds:
            hit &= F.col("crate_target_kind").isin(*kinds)
        if r.get("except_"):
            hit &= ~glob_match(F.col("consumer_crate"), r["except_"])
        out.append(F.when(hit, F.struct(F.lit(i).cast("long").alias("rule_index"), F.lit(r.get("severity", "error")).alias("severity"))))
    broken = F.explode(F.array_compact(F.array(*out))).alias("r")
    return edges.select("consumer_crate", "producer_crate", "symbol", broken).select("r.rule_index", "r.severity", "consumer_crate", "producer_crate", F.col("symbol").alias("sample"))


def test_or_prod(g: Graph) -> DataFrame:
    """Whether an item is used by tests only, by other code only, or by both."""
    rows = g.usages.groupBy("target").agg(F.count("*").alias("n"), F.count_if(F.col("category") == "Test").alias("tests"))
    kind = F.when(F.col("tests") == F.col("n"), F.lit("test")).when(F.col("tests") == 0, F.lit("prod")).otherwise(F.lit("mixed"))
    return rows.join(g.names("target", "item"), "target").select("item", "n", "tests", kind.alias("class"))


def hubs_and_leaves(g: Graph) -> DataFrame:
    """Functions by whether they call, are called, both or neither."""
    fns = g.nodes.where(F.col("item_kind").isin("Function", "Method")).select("id", F.col("qualified_name").alias("item"))
    edges = g.usages.select("consumer_function", "target").distinct()
    out = edges.groupBy(F.col("consumer_function").alias("id")).agg(F.count("*").alias("calls"))
    inc = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("callers"))
    rows = fns.join(out, "id", "left").join(inc, "id", "left").na.fill(0)
    kind = F.when((F.col("calls") == 0) & (F.col("callers") == 0), F.lit("isolated")).when(F.col("calls") == 0, F.lit("leaf")).when(F.col("callers") == 0, F.lit("root")).when(F.col("callers") >= 2 * F.col("calls"), F.lit("hub")).otherwise(F.lit("midstream"))
    return rows.select("item", "calls", "callers", kind.alias("class"))
