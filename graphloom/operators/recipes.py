"""Compositions of graph lookups that answer a question of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph
from graphloom.operators.relations import containers


def blast_radius(g: Graph) -> DataFrame:
    """(item, out_degree, usages, priority): functions by the number of different
    things they call times the number of times they are used."""
    fns = g.nodes.where(F.col("item_kind").isin("Function", "Method")).select("id", F.col("qualified_name").alias("item"))
    out = g.usages.select("consumer_function", "target").distinct().groupBy(F.col("consumer_function").alias("id")).agg(F.count("*").alias("out_degree"))
    used = g.usages.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("usages"))
    rows = fns.join(out, "id", "left").join(used, "id", "left").na.fill(0, ["out_degree", "usages"])
    return rows.select("item", "out_degree", "usages", (F.col("out_degree") * F.col("usages")).alias("priority"))


def _crossings(g: Graph, level: str) -> DataFrame:
    """(item, src, dst): usages between modules or crates, by who uses."""
    if level not in ("module", "crate"):
        raise ValueError(f"unknown level {level!r}")
    if level == "module":
        home = containers(g).select("id", F.col("container").alias("c"))
    else:
        home = g.nodes.where("crate_id IS NOT NULL").select("id", F.col("crate_id").alias("c"))
    rows = g.usages.select(F.col("consumer_function").alias("item"), "consumer_module", "target")
    rows = rows.join(home.select(F.col("id").alias("consumer_module"), F.col("c").alias("src")), "consumer_module")
    return rows.join(home.select(F.col("id").alias("target"), F.col("c").alias("dst")), "target").select("item", "src", "dst")


def boundary_density(g: Graph, level: str = "module") -> DataFrame:
    """(container, internal, external, share, is_boundary): usages that stay in a
    module or crate and those that leave it; a boundary has more of the former."""
    rows = _crossings(g, level).groupBy(F.col("src").alias("id")).agg(F.count_if(F.col("src") == F.col("dst")).alias("internal"), F.count_if(F.col("src") != F.col("dst")).alias("external"))
    share = F.round(F.col("internal") / (F.col("internal") + F.col("external")), 6)
    return rows.join(g.names("id", "container"), "id").select("container", "internal", "external", share.alias("share"), (F.col("internal") > F.col("external")).alias("is_boundary"))


def alignment(g: Graph) -> DataFrame:
    """(item, home, best, n): functions whose usages end in another crate than
    their own for the most part; of equals the own crate, then the first by id."""
    own = g.nodes.select(F.col("id").alias("item"), F.col("crate_id").alias("home"), F.col("qualified_name").alias("name"))
    ends = g.nodes.where("crate_id IS NOT NULL").select(F.col("id").alias("target"), F.col("crate_id").alias("dst"))
    rows = g.usages.select(F.col("consumer_function").alias("item"), "target").join(ends, "target").groupBy("item", "dst").agg(F.count("*").alias("n")).join(own, "item")
    best = F.min_by(F.struct("dst", "n"), F.struct(-F.col("n"), F.col("dst") != F.col("home"), "dst"))
    rows = rows.groupBy("item", "home", "name").agg(best.alias("b")).where("b.dst <> home")
    names = g.names("dst", "best")
    rows = rows.select(F.col("name").alias("item"), "home", "b.dst", "b.n").join(names, "dst")
    return rows.join(g.names("home", "home_name"), "home").select("item", F.col("home_name").alias("home"), "best", "n")


def trait_audit(g: Graph) -> DataFrame:
    """(item, importers, users, crates, verdict) of traits: those that no other
    crate uses may be sealed, those with one importing module inlined."""
    traits = g.nodes.where("item_kind = 'Trait'").select(F.col("id").alias("target"), F.col("qualified_name").alias("item"), F.col("crate_id").alias("home"))
    crate = g.nodes.select(F.col("id").alias("m"), "crate_id")
    imports = g.bindings.where("kind <> 'Declared'").select("target", F.col("from_module").alias("m"), F.lit(1).alias("i"))
    usages = g.usages.select("target", F.col("consumer_module").alias("m"), F.lit(0).alias("i"))
    seen = traits.join(imports.union(usages).join(crate, "m"), "target", "left")
    rows = seen.groupBy("item").agg(
        F.count_distinct(F.when(F.col("i") == 1, F.col("m"))).alias("importers"),
        F.count_distinct(F.when(F.col("i") == 0, F.col("m"))).alias("users"),
        F.count_distinct(F.when(F.col("crate_id") != F.col("home"), F.col("crate_id"))).alias("crates"),
    )
    verdict = F.when(F.col("crates") == 0, F.lit("seal")).when((F.col("importers") == 1) & (F.col("users") <= 1), F.lit("inline")).otherwise(F.lit("keep"))
    return rows.withColumn("verdict", verdict)


def method_fate(g: Graph) -> DataFrame:
    """(item, n, class) of methods: dead, test-only, critical or mixed by who uses them."""
    methods = g.nodes.where("item_kind = 'Method'").select(F.col("id").alias("target"), F.col("qualified_name").alias("item"))
    used = g.usages.groupBy("target").agg(F.count("*").alias("n"), F.count_if(F.col("category") == "Test").alias("tests"))
    rows = methods.join(used, "target", "left").na.fill(0, ["n", "tests"])
    kind = F.when(F.col("n") == 0, F.lit("dead")).when(F.col("tests") == F.col("n"), F.lit("test_only")).when(F.col("tests") == 0, F.lit("critical")).otherwise(F.lit("mixed"))
    return rows.select("item", "n", kind.alias("class"))


def root_modules(g: Graph) -> DataFrame:
    """(crate_name, root_id): the module of each crate that has its name."""
    mods = g.nodes.where("kind = 'Module'").select(F.col("id").alias("root_id"), F.col("parent_id").alias("crate_id"), "qualified_name")
    crates = g.nodes.where("kind = 'Crate'").select(F.col("id").alias("crate_id"), F.col("qualified_name").alias("crate_name"))
    return mods.join(crates, "crate_id").where("qualified_name = crate_name").select("crate_name", "root_id")
