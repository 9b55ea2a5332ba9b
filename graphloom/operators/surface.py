"""What a crate shows: types, attributes, dead items, overlaps, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import TYPES, Graph, declared_visibility

TEST_PATH = "::tests::"
# Item kinds that a missing doc comment is reported for.
DOCUMENTED = ("Function", "Struct", "Enum", "Union", "Trait", "TypeAlias", "Const", "Static", "Method")
# What marks a static as shared mutable or lazy state.
STATIC_PATTERNS = ("LazyLock", "OnceLock", "OnceCell")
# Names that callers may use for item kinds.
KIND_NAMES = {"fn": "Function", "function": "Function", "struct": "Struct", "enum": "Enum", "union": "Union", "trait": "Trait", "type": "TypeAlias", "type_alias": "TypeAlias", "typealias": "TypeAlias", "const": "Const", "static": "Static", "assoc_fn": "AssocFunction", "assoc_const": "AssocConst", "assoc_type": "AssocType", "method": "Method", "variant": "EnumVariant", "enum_variant": "EnumVariant"}


def item_kind(name: str) -> str:
    try:
        return KIND_NAMES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown item kind {name!r}") from None


def enum_variants(g: Graph, enum: str) -> DataFrame:
    kids = g.nodes.where("item_kind = 'EnumVariant'").withColumnRenamed("id", "child").withColumnRenamed("parent_id", "id")
    return g.at(kids, "id", enum).select(F.col("display_name").alias("variant"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce("span_start", F.lit(0)).alias("span_start"))


def all_enum_variants(g: Graph) -> DataFrame:
    """Variants of every enum, in source order."""
    kids = g.nodes.where("item_kind = 'EnumVariant'").select(F.col("parent_id").alias("id"), F.col("display_name").alias("variant"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce("span_start", F.lit(0)).alias("span_start"))
    return kids.join(g.names("id", "enum"), "id").select("enum", "variant", "file", "span_start")


def item_attributes(g: Graph) -> DataFrame:
    """One row for each attribute, with its place in source order."""
    return g.nodes.where("kind = 'Item'").select(F.col("qualified_name").alias("item"), F.posexplode("attributes").alias("pos", "attribute")).select("item", F.col("pos").cast("long").alias("pos"), "attribute")


def attribute_path(a: Column) -> Column:
    return F.regexp_extract(a, r"^#!?\[\s*([A-Za-z0-9_:]+)", 1)


def matches_attribute(a: Column, pattern: str) -> Column:
    """How an attribute matches a pattern: attr, doc or null.

    A pattern matches as prefix of the raw text; a bare name also as the whole
    path or its last segment, anything else as prefix of what is in the
    brackets; doc lines match by prefix of their text.
    """
    if not pattern:
        return F.lit(None).cast("string")
    path = attribute_path(a)
    bare = pattern.replace("_", "").isalnum()
    inner = (path == pattern) | (F.substring_index(path, "::", -1) == pattern) if bare else F.regexp_replace(a, r"^#!?\[\s*", "").startswith(pattern)
    is_attr = a.startswith("#")
    return F.when(a.startswith(pattern) | (is_attr & inner), F.when(is_attr, F.lit("attr")).otherwise(F.lit("doc"))).when(a.startswith("/// ") & F.substring(a, 5, 1 << 20).startswith(pattern), F.lit("doc"))


def items_with_attribute(g: Graph, pattern: str, crate: str | None = None) -> DataFrame:
    """Items by their first attribute that matches."""
    hit = F.filter("attributes", lambda a: matches_attribute(a, pattern).isNotNull())
    rows = g.nodes.where("kind = 'Item'").withColumn("hit", F.get(hit, F.lit(0))).where("hit IS NOT NULL")
    if crate:
        rows = rows.join(g.crates().where(F.col("crate_name") == crate), "crate_id", "left_semi")
    return rows.select(F.col("qualified_name").alias("item"), F.col("hit").alias("attribute"), matches_attribute(F.col("hit"), pattern).alias("matched"))


def crate_types(g: Graph, crate: str | None = None, kinds: Sequence[str] = TYPES, pub_only: bool = False, skip_tests: bool = False) -> DataFrame:
    rows = g.nodes.where(F.col("item_kind").isin(*kinds))
    if skip_tests:
        rows = rows.where(~F.col("qualified_name").contains(TEST_PATH))
    if crate:
        rows = rows.join(g.crates().where(F.col("crate_name") == crate), "crate_id", "left_semi")
    vis = declared_visibility(g).select(F.col("target").alias("id"), "vis_tag")
    rows = rows.join(vis, "id", "left")
    if pub_only:
        rows = rows.where("vis_tag = 'Public'")
    return rows.select(F.col("qualified_name").alias("item"), "item_kind", F.coalesce("vis_tag", F.lit("Private")).alias("visibility"))


def pub_use_pub_type(g: Graph) -> DataFrame:
    """Type aliases whose parent re-exports something else under their name."""
    alias = g.nodes.where("item_kind = 'TypeAlias'").select(F.col("id").alias("alias_id"), F.col("qualified_name").alias("alias"), F.col("parent_id").alias("from_module"), F.col("display_name").alias("visible_name"))
    rows = g.bindings.where("is_explicit_pub_use").join(alias, ["from_module", "visible_name"]).where("target <> alias_id")
    return rows.join(g.names("target", "reexported"), "target").select("alias", "reexported")


def functions_with(g: Graph, is_async: bool | None = None, min_params: int | None = None, param_type: str | None = None, returns: str | None = None, self_kind: str | None = None) -> DataFrame:
    """Functions whose signature meets every given condition."""
    rows = g.signatures
    if is_async is not None:
        rows = rows.where(F.col("is_async") == is_async)
    if min_params is not None:
        rows = rows.where(F.size("params") >= min_params)
    if param_type is not None:
        rows = rows.where(F.exists("params", lambda p: p["ty"].contains(param_type)))
    if returns is not None:
        rows = rows.where(F.col("return_type").contains(returns))
    if self_kind is not None:
        rows = rows.where(F.col("self_param") == self_kind)
    shown = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit(": "), p["ty"])), ", ")
    return rows.join(g.names("target", "item"), "target").select("item", "is_async", "self_param", shown.alias("params"), "return_type")


def dead_pub(g: Graph, min_weight: float = 0.0) -> DataFrame:
    """Public items that no other crate imports or uses.

    min_weight: usages below this weight do not count.
    """
    home = g.nodes.select("id", "crate_id")
    items = g.bindings.where("kind = 'Declared' AND vis_tag = 'Public'").select("target").distinct()
    items = items.join(g.nodes.where("kind = 'Item'").select(F.col("id").alias("target"), F.col("qualified_name").alias("item"), "crate_id", "item_kind"), "target")
    imports = g.bindings.where("kind <> 'Declared'").select("target", F.col("from_module").alias("m"))
    uses = g.usages.where(F.col("weight") >= min_weight).select("target", F.col("consumer_module").alias("m"))
    seen = imports.union(uses).distinct().join(home.select(F.col("id").alias("m"), F.col("crate_id").alias("from_crate")), "m")
    seen = seen.select("target", "from_crate").distinct()
    outside = F.col("i.crate_id") != F.col("s.from_crate")
    alone = items.alias("i").join(seen.alias("s"), (F.col("i.target") == F.col("s.target")) & outside, "left_anti")
    return alone.join(g.crates(), "crate_id").select("crate_name", "item", "item_kind")


def dead_pub_report(g: Graph, min_weight: float = 0.0) -> DataFrame:
    """Number of dead public items of every crate, zeros included."""
    counts = dead_pub(g, min_weight).groupBy("crate_name").agg(F.count("*").alias("dead"))
    return g.crates().select("crate_name").join(counts, "crate_name", "left").na.fill(0)


def scope(g: Graph, which: str = "all") -> DataFrame:
    """(crate_id, crate_name) of all crates, the local ones (lib and bin), or
    those without files under ``vendor/``."""
    rows = g.crates()
    if which == "all":
        return rows.select("crate_id", "crate_name")
    rows = rows.where(F.coalesce("crate_target_kind", F.lit("lib")).isin("lib", "bin"))
    if which == "local_no_vendor":
        vendored = g.nodes.where(F.col("file").startswith("vendor/") | F.col("file").contains("/vendor/")).select("crate_id").distinct()
        rows = rows.join(vendored, "crate_id", "left_anti")
    elif which != "local":
        raise ValueError(f"unknown scope {which!r}")
    return rows.select("crate_id", "crate_name")


def _named(g: Graph, which: str, kinds: Sequence[str]) -> DataFrame:
    return g.nodes.where(F.col("item_kind").isin(*kinds)).join(scope(g, which), "crate_id").withColumnRenamed("display_name", "name")


def type_collisions(g: Graph, which: str = "all") -> DataFrame:
    """Type names declared in two crates or more."""
    rows = _named(g, which, ("Struct", "Enum", "Trait", "TypeAlias")).groupBy("name")
    return rows.agg(F.count_distinct("crate_id").alias("crates"), F.count("*").alias("items")).where("crates >= 2")


def duplicates_in_crate(g: Graph, which: str = "all") -> DataFrame:
    rows = _named(g, which, ("Struct", "Enum", "Trait", "TypeAlias")).groupBy("crate_name", "name")
    return rows.agg(F.count("*").alias("items")).where("items >= 2")


def common_functions(g: Graph, which: str = "all", min_crates: int = 4) -> DataFrame:
    """Function names that several crates share, with the crates."""
    rows = _named(g, which, ("Function",)).groupBy("name").agg(F.array_sort(F.collect_set("crate_name")).alias("c"))
    return rows.where(F.size("c") >= min_crates).select("name", F.size("c").cast("long").alias("crates"), F.array_join("c", ",").alias("crate_names"))


def module_shadows(g: Graph, which: str = "all") -> DataFrame:
    """Modules that bear the name of another crate."""
    own = scope(g, which)
    mods = g.nodes.where("kind = 'Module'").join(own, "crate_id").select(F.col("qualified_name").alias("module"), F.col("display_name").alias("name"), "crate_name")
    return mods.join(own.select(F.col("crate_name").alias("name")), "name", "left_semi").where("name <> crate_name")


def workspace_stats(g: Graph) -> DataFrame:
    """(metric, value): counts by kind of node, item, binding and visibility."""
    def counted(df: DataFrame, label: str, col: str) -> DataFrame:
        return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").cast("double").alias("value")).select(F.concat(F.lit(f"{label}:"), F.col(col)).alias("metric"), "value")

    declared = declared_visibility(g)
    private = (F.col("vis_tag") == "Private") | ((F.col("vis_tag") == "RestrictedTo") & (F.col("vis_node") == F.col("from_module")))
    bucket = F.when(private, F.lit("module_private")).when(F.col("vis_tag") == "Crate", F.lit("pub_crate")).when(F.col("vis_tag") == "Public", F.lit("pub")).otherwise(F.lit("restricted_to"))
    declared = declared.withColumn("bucket", bucket)
    p, c = F.count_if(F.col("bucket") == "pub"), F.count_if(F.col("bucket") == "pub_crate")
    share = declared.agg(F.round(F.when(p + c == 0, F.lit(0.0)).otherwise(c / (p + c)), 6).alias("value")).select(F.lit("pub_crate_share").alias("metric"), "value")
    return counted(g.nodes, "node", "kind").union(counted(g.nodes, "item", "item_kind")).union(counted(g.bindings, "binding", "kind")).union(counted(declared, "visibility", "bucket")).union(share)


def missing_docs(g: Graph, kinds: Sequence[str] = DOCUMENTED) -> DataFrame:
    """Public items without a doc line."""
    vis = declared_visibility(g).where("vis_tag = 'Public'").select(F.col("target").alias("id"))
    rows = g.nodes.where(F.col("item_kind").isin(*kinds) & ~F.exists("attributes", lambda a: a.startswith("///"))).join(vis, "id", "left_semi")
    return rows.select(F.col("qualified_name").alias("item"), "item_kind", "file", "span_start")


def derives(attributes: Column) -> Column:
    """Sorted last path segments of everything derived."""
    bodies = F.filter(attributes, lambda a: a.startswith("#[derive("))
    names = F.flatten(F.transform(bodies, lambda a: F.split(F.regexp_extract(a, r"^#\[derive\((.*)\)\]", 1), ",")))
    names = F.transform(names, lambda n: F.substring_index(F.trim(n), "::", -1))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n != "")))


def derive_audit(g: Graph, required: Sequence[str] = ("Debug", "Clone"), pub_only: bool = False) -> DataFrame:
    """Types that lack a required derive."""
    rows = g.nodes.where(F.col("item_kind").isin("Struct", "Enum", "Union"))
    if pub_only:
        rows = rows.join(declared_visibility(g).where("vis_tag = 'Public'").select(F.col("target").alias("id")), "id", "left_semi")
    has = derives(F.col("attributes"))
    lacks = F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), has))
    rows = rows.select(F.col("qualified_name").alias("item"), has.alias("has"), lacks.alias("lacks")).where(F.size("lacks") > 0)
    return rows.select("item", F.array_join("has", ",").alias("derives"), F.array_join("lacks", ",").alias("missing"))


def mutable_statics(g: Graph) -> DataFrame:
    """A row for each pattern that a static matches."""
    found = F.array_compact(F.array(F.when(F.col("is_mut"), F.lit("static mut")), *[F.when(F.col("type_string").contains(p), F.lit(p)) for p in STATIC_PATTERNS]))
    return g.statics.select("target", "type_string", F.explode(found).alias("pattern")).join(g.names("target", "item"), "target").select("item", "type_string", "pattern")


# Channel constructors, as path, kind, bounded.
CHANNELS = (
    ("tokio::sync::mpsc::channel", "tokio_mpsc", True), ("tokio::sync::mpsc::unbounded_channel", "tokio_mpsc_unbounded", False),
    ("tokio::sync::broadcast::channel", "tokio_broadcast", True), ("tokio::sync::watch::channel", "tokio_watch", True),
    ("tokio::sync::oneshot::channel", "tokio_oneshot", True), ("std::sync::mpsc::channel", "std_mpsc", False),
    ("std::sync::mpsc::sync_channel", "std_sync", True), ("crossbeam_channel::bounded", "crossbeam_bounded", True),
    ("crossbeam_channel::unbounded", "crossbeam_unbounded", False), ("futures::channel::mpsc::channel", "futures_mpsc", True),
)


def capacity(literal: Column) -> Column:
    """A capacity literal as a number; null for anything but one."""
    digits = F.regexp_replace(literal, "_", "")
    return F.when(digits.rlike("^[0-9]+$"), digits.try_cast("long"))


def channel_audit(calls: DataFrame) -> DataFrame:
    """Call sites (path, argument, ...) of channel constructors."""
    known = calls.sparkSession.createDataFrame(list(CHANNELS), "path string, channel string, bounded boolean")
    return calls.join(F.broadcast(known), "path").withColumn("capacity", F.when(F.col("bounded"), capacity(F.col("argument"))))  # ten rows
