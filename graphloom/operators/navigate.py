"""Symbol lookup by name, references, and previews of renaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph


def find_definition(g: Graph, name: str, exact: bool = False) -> DataFrame:
    """Items by name, exact matches first, then by full name and place."""
    low = F.lower("display_name")
    hit = F.col("display_name") == name if exact else low.contains(name.lower())
    rows = g.nodes.where(F.col("kind") == "Item").where(hit)
    rows = rows.select(F.col("qualified_name").alias("item"), (F.col("display_name") == name).alias("is_exact"), "file", F.col("span_start").alias("start"))
    return rows.orderBy(F.desc("is_exact"), "item", "file", "start")


def references(g: Graph, name: str, limit: int = 50) -> DataFrame:
    """Declarations and usages of the first ``limit`` items of a name, each place
    once, the declaration before a usage there."""
    items = g.nodes.where((F.col("kind") == "Item") & (F.col("display_name") == name)).orderBy("id").limit(limit)
    declared = items.select(F.col("qualified_name").alias("item"), "file", F.col("span_start").alias("start"), F.lit("declaration").alias("what"))
    used = g.usages.join(items.select(F.col("id").alias("target"), F.col("qualified_name").alias("item")), "target").select("item", "file", "start", F.lit("usage").alias("what"))
    return declared.union(used).groupBy("item", "file", "start").agg(F.min("what").alias("what"))


def rename_preview(g: Graph, item: str, new_name: str) -> DataFrame:
    """(file, start, stop, new_name): edits at the declaration and all usages.

    The item's full name must be unique.
    """
    hits = g.nodes.where((F.col("kind") == "Item") & (F.col("qualified_name") == item)).limit(2).collect()
    if len(hits) != 1:
        raise ValueError(f"{item!r} names {'several items' if hits else 'no item'}")
    n = hits[0]
    here = g.nodes.where(F.col("id") == n["id"]).select("file", F.col("span_start").alias("start"), F.col("span_end").alias("stop"))
    uses = g.usages.where(F.col("target") == n["id"]).select("file", "start", "stop")
    return here.union(uses).distinct().withColumn("new_name", F.lit(new_name))
