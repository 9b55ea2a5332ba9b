"""The graph tables, and lookups that most operators share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALLABLE = ("Function", "Method", "AssocFunction")
TYPES = ("Struct", "Enum", "Union", "Trait", "TypeAlias")
CONTAINERS = ("Module", "Crate", "ExternalSymbol")


@dataclass(frozen=True)
class Graph:
    """nodes: id, kind, display_name, qualified_name, crate_id, parent_id,
    item_kind, file, span_start, span_end, visibility, attributes,
    crate_target_kind. bindings: binding_id, from_module, namespace,
    visible_name, target, kind, vis_tag, vis_node, is_explicit_pub_use. usages:
    usage_id, target, consumer_module, file, start, stop, category,
    consumer_function, weight. signatures: target, is_async, self_param, params,
    return_type. statics: target, type_string, is_mut.
    """

    nodes: DataFrame
    bindings: DataFrame
    usages: DataFrame
    signatures: DataFrame
    statics: DataFrame

    def names(self, key: str, name: str) -> DataFrame:
        """(key, name): qualified names by node id, to join on ``key``."""
        return self.nodes.select(F.col("id").alias(key), F.col("qualified_name").alias(name))

    def crates(self) -> DataFrame:
        return self.nodes.where("kind = 'Crate'").select(F.col("id").alias("crate_id"), F.col("display_name").alias("crate_name"), "crate_target_kind")

    def find(self, qualified_name: str, kind: str | None = None) -> DataFrame:
        """The node of that name; of several the first by id."""
        hits = self.nodes.where(F.col("qualified_name") == qualified_name)
        if kind:
            hits = hits.where(F.col("kind") == kind)
        return hits.orderBy("id").limit(1)

    def at(self, table: DataFrame, column: str, qualified_name: str, kind: str | None = None) -> DataFrame:
        """Rows of ``table`` whose ``column`` is the named node."""
        key = self.find(qualified_name, kind).select(F.col("id").alias(column))
        return table.join(F.broadcast(key), column, "left_semi")  # one row


def declared_visibility(g: Graph) -> DataFrame:
    """(target, vis_tag, vis_node, from_module): the declared binding of each
    item, that of its own parent first, else the first by id."""
    parent = g.nodes.select(F.col("id").alias("target"), "parent_id")
    rows = g.bindings.where("kind = 'Declared'").join(parent, "target")
    best = F.min_by(F.struct("vis_tag", "vis_node", "from_module"), F.struct(F.col("from_module") != F.col("parent_id"), "binding_id"))
    return rows.groupBy("target").agg(best.alias("b")).select("target", "b.*")


def visibility_label(tag: str = "vis_tag", node_name: str = "vis_name") -> Column:
    """pub, private, pub(crate=X) or pub(in X)."""
    return (
        F.when(F.col(tag) == "Public", F.lit("pub"))
        .when(F.col(tag) == "Crate", F.concat(F.lit("pub(crate="), F.col(node_name), F.lit(")")))
        .when(F.col(tag) == "RestrictedTo", F.concat(F.lit("pub(in "), F.coalesce(node_name, F.lit("?")), F.lit(")")))
        .otherwise(F.lit("private"))
    )


def summary(rows: DataFrame) -> DataFrame:
    """A listing without the columns that say where things are."""
    return rows.drop("file", "span_start", "span_end", "start", "stop")


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def page(df: DataFrame, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of a listing in a total order, with the listing's length."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row
