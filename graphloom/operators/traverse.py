"""Bounded traversals: breadth-first search, parent chains, trees and cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph
from graphloom.session import materialize

MAX_DEPTH, MAX_CYCLE, MAX_PARENTS = 8, 12, 32


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, depth): nodes within ``depth`` hops of ``start`` (one column id).

    Each hop joins the frontier with the edges and drops what was seen. The
    start nodes have depth 0 only in that they are where the search begins; they
    are in the result if an edge leads back to them, as any other node.
    """
    hops = edges.select(F.col("src").alias("id"), F.col("dst").alias("nxt")).distinct()
    frontier, found = start.select("id"), None
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        step = frontier.join(hops, "id").select(F.col("nxt").alias("id")).distinct()
        step = step if found is None else step.join(found.select("id"), "id", "left_anti")
        step = materialize(step.select("id", F.lit(d).cast("long").alias("depth")), "reach")
        found = step if found is None else found.unionByName(step)
        frontier = step
        if step.isEmpty():
            break
    return found if found is not None else start.select("id", F.lit(0).cast("long").alias("depth")).limit(0)


def recursive_callers(g: Graph, target: str, depth: int) -> DataFrame:
    """One row: distinct callers within ``depth`` hops, direct ones, the depth
    reached, and whether callers remain beyond it."""
    calls = g.usages.where("consumer_function IS NOT NULL").select(F.col("target").alias("src"), F.col("consumer_function").alias("dst"))
    found = reach(calls, g.find(target).select("id"), depth + 1)
    inside = F.col("depth") <= depth
    return found.agg(F.count_if(inside).alias("callers"), F.count_if(F.col("depth") == 1).alias("direct"), F.coalesce(F.max(F.when(inside, F.col("depth"))), F.lit(0)).cast("long").alias("depth_reached"), (F.count_if(~inside) > 0).alias("truncated"))


def call_graph(g: Graph, root: str, depth: int = 3) -> DataFrame:
    """(callee, depth): what a function reaches, with the least number of hops."""
    calls = g.usages.select(F.col("consumer_function").alias("src"), F.col("target").alias("dst"))
    return reach(calls, g.find(root).select("id"), depth).join(g.names("id", "callee"), "id").select("callee", "depth")


def re_export_chain(g: Graph, target: str, depth: int = MAX_DEPTH) -> DataFrame:
    """(module, visible_name, depth): public re-exports of a target, of the
    modules that re-export it, and so on."""
    pub = g.bindings.where("kind <> 'Declared' AND is_explicit_pub_use").select("target", "from_module", "visible_name").distinct()
    frontier, seen = g.find(target).select(F.col("id").alias("target")), None
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        step = pub.join(frontier, "target").select("from_module", "visible_name").distinct()
        step = step if seen is None else step.join(seen, ["from_module", "visible_name"], "left_anti")
        step = materialize(step.select("from_module", "visible_name", F.lit(d).cast("long").alias("depth")), "re-exports")
        seen = step if seen is None else seen.unionByName(step)
        frontier = step.select(F.col("from_module").alias("target")).distinct()
        if step.isEmpty():
            break
    return seen.join(g.names("from_module", "module"), "from_module").select("module", "visible_name", "depth")


def ancestors(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """(id, ancestor, depth) of the start nodes, each its own at depth 0.

    Nodes nest a handful of levels, so the chain is a few joins with the parent
    table; a cycle ends it after ``MAX_PARENTS``.
    """
    up = nodes.where("parent_id IS NOT NULL").select(F.col("id").alias("ancestor"), "parent_id")
    level = start.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("depth"))
    out = [level]
    for d in range(1, MAX_PARENTS + 1):
        level = level.join(up, "ancestor").select("id", F.col("parent_id").alias("ancestor"), F.lit(d).cast("long").alias("depth"))
        level = materialize(level, "ancestors")
        if level.isEmpty():
            break
        out.append(level)
    return reduce(DataFrame.unionByName, out)


def module_ancestors(g: Graph, module: str) -> DataFrame:
    rows = ancestors(g.nodes, g.find(module, "Module").select("id"))
    return rows.join(g.nodes.select(F.col("id").alias("ancestor"), "qualified_name", "kind"), "ancestor").select("qualified_name", "kind", "depth")


def module_tree(g: Graph, crate: str, depth: int = 3) -> DataFrame:
    """(path, name, kind, depth): the tree under a crate, level by level."""
    kids = g.nodes.select(F.col("parent_id").alias("at"), F.col("id"), F.col("display_name").alias("name"), "kind", "item_kind")
    level = g.find(crate, "Crate").select(F.col("id"), F.col("display_name").alias("name"), "kind", "item_kind", F.col("display_name").alias("path"))
    out = [level.select("path", "name", "kind", "item_kind", F.lit(0).cast("long").alias("depth"))]
    for d in range(1, depth + 1):
        up = level.select(F.col("id").alias("at"), F.col("path").alias("up"))
        level = kids.join(up, "at").select("id", "name", "kind", "item_kind", F.concat_ws("/", "up", "name").alias("path"))
        out.append(level.select("path", "name", "kind", "item_kind", F.lit(d).cast("long").alias("depth")))
    return reduce(DataFrame.unionByName, out)


def cycles(edges: DataFrame, max_length: int = 5) -> DataFrame:
    """(path, length): simple cycles, each once, from its least node.

    Paths of k nodes are k - 1 joins of the distinct edges. The first node stays
    the least, which prunes all rotations, and no node repeats.
    """
    e = materialize(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    loops = e.where("src = dst").select(F.col("src").alias("path"), F.lit(1).cast("long").alias("length"))
    out, walk = [loops], e.where("src < dst").select(F.array("src", "dst").alias("p"), F.col("src").alias("first"), F.col("dst").alias("last"))
    for k in range(2, min(max_length, MAX_CYCLE) + 1):
        closing = e.select(F.col("src").alias("last"), F.col("dst").alias("first"))
        out.append(walk.join(closing, ["last", "first"], "left_semi").select(F.array_join("p", " -> ").alias("path"), F.lit(k).cast("long").alias("length")))
        nxt = e.select(F.col("src").alias("last"), F.col("dst").alias("n"))
        walk = walk.join(nxt, "last").where((F.col("n") > F.col("first")) & ~F.array_contains("p", F.col("n")))
        walk = walk.select(F.concat("p", F.array("n")).alias("p"), "first", F.col("n").alias("last"))
    return reduce(DataFrame.unionByName, out)


def recursion_check(g: Graph, max_length: int = 5) -> DataFrame:
    """Call cycles between functions that have a signature."""
    fns = g.signatures.select("target")
    calls = g.usages.select(F.col("consumer_function").alias("src"), "target")
    calls = calls.join(fns, "target", "left_semi").join(fns.withColumnRenamed("target", "src"), "src", "left_semi")
    return cycles(calls.select("src", F.col("target").alias("dst")), max_length)
