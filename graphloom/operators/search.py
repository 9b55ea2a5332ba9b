"""Rank fusion, ranking quality, and codemaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import CALLABLE, TYPES, Graph
from graphloom.operators.spans import enclosing_ids
from graphloom.session import materialize

RRF_K, WEIGHTS = 60, (0.5, 0.5)
TUNED = (10, 20, 40, 60, 80, 100)


def fuse(text: DataFrame, vector: DataFrame, limit: int | None = 10, k: int = RRF_K, weights: tuple[float, float] = WEIGHTS) -> DataFrame:
    """(query_id, id, score, rank) by reciprocal rank fusion of two ranked lists."""
    t = text.select("query_id", "id", F.col("rank").alias("rt"))
    v = vector.select("query_id", "id", F.col("rank").alias("rv"))
    term = lambda c, w: F.coalesce(w / (k + F.col(c)), F.lit(0.0))
    rows = t.join(v, ["query_id", "id"], "full_outer").select("query_id", "id", F.round(term("rt", weights[0]) + term("rv", weights[1]), 8).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long")
    rows = rows.withColumn("rank", rank)
    return rows if limit is None else rows.where(F.col("rank") <= limit)


def resilient(text, vector, limit: int = 10) -> DataFrame:
    """Fuse two searches, given as functions; if one fails, the other's list.

    Each search is run and written here, so that failures while it runs count.
    """
    found, errors = [], []
    for search in (text, vector):
        try:
            found.append(materialize(search(), "search"))
        except Exception as e:  # noqa: BLE001  either search may be down
            errors.append(e)
            found.append(None)
    if len(errors) == 2:
        raise RuntimeError(f"both searches failed: {errors[0]}; {errors[1]}")
    if errors:
        return (found[0] if found[0] is not None else found[1]).select("query_id", "id", "score", "rank")
    return fuse(*found, limit=None)


def quality(ranked: DataFrame, relevant: DataFrame, k: int = 10, totals: DataFrame | None = None) -> DataFrame:
    """Per query: ndcg, mrr, map, recall and precision at k.

    ranked: query_id, id, rank; relevant: query_id, id. Recall is hits over the
    number of relevant rows. Queries without results score 0. With totals (query_id,
    total: the number of relevant rows), relevant needs those among the ranked only.
    """
    r = ranked.where(F.col("rank") <= k).join(relevant.select("query_id", "id", F.lit(1).alias("rel")), ["query_id", "id"], "left").na.fill(0, ["rel"])
    hits = F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("hits", hits)
    per = r.groupBy("query_id").agg(
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.max(F.when(F.col("rel") == 1, 1 / F.col("rank"))).alias("mrr"),
        F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("rank"))).alias("ap"),
        F.sum("rel").alias("found"),
        F.count("*").alias("n"),
    )
    total = relevant.groupBy("query_id").agg(F.count("*").alias("total")) if totals is None else totals
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    rows = total.join(per, "query_id", "left")
    r6 = lambda c, n: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(n)
    return rows.select("query_id", r6(F.col("dcg") / best, "ndcg"), r6(F.col("mrr"), "mrr"), r6(F.col("ap") / F.col("total"), "map"), r6(F.col("found") / F.col("total"), "recall"), r6(F.col("found") / F.col("n"), "precision"))


def mean_quality(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 5).alias(c) for c in ("ndcg", "mrr", "map", "recall", "precision")])


def tune_k(text: DataFrame, vector: DataFrame, relevant: DataFrame, ks: Sequence[int] = TUNED, totals: DataFrame | None = None) -> DataFrame:
    """(k, ndcg) of the best fusion constant; the first of equals."""
    rows = None
    for k in ks:
        one = mean_quality(quality(fuse(text, vector, None, k), relevant, totals=totals)).select(F.lit(k).cast("long").alias("k"), "ndcg")
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(F.max_by("k", F.struct("ndcg", -F.col("k"))).alias("k"), F.max("ndcg").alias("ndcg"))


def seeds_by_name(g: Graph, names: Sequence[str]) -> DataFrame:
    """(name, id, diagnostic): the node of each name, or why there is none."""
    spark = g.nodes.sparkSession
    asked = spark.createDataFrame([(n, n.rpartition("::")[0]) for n in dict.fromkeys(names)], "name string, parent string")
    nodes = g.nodes.groupBy("qualified_name").agg(F.min("id").alias("id"), F.max((F.col("kind") == "Module").cast("int")).alias("is_module"))
    rows = asked.join(nodes.select(F.col("qualified_name").alias("name"), "id"), "name", "left")
    rows = rows.join(nodes.select(F.col("qualified_name").alias("parent"), "is_module"), "parent", "left")
    hint = F.when(F.col("is_module") == 1, F.lit(" (its module is there; it may be private or not indexed)")).otherwise(F.lit(""))
    return rows.select("name", "id", F.when(F.col("id").isNull(), F.concat(F.lit("unresolved seed: "), "name", hint)).alias("diagnostic"))


def _resolved(g: Graph, hits: DataFrame) -> DataFrame:
    """Search hits (hit_id, file, lo, hi, ...) with the id of the item around them, or null."""
    found = enclosing_ids(g, hits.select("hit_id", "file", "lo", "hi"))
    return hits.join(found, "hit_id", "left")


def seeds_by_hits(g: Graph, hits: DataFrame, top: int = 20) -> DataFrame:
    """(id, rank): the first ``top`` callables and types around search hits (hit_id,
    file, lo, hi, rank), in the order of their first hit."""
    kinds = g.nodes.where(F.col("item_kind").isin(*CALLABLE, *TYPES)).select("id")
    first = _resolved(g, hits).join(kinds, "id", "left_semi").groupBy("id").agg(F.min("rank").alias("rank"))
    return first.orderBy("rank", "id").limit(top)


def dropped_hits(g: Graph, hits: DataFrame) -> DataFrame:
    """One row: hits without an item around them, and those whose item is neither callable nor type."""
    rows = _resolved(g, hits).join(g.nodes.select("id", "item_kind"), "id", "left")
    return rows.agg(F.count_if(F.col("id").isNull()).alias("unresolved"), F.count_if(F.col("id").isNotNull() & ~F.coalesce(F.col("item_kind").isin(*CALLABLE, *TYPES), F.lit(False))).alias("other_kind"))


def scores_by_node(g: Graph, hits: DataFrame) -> DataFrame:
    """(id, score): the scores of all hits within an item, added up."""
    return _resolved(g, hits).where("id IS NOT NULL").groupBy("id").agg(F.round(F.sum("score"), 6).alias("score"))


def expand(g: Graph, seeds: DataFrame, text_scores: DataFrame, depth: int = 3, incoming: int = 8) -> DataFrame:
    """(id, distance): the neighbourhood of seed items for a codemap.

    Out-edges go to all targets; in-edges come to callables and types only, the
    ``incoming`` best referrers by text score, then name.
    """
    edges = g.usages.where("consumer_function IS NOT NULL").select(F.col("consumer_function").alias("src"), F.col("target").alias("dst")).distinct()
    items = g.nodes.where("kind = 'Item'").select("id", "qualified_name", "item_kind")
    rated = items.join(text_scores.select("id", "text_score"), "id", "left").na.fill(0.0, ["text_score"])
    back = edges.join(rated.select(F.col("id").alias("src"), F.floor(F.col("text_score") * 1000).alias("s"), "qualified_name"), "src")
    back = back.join(items.where(F.col("item_kind").isin(*CALLABLE, *TYPES)).select(F.col("id").alias("dst")), "dst", "left_semi")
    best = F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("s"), "qualified_name"))
    back = back.withColumn("r", best).where(F.col("r") <= incoming).select(F.col("dst").alias("id"), F.col("src").alias("nxt"))
    hops = edges.select(F.col("src").alias("id"), F.col("dst").alias("nxt")).union(back)
    found = frontier = seeds.select("id", F.lit(0).cast("long").alias("distance"))
    for d in range(1, min(depth, 5) + 1):
        step = hops.join(frontier.select("id"), "id").select(F.col("nxt").alias("id")).distinct().join(found.select("id"), "id", "left_anti")
        frontier = materialize(step.select("id", F.lit(d).cast("long").alias("distance")), "codemap")
        found = found.unionByName(frontier)
    return found


def relevance(found: DataFrame, text_scores: DataFrame, embedding: DataFrame | None = None) -> DataFrame:
    """Adds ``score`` to a neighbourhood from text, distance and embedding."""
    top = text_scores.agg(F.max("text_score").alias("top"))
    rows = found.join(text_scores.select("id", "text_score"), "id", "left").crossJoin(F.broadcast(top))  # one row
    bm = F.coalesce(F.col("text_score") / F.when(F.col("top") > 0, F.col("top")), F.lit(0.0))
    near = 1 / (1 + F.col("distance"))
    if embedding is None:
        return rows.select("id", "distance", F.round(0.60 * bm + 0.40 * near, 6).alias("score"))
    rows = rows.join(embedding.select("id", "similarity"), "id", "left").na.fill(0.0, ["similarity"])
    return rows.select("id", "distance", F.round(0.40 * F.col("similarity") + 0.35 * bm + 0.25 * near, 6).alias("score"))


def prune(scored: DataFrame, g: Graph, max_nodes: int = 80) -> DataFrame:
    """All seeds and the best others, ``max_nodes`` in all."""
    named = scored.join(g.names("id", "item"), "id")
    seed = F.col("distance") == 0
    rank = F.row_number().over(Window.orderBy(F.desc(seed.cast("int")), F.desc("score"), "item"))
    ordered = named.orderBy(F.desc(seed.cast("int")), F.desc("score"), "item").limit(max(max_nodes, 1))
    extra = named.where(seed).join(ordered.select("id"), "id", "left_anti")
    return ordered.unionByName(extra).withColumn("rank", rank.cast("long"))


def retained_edges(g: Graph, kept: DataFrame) -> DataFrame:
    """(caller, callee) between kept items, with the kind of the edge."""
    edges = g.usages.select(F.col("consumer_function").alias("src"), F.col("target").alias("dst")).distinct()
    a = kept.select(F.col("id").alias("src"), F.col("item").alias("caller"))
    b = kept.join(g.nodes.select("id", "item_kind"), "id").select(F.col("id").alias("dst"), F.col("item").alias("callee"), F.when(F.col("item_kind").isin(*CALLABLE), F.lit("Calls")).otherwise(F.lit("Uses")).alias("edge"))
    return edges.join(a, "src").join(b, "dst").select("caller", "callee", "edge")
