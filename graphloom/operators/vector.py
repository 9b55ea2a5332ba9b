"""Vectors: cosine, exact nearest neighbours, overlaps and clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.operators.ranking import nearest as nearest


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, over the shorter length."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if a norm is 0."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def unit(v: Column) -> Column:
    """The vector at length one, in doubles; zeros stay zeros."""
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, F.transform(v, lambda x: F.lit(0.0))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def overlap_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding", block_col: str | None = None, block_rows: int = 2000) -> DataFrame:
    """(id_a, id_b, score): pairs with cosine at or above the threshold.

    Ids are dealt to blocks of about ``block_rows`` rows, and every pair of blocks
    is a group of its own, so no task needs more than two blocks at a time and
    the work, quadratic as it is, spreads over all tasks, as matrix products in
    Arrow batches. With ``block_col`` only rows that differ in it pair. Rows with equal
    vectors pair like any others.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    blocks = max(1, -(-vectors.count() // block_rows))
    rows = vectors.select(F.col(id_col).alias("id"), unit(F.col(vector_col)).alias("v"), (F.col(block_col).cast("string") if block_col else F.lit(None).cast("string")).alias("b"))
    rows = rows.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumns({"lo": F.least("k", "x"), "hi": F.greatest("k", "x")})

    def joined(table: pa.Table) -> pa.Table:
        ids, k = table["id"].combine_chunks(), table["k"].to_numpy()
        lists = table["v"].combine_chunks()
        width = max(lists.value_lengths().to_numpy(zero_copy_only=False), default=0)
        v = np.zeros((len(ids), int(width)))
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
        v[np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        left, right = np.flatnonzero(k == lo), np.flatnonzero(k == hi)
        score = np.round(v[left] @ v[right].T, 6)
        i, j = np.nonzero(score >= threshold)
        s, i, j = score[i, j], left[i], right[j]
        if lo == hi:
            s, i, j = s[i < j], i[i < j], j[i < j]
        a, b = ids.take(pa.array(i)), ids.take(pa.array(j))
        if block_col:
            group = np.array(table["b"].to_pylist(), dtype=object)
            apart = pa.array(group[i] != group[j])
            a, b, s = a.filter(apart), b.filter(apart), s[np.asarray(group[i] != group[j], bool)]
        return pa.table({"id_a": pc.min_element_wise(a, b), "id_b": pc.max_element_wise(a, b), "score": pa.array(s)})

    return rows.groupBy("lo", "hi").applyInArrow(joined, f"id_a {kind}, id_b {kind}, score double")


def clusters(pairs: DataFrame) -> DataFrame:
    """(cluster, size, avg_score, min_score) of the components of the pairs."""
    parts = connected_components(pairs, "id_a", "id_b")
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    scores = pairs.join(parts.withColumnRenamed("node", "id_a"), "id_a").groupBy("component").agg(F.round(F.avg("score"), 6).alias("avg_score"), F.round(F.min("score"), 6).alias("min_score"))
    return sizes.join(scores, "component").withColumnRenamed("component", "cluster")


def cluster_page(found: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Clusters, the best first, until ``limit`` members are out; the last is cut.

    Adds rank and shown, the members of the cluster that are within the limit. The
    offset skips whole clusters.
    """
    order = Window.orderBy(F.desc("avg_score"), F.desc("size"), "cluster")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") > offset)
    before = F.coalesce(F.sum("size").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("before", before).where(F.col("before") < limit).withColumn("shown", F.least("size", F.lit(limit) - F.col("before")).cast("long")).drop("before")


def exact_pairs(rows: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """Membership of groups with equal content: (id, first_id, size)."""
    groups = rows.groupBy(hash_col).agg(F.min(id_col).alias("first_id"), F.count("*").alias("size")).where("size > 1")
    return rows.join(groups, hash_col).select(F.col(id_col).alias("id"), "first_id", "size")
