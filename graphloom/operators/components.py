"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize, release


def _with_min(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the least id m among u and all of u's partners.

    The minimum is combined before the shuffle; in the join only the side with
    many rows per key is large, so adaptive execution may split a hot key.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the least node id.

    Edges with a null end or equal ends link nothing and are left out, so a
    node that has only such edges is absent; an empty table gives no rows.
    Repeated edges count once. Every round is written to the shared folder, so
    the lineage stays short and a lost executor costs one round at most. The
    number of rounds grows with the logarithm of a component's diameter.
    """
    cur = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct(),
        "components",
    )
    mark = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = _with_min(large)
        small = low.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        nxt = materialize(small.where("u != v").distinct(), "components")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(cur)
        cur = nxt
        if tuple(state) == mark:
            break
        mark = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
