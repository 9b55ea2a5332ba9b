"""Joins on spans of source: the narrowest span around a place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph


def enclosing(spans: DataFrame, hits: DataFrame, bucket: int = 4096) -> DataFrame:
    """Each hit with the narrowest span of its file that contains it.

    spans: file, start, stop, id; hits: hit_id, file, lo, hi. Spans are dealt to
    every stretch of ``bucket`` bytes they touch, so the join is an equality on file
    and stretch, and only spans near a hit are compared. Of equal widths the
    first by start, then id, wins. Hits in no span are left out.
    """
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("stop") / bucket))))
    at = hits.withColumn("cell", F.floor(F.col("lo") / bucket))
    rows = at.join(cells, ["file", "cell"]).where("start <= lo AND hi <= stop")
    best = F.min_by("id", F.struct(F.col("stop") - F.col("start"), "start", "id"))
    return rows.groupBy("hit_id").agg(best.alias("id"))


def enclosing_ids(g: Graph, hits: DataFrame) -> DataFrame:
    """(hit_id, id) for hits in source files."""
    spans = g.nodes.where("span_start IS NOT NULL").select("file", F.col("span_start").alias("start"), F.col("span_end").alias("stop"), "id")
    return enclosing(spans, hits)


def enclosing_items(g: Graph, hits: DataFrame) -> DataFrame:
    """(hit_id, item) for hits in source files."""
    return enclosing_ids(g, hits).join(g.names("id", "item"), "id").select("hit_id", "item")
