"""Incremental maintenance: file state, differences, consistency, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import materialize
from graphloom.sources.snapshots import SnapshotStore

# Messages that mark an error as permanent.
PERMANENT = ("permission denied", "not found", "invalid utf", "is a directory")


def file_state(files: DataFrame, path: str = "path", content: str = "content", salt: str = "") -> DataFrame:
    """(path, content_hash, size): the state that changes are found by."""
    body = F.concat(F.lit(salt), F.col(content)) if salt else F.col(content)
    return files.select(F.col(path).alias("path"), F.sha2(body, 256).alias("content_hash"), F.octet_length(content).cast("long").alias("size"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, deleted or modified."""
    o, n = old.select("path", F.col("content_hash").alias("h1")), new.select("path", F.col("content_hash").alias("h2"))
    rows = o.join(n, "path", "full_outer")
    change = F.when(F.col("h1").isNull(), F.lit("added")).when(F.col("h2").isNull(), F.lit("deleted")).when(F.col("h1") != F.col("h2"), F.lit("modified"))
    return rows.select("path", change.alias("change")).where("change IS NOT NULL")


def root_hash(state: DataFrame) -> DataFrame:
    """One row with a digest of the whole state, independent of row order.

    Leaves are added up by 60-bit pieces of their digests, which tasks combine
    before anything is moved, so no list of leaves is gathered anywhere.
    """
    leaf = F.sha2(F.concat_ws("\0", "path", "content_hash"), 256)
    sums = [F.sum(F.conv(F.substring(leaf, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(4)]
    return state.agg(F.count("*").cast("string").alias("n"), *sums).select(F.sha2(F.concat_ws(":", "n", *[F.coalesce(f"s{i}", F.lit("0")) for i in range(4)]), 256).alias("root"))


def changed_candidates(old: DataFrame, stat: DataFrame) -> DataFrame:
    """Files whose size or time differ from the stored state, or that are new:
    the only ones whose content is worth hashing."""
    o = old.select("path", F.col("size").alias("s0"), F.col("last_modified").alias("t0"))
    return stat.join(o, "path", "left").where("s0 IS NULL OR s0 <> size OR t0 <> last_modified").drop("s0", "t0")


def apply_changes(table: DataFrame, changes: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """A table without the rows of changed files, with the fresh rows."""
    gone = changes.where("change IN ('deleted', 'modified')").select(F.col("path").alias(key))
    live = changes.where("change IN ('added', 'modified')").select(F.col("path").alias(key))
    return table.join(gone, key, "left_anti").unionByName(fresh.join(live, key, "left_semi"))


class IncrementalIndex:
    """An index kept in step with a set of files, in a folder of the shared store.

    A run compares the files with the saved state, prepares only what was added or
    modified, drops what was deleted, and saves state, rows and the log of changes
    under the run's number; the pointer to it is set last, so that a run that is
    broken off leaves the one before in place. Without a change nothing is written.
    """

    def __init__(self, spark: SparkSession, root: str, prepare):
        self.store = SnapshotStore(spark, root)
        self.spark, self.prepare = spark, prepare

    def open(self) -> DataFrame | None:
        """(path, content_hash, run, and what ``prepare`` made) as of the last run."""
        tables = self.store.open()
        return tables["rows"].join(tables["state"].select("path", "content_hash"), "path") if tables else None

    def log(self) -> DataFrame:
        """(run, path, change) of all runs."""
        return self.store.open()["log"]

    def runs(self) -> int:
        tables = self.store.open()
        return int(tables["log"].agg(F.max("run")).first()[0] or 0) if tables else 0

    def update(self, files: DataFrame) -> int:
        """Bring the index up to (path, content); the number of changes."""
        old, state = self.store.open(), materialize(file_state(files), "file-state")
        run = self.runs() + 1
        before = old["state"] if old else state.limit(0)
        changes = materialize(diff(before, state), "changes")
        if not (n := changes.count()) and old:
            return 0
        live = changes.where("change IN ('added', 'modified')")
        fresh = self.prepare(files.join(live.select("path"), "path", "left_semi")).withColumn("run", F.lit(run))
        rows = apply_changes(old["rows"], changes, fresh) if old else fresh
        log = changes.select(F.lit(run).alias("run"), "path", "change")
        log = old["log"].unionByName(log) if old else log
        self.store.build("index", f"{run}:{root_hash(state).first()[0]}", {"state": state, "rows": rows, "log": log})
        return n

    def repair(self, files: DataFrame) -> int:
        """Prepare files anew whose rows are missing; how many there were."""
        old = self.store.open()
        if old is None:
            return self.update(files)
        lost = materialize(old["state"].join(old["rows"].select("path").distinct(), "path", "left_anti").select("path"), "lost")
        if n := lost.count():
            run = self.runs() + 1
            fresh = self.prepare(files.join(lost, "path", "left_semi")).withColumn("run", F.lit(run))
            log = old["log"].unionByName(lost.select(F.lit(run).alias("run"), "path", F.lit("repaired").alias("change")))
            self.store.build("index", f"{run}:repair", {"state": old["state"], "rows": old["rows"].unionByName(fresh), "log": log})
        return n


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows by key: the new ones where there are any."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def consistency(text_ids: DataFrame, vector_ids: DataFrame) -> DataFrame:
    """(id, missing): ids that one of two stores lacks."""
    a, b = text_ids.select("id"), vector_ids.select("id")
    return a.join(b, "id", "left_anti").select("id", F.lit("vector").alias("missing")).union(b.join(a, "id", "left_anti").select("id", F.lit("text").alias("missing")))


def compare_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """(metric, before, after, delta) of two (metric, value) tables."""
    o, n = old.withColumnRenamed("value", "before"), new.withColumnRenamed("value", "after")
    rows = o.join(n, "metric", "full_outer").na.fill(0.0, ["before", "after"])
    return rows.select("metric", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round(F.col("after") - F.col("before"), 6).alias("delta"))


def percentiles(rows: DataFrame, group: str, value: str, points=(0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles: the value at floor(n * p), the last at most.

    Equal values are counted first; ranks follow from running counts over the
    distinct values of a group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    run = F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(group, value, run.alias("to"), F.sum("c").over(w).alias("n"))
    at = lambda p: F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    picks = [F.min(F.when(F.col("to") > at(p), F.col(value))).alias(f"p{round(p * 100)}") for p in points]
    return ranked.groupBy(group).agg(F.max("n").alias("n"), *picks)


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.when(b == 0, F.lit(0.0)).otherwise(a / b), 6)


def error_category(message: Column) -> Column:
    low = F.lower(message)
    hit = low.contains(PERMANENT[0])
    for p in PERMANENT[1:]:
        hit = hit | low.contains(p)
    return F.when(hit, F.lit("Permanent")).otherwise(F.lit("Transient"))


def health(statuses: DataFrame) -> DataFrame:
    """One row: the rollup of (component, status), where the engines are bm25
    and vector."""
    engine = F.col("component").isin("bm25", "vector")
    bad = F.count_if(engine & (F.col("status") == "unhealthy"))
    return statuses.agg(F.when(bad == 2, F.lit("unhealthy")).when(F.count_if(F.col("status") != "healthy") > 0, F.lit("degraded")).otherwise(F.lit("healthy")).alias("status"))


def token_batches(lengths: DataFrame, batch: str = "batch", raw: str = "n", cap: int = 512) -> DataFrame:
    """Sums over texts and over padded batches of their token counts."""
    capped = F.least(F.col(raw), F.lit(cap))
    per = lengths.groupBy(batch).agg(F.sum(raw).alias("r"), F.sum(capped).alias("c"), F.min(capped).alias("lo"), F.max(capped).alias("hi"), (F.max(capped) * F.count("*")).alias("p"))
    return per.agg(F.sum("r").cast("long").alias("raw_tokens"), F.sum("c").cast("long").alias("capped_tokens"), F.min("lo").cast("long").alias("shortest"), F.max("hi").cast("long").alias("longest"), F.sum("p").cast("long").alias("padded_tokens"))
