"""Exact dedup: two-pass Bloom filtering before any row is shuffled.

Pass one fills a filter of two-bit saturating counters with the hash of every
normalised text. Pass two tests each row: if some counter of a hash stands below
two, no other row has that text, and the row passes straight through. Only the
remaining rows, the repeated texts and a few false positives, are shuffled.

The filter has a byte a row or two and grows with the rows. It is built in
segments; tasks send lists of the counters they touched, so a task sends what its
own rows need. A finished segment is a file in the shared folder, packed to one bit
a counter, which workers map; the driver holds the names of the files.

Defined results: null text counts as empty; a null id sorts after all others;
rows that repeat the smallest id as well as the text are settled in favour of
one of them; an empty table gives no rows; the report has only the id and its
own columns, so columns with clashing names in the input do not matter, and the
filter form returns the columns of the input as they came.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.files import mapped, write_file
from graphloom.session import materialize, new_path, release

SPACES = r"[\x20\x09-\x0D]+"
N_HASHES = 4
COUNTERS = 8  # a row, at least


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(normalized(text), 256))


def layout(rows: int, per_row: int = COUNTERS) -> tuple[int, int]:
    """(bits of the segment, bits of the place in it) for so many rows.

    A segment has 2**18 counters and, where there would be over 2**14 segments,
    more, up to 2**25; from there on the segments grow in number.
    """
    bits = max(10, math.ceil(math.log2(max(1, rows) * per_row)))
    inner = min(bits, 18 if bits <= 32 else min(bits - 14, 25))
    return bits - inner, inner


def _positions(digests, outer: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, (rows, N_HASHES) places in it), from the digests' own bytes."""
    raw = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)
    segment = (raw[:, 0] >> np.uint64(64 - outer)).astype(np.int64) if outer else np.zeros(len(raw), np.int64)
    return segment, (raw[:, :N_HASHES] & np.uint64((1 << inner) - 1)).astype(np.int64)


def _fill(outer: int, inner: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seg, pos = _positions(batch.column(0).to_pylist(), outer, inner)
            pos, n = np.unique((seg[:, None] << inner) | pos, return_counts=True)
            seg = pos >> inner
            cuts = np.flatnonzero(np.diff(seg)) + 1
            starts = np.concatenate([[0], cuts]) if len(pos) else []
            ends = np.concatenate([cuts, [len(pos)]]) if len(pos) else []
            place = (pos & ((1 << inner) - 1)).astype("<u4")
            twice = np.minimum(n, 2).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(seg[s]) for s in starts], pa.int64()),
                    pa.array([place[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()),
                    pa.array([twice[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()),
                ],
                names=["segment", "pos", "n"],
            )

    return run


def _merge(folder: str, inner: int):
    """One segment after the other, sorted by segment, to a file each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish() -> pa.RecordBatch:
            name = write_file(folder, f"segment-{at:08d}", [np.packbits(counters >= 2, bitorder="little").tobytes()])
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([name])], names=["segment", "file"])

        at, counters = None, np.zeros(0, np.uint8)
        for batch in batches:
            for seg, pos, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if seg != at:
                    if at is not None:
                        yield finish()
                    at, counters = seg, np.zeros(1 << inner, np.uint8)
                p = np.frombuffer(pos, "<u4")
                counters[p] = np.minimum(counters[p] + np.frombuffer(n, np.uint8), 2)
        if at is not None:
            yield finish()

    return run


def repeated_filter(digests: DataFrame, outer: int, inner: int) -> dict[int, str]:
    """Pass one over (digest): files by segment, bits set where a counter reached two."""
    spark = digests.sparkSession
    parts = digests.mapInArrow(_fill(outer, inner), "segment long, pos binary, n binary")
    parts = parts.repartition(min(1 << outer, int(spark.conf.get("spark.sql.shuffle.partitions"))), "segment").sortWithinPartitions("segment")
    made = materialize(parts.mapInArrow(_merge(new_path(spark, "bloom"), inner), "segment long, file string"), "bloom-files")
    return {r["segment"]: r["file"] for r in made.collect()}


def maybe_repeated(digests: DataFrame, rows: int, per_row: int = COUNTERS):
    """A column function for pass two: may this digest occur more than once?"""
    outer, inner = layout(rows, per_row)
    sent = digests.sparkSession.sparkContext.broadcast(repeated_filter(digests, outer, inner))  # names only

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        seg, pos = _positions(h.tolist(), outer, inner)
        out = np.zeros(len(seg), bool)
        order = np.argsort(seg, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(seg[order])) + 1).tolist(), len(seg)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo < hi:
                at, bits = order[lo:hi], mapped(sent.value[int(seg[order[lo]])])
                p = pos[at]
                out[at] = ((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=1)
        return pd.Series(out)

    return test


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_row: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    d = materialize(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("h"), F.monotonically_increasing_id().alias("rid")), "digests")
    flagged = materialize(d.withColumn("again", maybe_repeated(d.select("h"), d.count(), per_row)("h")), "digests-flagged")
    release(d)
    out = ["id", "keep_id", "group_size", "kept", "h"]
    alone = flagged.where(~F.col("again")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "h")
    many = flagged.where("again").select("id", "h", "rid")
    least = F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("least")
    # written, so that both sides of the join are dealt for it and a hot key can be split
    groups = materialize(many.groupBy("h").agg(least, F.count("*").alias("group_size")), "groups")
    rows = many.join(groups, "h").select("id", F.col("least.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("least.rid")).alias("kept"), "h")
    return alone.unionByName(rows.select(out)).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("h")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_row: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the least id.

    Rows the filter clears keep their place; of the rest, each task combines the
    rows of a group before they are shuffled, so that a hot group arrives as one
    row from each task.
    """
    h = text_digest(F.col(text_col))
    digests = materialize(docs.select(h.alias("h")), "digests")
    flag = maybe_repeated(digests, digests.count(), per_row)(h)
    cols = docs.columns
    alone = docs.where(~flag)
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(text_col))
    many = docs.where(flag).groupBy(h.alias("__h")).agg(F.min_by(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]), order).alias("__r"))
    return alone.unionByName(many.select(*[F.col(f"__r.c{i}").alias(c) for i, c in enumerate(cols)]))
