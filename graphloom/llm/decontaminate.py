"""Benchmark decontamination with spaced seeds.

A seed is a hash of the tokens under a fixed mask, which ignores some positions,
so that replaced words at those positions leave it unchanged. The seeds of the
benchmark items are joined with those of every position of every document. For each
pair that shares one, the item is laid against the document without gaps at all
shared seeds; it is an overlap if a stretch of ``min(stretch, item length)`` tokens
agrees in at least ``similarity`` of its tokens. The masks are chosen by that length
and the mismatches it allows, so that one of them fits between the mismatches
wherever those are.

Documents are read once. Before the join, workers drop the seeds that no item has:
the items' seeds lie sorted in files of the shared folder, which workers map, so
neither the driver nor a broadcast holds the benchmark. Only documents with a hit,
and their hits, are written and shuffled.

Tokens are runs of letters, digits and underscores, lower-cased.

Defined results: null or empty texts and benchmark items have no overlaps, as have
items of fewer than ``min_tokens`` tokens, unless ``short_items`` asks for their
whole and exact matches; repeated rows on either side give repeated results; of the
places where an item fits equally well the first counts; texts of any length are
taken whole; empty tables give no rows. The overlaps have the two ids and their own
columns only; the filter form returns the columns of the documents as they came.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.files import mapped, write_file
from graphloom.llm.hashing import WordHashes
from graphloom.llm.held import held
from graphloom.session import materialize, new_path

# By length of the stretch and mismatches in it: masks of which one is free of
# mismatches somewhere in the stretch, wherever they are (found by search).
MASKS = {
    (6, 1): ("10111", "11101"),
    (8, 1): ("111011", "1011011"),
    (10, 2): ("110111", "11100011", "1101001001"),
    (12, 2): ("11010111", "111100101", "111000001011"),
    (13, 2): ("11011111", "11101010011", "1110010111"),
}
WORD = re.compile(r"\w+")
NONE = np.uint64(0)  # no token's hash


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the text's tokens."""
    return held("words", lambda: WordHashes(250_000, least=1)).of(WORD.findall((text or "").lower()))


def needed(stretch: int, similarity: float) -> int:
    """The tokens of a stretch that have to agree."""
    return math.ceil(similarity * stretch - 1e-9)


def masks_for(stretch: int, mismatches: int) -> tuple[str, ...]:
    """Masks that find every stretch of this length with so many mismatches or fewer."""
    if mismatches <= 0:
        return ("1" * stretch,)
    # mismatches leave a run of that many tokens at least
    plain = ("1" * max(1, stretch // (mismatches + 1)),)
    fit = [m for (n, k), m in MASKS.items() if n <= stretch and k >= mismatches]
    return max([plain, *fit], key=lambda m: m[0].count("1"))


def seeds(t: np.ndarray, mask: str) -> np.ndarray:
    """Seed at every position where the mask fits."""
    n = len(t) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, crc32(mask.encode()), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = (out ^ t[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def plan(length: int, min_tokens: int, stretch: int, similarity: float, short_items: bool) -> tuple[int, int, tuple[str, ...]]:
    """For an item of so many tokens: length of the stretch, tokens of it that agree, masks."""
    n = min(stretch, length) if length >= min_tokens else length
    least = needed(n, similarity) if length >= min_tokens else n
    return n, least, masks_for(n, n - least) if n and (length >= min_tokens or short_items) else ()


def _shared(t: np.ndarray, item: np.ndarray, masks: tuple[str, ...]) -> np.ndarray:
    """The shifts of the item against the document at which they share a seed, ascending."""
    off = len(item)
    mark = np.zeros(len(t) + off + 1, bool)
    for m in masks:
        of_item, of_text = seeds(item, m), seeds(t, m)
        s, first, back = np.unique(of_item, return_index=True, return_inverse=True)
        if not len(s):
            continue
        at = np.minimum(np.searchsorted(s, of_text), len(s) - 1)
        hit = np.flatnonzero(s[at] == of_text)
        hit = hit[np.argsort(at[hit], kind="stable")]
        which = at[hit]
        for lo, hi in zip(*(np.searchsorted(which, np.unique(which), side) for side in ("left", "right"))):
            places, items = hit[lo:hi], np.flatnonzero(back == which[lo])
            cuts = np.flatnonzero(np.diff(places) != 1) + 1
            runs = list(zip([places[0], *places[cuts]], [*(places[cuts - 1] + 1), places[-1] + 1])) if len(cuts) * 8 < len(places) else None
            for p in items.tolist():
                if runs is None:
                    mark[places - p + off] = True
                else:
                    for a, b in runs:
                        mark[a - p + off : b - p + off] = True
    return np.flatnonzero(mark) - off


def overlap(t: np.ndarray, item: np.ndarray, need: int, least: int, masks: tuple[str, ...], cells: int = 1 << 22) -> tuple[int, float, int] | None:
    """(tokens that agree, share of the item, first token) where the item fits best."""
    shifts = _shared(t, item, masks)
    n = len(item)
    shifts = shifts[np.minimum(n, len(t) - shifts) - np.maximum(0, -shifts) >= need]
    if not len(shifts):
        return None
    edge = np.full(n, NONE)  # stands before and after the text
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, t, edge]), n)
    best = None
    step = max(1, cells // n)
    for lo in range(0, len(shifts), step):
        some = shifts[lo : lo + step]
        same = around[some + n] == item
        total = same.sum(axis=1)
        run = np.concatenate([np.zeros((len(some), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
        part, first = run[:, need:] - run[:, :-need], np.arange(n - need + 1)
        part[(first < -some[:, None]) | (first + need > len(t) - some[:, None])] = 0  # reach beyond the text
        total[part.max(axis=1) < least] = 0
        k = int(total.argmax())
        if total[k] > (best[0] if best else 0):
            best = int(total[k]), float(total[k] / n), max(0, int(some[k]))
            if best[0] == n:
                break
    return best


# Seeds of the items ----------------------------------------------------------


def _item_seeds(how: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = tokens(text)
                of = [seeds(t, m) for m in plan(len(t), *how)[2]]
                if of:
                    s = np.unique(np.concatenate(of))
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), i, np.int64)), pa.array(np.full(len(s), min(len(t), how[1]), np.int32))], names=["seed", "iid", "length"])

    return run


def _write_seeds(folder: str, bits: int):
    """Sorted seeds of one shard after the other, each to a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(shard: int, held: list) -> pa.RecordBatch:
            s = np.sort(np.concatenate(held).view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([write_file(folder, f"seeds-{shard:06d}", [s.astype("<u8").tobytes()])])], names=["shard", "file"])

        at, held = None, []
        for b in batches:
            shard, s = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo < hi:
                    if shard[lo] != at and held:
                        yield finish(at, held)
                        held = []
                    at = int(shard[lo])
                    held.append(s[lo:hi])
        if held:
            yield finish(at, held)

    return run


class SeedFiles:
    """All seeds of the items, in mapped files by their leading bits."""

    def __init__(self, bits: int, files: dict[int, str], masks: list[str]):
        self.bits, self.files, self.masks = bits, files, masks
        self.held: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def __getstate__(self):
        return self.bits, self.files, self.masks

    def __setstate__(self, state):
        self.__init__(*state)

    def _shard(self, k: int):
        if k not in self.held:
            s = mapped(self.files[k]).view("<u8")
            wide = max(16, len(s).bit_length() + 4)  # of a bitmap in front, with 32 bits a seed at most
            there = np.zeros(1 << wide, bool)
            there[((s << np.uint64(self.bits)) >> np.uint64(64 - wide)).astype(np.int64)] = True
            self.held[k] = s, np.packbits(there, bitorder="little") if wide > 24 else there, wide
        return self.held[k]

    def _known(self, k: int, s: np.ndarray) -> np.ndarray:
        if k not in self.files:
            return s[:0]
        there, front, wide = self._shard(k)
        at = ((s << np.uint64(self.bits)) >> np.uint64(64 - wide)).astype(np.int64)
        s = s[front[at] if wide <= 24 else (front[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
        return s[there[np.minimum(np.searchsorted(there, s), len(there) - 1)] == s]

    def hits(self, text: str | None) -> np.ndarray:
        """The different seeds of a text that some item has."""
        t = tokens(text)
        out = []
        for m in self.masks:
            s = seeds(t, m)
            if not self.bits:
                out.append(self._known(0, s))
            elif len(s):
                s = np.sort(s)
                k = (s >> np.uint64(64 - self.bits)).astype(np.int64)
                cuts = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
                out += [self._known(int(k[lo]), s[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:])]
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _hits(sent):
    @F.pandas_udf("array<bigint>")
    def hits(texts: pd.Series) -> pd.Series:
        out = [sent.value.hits(t) for t in texts]
        return pd.Series([h.view(np.int64) if len(h) else None for h in out], dtype=object)

    return hits.asNondeterministic()  # so that it is not repeated for a filter on its result


def _found(sent):
    """(id, text) to (id, text, hits), texts with a hit only; a few are decoded at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                some = b.slice(lo, 200)
                hits = [sent.value.hits(t) for t in some.column(1).to_pylist()]
                at = pa.array([i for i, h in enumerate(hits) if len(h)], pa.int64())
                if len(at):
                    found = pa.array([h.view(np.int64) for h in hits if len(h)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([some.column(0).take(at), some.column(1).take(at), found], names=["id", "text", "hits"])

    return run


def _verify(how: tuple):
    """(rid, iid, text, item text) to those pairs that overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, t = None, None
        for b in batches:
            rid, iid, n, share, start = out = [], [], [], [], []
            for r, i, text, item in zip(*(b.column(k).to_pylist() for k in range(4))):
                if r != last:
                    last, t = r, tokens(text)
                x = tokens(item)
                if found := overlap(t, x, *plan(len(x), *how)):
                    for col, v in zip(out, (r, i, *found)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["rid", "iid", "n_matched", "share", "start"])

    return run


class Benchmark:
    """The items and their seeds, as tables and files of the shared folder."""

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str, how: tuple, seeds_per_file: int):
        spark = benchmark.sparkSession
        self.how = how
        items = benchmark.select(F.monotonically_increasing_id().alias("iid"), F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("itext"))
        self.items = materialize(items.where("itext is not null"), "benchmark-items")
        self.seeds = materialize(self.items.select("iid", "itext").mapInArrow(_item_seeds(how), "seed long, iid long, length int"), "benchmark-seeds")
        bits = max(0, (self.seeds.count() // seeds_per_file).bit_length())
        shard = F.shiftrightunsigned("seed", 64 - bits) if bits else F.lit(0).cast("long")
        files = self.seeds.select(shard.alias("shard"), "seed").distinct().repartition(max(1, min(1 << bits, int(spark.conf.get("spark.sql.shuffle.partitions")))), "shard").sortWithinPartitions("shard")
        files = materialize(files.mapInArrow(_write_seeds(new_path(spark, "seeds"), bits), "shard long, file string"), "benchmark-seed-files")
        lengths = [r[0] for r in self.seeds.select("length").distinct().collect()]  # up to the stretch: a few
        masks = sorted({m for n in lengths for m in plan(n, *how)[2]})
        self.sent = spark.sparkContext.broadcast(SeedFiles(bits, {r["shard"]: r["file"] for r in files.collect()}, masks))  # names of files and masks only
        self.hits = _hits(self.sent)

    def overlaps(self, found: DataFrame) -> DataFrame:
        """(rid, iid, n_matched, share, start) of documents (rid, text, hits)."""
        hits = found.select("rid", F.explode("hits").alias("seed"))
        pairs = hits.join(self.seeds.select("seed", "iid"), "seed").select("rid", "iid").distinct()
        pairs = pairs.join(self.items.select("iid", "itext"), "iid").join(found.select("rid", "text"), "rid").select("rid", "iid", "text", "itext")
        return pairs.mapInArrow(_verify(self.how), "rid long, iid long, n_matched long, share double, start long")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_tokens: int = 6, stretch: int = 13, similarity: float = 0.8, short_items: bool = False, seeds_per_file: int = 1 << 24) -> DataFrame:
    """(doc id, item id, n_matched, share, start): one row per document and item."""
    b = Benchmark(benchmark, item_col, item_text_col, (min_tokens, stretch, similarity, short_items), seeds_per_file)
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_found(b.sent), f"id {kind}, text string, hits array<long>")
    found = materialize(found.withColumn("rid", F.monotonically_increasing_id()), "benchmark-hits")
    out = b.overlaps(found).join(found.select("rid", "id"), "rid").join(b.items.select("iid", "item"), "iid")
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_matched", "share", "start")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_tokens: int = 6, stretch: int = 13, similarity: float = 0.8, seeds_per_file: int = 1 << 24) -> DataFrame:
    """The rows of ``docs`` without an overlap; rows without a hit move nowhere."""
    b = Benchmark(benchmark, item_col, item_text_col, (min_tokens, stretch, similarity, False), seeds_per_file)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text")).withColumn("hits", b.hits("text"))
    rows = materialize(rows.select("row", "hits", F.when(F.col("hits").isNotNull(), F.col("text")).alias("text"), F.monotonically_increasing_id().alias("rid")), "benchmark-flagged")
    found = rows.where("hits is not null")
    gone = materialize(b.overlaps(found).select("rid").distinct(), "benchmark-gone")
    kept = rows.where("hits is null").select("row").unionByName(found.join(gone, "rid", "left_anti").select("row"))
    return kept.select("row.*")
