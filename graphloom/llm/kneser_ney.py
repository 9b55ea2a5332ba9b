"""Language-model scoring with an interpolated modified Kneser-Ney model.

Counting. A first pass counts words. Each shard of the word table gives its words
numbers by falling count, so that an n-gram is a row of small numbers. A second
pass counts the n-grams of the highest order: tasks combine what they read before
it is shuffled, as packed columns, one block for each shard of the model. Reducing
an order yields its tables and the counts of the order below, which is the number
of different words seen in front of an n-gram, or, for n-grams at the start of a
text, their plain count.

Sharding. The highest order (from three on) goes by the hash of its context, so
that a context's totals come together where the context itself is stored. The
orders below, and order two, go by the hash of the whole n-gram; the totals of their
contexts are added up in the order below, from one partial sum for each shard, so
that a very common context word is nobody's burden.

Storing. Each shard of each order is a file in the shared folder: n-gram hashes,
sorted, as a directory of their leading bits and 32 further bits; the counts, of a
byte where they are below 255; and for each n-gram its totals as a context. Words
keep all 64 bits of their hash. About one n-gram in 10**9 shares its stored bits
with another of its shard and is scored as if it were that one.

Scoring. Workers map the files into memory and look up a batch of texts at a
time in order of shard and hash. A store whose files cannot be mapped is read
table by table into a bounded cache. The driver holds file names and discounts.
The probability of a word w after a context h is

    p(w|h) = max(c(hw) - D(c(hw)), 0) / c(h) + gamma(h) * p(w|h')

with h' the context without its first word, gamma(h) = (D1 N1(h) + D2 N2(h) +
D3 N3(h)) / c(h), and at the end of the recursion 1 / (V + 1). An unseen context
has p(w|h) = p(w|h'). D1, D2 and D3 of each order come from its counts of counts,
within 0 and 1, 2 and 3; where those are too few, they are 0.5, 1 and 1.5.

Words are runs of characters other than ASCII white space, with A-Z lower-cased;
every text ends in an end token, which is counted, and starts after a start token,
which is not.

Defined results: null and empty texts have the end token alone; rows with a null
id are scored, are not held out and are not learned from; repeated rows count and
are scored each; texts of any length are taken whole; without training text every
probability is 1 / (V + 1) = 1; an empty table gives no rows. Results have the id
and their own columns only, whatever other columns there are.
"""

from __future__ import annotations

import gc
import struct
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.files import open_file, write_file
from graphloom.llm.held import held
from graphloom.llm.language_id import remainder
from graphloom.session import materialize, new_path, release, remove_path

U64 = np.uint64
START = 0  # number of the start token; words have 1 and more
UNKNOWN = U64((1 << 64) - 1)
END_HASH = 2
FLUSH = 1_400_000
GROUP_BYTES = 2_500_000
CACHE_BYTES = 1 << 28  # of tables whose files cannot be mapped


def mix(a: np.ndarray, b) -> np.ndarray:
    """A hash of a and b; for a fixed b, one to one in a."""
    x = a * U64(0x9E3779B97F4A7C15) + b * U64(0xC2B2AE3D27D4EB4F) + U64(0x165667B19E3779F9)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def gram_key(cols: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams from the numbers of their words."""
    key = mix(cols[0].astype(U64), U64(0))
    for c in cols[1:]:
        key = mix(key, c.astype(U64))
    return key


# Texts -----------------------------------------------------------------------


@dataclass
class Group:
    """Several texts: their different words, and each token as a place among these.

    The last word is the end token, whose text is empty.
    """

    words: list[bytes]
    which: np.ndarray
    sizes: np.ndarray

    def hashes(self) -> np.ndarray:
        out = np.fromiter(map(xxhash.xxh64_intdigest, self.words), U64, len(self.words))
        out = np.maximum(out, U64(END_HASH + 1))
        out[-1] = END_HASH
        return out

    def places(self) -> np.ndarray:
        return np.arange(len(self.which)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)


def _tokens(texts: pa.Array) -> Group:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    sizes, values = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
    full = pc.greater(pc.binary_length(values), 0)
    if not pc.all(full, min_count=0).as_py():
        there = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        ends = np.cumsum(sizes)
        sizes = there[ends] - there[ends - sizes]
        values = values.filter(full)
    encoded = values.dictionary_encode()
    words = [*encoded.dictionary.cast(pa.large_binary()).to_pylist(), b""]
    which = np.full(len(values) + len(sizes), len(words) - 1, np.int32)
    inner = np.ones(len(which), bool)
    sizes = sizes + 1
    inner[np.cumsum(sizes) - 1] = False
    which[inner] = encoded.indices.to_numpy(zero_copy_only=False)
    return Group(words, which, sizes)


def groups_of(texts: pa.Array) -> Iterator[tuple[int, Group]]:
    """(rows, tokens) of several texts at a time, of about ``GROUP_BYTES``; a longer text is its own group."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + GROUP_BYTES, "right")))
        yield to - at, _tokens(texts.slice(at, to - at))
        at = to


# Blocks of n-grams on their way ----------------------------------------------


@dataclass
class Layout:
    """Where n-grams go. Words: shard and rank in it follow from the number."""

    order: int
    shards: int

    def spread(self, h: np.ndarray) -> np.ndarray:
        return (((h >> U64(32)) * U64(self.shards)) >> U64(32)).astype(np.int64)

    def shard(self, level: int, cols: list[np.ndarray]) -> np.ndarray:
        if level == 0:
            return self.spread(cols[0])
        if level == 1:
            return (np.maximum(cols[0].astype(np.int64), 1) - 1) % self.shards
        by_context = level == self.order and level > 2
        return self.shard_of_key(gram_key(cols[:-1] if by_context else cols))

    def shard_of_key(self, key: np.ndarray) -> np.ndarray:
        return self.spread(mix(key, U64(1)))


def _planes(a: np.ndarray) -> tuple[int, bytes]:
    """Width and bytes of whole numbers, bytes of equal weight side by side."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(a.max(initial=0)) < 1 << 8 * w)
    return width, a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def pack(cols: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    """n-grams, ascending in their first word, and the numbers that go with them."""
    first = np.diff(cols[0].astype(U64), prepend=U64(0))
    widths, parts = zip(*map(_planes, [first, *cols[1:], *counts]))
    return zstandard.compress(struct.pack("<IBB", len(first), len(cols), len(counts)) + bytes(widths) + b"".join(parts), 1)


def unpack(blob: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    raw = zstandard.decompress(blob)
    n, k, m = struct.unpack_from("<IBB", raw)
    at, out = 6 + k + m, []
    for width in raw[6:at]:
        out.append(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T.copy().view(f"<u{width}").ravel())
        at += n * width
    out[0] = np.cumsum(out[0], dtype=U64)
    return out[:k], out[k:]


def combine(cols: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(ascending hashes, n-grams, sums of the counts) of the different n-grams."""
    key = gram_key(cols) if len(cols) > 1 else cols[0].astype(U64)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    at = order[first]
    # without counts, n-grams count once for each time they are there
    sums = [np.add.reduceat(c[order].astype(np.int64), first) if len(first) else c[:0].astype(np.int64) for c in counts] or [np.diff(first, append=len(key))]
    return key[first], [c[at] for c in cols], sums


BLOBS = "level int, shard int, blob binary"


def dealt(layout: Layout, level: int, cols: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (level, shard, blob) of combined n-grams."""
    by = cols[0].astype(U64)
    order = np.argsort(by << U64(32) | (cols[1].astype(U64) & U64(0xFFFFFFFF)) if len(cols) > 1 and by.max(initial=U64(0)) < 1 << 32 else by)
    shard = layout.shard(level, cols)[order]
    small = shard.astype(np.min_scalar_type(layout.shards))
    again = np.argsort(small, kind="stable")
    order, shard = order[again], shard[again]
    cols, counts = [c[order] for c in cols], [c[order] for c in counts]
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    blobs = [pack([c[s:e] for c in cols], [c[s:e] for c in counts]) for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)])]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), level, np.int32)), pa.array(shard[cuts].astype(np.int32)), pa.array(blobs, pa.binary())], names=["level", "shard", "blob"])


class Gatherer:
    """Combines n-grams of one level until there are enough to send."""

    def __init__(self, layout: Layout, level: int):
        self.layout, self.level = layout, level
        self.held: list[tuple[list[np.ndarray], list[np.ndarray]]] = []
        self.size = 0

    def add(self, cols: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.held.append((cols, counts))
        self.size += len(cols[0])
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            cols, counts = ([np.concatenate(c) for c in zip(*(h[i] for h in self.held))] for i in (0, 1))
            self.held, self.size = [], 0
            yield dealt(self.layout, self.level, *combine(cols, counts)[1:])


def _count_words(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Gatherer(layout, 0)
        for b in batches:
            for _, g in groups_of(b.column(0)):
                yield from out.add([g.hashes()], [np.bincount(g.which, minlength=len(g.words))])
        yield from out.flush()

    return run


def _count_grams(layout: Layout, model: Model):
    """n-grams of the highest order, and those below it that start a text."""
    n = layout.order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Tables(model)
        out = {k: Gatherer(layout, k) for k in range(2, n + 1)}
        for b in batches:
            for _, g in groups_of(b.column(0)):
                ids = words.numbers(g.hashes())
                ids = ids.astype(np.uint32 if int(ids.max()) < 1 << 32 else U64)[g.which]
                place = g.places()
                at = np.flatnonzero(place >= n - 2)
                cols = [ids[at - m] for m in range(n - 1, 0, -1)] + [ids[at]]
                cols[0][place[at] == n - 2] = START
                yield from out[n].add(cols, [])
                first = np.cumsum(g.sizes) - g.sizes
                for k in range(2, n):
                    at = first[g.sizes >= k - 1]
                    yield from out[k].add([np.zeros(len(at), np.uint32)] + [ids[at + j] for j in range(k - 1)], [])
        for o in out.values():
            yield from o.flush()

    return run


# Tables ----------------------------------------------------------------------

MAGIC = b"GLKN0003"


def _wide(a: np.ndarray) -> np.ndarray:
    return a.astype(f"<u{next(w for w in (1, 2, 4, 8) if w == 8 or int(a.max(initial=0)) < 1 << 8 * w)}")


def _small(values: np.ndarray) -> list[np.ndarray]:
    """A byte each, 255 for those listed beside with their places."""
    big = np.flatnonzero(values >= 255)
    return [np.minimum(values, 255).astype(np.uint8), big.astype("<u8"), values[big].astype("<u8")]


def _coded(stats: np.ndarray) -> list[np.ndarray]:
    """Rows of four totals as a byte each: 0 for none, 255 for those listed beside."""
    n = len(stats)
    short = (stats < 1 << 16).all(axis=1)
    whole = (stats.astype(U64) << np.array([48, 32, 16, 0], U64)).sum(axis=1, dtype=U64) if n else np.zeros(0, U64)
    kinds, often = np.unique(whole[short & (stats[:, 0] > 0)], return_counts=True)
    kinds = np.sort(kinds[np.argsort(-often, kind="stable")[:254]])
    codes = np.full(n, 255, np.uint8)
    if len(kinds):
        at = np.minimum(np.searchsorted(kinds, whole), len(kinds) - 1)
        same = short & (kinds[at] == whole)
        codes[same] = at[same] + 1
    codes[stats[:, 0] == 0] = 0
    rest = np.flatnonzero(codes == 255)
    return [codes, kinds.astype("<u8"), rest.astype("<u8"), _wide(stats[rest]).ravel()]


def _directory(key: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Ascending hashes by leading bits, about eight to a value, and 32 bits after those."""
    bits = max(0, len(key).bit_length() - 3)
    top = (key >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    starts = np.searchsorted(top, np.arange((1 << bits) + 1))
    return [_wide(starts), ((key << U64(bits)) >> U64(32)).astype("<u4")], int(np.diff(starts).max(initial=0)).bit_length()


def table_file(parts: list[np.ndarray], steps: int = 0) -> list[bytes]:
    """Arrays on end, each padded to eight bytes, after a list of their types."""
    head = MAGIC + struct.pack("<II", len(parts), steps)
    head += b"".join(struct.pack("<BQ", p.dtype.itemsize, len(p)) for p in parts)
    return [x + bytes(-len(x) % 8) for x in (head, *(p.tobytes() for p in parts))]


def _arrays(address: str) -> tuple[list[np.ndarray], int, int]:
    """(arrays, steps, bytes held in memory) of a table file."""
    if address.startswith(("file:///", "/")):
        raw, held = np.asarray(np.memmap(address.removeprefix("file://"), np.uint8, "r")), 0
    else:
        with open_file(address) as f:
            raw = np.frombuffer(f.read(), np.uint8)
        held = len(raw)
    if raw[:8].tobytes() != MAGIC:
        raise ValueError(f"{address} is not a model file")
    n, steps = struct.unpack_from("<II", raw, 8)
    at, out = 16 + 9 * n + -(16 + 9 * n) % 8, []
    for i in range(n):
        width, size = struct.unpack_from("<BQ", raw, 16 + 9 * i)
        out.append(raw[at : at + width * size].view(f"<u{width}"))
        at += width * size + -(width * size) % 8
    return out, steps, held


def _fetch(small: np.ndarray, big: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = small[at].astype(np.int64)
    far = np.flatnonzero(out == 255)
    out[far] = values[np.searchsorted(big, at[far])]
    return out


def _decoded(codes: np.ndarray, kinds: np.ndarray, rest: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(4, n) totals."""
    table = np.zeros((256, 4))
    table[1 : len(kinds) + 1] = (kinds[:, None] >> np.array([48, 32, 16, 0], U64)) & U64(0xFFFF)
    code = codes[at]
    out = table[code]
    far = np.flatnonzero(code == 255)
    out[far] = values.reshape(-1, 4)[np.searchsorted(rest, at[far])]
    return out.T


class Table:
    """One file: hashes if the places do not follow from the words' numbers, counts, totals as context."""

    def __init__(self, address: str, level: int):
        self.parts, self.steps, self.held = _arrays(address)
        self.level = level
        self.key = 2 if level != 1 else 0  # arrays before the counts

    def __len__(self) -> int:
        return len(self.parts[self.key])

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key and whether it is there."""
        if not len(self):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        starts, there = self.parts[:2]
        bits = (len(starts) - 1).bit_length() - 1
        top = (key >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
        rest = ((key << U64(bits)) >> U64(32)).astype(np.uint32)
        lo, end = starts[top].astype(np.int64), starts[top + 1].astype(np.int64)
        hi, last = end, len(there) - 1
        for _ in range(self.steps):
            mid = (lo + hi) >> 1
            less = (there[np.minimum(mid, last)] < rest) & (lo < hi)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
        at = np.minimum(lo, last)
        return at, (lo < end) & (there[at] == rest)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Ranks of words by their ascending hashes, -1 where unseen."""
        keys, ranks = self.parts[:2]
        if not len(keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, ranks[at].astype(np.int64), -1)

    def counts(self, at: np.ndarray) -> np.ndarray:
        return _fetch(*self.parts[self.key : self.key + 3], at)

    def totals(self, at: np.ndarray) -> np.ndarray:
        return _decoded(*self.parts[self.key + 3 : self.key + 7], at)


REDUCED = "kind string, level int, shard int, blob binary, file string, nums array<long>"
SCHEMA = pa.schema([("kind", pa.string()), ("level", pa.int32()), ("shard", pa.int32()), ("blob", pa.binary()), ("file", pa.string()), ("nums", pa.list_(pa.int64()))])


def _rows(*rows: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(list(rows), schema=SCHEMA)


def _by_context(cols: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(hashes, contexts, totals as (n, 4)) of different n-grams, ascending by hash."""
    key, ctx, sums = combine(cols[:-1], [counts, counts == 1, counts == 2, counts >= 3])
    return key, ctx, np.stack(sums, axis=1)


def _reduce(layout: Layout, level: int, folder: str, side: dict[int, str], sizes: dict[int, int]):
    """Blobs of one level, sorted by shard, to model files and blobs of the level below.

    side: files with the totals of this level's n-grams as contexts, by shard;
    sizes: words of each shard.
    """
    top = level == layout.order
    own_contexts = top and level > 2  # whose totals are whole in this shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = [Gatherer(layout, level - 1) for _ in range(2)] if level > 1 else []
        coc = np.zeros(6, np.int64)  # n-grams counted 1 to 4 times, all, their sum

        def passed(made: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for m in made:
                yield _rows(*({"kind": "lower", "level": k, "shard": s, "blob": x} for k, s, x in zip(*(m.column(i).to_pylist() for i in range(3)))))

        def written(shard: int, parts: list[np.ndarray], steps: int = 0, kind: str = "file", n: int = 0) -> pa.RecordBatch:
            name = write_file(folder if kind == "file" else f"{folder}/{kind}", f"{kind}-{level}-{shard:06d}", table_file(parts, steps))
            return _rows({"kind": kind, "level": level, "shard": shard, "file": name, "nums": [n]})

        def note(counts: np.ndarray) -> None:
            coc[:] += [*((counts == c).sum() for c in range(1, 5)), (counts > 0).sum(), counts.sum()]

        def words(shard: int, blobs: list) -> Iterator[pa.RecordBatch]:
            key, _, (counts,) = combine(*([np.concatenate(c) for c in zip(*(b[i] for b in blobs))] for i in (0, 1)))
            key, counts = key[counts > 0], counts[counts > 0]
            note(counts)
            ranks = np.empty(len(key), np.int64)
            falling = np.argsort(-counts, kind="stable")
            ranks[falling] = np.arange(len(key))
            yield written(shard, [key.astype("<u8"), _wide(ranks), *_small(counts[falling])], n=len(key))

        def unigrams(shard: int, blobs: list) -> Iterator[pa.RecordBatch]:
            n = sizes.get(shard, 0)
            counts, totals = np.zeros(n, np.int64), np.zeros((n, 4), np.int64)
            for (ids,), nums in blobs:
                at = (ids.astype(np.int64) - 1) // layout.shards
                if len(nums) == 1:
                    counts[at] += nums[0].astype(np.int64)
                else:
                    held = np.stack([x.astype(np.int64) for x in nums], axis=1)
                    if len(ids) and ids[0] == START:
                        yield _rows({"kind": "start", "level": level, "nums": held[0].tolist()})
                        at, held = at[1:], held[1:]
                    totals[at] += held
            note(counts)
            yield written(shard, [*_small(counts), *_coded(totals)])

        def grams(shard: int, blobs: list) -> Iterator[pa.RecordBatch]:
            plain, partial = ([b for b in blobs if len(b[1]) == m] for m in (1, 4))
            key, cols, (counts,) = combine(*([np.concatenate(c) for c in zip(*(b[i] for b in plain))] for i in (0, 1)))
            note(counts)
            totals = np.zeros((len(key), 4), np.int64)
            for ids, nums in partial:
                totals[np.searchsorted(key, gram_key(ids))] += np.stack([x.astype(np.int64) for x in nums], axis=1)
            directory, steps = _directory(key)
            if shard in side:
                held, _, _ = _arrays(side[shard])
                totals[np.searchsorted(key, held[0])] = _decoded(*held[1:5], np.arange(len(held[0]))).T
            yield written(shard, [*directory, *_small(counts), *([] if top else _coded(totals))], steps)
            key, ctx, sums = _by_context(cols, counts)
            if own_contexts:
                yield written(shard, [key.astype("<u8"), *_coded(sums)], kind="side")
            else:
                yield from passed(lower[1].add(ctx, list(sums.T)))
            yield from passed(lower[0].add(cols[1:], []))

        finish = words if level == 0 else unigrams if level == 1 else grams
        held, at = [], None
        for b in batches:
            for k, shard, blob in zip(*(b.column(i).to_pylist() for i in range(3))):
                if k != level:
                    yield _rows({"kind": "lower", "level": k, "shard": shard, "blob": blob})
                    continue
                if shard != at and held:
                    yield from finish(at, held)
                    held = []
                at = shard
                held.append(unpack(blob))
        if held:
            yield from finish(at, held)
        for o in lower:
            yield from passed(o.flush())
        yield _rows({"kind": "counts", "level": level, "nums": coc.tolist()})

    return run


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3 from the number of n-grams counted 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


@dataclass
class Model:
    """What workers need to find and use the tables of a model."""

    layout: Layout
    files: dict[tuple[int, int], str]
    counts: dict[int, list[int]]  # by level: counted 1, 2, 3, 4 times; all; sum
    start: list[int]  # totals of the start token as a context

    @property
    def discounts(self) -> dict[int, list[float]]:
        return {k: discounts(c[:4]) for k, c in self.counts.items() if k}

    @property
    def tokens(self) -> int:
        return self.counts[0][5]

    @property
    def vocabulary(self) -> int:
        return self.counts[0][4]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, docs_per_shard: int = 5000) -> Model:
    """Count the texts whose id has a remainder other than 0 modulo 10."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    folder = new_path(spark, "kneser-ney")
    texts = docs.where(remainder(F.col(id_col), 10) != 0).select(F.col(text_col).cast("string").alias("t"))
    layout = Layout(order, max(8, docs.count() // docs_per_shard))
    model = Model(layout, {}, {}, [0] * 4)
    parts, sizes, side, n = texts.mapInArrow(_count_words(layout), BLOBS), {}, {}, max(layout.shards, int(spark.conf.get("spark.sql.shuffle.partitions")))

    above = None
    for level in (0, *range(order, 0, -1)):
        if level == order:
            parts = texts.mapInArrow(_count_grams(layout, model), BLOBS)
        at = f"{folder}/{level}"
        made = parts.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_reduce(layout, level, at, side, sizes), REDUCED)
        made = materialize(made, f"order-{level}")
        if side:
            remove_path(spark, f"{folder}/{level + 1}/side")
            side = {}
        for r in made.where("kind in ('file', 'side', 'start', 'counts')").drop("blob").collect():
            if r["kind"] == "file":
                model.files[level, r["shard"]] = r["file"]
                if level == 0:
                    sizes[r["shard"]] = r["nums"][0]
            elif r["kind"] == "side":
                side[r["shard"]] = r["file"]
            elif r["kind"] == "start":
                model.start = [a + b for a, b in zip(model.start, r["nums"])]
            else:
                model.counts[level] = [a + b for a, b in zip(model.counts.get(level, [0] * 6), r["nums"])]
        model.counts.setdefault(level, [0] * 6)
        parts = made.where("kind = 'lower'").select("level", "shard", "blob")
        if above is not None:
            release(above)
        _let_go(spark)
        above = made
    release(above)
    return model


def _let_go(spark: SparkSession) -> None:
    """Have Spark delete shuffle files of frames that are out of use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# Scoring ---------------------------------------------------------------------


class Tables:
    """The tables of a model, asked for many keys at a time."""

    def __init__(self, model: Model):
        self.model, self.layout = model, model.layout
        self.held: OrderedDict[tuple[int, int], Table] = OrderedDict()
        self.size = 0

    def table(self, level: int, shard: int) -> Table | None:
        at = (level, shard)
        if at in self.held:
            self.held.move_to_end(at)
        elif at in self.model.files:
            t = self.held[at] = Table(self.model.files[at], level)
            self.size += t.held
            while self.size > CACHE_BYTES and len(self.held) > 1:
                self.size -= self.held.popitem(last=False)[1].held
        return self.held.get(at)

    def shards(self, level: int, shard: np.ndarray, key: np.ndarray) -> Iterator[tuple[Table, np.ndarray]]:
        """Each table that is asked, and which rows ask it, in order of their keys."""
        small = shard.astype(np.min_scalar_type(self.layout.shards))
        order = np.argsort(key)
        order = order[np.argsort(small[order], kind="stable")]
        shard = shard[order]
        cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)]):
            t = self.table(level, int(shard[s]))
            if t is not None:
                yield t, order[s:e]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Numbers of words by hash; unseen words share one that no n-gram has."""
        out = np.full(len(h), UNKNOWN)
        shard = self.layout.spread(h)
        for t, at in self.shards(0, shard, h):
            rank = t.numbers(h[at])
            out[at[rank >= 0]] = rank[rank >= 0].astype(U64) * U64(self.layout.shards) + shard[at[0]].astype(U64) + U64(1)
        return out

    def words(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Plain counts, counts of order one and totals as a context."""
        raw, count, totals = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros((4, len(ids)))
        known = np.flatnonzero((ids != UNKNOWN) & (ids != START))
        place = ids[known].astype(np.int64) - 1
        for level in (0, 1):
            for t, at in self.shards(level, place % self.layout.shards, place):
                rank = place[at] // self.layout.shards
                if level == 0:
                    raw[known[at]] = t.counts(rank)
                else:
                    count[known[at]] = t.counts(rank)
                    totals[:, known[at]] = t.totals(rank)
        totals[:, ids == START] = np.array(self.model.start, float)[:, None]
        return raw, count, totals

    def grams(self, level: int, key: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Counts of n-grams by hash, and below the highest order their totals as contexts."""
        count, totals = np.zeros(len(key), np.int64), None if level == self.layout.order else np.zeros((4, len(key)))
        for t, at in self.shards(level, shard, key):
            place, ok = t.find(key[at])
            at, place = at[ok], place[ok]
            count[at] = t.counts(place)
            if totals is not None:
                totals[:, at] = t.totals(place)
        return count, totals


class Scorer:
    def __init__(self, model: Model):
        self.model, self.tables, self.discounts = model, Tables(model), model.discounts

    def _discounted(self, c: np.ndarray, level: int) -> np.ndarray:
        d = np.array([0.0, *self.discounts[level]])
        return np.maximum(c - d[np.minimum(c, 3)], 0)

    def _weights(self, totals: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """1 / c(h) and gamma(h) of contexts of n-grams of this level."""
        seen = totals[0] > 0
        part = np.where(seen, 1 / np.where(seen, totals[0], 1), 0)
        d1, d2, d3 = self.discounts[level]
        return part, np.where(seen, (d1 * totals[1] + d2 * totals[2] + d3 * totals[3]) * part, 1)

    def score(self, g: Group) -> list[np.ndarray]:
        """Per text: tokens, known tokens, base score, score."""
        m, layout = self.model, self.model.layout
        ids = np.append(self.tables.numbers(g.hashes()), U64(START))
        raw, count, totals = self.tables.words(ids)
        base = np.log10((raw + 0.1) / (m.tokens + 0.1 * (m.vocabulary + 1)))
        n1, n2, _, _, kinds, total = m.counts[1]
        p = np.full(len(ids), 1 / (m.vocabulary + 1))
        if total:
            d = self.discounts[1]
            p = self._discounted(count, 1) / total + (d[0] * n1 + d[1] * n2 + d[2] * (kinds - n1 - n2)) / total * p
        p, place = p[g.which], g.places()
        part, gamma = self._weights(totals, 2)
        before = np.roll(g.which, 1)
        before[place == 0] = len(ids) - 1
        part, gamma = part[before], gamma[before]
        # of each token: hash of the n-gram that ends there; its context, which ends a token before
        key, ctx = mix(ids, U64(0))[before], None
        for level in range(2, layout.order + 1):
            if level > 2:
                ctx = key = np.roll(key, 1)
            key = mix(key, ids[g.which])
            at = np.flatnonzero(place >= level - 2)
            shard = layout.shard_of_key((ctx if level == layout.order and level > 2 else key)[at])
            c, totals = self.tables.grams(level, key[at], shard)
            p[at] = self._discounted(c, level) * part[at] + gamma[at] * p[at]
            if totals is not None:
                one, two = self._weights(totals, level + 1)
                part, gamma = np.zeros(len(p)), np.ones(len(p))
                part[at], gamma[at] = one, two
                part, gamma = np.roll(part, 1), np.roll(gamma, 1)
        owner = np.repeat(np.arange(len(g.sizes)), g.sizes)
        p = np.log10(p)
        return [g.sizes, *(np.bincount(owner, x, len(g.sizes)) for x in (raw[g.which] > 0, base[g.which], p))]


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("model", min(sent.value.files.values(), default=None)), lambda: Scorer(sent.value))
        for b in batches:
            at = 0
            for n, group in groups_of(b.column(2)):
                some, at = b.slice(at, n), at + n
                size, known, base, score = scorer.score(group)
                train_tokens = np.full(n, sent.value.tokens, np.int64)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *(pa.array(x) for x in (size, known.astype(np.int64), train_tokens, base, score))], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(remainder(F.col(id_col), 10) == 0, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)
