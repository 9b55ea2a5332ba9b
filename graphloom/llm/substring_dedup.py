"""Substring dedup with a compressed FM-index per shard.

A window is ``window`` consecutive words. Of every word sequence that fills a
window somewhere, the occurrences in the document with the least id stay, and the
words of all occurrences in other documents go.

Candidates. In every window the ``gram``-word sequence with the least hash, the
leftmost of equals, is its anchor, so equal windows have equal anchors at equal
places. Anchors found in one document only are dropped after an aggregation over
their hashes; a document without other anchors is never moved. Around each
remaining anchor lies its context: all windows whose anchor it is. Equal contexts are combined before they are
shuffled and keep the least id. Contexts go to shards by their anchor. If an anchor
has more than ``max_contexts`` different contexts, as at the edge of a passage that
very many documents share, each window of these becomes a context of its own and
goes to a shard by its own hash, so that equal windows still meet.

Matching. A shard indexes its contexts: the Burrows-Wheeler transform of their
words, held in a wavelet matrix of packed bits with counts per 64 bits. The words of
the contexts are then streamed through it from right to left, all contexts of the
shard in step. A step of backward search adds a word on the left; if nothing
matches, the interval falls back to that of a shorter match, which the array of
longest common prefixes gives. The lengths found are the matching statistics, up to
``window``. Where they reach ``window``, the interval names all equal windows of the
shard, and so the least id that has this window. Suffixes are sorted by their first
64 words, which is enough for matches of that length.

Defined results: null text has no words; a null id counts as larger than any other
and null ids as equal; documents with equal ids never take words from each other;
an empty table gives no rows; the result has the id and its own columns only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize

U64 = np.uint64
DEPTH = 64
BELOW = (U64(1) << np.arange(64, dtype=U64)) - U64(1)
BYTES = np.append(BELOW[:64:8], ~U64(0))  # masks of the first bytes of a block
NO_ID = (1 << 63) - 1
EMPTY = hashlib.sha256().digest()


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * U64(0x9E3779B97F4A7C15)) ^ (b + U64(0xC2B2AE3D27D4EB4F))
    x = (x ^ (x >> U64(31))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(29))


class Words:
    """The words of several texts behind each other, and their hashes, by whole arrays.

    starts and ends are their bytes in ``raw``; those of text k are borders[k] to
    borders[k + 1]. Unlike words of 8 bytes or less and of one size have unlike hashes.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        """raw: the bytes of the texts; offsets: where each text starts, and the end."""
        self.raw = raw.tobytes()
        word = (raw != 32) & (raw - np.uint8(9) > 4)
        cut = np.zeros(len(raw) + 1, bool)
        cut[offsets] = True
        before = np.concatenate([[False], word[:-1]]) & ~cut[:-1] if len(raw) else word
        after = np.concatenate([word[1:], [False]]) & ~cut[1:] if len(raw) else word
        self.starts, self.ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        self.borders = np.searchsorted(self.starts, offsets)
        self.hashes = self._hash(np.concatenate([raw, np.zeros(-len(raw) % 8 + 8, np.uint8)]).view("<u8"))
        # places of words that follow the one before by other than one space
        odd = self.starts[1:] - self.ends[:-1] != 1
        odd[~odd] = raw[self.ends[:-1][~odd]] != 32
        self.odd = np.concatenate([[0], np.cumsum(odd)])

    def _hash(self, blocks: np.ndarray) -> np.ndarray:
        def block(at: np.ndarray, left: np.ndarray) -> np.ndarray:
            k, shift = at >> 3, ((at & 7) << 3).astype(U64)
            x = (blocks[k] >> shift) | (blocks[k + 1] << (U64(63) - shift) << U64(1))
            return x & BYTES[np.minimum(left, 8)]

        sizes = self.ends - self.starts
        out = _pair(sizes.astype(U64), block(self.starts, sizes))
        todo, done = np.flatnonzero((sizes > 8) & (sizes <= 64)), 8
        while len(todo):
            out[todo] = _pair(out[todo], block(self.starts[todo] + done, sizes[todo] - done))
            done += 8
            todo = todo[sizes[todo] > done]
        for k in np.flatnonzero(sizes > 64).tolist():
            out[k] = xxhash.xxh64_intdigest(self.raw[self.starts[k] : self.ends[k]])
        return out

    def inside(self, window: int) -> np.ndarray:
        """Which windows lie in one text, by their first word."""
        text = np.repeat(np.arange(len(self.borders) - 1), np.diff(self.borders))
        return text[: max(0, len(text) - window + 1)] == text[window - 1 :]

    def joined(self, first: np.ndarray, end: np.ndarray) -> Iterator[bytes]:
        """The words from ``first`` to before ``end``, one at least, joined by one space."""
        for s, e, odd in zip(self.starts[first].tolist(), self.ends[end - 1].tolist(), (self.odd[end - 1] > self.odd[first]).tolist()):
            yield b" ".join(self.raw[s:e].split()) if odd else self.raw[s:e]


def words_of(texts: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, int, Words]]:
    """(first text, text past the last, their words), of some ``size`` bytes or one text each."""
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, end, Words(raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from every place where so many are left."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, power, step = None, 0, h, 1
    while done < size:
        if size & step:
            part = power[done : done + n]
            out = part if out is None else _pair(out, part)
            done += step
        if done < size:
            power = _pair(power[:-step], power[step:])
            step *= 2
    return out


def _slide(x: np.ndarray, size: int, f) -> np.ndarray:
    """f over every ``size`` consecutive values."""
    step = 1
    while step * 2 <= size:
        x = f(x[:-step], x[step:])
        step *= 2
    return x if step == size else f(x[: len(x) - (size - step)], x[size - step :])


def anchors(h: np.ndarray, window: int, gram: int, inside: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(places, hashes, first, last) of the grams that are the leftmost least of
    some window; first and last are the outermost of those windows. Of several texts
    behind each other, ``inside`` marks the windows that lie in one text."""
    starts = np.flatnonzero(inside) if inside is not None else np.arange(max(0, len(h) - window + 1))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = gram_hashes(h, gram)
    span = window - gram + 1
    least = _slide(g, span, np.minimum)  # by window
    edge = np.zeros(span - 1, U64)
    most = _slide(np.concatenate([edge, least if inside is None else np.where(inside, least, U64(0)), edge]), span, np.maximum)
    at = np.flatnonzero(g == most[: len(g)])
    least = least[starts]
    which = np.searchsorted(at, starts)
    off = np.flatnonzero(g[at[which]] != least)
    while len(off):
        which[off] += 1
        off = off[g[at[which[off]]] != least[off]]
    # the leftmost least place never moves back from one window to the next
    first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    at = at[which[first]]
    return at, g[at], starts[first], starts[np.append(first[1:], len(starts)) - 1]


class WaveletMatrix:
    """Counts of symbols in prefixes of a sequence, from packed bits."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            b = ((s >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([b, np.zeros(-len(b) % 64 + 64, np.uint8)]), bitorder="little").view("<u8")
            self.bits.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(np.int32(len(b) - int(b.sum())))
            s = np.concatenate([s[b == 0], s[b == 1]])
        self.first = self.forward(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def forward(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        i, c = i.astype(np.int32), c.astype(np.int32)
        for k in range(self.levels):
            word = i >> 6
            ones = self.ones[k].take(word) + np.bitwise_count(self.bits[k].take(word) & BELOW.take(i & 63))
            i = np.where(c & np.int32(1 << (self.levels - 1 - k)), ones + self.zeros[k], i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands before place i."""
        return self.forward(c, i) - self.first[c]


class FMIndex:
    """Backward search over several word sequences.

    Symbol 0 ends each sequence; no query holds it, so no match crosses an end.
    """

    def __init__(self, sequences: list[np.ndarray], n_symbols: int):
        """sequences of symbols from 1 to n_symbols - 1."""
        self.sizes = np.array([len(s) for s in sequences], np.int64)
        ends = np.cumsum(self.sizes + 1)
        text = np.zeros(int(ends[-1]), np.int64)
        self.owner = np.repeat(np.arange(len(sequences)), self.sizes + 1)
        inner = np.ones(len(text), bool)
        inner[ends - 1] = False
        text[inner] = np.concatenate(sequences)
        ranks, rank, step = [], text, 1
        while True:
            ranks.append(rank.astype(np.int32))
            nxt = np.zeros(len(text), np.int64)
            nxt[:-step] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + nxt
            self.order = np.argsort(key)  # the order of equal suffixes does not matter: matches see whole classes of them
            step *= 2
            if step == DEPTH:
                break
            k = key[self.order]
            rank = np.empty(len(text), np.int64)
            rank[self.order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
        sa = self.order
        self.lcp = np.zeros(len(sa) + 1, np.int64)
        a, b = sa[:-1].copy(), sa[1:].copy()
        for r, size in zip(ranks[::-1], (32, 16, 8, 4, 2, 1)):
            inside = (a < len(text)) & (b < len(text))
            same = inside.copy()
            same[inside] = r[a[inside]] == r[b[inside]]
            self.lcp[1:-1] += np.where(same, size, 0)
            a, b = a + np.where(same, size, 0), b + np.where(same, size, 0)
        self.lcp[0] = self.lcp[-1] = -1
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.before = text[sa - 1].astype(np.int32)
        self.bwt = WaveletMatrix(self.before, n_symbols)
        self._nearest: tuple[np.ndarray, np.ndarray] | None = None

    def classes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last row of the rows that share ``length`` symbols."""
        cut = self.lcp[:-1] < length
        first = np.flatnonzero(cut)
        which = np.cumsum(cut) - 1
        return first[which], np.append(first[1:], len(cut))[which]

    def nearest_smaller(self) -> tuple[np.ndarray, np.ndarray]:
        """For each border between rows the nearest borders with a lesser common prefix."""
        if self._nearest is None:
            lcp = self.lcp.tolist()
            left, right, stack = [0] * len(lcp), [len(lcp) - 1] * len(lcp), []
            for i, x in enumerate(lcp):
                while stack and lcp[stack[-1]] > x:
                    right[stack.pop()] = i
                j = stack[-1] if stack else 0
                left[i] = left[j] if stack and lcp[j] == x else j
                stack.append(i)
            self._nearest = np.array(left), np.array(right)
        return self._nearest

    def matching_statistics(self, queries: list[np.ndarray], longest: int) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, rows), one line per query and place, from its first symbol.

        length is that of the longest match, up to ``longest``, of the symbols
        from there on; row is the first row of its interval. Symbols the index
        lacks are 0 or less. Lines are padded to the longest query.
        """
        if not 1 < longest < DEPTH:
            raise ValueError(f"lengths from 2 to {DEPTH - 1} can be matched")
        sizes = np.array([len(q) for q in queries])
        width = int(sizes.max()) if len(sizes) else 0
        grid = np.zeros((width, len(queries)), np.int64)  # column by column from the right
        for k, q in enumerate(queries):
            grid[: len(q), k] = q[::-1]
        n = len(self.order)
        lo, hi, length = np.zeros(len(queries), np.int64), np.full(len(queries), n), np.zeros(len(queries), np.int64)
        lengths, rows = np.zeros((len(queries), width), np.int64), np.zeros((len(queries), width), np.int64)
        near_lo, near_hi = self.classes(longest - 1)
        for t in range(width):
            full = np.flatnonzero(length == longest)
            hi[full], lo[full] = near_hi[lo[full]], near_lo[lo[full]]
            length[full] = longest - 1
            todo = np.flatnonzero(t < sizes)
            while len(todo):
                c = grid[t, todo]
                known = c > 0
                lost = todo[~known]
                lo[lost], hi[lost], length[lost] = 0, n, 0
                todo, c = todo[known], c[known]
                old_lo, old_hi = lo[todo], hi[todo]
                new_lo = self.starts[c] + self.bwt.rank(c, old_lo)
                new_hi = new_lo + (self.before[old_lo] == c)  # of a single row
                wide = np.flatnonzero(old_hi - old_lo > 1)
                new_hi[wide] = self.starts[c[wide]] + self.bwt.rank(c[wide], old_hi[wide])
                ok = new_lo < new_hi
                hit = todo[ok]
                lo[hit], hi[hit] = new_lo[ok], new_hi[ok]
                length[hit] += 1
                todo = todo[~ok]
                todo = todo[length[todo] > 0]
                if len(todo):
                    left, right = self.nearest_smaller()
                    a, b = self.lcp[lo[todo]], self.lcp[hi[todo]]
                    border = np.where(a >= b, lo[todo], hi[todo])
                    short = np.maximum(np.maximum(a, b), 0)
                    lo[todo] = np.where(short > 0, left[border], 0)
                    hi[todo] = np.where(short > 0, right[border], n)
                    length[todo] = short
            live = np.flatnonzero(t < sizes)
            lengths[live, sizes[live] - 1 - t] = length[live]
            rows[live, sizes[live] - 1 - t] = lo[live]
        return lengths, rows


def _scan(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, size, hs, ps = [], [], [], [], []
            for _, _, words in words_of(b.column(2)):
                at, h, _, _ = anchors(words.hashes, window, gram, words.inside(window))
                lo, hi = words.borders[:-1], words.borders[1:]
                some = np.flatnonzero(hi > lo)
                digests = [EMPTY] * len(lo)
                for k, text in zip(some.tolist(), words.joined(lo[some], hi[some])):
                    digests[k] = hashlib.sha256(text).digest()
                found = np.diff(np.searchsorted(at, words.borders))
                n.append(hi - lo)
                sha += digests
                size.append(found)
                hs.append(h.view(np.int64))
                ps.append((at - np.repeat(lo, found)).astype(np.int32))
            if sha:
                borders = pa.array(np.cumsum(np.concatenate([[0], *size])), pa.int32())
                lists = [pa.ListArray.from_arrays(borders, pa.array(np.concatenate(x))) for x in (hs, ps)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(n), pa.int64()), pa.array(sha, pa.binary()), *lists], names=["id", "rid", "n_words", "sha", "h", "p"])

    return run


def _contexts(window: int, gram: int, text: bool):
    """Contexts of the marked anchors: their places, or their distinct texts."""

    def found(some: pa.RecordBatch) -> Iterator[tuple]:
        """(rows, hashes, first words, contexts with their digests) of the marked anchors."""
        for start, end, words in words_of(some.column(2)):
            at, h, first, last = anchors(words.hashes, window, gram, words.inside(window))
            marks = some.column(3).slice(start, end - start)
            row = np.repeat(np.arange(end - start), pc.list_value_length(marks).to_numpy())
            k = np.searchsorted(at, np.sort(marks.flatten().to_numpy() + words.borders[row]))
            raw = h[k].tobytes()
            texts = ((x, xxhash.xxh3_128_digest(x + raw[8 * j : 8 * j + 8])) for j, x in enumerate(words.joined(first[k], last[k] + window)))
            yield row + start, h[k].view(np.int64), first[k] - words.borders[row], texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):
                some = b.slice(start, 500)
                if text:
                    ids = pc.fill_null(some.column(0).cast(pa.int64()), NO_ID).to_pylist()
                    out: dict = {}
                    for rows, h, _, texts in found(some):
                        for k, x, (ctx, c) in zip(rows.tolist(), h.tolist(), texts):
                            if c not in out or ids[k] < out[c][3]:
                                out[c] = (x, c, ctx, ids[k])
                    cols = list(zip(*out.values())) or [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.int64()))], names=["h", "c", "ctx", "least"])
                else:
                    for rows, _, first, texts in found(some):
                        yield pa.RecordBatch.from_arrays([pa.array([c for _, c in texts], pa.binary()), some.column(0).take(pa.array(rows)), some.column(1).take(pa.array(rows)), pa.array(first, pa.int32())], names=["c", "id", "rid", "start"])

    return run


def _windows(window: int):
    """(c, ctx, least) to one row for each window: (c, at, route, u, ctx, least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):
                out = []
                for c, ctx, least in zip(*(b.slice(start, 500).column(i).to_pylist() for i in range(3))):
                    words = ctx.split()
                    for k in range(len(words) - window + 1):
                        w = b" ".join(words[k : k + window])
                        u = xxhash.xxh3_128_digest(w)
                        out.append((c, k, int.from_bytes(u[:8], "little", signed=True), u, w, least))
                cols = list(zip(*out)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()))], names=["c", "at", "route", "u", "ctx", "least"])

    return run


def least_owners(texts: list[bytes], least: list[int], window: int) -> list[np.ndarray]:
    """For each text and window the least id among texts with that window."""
    words = [w for _, _, w in words_of(pa.array(texts, pa.large_binary()))]
    names, symbols = np.unique(np.concatenate([w.hashes for w in words]), return_inverse=True)
    seqs = np.split(symbols + 1, np.cumsum(np.concatenate([np.diff(w.borders) for w in words]))[:-1])
    del words
    index = FMIndex(seqs, len(names) + 1)
    lengths, rows = index.matching_statistics(seqs, window)
    owners = np.array(least, np.int64)[index.owner[index.order]]
    first, _ = index.classes(window)
    starts = np.unique(first)
    by_row = np.minimum.reduceat(owners, starts)[np.searchsorted(starts, first)]
    out = []
    for k, s in enumerate(seqs):
        n = max(0, len(s) - window + 1)
        if (lengths[k, :n] < window).any():
            raise AssertionError("a window of the shard is missing from its index")
        out.append(by_row[rows[k, :n]])
    return out


def _match(window: int, batch_words: int = 4_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, texts, least = [], [], []
        for b in batches:
            units += b.column(0).to_pylist()
            texts += b.column(1).to_pylist()
            least += b.column(2).to_pylist()
        if not units:
            return
        found = least_owners(texts, least, window)
        for start in range(0, len(units), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(units[start : start + 5000], pa.binary()), pa.array(found[start : start + 5000], pa.list_(pa.int64()))], names=["u", "owners"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha = [], [], []
            for t, at in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = split_words(t)
                cover = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.array(at, np.int64))
                cover[at] += 1
                np.add.at(cover, at + window, -1)
                out = np.cumsum(cover)[:-1] > 0
                kept = [w for w, o in zip(words, out.tolist()) if not o]
                n.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.binary())], names=["id", "rid", "n_words", "n_removed", "sha"])

    return run


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, max_contexts: int, shard_contexts: int):
    """(scanned, marked, removed).

    scanned: id, rid, n_words, sha of every row; marked: rows with a shared
    anchor, with text; removed: id, rid and the places of the windows that go.
    rid tells apart rows with equal ids and unequal texts.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), F.col(text_col).alias("t"))
    scanned = materialize(rows.mapInArrow(_scan(window, gram), f"id {kind}, rid long, n_words long, sha binary, h array<long>, p array<int>"), "anchors")

    places = scanned.select("id", "rid", F.explode(F.arrays_zip("h", "p")).alias("a")).select("id", "rid", "a.h", "a.p")
    order = F.coalesce(F.col("id"), F.lit(NO_ID))
    shared = places.groupBy("h").agg(F.min(order).alias("lo"), F.max(order).alias("hi")).where("lo < hi").select("h")
    shared = materialize(shared, "shared")  # so that the join can split a hot anchor
    marks = places.join(shared, "h").groupBy("id", "rid").agg(F.collect_set("p").alias("p")).withColumnsRenamed({"id": "i2", "rid": "r2"})
    marked = rows.join(marks, (F.col("rid") == F.col("r2")) & F.col("id").eqNullSafe(F.col("i2"))).select("id", "rid", "t", "p")
    marked = materialize(marked, "marked")

    texts = marked.mapInArrow(_contexts(window, gram, True), "h long, c binary, ctx binary, least long")
    texts = materialize(texts.groupBy("h", "c", "ctx").agg(F.min("least").alias("least")), "contexts")
    contexts = texts.count()
    crowded = texts.groupBy("h").count().where(F.col("count") > max_contexts).select("h", F.lit(True).alias("crowded"))
    texts = texts.join(F.broadcast(crowded), "h", "left")  # one row for max_contexts contexts at most
    plain = texts.where("crowded is null").select(F.col("h").alias("route"), F.col("c").alias("u"), "ctx", "least")
    apart = materialize(texts.where("crowded").select("c", "ctx", "least").mapInArrow(_windows(window), "c binary, at int, route long, u binary, ctx binary, least long"), "windows")
    single = apart.groupBy("route", "u", "ctx").agg(F.min("least").alias("least"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (contexts + apart.count()) // shard_contexts)
    owners = materialize(plain.unionByName(single).repartition(n, "route").select("u", "ctx", "least").mapInArrow(_match(window), "u binary, owners array<long>"), "owners")

    pieces = apart.select("c", "at", "u").join(owners.select("u", F.col("owners")[0].alias("o")), "u").groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "o"))), lambda x: x["o"]).alias("owners"))
    known = owners.withColumnRenamed("u", "c").join(apart.select("u").distinct().withColumnRenamed("u", "c"), "c", "left_anti").unionByName(pieces)
    found = marked.mapInArrow(_contexts(window, gram, False), f"c binary, id {kind}, rid long, start int").join(known, "c")
    gone = F.filter(F.transform("owners", lambda o, k: F.when(o < order, F.col("start") + k)), lambda x: x.isNotNull())
    removed = found.select("id", "rid", gone.alias("gone")).where(F.size("gone") > 0).groupBy("id", "rid").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    return scanned, marked, materialize(removed, "removed")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 20, max_contexts: int = 20_000, shard_contexts: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256."""
    kind = docs.schema[id_col].dataType.simpleString()
    scanned, marked, removed = repeated_windows(docs, id_col, text_col, window, gram, max_contexts, shard_contexts)
    removed = removed.withColumnsRenamed({"id": "i2", "rid": "r2"})
    same = (F.col("rid") == F.col("r2")) & F.col("id").eqNullSafe(F.col("i2"))
    cut = marked.join(removed, same).select("id", "rid", "t", "gone").mapInArrow(_cut(window), f"id {kind}, rid long, n_words long, n_removed long, sha binary")
    whole = scanned.select("id", "rid", "n_words", "sha").join(removed, same, "left_anti").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "sha")
    out = cut.select("id", "n_words", "n_removed", "sha").unionByName(whole)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.lower(F.hex("sha")).alias("kept_sha256"))
