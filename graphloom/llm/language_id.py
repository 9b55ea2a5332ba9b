"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over labelled text. A text is
parsed against each automaton into the longest phrases that occur in the
labelled text; few phrases mean that the text is made of what that language is
made of. Phrases times the logarithm of the labelled text's length, divided by
the text's length, estimates the cross-entropy in bits a letter; the language
with the least wins, the first name on ties.

Texts are lower-cased, every run of characters that are not letters becomes one
gap. Every letter of the labelled text has a symbol of its own; letters that none
of it has share one, which no automaton knows. An automaton has a column for each
letter of its own language only.
Phrases end at every ``BLOCK`` symbols, so that all blocks of a batch of texts,
whole texts throughout, are parsed in step with array operations.

The labelled sample is bounded: of each language ``docs_per_language`` documents,
chosen by a hash of the row, and of each ``chars_per_doc`` characters from its middle.

Defined results: text that is null or has no letter gives ``und`` with score 0, as
does any text when nothing was learned; rows with a null id are predicted, are
not held out, and are not learned from; repeated rows are predicted each and learned
once; texts of any length are parsed whole; an empty table gives no rows. Extra
columns do not matter, the result has the id and its own columns only.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.held import held

BLOCK = 256
ROWS = 4096  # blocks parsed in step
DENSE = 1 << 25  # cells of the tables of all languages; automata beyond are kept as edges
GAP, OTHER, FIRST = 0, 1, 2
PHRASE = np.uint32(1 << 30)  # phrases that end, above the bits of the state


class SuffixAutomaton:
    """The automaton of all substrings of a sequence of small integers."""

    def __init__(self, symbols):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def parse_table(self, n_symbols: int) -> np.ndarray:
        """For state and symbol the state after it, and the phrases that end: the
        open one if it cannot go on, and the symbol's own if it was never seen.

        Symbol ``n_symbols`` is padding: it ends an open phrase.
        """
        table = np.zeros((len(self.next), n_symbols + 1), np.uint32)
        start = np.zeros(n_symbols + 1, np.uint32)
        for c, s in self.next[0].items():
            start[c] = s
        start[:n_symbols][start[:n_symbols] == 0] = PHRASE
        for s, edges in enumerate(self.next):
            if s:
                table[s] = start + PHRASE
                for c, t in edges.items():
                    table[s, c] = t
        table[0] = start
        table[1:, n_symbols] = PHRASE
        return table


    def parse_edges(self, n_symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same as sorted edges: symbols at the start, keys state and symbol, states."""
        start = np.zeros(n_symbols + 1, np.uint32)
        start[:n_symbols] = [self.next[0].get(c, int(PHRASE)) for c in range(n_symbols)]
        edges = sorted((s * (n_symbols + 1) + c, t) for s, e in enumerate(self.next) for c, t in e.items())
        key, to = np.array(edges, np.int64).reshape(-1, 2).T
        return start, np.append(key, np.int64(1 << 62)), np.append(to, 0).astype(np.uint32)


def _step(table, width: int, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    key = state * width + symbol
    if isinstance(table, np.ndarray):
        return table[key]
    start, keys, to = table
    at = np.searchsorted(keys, key)
    return np.where(keys[at] == key, to[at], start[symbol] + PHRASE * (state > 0))


def _alpha() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = True
    return out


class CrossParser:
    """Automata of several languages, applied to batches of texts."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        alpha = _alpha()
        letters = sorted({c for t in samples.values() for c in t.lower() if c.isalpha()})
        self.classes = np.where(alpha, OTHER, GAP).astype(np.uint32)
        for i, c in enumerate(letters):
            self.classes[ord(c)] = FIRST + i
        self.padding = FIRST + len(letters)
        self.tables, self.columns, self.log_sizes = [], [], []
        room = DENSE
        for name in self.languages:
            symbols, _ = self.symbols([samples[name]])
            own = np.unique(symbols)
            # columns: symbols of the sample, one for all others, padding
            column = np.full(self.padding + 1, len(own), np.min_scalar_type(len(own) + 1))
            column[own] = np.arange(len(own))
            column[self.padding] = len(own) + 1
            self.columns.append(column)
            automaton = SuffixAutomaton(column[symbols].tolist())
            room -= (cells := len(automaton.next) * (len(own) + 2))
            if room >= 0:
                self.tables.append(automaton.parse_table(len(own) + 1).ravel())
            else:
                self.tables.append(automaton.parse_edges(len(own) + 1))
                room += cells
            self.log_sizes.append(math.log2(max(2, len(symbols))))

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' symbols on end, and where each text starts."""
        raw = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        c = self.classes[np.concatenate(raw)] if len(raw) else np.zeros(0, np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != GAP) | (c[:-1] != GAP)
        keep[starts[:-1][sizes > 0]] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        return c[keep], kept[starts]

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) bits a symbol, and whether a text has letters."""
        flat, starts = self.symbols(texts)
        sizes = np.diff(starts)
        letters = np.concatenate([[0], np.cumsum(flat != GAP)])
        has = letters[starts[1:]] > letters[starts[:-1]]
        n_blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        first = np.concatenate([[0], np.cumsum(n_blocks)])[:-1]
        at = starts[:-1][owner] + (np.arange(len(owner)) - first[owner]) * BLOCK
        end = np.minimum(at + BLOCK, starts[1:][owner])
        phrases = np.zeros((len(self.languages), len(texts)))
        for lo in range(0, len(owner), ROWS):
            a, e, o = at[lo : lo + ROWS], end[lo : lo + ROWS], owner[lo : lo + ROWS]
            grid = a[None, :] + np.arange(BLOCK + 1)[:, None]
            grid = np.where(grid < e[None, :], flat[np.minimum(grid, len(flat) - 1)], self.padding)
            for k in range(len(self.languages)):
                table, column = self.tables[k], self.columns[k]
                width = int(column[self.padding]) + 1
                state = np.zeros(len(a), np.int64)
                count = np.zeros(len(a), np.int64)
                for row in column[grid]:
                    v = _step(table, width, state, row)
                    count += v >> 30
                    state = (v & (PHRASE - np.uint32(1))).astype(np.int64)
                phrases[k] += np.bincount(o, count, len(texts))
        bits = phrases * np.array(self.log_sizes)[:, None] / np.maximum(sizes, 1)[None, :]
        return bits.T, has

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        texts = [t or "" for t in texts]
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        bits, has = self.entropies(texts)
        best = bits.argmin(axis=1)
        names = [self.languages[k] if h else "und" for k, h in zip(best, has)]
        if len(self.languages) == 1:
            return names, [float(h) for h in has]
        least = bits.min(axis=1)
        others = (bits.sum(axis=1) - least) / (len(self.languages) - 1)
        score = np.where(has & (others > 0), 1 - least / np.where(others > 0, others, 1), 0.0)
        return names, np.clip(score, 0, 1).tolist()


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_language: int, chars_per_doc: int) -> dict[str, str]:
    """Sampled text of each language; rows with remainder 2 of 4 are left out."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (remainder(F.col(id_col), 4) != 2))
    counts = rows.groupBy(F.col(lang_col).alias("l")).count().collect()
    if not counts:
        return {}
    shares = F.from_json(F.lit(json.dumps({r["l"]: min(1.0, 2 * docs_per_language / r["count"]) for r in counts})), "map<string,double>")
    hashed = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(3))
    size = F.length(text_col)
    picked = rows.where(F.pmod(hashed, F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.try_element_at(shares, F.col(lang_col))).select(
        F.col(lang_col).alias("l"), hashed.alias("k"), F.substring(F.col(text_col), F.greatest(F.lit(1), F.floor((size - chars_per_doc) / 2) + 1).cast("int"), F.lit(chars_per_doc)).alias("t")
    )
    chosen: dict[str, list[tuple[int, str]]] = {}
    for r in picked.distinct().collect():  # repeated rows would be chosen together
        chosen.setdefault(r["l"], []).append((r["k"], r["t"]))
    return {l: " ".join(t for _, t in sorted(v)[:docs_per_language]) for l, v in chosen.items()}


def _parser(samples: dict[str, str]) -> CrossParser:
    return held(("language", hash(tuple(sorted(samples.items())))), lambda: CrossParser(samples))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 64, chars_per_doc: int = 600) -> DataFrame:
    """(id, held_out, lang_pred, score) for every row."""
    samples = docs.sparkSession.sparkContext.broadcast(labelled_sample(docs, id_col, text_col, lang_col, docs_per_language, chars_per_doc))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                some = b.slice(start, 1000)
                names, scores = _parser(samples.value).predict(some.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(remainder(F.col(id_col), 4) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows whose text has letters, which is in a learned language if there are any."""
    bounds = {"docs_per_language": 64, "chars_per_doc": 600} | options
    samples = docs.sparkSession.sparkContext.broadcast(labelled_sample(docs, id_col, text_col, lang_col, **bounds))

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        if not samples.value:
            return pd.Series([any(c.isalpha() for c in t or "") for t in texts], dtype=bool)
        out: list[bool] = []
        for i in range(0, len(texts), 1000):
            out += [n != "und" for n in _parser(samples.value).predict(texts[i : i + 1000].tolist())[0]]
        return pd.Series(out, dtype=bool)

    return docs.where(known(F.col(text_col)))
