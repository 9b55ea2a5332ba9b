"""SentencePiece encoding and decoding by an Aho-Corasick automaton.

The automaton over all pieces reports, at every position of a text, the pieces
that end there, longest first, by its output links. A single pass relaxes the
best path to each position from these:

* In unigram models a path's score is the sum of its pieces' scores.
* In merge (BPE) models a path is as good as the merges that make it. A piece may
  follow another only if merging would not have joined parts of the two first,
  which follows from the ranks of the merges on both sides of the border; of the
  pieces that end at a position exactly one continues a valid path, so the pass
  gives the very pieces that merging gives, without merging the text.

Text is read as spaces turned to U+2581 with one such mark in front, and cut
before every mark that follows another character; no piece reaches across such a
cut. A bounded table keeps the segments met before. The pieces of a run of marks
tie in score in merge models; such a run is merged by definition, from a heap, in
n log n steps. All else is linear in the text.

Characters without a piece become byte pieces. A U+2581 of the text itself
becomes byte pieces too, unlike in the public library, so that decoding gives
back every text exactly.

Defined results: null text encodes as null and decodes to null; empty text has
no ids; texts of any length, of spaces or one character alone too, are encoded
whole; repeated rows and null ids are carried along; an empty table gives no rows.
The results have the id and their own columns only, whatever other columns there
are.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.held import held

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, BYTE = 1, 6  # kinds of pieces in a model file
FOREVER = 1 << 60


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            value = buf[at : at + size]
            at += size
        yield key >> 3, value


class PieceModel:
    """Pieces of a model file, and encoding and decoding with them."""

    def __init__(self, path: str, max_segments: int = 120_000, max_segment: int = 48):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind = UNIGRAM
        with open(path, "rb") as f:
            for field, value in _fields(f.read()):
                if field == 1:
                    piece, score, kind = "", 0.0, NORMAL
                    for n, v in _fields(value):
                        if n == 1:
                            piece = v.decode()
                        elif n == 2:
                            score = float(np.frombuffer(v, "<f4")[0])
                        else:
                            kind = v
                    self.pieces.append((piece, score, kind))
                elif field == 2:
                    self.kind = dict(_fields(value)).get(3, UNIGRAM)
        normal = [i for i, p in enumerate(self.pieces) if p[2] == NORMAL]
        self.letters = {c for i in normal for c in self.pieces[i][0] if len(self.pieces[i][0]) == 1} - {"\0"}
        self.longest = max((len(self.pieces[i][0]) for i in normal), default=0)
        self.ids = {self.pieces[i][0]: i for i in normal}
        self.bytes = {int(p[0][1:-1], 16): i for i, p in enumerate(self.pieces) if p[2] == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("the model needs a piece for every byte")
        values = {i: b for b, i in self.bytes.items()}
        self.spelled = [bytes([values[i]]) if i in values else p[0].replace(MARK, " ").encode() if p[2] == NORMAL else b"" for i, p in enumerate(self.pieces)]
        # Merging takes the pair of the best score first. Single characters come
        # before all; pieces of equal scores share a rank.
        scores = sorted({self.pieces[i][1] for i in normal if len(self.pieces[i][0]) > 1}, reverse=True)
        level = {x: r for r, x in enumerate(scores, 1)}
        self.rank = {i: level[self.pieces[i][1]] if len(self.pieces[i][0]) > 1 else 0 for i in normal}
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(self.pieces[i][0], (i, len(self.pieces[i][0])))
        self.automaton.make_automaton()
        runs = [self.rank[i] for i in normal if set(self.pieces[i][0]) == {MARK} and len(self.pieces[i][0]) > 1]
        others = [self.rank[i] for i in normal if set(self.pieces[i][0]) != {MARK} and len(self.pieces[i][0]) > 1]
        # whether marks merge with each other after all else, and whether all else has ranks of its own
        self.runs_last = not runs or min(runs) > max(others, default=0)
        self.distinct = len(set(others)) == len(others) and (self.runs_last or len(set(runs)) == len(runs))
        self.ends: dict[int, tuple[list, list]] = {}
        self.agrees: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}  # segments met of late, and those of the time before
        self.older: dict[str, bytes] = {}
        self.max_segments, self.max_segment = max_segments, max_segment

    def _merge(self, symbols: list[str], seen=None) -> list[int]:
        """Merging as defined: the pair of the best score first, the leftmost of
        equals; seen(rank, place of the left part, place of the end) hears of each.

        Neighbours are linked by place, pairs wait in a heap.
        """
        n = len(symbols)
        ids = [self.ids[s] for s in symbols]
        text, starts = "".join(symbols), [0, *accumulate(map(len, symbols))]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ends = starts[1:]
        heap: list[tuple[int, int, int, int]] = []

        def offer(k: int) -> None:
            if k >= 0 and (j := after[k]) < n:
                i = self.ids.get(text[starts[k] : ends[j]]) if ends[j] - starts[k] <= self.longest else None
                if i is not None:
                    heapq.heappush(heap, (self.rank[i], k, ends[j], i))

        for k in range(n - 1):
            offer(k)
        alive = [True] * n
        while heap:
            rank, k, end, i = heapq.heappop(heap)
            if not alive[k] or (j := after[k]) >= n or ends[j] != end:
                continue
            if seen:
                seen(rank, k, end)
            ids[k], ends[k], after[k], alive[j] = i, end, after[j], False
            if after[k] < n:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [ids[k] for k in range(n) if alive[k]]

    def _ends(self, i: int) -> tuple[list, list]:
        """What stands first, and last, in a piece while it is merged from its
        characters: (piece, rank of the merge that takes it in), in order."""
        out = self.ends.get(i)
        if out is None:
            text = self.pieces[i][0]
            first, last = [(self.ids.get(text[0], -1), 0)], [(self.ids.get(text[-1], -1), len(text) - 1)]
            when: tuple[list, list] = ([], [])

            def seen(rank: int, k: int, end: int) -> None:
                if k == 0:
                    first.append((self.ids[text[:end]], 0))
                    when[0].append(rank)
                if end == len(text):
                    last.append((self.ids[text[k:]], k))
                    when[1].append(rank)

            if len(text) == 1 or all(c in self.ids for c in text) and self._merge(list(text), seen) == [i]:
                out = tuple([(p, w) for (p, _), w in zip(x, [*at, FOREVER])] for x, at in ((first, when[0]), (last, when[1])))
            else:  # merging never makes this piece
                out = ([], [])
            if len(self.ends) > 100_000:
                self.ends.clear()
            self.ends[i] = out
        return out

    def _agree(self, a: int, b: int) -> bool:
        """Whether merging leaves piece a followed by piece b as they are.

        The pieces that face each other change over the course of the merges.
        The two are joined if at some time those that face each other make a
        piece whose rank comes before the merges that would take either away;
        of equal ranks the one further left comes first.
        """
        left, right = self._ends(a)[1], self._ends(b)[0]
        i = j = 0
        out = bool(left and right)
        while out and i < len(left) and j < len(right):
            (x, gone), (y, taken) = left[i], right[j]
            joined = self.ids.get(self.pieces[x][0] + self.pieces[y][0])
            if joined is not None and (r := self.rank[joined]) < gone and r <= taken:
                out = False
            i, j = i + (gone <= taken), j + (taken <= gone)
        if len(self.agrees) > 300_000:
            self.agrees.clear()
        self.agrees[a << 32 | b] = out
        return out

    def _best_merges(self, text: str) -> list[int]:
        last = [-1] * (len(text) + 1)
        size = [0] * (len(text) + 1)
        agrees = self.agrees.get
        for end, (r, n) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                before = last[end - n]
                if end == n or before >= 0 and (self._agree(before, r) if (ok := agrees(before << 32 | r)) is None else ok):
                    last[end], size[end] = r, n
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _best_sum(self, text: str) -> list[int]:
        best = [0.0] + [-np.inf] * len(text)
        last = [(-1, 0)] * (len(text) + 1)
        for end, (r, n) in self.automaton.iter(text):
            end += 1
            score = best[end - n] + self.pieces[r][1]
            if score > best[end]:
                best[end], last[end] = score, (r, n)
        out, at = [], len(text)
        while at:
            out.append(last[at][0])
            at -= last[at][1]
        return out[::-1]

    def _known_part(self, text: str) -> list[int]:
        if self.kind == UNIGRAM:
            return self._best_sum(text)
        if not self.distinct or MARK * 2 in text and not self.runs_last:
            return self._merge(list(text))
        if MARK * 2 in text:
            head = len(text) - len(text.lstrip(MARK))
            rest = self._best_merges(text[head - 1 :]) if head < len(text) else []
            if rest and self.pieces[rest[0]][0] != MARK:
                return self._merge([MARK] * (head - 1)) + rest
            return self._merge([MARK] * head) + rest[1:]
        return self._best_merges(text)

    def segment(self, text: str) -> list[int]:
        """Ids of a segment, in which U+0000 stands for a mark of the text itself
        if ``\\0m`` follows and for itself if ``\\0z`` follows."""
        if self.letters.issuperset(text):
            return self._known_part(text)
        out: list[int] = []
        part: list[str] = []

        def spell(c: str) -> None:
            if part:
                out.extend(self._known_part("".join(part)))
                part.clear()
            out.extend(self.bytes[b] for b in c.encode())

        i = 0
        while i < len(text):
            c = text[i]
            if c == "\0":
                i += 1
                spell(MARK if text[i] == "m" else "\0")
            elif c in self.ids:
                part.append(c)
            else:
                spell(c)
            i += 1
        if part:
            out.extend(self._known_part("".join(part)))
        return out

    def encode(self, text: str | None) -> bytes | None:
        """u32 little-endian ids."""
        if not text:
            return None if text is None else b""
        if "\0" in text or MARK in text:
            text = text.replace("\0", "\0z").replace(MARK, "\0m")
        words = text.split(" ")
        if text[0] == " " or text[-1] == " " or "  " in text:
            words, marks = [], 0
            parts = text.split(" ")
            for k, w in enumerate(parts, 1):
                marks += 1
                if w or k == len(parts):
                    words.append(MARK * (marks - 1) + w if w else MARK * (marks - 1))
                    marks = 0
        known, out = self.known, []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = self.older.get(w)
                if ids is None:
                    ids = array("I", self.segment(MARK + w)).tobytes()
                if len(w) <= self.max_segment:
                    if len(known) > self.max_segments:
                        self.older, self.known = known, (known := {})
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str | None:
        if not ids:
            return None if ids is None else ""
        return b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:].decode()


def _model(path: str) -> PieceModel:
    return held(("pieces", path), lambda: PieceModel(path))


def _each(path: str, decoded: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(path)
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                some = b.slice(start, 1000)
                ids = [m.encode(x) for x in some.column(1).to_pylist()]
                cols = {b.schema.names[0]: some.column(0), "ids": pa.array(ids, pa.binary())}
                if decoded:
                    cols[decoded] = pa.array([m.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """(id, ids): the ids of each text as little-endian u32, a narrow pass.

    ``decoded`` names a further column with the text that the ids spell. The worker
    that made the ids decodes them, so that a task has one worker with the model, not two.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    more = f", `{decoded}` string" if decoded else ""
    return docs.select(id_col, text_col).mapInArrow(_each(model, decoded), f"`{id_col}` {kind}, ids binary{more}")


def decode_column(encoded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids in a further column."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        return pd.Series([_model(model).decode(x) for x in ids], dtype=object)

    return encoded.withColumn(text_col, decode(F.col(ids_col)))
