"""Token ids in binary files with Elias-Fano document boundaries.

A file holds the ids of consecutive documents as one array, and the borders
between documents as an Elias-Fano sequence: the low bits of every border packed
side by side, the high bits in unary. A select structure over the unary part (a
count of ones before every 512th bit, found by binary search) gives any border,
so that no table of 64-bit offsets is needed. Document ids are kept the same way.

Layout, all little-endian: the magic ``GLTI``, u32 version, u32 bytes per id,
u64 documents, u64 ids, u64 documents with a null id (they come first), i64
least document id, then two Elias-Fano sequences (borders, document ids less the
least) and the id array. A sequence is u64 n, u64 largest value, u32 low bits,
u32 zero, the packed low bits, the packed high bits and the u32 block counts,
each part padded to 8 bytes.

Encoding is that of the library, special tokens in a text included. It runs over
the pieces of a text between spaces. The vocabulary's pre-tokenizer never joins
text across a space that has other characters on both sides, so pieces can be
encoded apart and kept in a bounded table. A text that holds the string of an added
token is given to the library whole.

Defined results: null text counts as empty and gives the end id alone; documents
with null ids come first, in the order of their texts; rows with the same id are
ordered by text; an empty table gives no rows; texts of any length are taken whole;
an id that does not fit the width is an error. Results have their own columns only.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.files import open_file, write_file
from graphloom.llm.held import held
from graphloom.session import materialize, new_path

MAGIC = b"GLTI"
HEADER = struct.Struct("<4sIIQQQq")
SEQUENCE = struct.Struct("<QQII")
SELECT_BITS = 512


def _padded(b: bytes) -> bytes:
    return b + bytes(-len(b) % 8)


class EliasFano:
    """A non-decreasing sequence of non-negative integers, with select."""

    def __init__(self, n: int, top: int, low_bits: int, low: np.ndarray, high: np.ndarray, counts: np.ndarray):
        self.n, self.top, self.low_bits, self.low, self.high, self.counts = n, top, low_bits, low, high, counts

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        if low_bits:
            bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        unary = np.zeros(-(-(n + (top >> low_bits) + 1) // SELECT_BITS) * SELECT_BITS, np.uint8)
        unary[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        ones = unary.reshape(-1, SELECT_BITS).sum(axis=1, dtype=np.int64)
        counts = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        return cls(n, top, low_bits, low, np.packbits(unary, bitorder="little"), counts)

    def select(self, i) -> np.ndarray:
        """The values at positions ``i``."""
        i = np.asarray(i, np.int64)
        block = np.searchsorted(self.counts, i, side="right") - 1
        rows = np.unpackbits(self.high.reshape(-1, SELECT_BITS // 8)[block], axis=1, bitorder="little")
        inside = (np.cumsum(rows, axis=1, dtype=np.int32) <= (i - self.counts[block])[:, None]).sum(axis=1)
        high = (block * SELECT_BITS + inside - i).astype(np.uint64)
        low = np.zeros(len(i), np.uint64)
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            low |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return ((high << np.uint64(self.low_bits)) | low).astype(np.int64)

    def scan(self, step: int = 1 << 14) -> np.ndarray:
        """All values, in blocks."""
        return np.concatenate([self.select(np.arange(i, min(i + step, self.n))) for i in range(0, self.n, step)] or [np.zeros(0, np.int64)])

    def tobytes(self) -> bytes:
        return SEQUENCE.pack(self.n, self.top, self.low_bits, 0) + b"".join(_padded(x.tobytes()) for x in (self.low, self.high, self.counts))

    @classmethod
    def read(cls, buf: memoryview, at: int) -> tuple[EliasFano, int]:
        n, top, low_bits, _ = SEQUENCE.unpack_from(buf, at)
        at += SEQUENCE.size
        n_low = -(-n * low_bits // 8)
        n_high = -(-(n + (top >> low_bits) + 1) // SELECT_BITS) * SELECT_BITS // 8
        n_counts = n_high * 8 // SELECT_BITS + 1
        out = []
        for size, kind in ((n_low, np.uint8), (n_high, np.uint8), (n_counts * 4, "<u4")):
            out.append(np.frombuffer(buf[at : at + size], kind))
            at += size + -size % 8
        return cls(n, top, low_bits, *out), at


def pack_documents(doc_ids: list[int | None], ids: list[bytes], width: int) -> list[bytes]:
    """The parts of a file; ids has the u32 ids of each document."""
    if any(len(b) and int(np.frombuffer(b, "<u4").max()) >> 8 * width for b in ids):
        raise ValueError(f"an id does not fit {width} bytes")
    nulls = sum(d is None for d in doc_ids)
    own = np.array(doc_ids[nulls:], np.int64)
    least = int(own[0]) if len(own) else 0
    borders = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)])
    head = HEADER.pack(MAGIC, 1, width, len(ids), int(borders[-1]), nulls, least)
    return [
        _padded(head),
        EliasFano.build(borders).tobytes(),
        EliasFano.build((own - least).astype(np.uint64)).tobytes(),
        *(np.frombuffer(b, "<u4").astype(f"<u{width}").tobytes() for b in ids),
    ]


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, buf):
        self.buf = memoryview(buf)
        magic, version, self.width, self.n_docs, self.n_ids, self.nulls, self.least = HEADER.unpack_from(self.buf, 0)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file")
        self.borders, at = EliasFano.read(self.buf, HEADER.size + -HEADER.size % 8)
        self.ids, self.at = EliasFano.read(self.buf, at)
        if self.borders.n != self.n_docs + 1 or len(self.buf) - self.at != self.n_ids * self.width:
            raise ValueError("token file is cut short")

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.ids.scan() + self.least).tolist()

    def document(self, i: int) -> np.ndarray:
        s, e = self.borders.select(np.array([i, i + 1])).tolist()
        return self.slice(s, e)

    def slice(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.buf[self.at + start * self.width : self.at + end * self.width], f"<u{self.width}").astype("<u4")


_RUN = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?= \S)")


class PieceEncoder:
    """Encodes whole texts with a ``tokenizers`` file, piece by piece."""

    def __init__(self, path: str, max_pieces: int = 1_200_000, max_piece: int = 48):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        # with a normalizer, a token's string may arise from others: nothing is cut then
        self.added = re.compile("|".join(map(re.escape, added)) if self.model.normalizer is None and added else "$^" if not added else "")
        self.known: dict[str, bytes] = {}  # pieces met of late, and those of the time before
        self.older: dict[str, bytes] = {}
        vocabulary = self.model.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # tokens whose first byte is a space
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.max_pieces, self.max_piece = max_pieces, max_piece

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each after a space. They have none themselves, so that they can be
        encoded as one text and told apart by the tokens that start with one."""
        text = " " + " ".join(pieces)
        if len(pieces) > 1 and not self.added.search(text):
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.spaced[ids])
            if len(cuts) == len(pieces) and cuts[0] == 0:
                raw, at = ids.tobytes(), [*(cuts * 4).tolist(), len(ids) * 4]
                return [raw[a:b] for a, b in zip(at, at[1:])]
        return self._encode([f" {p}" for p in pieces])

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of pieces that follow a space."""
        plain = [p for p in missing if p and p.strip() == p and " " not in p]
        new = dict(zip(plain, self._pieces(plain)))
        other = [p for p in missing if p not in new]
        new.update(zip(other, self._encode([f" {p}" for p in other])))
        return new

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """u32 ids of each text."""
        order, parts = [], []  # texts with their own cuts come after the others
        for i, t in enumerate(texts):
            if not t or self.added.search(t):
                parts.append((i, [t or ""]))
            elif _RUN.search(t):
                parts.append((i, [p if k == 0 else p[1:] for k, p in enumerate(_CUT.split(t))]))
            else:
                order.append(i)
        cut = pc.split_pattern(pa.array([texts[i] for i in order], pa.large_string()), " ")
        cut = pa.concat_arrays([cut, pa.array([p for _, p in parts], cut.type)])
        order += [i for i, _ in parts]
        sizes, flat = pc.list_value_length(cut).to_numpy(), cut.flatten()
        rest = np.ones(len(flat), bool)
        rest[np.cumsum(sizes) - sizes] = False
        firsts = self._encode(flat.filter(pa.array(~rest)).to_pylist())
        if len(self.known) > self.max_pieces // 2:
            self.older, self.known = self.known, {}
        # each different piece is looked up once, and its ids go to all its places at once
        flat = flat.filter(pa.array(rest)).dictionary_encode()
        pieces, which = flat.dictionary.to_numpy(zero_copy_only=False).tolist(), flat.indices.to_numpy()
        found = list(map(self.known.get, pieces))
        lost = [i for i, x in enumerate(found) if x is None]
        for i in lost:
            found[i] = self.older.get(pieces[i])
        new = self._learn([pieces[i] for i in lost if found[i] is None])
        for i in lost:
            if found[i] is None:
                found[i] = new[pieces[i]]
            if len(pieces[i]) <= self.max_piece:
                self.known[pieces[i]] = found[i]
        raw, at = _gather(found, which)
        cuts = at[np.cumsum(np.append(0, sizes - 1))].tolist()
        out = [b""] * len(texts)
        for i, first, a, b in zip(order, firsts, cuts, cuts[1:]):
            out[i] = first + raw[a:b]
        return out


def _gather(parts: list[bytes], which: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The parts of u32 named by ``which``, one after the other, and the bytes before each and after all."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    n = sizes[which]
    at = np.concatenate([[0], np.cumsum(n)])
    shift = (np.cumsum(sizes) - sizes)[which] - at[:-1]
    return np.frombuffer(b"".join(parts), "<u4")[np.repeat(shift, n) + np.arange(at[-1])].tobytes(), at * 4


def _encoder(path: str) -> PieceEncoder:
    return held(("tokens", path), lambda: PieceEncoder(path))


def _write(folder: str, tokenizer: str, end_id: int, width: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        ids: list[bytes] = []
        size = 0
        end = np.array([end_id], "<u4").tobytes()

        def flush():
            nonlocal docs, ids, size, seq
            name = write_file(folder, f"tokens-{part:06d}-{seq:04d}", pack_documents(docs, ids, width))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_docs": len(docs), "n_ids": size, "file": name}])
            docs, ids, size, seq = [], [], 0, seq + 1
            return row

        for b in batches:
            for start in range(0, b.num_rows, 1000):
                some = b.slice(start, 1000)
                enc = [x + end for x in _encoder(tokenizer).encode(some.column(1).to_pylist())]
                docs += some.column(0).to_pylist()
                ids += enc
                size += sum(map(len, enc)) // 4
                if size >= file_ids:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", width: int | None = None, file_ids: int = 1 << 23) -> tuple[DataFrame, str]:
    """Encode ``docs`` into files in ascending id order.

    Returns the manifest (part, seq, n_docs, n_ids, file), whose order by
    (part, seq) is that of the documents, and the folder. Rows are dealt by
    ranges of the id, as many as the input has partitions at least. An id takes
    ``width`` bytes, as many as the vocabulary and the end id need by default.
    """
    spark = docs.sparkSession
    if width is None:
        top = max(end_id, _encoder(tokenizer).model.get_vocab_size() - 1)
        width = 2 if top < 1 << 16 else 4
    folder = new_path(spark, "tokens")
    n = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    rows = rows.repartitionByRange(n, F.asc_nulls_first("id")).sortWithinPartitions(F.asc_nulls_first("id"), "t")
    made = rows.mapInArrow(_write(folder, tokenizer, end_id, width, file_ids), "part long, seq long, n_docs long, n_ids long, file string")
    return materialize(made, "token-manifest"), folder


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for address, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            with open_file(address) as f:
                t = TokenFile(f.read_buffer())
            borders = t.borders.scan()
            crc = [zlib.crc32(t.slice(s, e)) for s, e in zip(borders[:-1].tolist(), borders[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(t.doc_ids(), pa.int64()), pa.array(borders[:-1] + base), pa.array(np.diff(borders)), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    The driver holds one line per task that wrote; the files of a task (each of
    ``file_ids`` ids) are numbered where they are.
    """
    spark = manifest.sparkSession
    rows, base, files = [], 0, 0
    for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count("*").alias("files")).orderBy("part").collect():
        rows.append((r["part"], base))
        base, files = base + r["n"], files + r["files"]
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = manifest.withColumn("before", before).join(spark.createDataFrame(rows, "part long, base long"), "part")
    table = table.select("file", (F.col("base") + F.col("before")).alias("base")).repartition(max(1, min(files, 4 * spark.sparkContext.defaultParallelism + len(rows))), "file")
    return table.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
