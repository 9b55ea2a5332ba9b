"""Web archives in Zstandard: one frame per record, dictionary up front.

An archive starts with a skippable frame that holds the dictionary. Every record
is a frame of its own and is decoded alone. The reader checks the version line,
the required headers, the content length, the record's end and, for responses,
the digest of the payload.

Records with equal payloads of ``min_bytes`` or more are written once: the one
with the least page id as a response, the others as revisits that name it and
carry the payload's digest and length without its bytes.

Defined results: null html counts as empty; a null id is written as an empty
header, never is a response that others refer to unless it has no rival, and
reads back as null; rows that share both payload and the least id are all
responses; null urls are written as an empty target; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.exact_dedup import maybe_repeated
from graphloom.llm.files import open_file, write_file
from graphloom.session import materialize, new_path

DICTIONARY_MAGIC = 0x184D2A5D
CRLF = b"\r\n"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
COLUMNS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


class ArchiveError(ValueError):
    """An archive or record that breaks the format."""


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _line(text: str | None) -> str:
    return (text or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def format_record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + CRLF * 2 + payload + CRLF * 2


def parse_record(raw: bytes) -> dict:
    head, sep, rest = raw.partition(CRLF * 2)
    if not sep:
        raise ArchiveError("record without end of headers")
    first, *lines = head.decode().split("\r\n")
    if first not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError(f"unknown version {first[:20]!r}")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise ArchiveError(f"malformed header {line[:40]!r}")
        headers[name] = value.removeprefix(" ")
    if missing := [h for h in REQUIRED if h not in headers]:
        raise ArchiveError(f"missing headers: {missing}")
    if not headers["Content-Length"].isdigit():
        raise ArchiveError("malformed content length")
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != CRLF * 2:
        raise ArchiveError(f"content length {size} does not fit the record")
    payload, digest = rest[:size], headers.get("WARC-Payload-Digest", "").removeprefix("sha256:")
    if headers["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ArchiveError("payload does not fit its digest")
    page, refers = headers.get("X-Page-ID", ""), headers.get("X-Refers-To-Page-ID", "")
    return {
        "page_id": int(page) if page else None,
        "url": _unline(headers.get("WARC-Target-URI", "")),
        "payload": payload,
        "payload_bytes": int(headers.get("X-Payload-Length", size)),
        "payload_digest": digest,
        "record_type": headers["WARC-Type"],
        "refers_to": int(refers) if refers else None,
    }


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def read_archive(f, chunk: int = 1 << 16) -> Iterator[dict]:
    """Records of an open archive; memory holds one record and one chunk."""
    rest = f.read(8)
    decoder = zstd.ZstdDecompressor()
    if len(rest) == 8 and struct.unpack("<I", rest[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", rest[4:])[0]
        raw = f.read(size)
        if len(raw) != size:
            raise ArchiveError("dictionary is cut short")
        if size:
            decoder = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw))
        rest = b""
    while rest or (rest := f.read(chunk)):
        frame, out = decoder.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := f.read(chunk)):
                raise ArchiveError("frame is cut short")
            out.append(frame.decompress(rest))
            rest = b""
        rest = frame.unused_data
        yield parse_record(b"".join(out))


def train_dictionary(pages: DataFrame, id_col: str, html_col: str, pages_sampled: int = 200, sample_bytes: int = 16_384, size: int = 32_768) -> bytes:
    """A dictionary from about ``pages_sampled`` pages of ``sample_bytes``.

    Pages are chosen by a hash of their ids, where they are read, so that only
    these reach the driver, four times as many at most where ids repeat. The dictionary changes the size of archives, never
    what is read back. Too little text to train on gives no dictionary.
    """
    share = min(1.0, pages_sampled / max(1, pages.count()))
    k = F.pmod(F.xxhash64(id_col), F.lit(1 << 30))
    chosen = pages.where(F.col(id_col).isNotNull() & (k < int(share * (1 << 30))))
    rows = chosen.select(k.alias("k"), F.substring(F.coalesce(html_col, F.lit("")), 1, sample_bytes).alias("t")).limit(4 * pages_sampled).collect()
    rows.sort(key=lambda r: (r["k"], r["t"]))
    samples = [r["t"].encode() for r in rows if r["t"]]
    try:
        return zstd.train_dictionary(size, samples).as_bytes() if len(samples) >= 20 else b""
    except zstd.ZstdError:
        return b""


def _write(folder: str, dictionary: bytes, level: int, max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        data = zstd.ZstdCompressionDict(dictionary) if dictionary else None
        make = zstd.ZstdCompressor(level=level, dict_data=data, write_content_size=True)
        held, size = [], 0

        def flush():
            nonlocal held, size, seq
            name = write_file(folder, f"pages-{part:06d}-{seq:04d}.warc.zst", [leading_frame(dictionary), *held])
            row = pa.RecordBatch.from_pylist([{"file": name, "n_records": len(held)}])
            held, size, seq = [], 0, seq + 1
            return row

        for b in batches:
            for r in b.to_pylist():
                payload = b"" if r["first"] is not None else r["html"].encode()
                frame = make.compress(format_record(r["id"], r["url"], payload, r["size"], r["digest"], r["first"]))
                held.append(frame)
                size += len(frame)
                if size >= max_bytes:
                    yield flush()
        if held:
            yield flush()

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100, level: int = 3, max_bytes: int = 1 << 25) -> DataFrame:
    """Write one record per row; returns the manifest (file, n_records)."""
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha2(html, 256).alias("digest"))
    keys = materialize(rows.where(F.col("size") >= min_bytes).select("id", F.unhex("digest").alias("h")), "warc-digests")
    flag = (F.col("size") >= min_bytes) & maybe_repeated(keys.select("h"), keys.count())(F.unhex("digest"))
    groups = keys.groupBy(F.lower(F.hex("h")).alias("digest")).agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = materialize(groups, "warc-groups")  # so that the join can split a hot digest
    # pages that are alone in their payload stay where they are read
    full = rows.where(~flag).withColumn("least", F.lit(None).cast("long")).unionByName(rows.where(flag).join(groups, "digest", "left"))
    revisit = F.col("least").isNotNull() & ~F.col("least").eqNullSafe(F.col("id"))
    full = full.select("id", "url", F.when(revisit, F.lit("")).otherwise(F.col("html")).alias("html"), "size", "digest", F.when(revisit, F.col("least")).alias("first"))
    folder = new_path(spark, "warc")
    dictionary = train_dictionary(pages, id_col, html_col)
    return materialize(full.mapInArrow(_write(folder, dictionary, level, max_bytes), "file string, n_records long"), "warc-manifest")


def _read(payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for address, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, seen, held = [], 0, 0
                with open_file(address) as f:
                    for r in read_archive(f):
                        held += len(r["payload"])
                        if not payload:
                            r["payload"] = None
                        rows.append(r)
                        seen += 1
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                            rows, held = [], 0
                if seen != n:
                    raise ArchiveError(f"{address} has {seen} records, not {n}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return run


SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """Read the archives of a manifest, one task per few files."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "file").mapInArrow(_read(payload), COLUMNS)
