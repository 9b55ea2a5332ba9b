"""Ids: SHA-256 over parts joined by a zero byte, as lower-case hex."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_id(*parts: Column) -> Column:
    """Nulls count as empty parts."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def node_id_of(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def content_hash(text: Column) -> Column:
    """First 16 bytes of the SHA-256 of the trimmed text."""
    return F.substring(F.sha2(F.trim(text), 256), 1, 32)


def chunk_id(path: Column, symbol: Column, line: Column, part: Column) -> Column:
    """A chunk's id follows from where it is."""
    return node_id(path, symbol, line, part)


def module_path(path: Column) -> Column:
    """``crate`` and the parts after ``src/`` without ``.rs`` and ``mod``; else
    the file's stem."""
    after = F.regexp_extract(path, r"(?:^|/)src/(.*)$", 1)
    parts = F.filter(F.split(F.regexp_replace(after, r"\.rs$", ""), "/"), lambda p: (p != "mod") & (p != ""))
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.rs$", "")
    return F.when(after != "", F.concat(F.array(F.lit("crate")), parts)).otherwise(F.array(stem))
