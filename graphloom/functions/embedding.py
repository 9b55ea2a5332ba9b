"""Embedding: models behind an interface, batches, and reuse of vectors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.identity import content_hash

SAFE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.~/:")


@dataclass(frozen=True)
class Identity:
    """What a vector depends on; its text form is kept beside stored vectors."""

    runtime: str
    model: str
    dim: int
    max_len: int
    query: str = ""

    def encode(self) -> str:
        return f"emb;v=2;rt={self.runtime};model={quote(self.model)};dim={self.dim};max={self.max_len};query={quote(self.query)}"

    @classmethod
    def decode(cls, text: str) -> Identity:
        head, *fields = text.split(";")
        if head != "emb":
            raise ValueError(f"not an embedding identity: {text!r}")
        found: dict[str, str] = {}
        for f in fields:
            key, eq, value = f.partition("=")
            if not eq or key in found:
                raise ValueError(f"malformed or repeated field {f!r} in {text!r}")
            found[key] = value
        if missing := {"v", "rt", "model", "dim", "max", "query"} - set(found):
            raise ValueError(f"missing fields {sorted(missing)} in {text!r}")
        if found["v"] != "2":
            raise ValueError(f"unknown version in {text!r}")
        return cls(found["rt"], unquote(found["model"]), int(found["dim"]), int(found["max"]), unquote(found["query"]))


def quote(text: str) -> str:
    return "".join(c if c in SAFE else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def unquote(text: str) -> str:
    if re.search(r"%(?![0-9A-Fa-f]{2})", text):
        raise ValueError(f"malformed escape in {text!r}")
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode()).decode()


class Embedder(Protocol):
    """A model; workers get a copy of it."""

    identity: Identity

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """A stand-in without weights: signed counts of hashed tokens, at length one."""

    dim: int = 64

    @property
    def identity(self) -> Identity:
        return Identity("hashing", "hashed-tokens", self.dim, 0)

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


def embed(text: Column, embedder: Embedder, query: bool = False) -> Column:
    """Vectors of texts; queries get the model's prefix, documents none."""
    prefix = embedder.identity.query if query else ""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.embed([prefix + (t or "") for t in s])))

    return run(text)


def plan_batches(lengths: Sequence[int], max_items: int, max_tokens: int) -> list[tuple[int, int]]:
    """(start, end) of batches in order: a batch ends before it has more than
    ``max_items`` texts or, padded to its longest, more than ``max_tokens`` tokens."""
    out, start, longest = [], 0, 0
    for i, n in enumerate(lengths):
        size, wide = i - start + 1, max(longest, n, 1)
        if i > start and (size > max(max_items, 1) or size * wide > max(max_tokens, 1)):
            out.append((start, i))
            start, wide = i, max(n, 1)
        longest = wide
    return [*out, (start, len(lengths))] if lengths else []


def with_cached(items: DataFrame, cache: DataFrame, embedder: Embedder) -> DataFrame:
    """(target, content_hash, vector): stored vectors where text and model are the
    same, null where the vector is to be made. items: target, source."""
    now = items.where("source IS NOT NULL AND trim(source) <> ''").select("target", content_hash(F.col("source")).alias("content_hash"))
    held = cache.where(F.col("embedder_version") == embedder.identity.encode()).select("target", "content_hash", "vector")
    return now.join(held, ["target", "content_hash"], "left")
