"""A bounded table from words to their hashes."""

from __future__ import annotations

import numpy as np
import xxhash


class WordHashes(dict):
    """Computes what it lacks, and starts over when it holds too much."""

    def __init__(self, limit: int, shift: int = 0, least: int = 0):
        super().__init__()
        self.limit, self.shift, self.least = limit, shift, least

    def __missing__(self, word: bytes | str) -> int:
        raw = word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass")
        out = self[word] = max(self.least, xxhash.xxh64_intdigest(raw) >> self.shift)
        return out

    def of(self, words: list) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
