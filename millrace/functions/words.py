"""Words of a text: NFKC, lower case, maximal runs of letters and digits. Python side, for Arrow-batched operators.

Spark SQL has no Unicode normalisation, so everything that must see NFKC words runs here, batch by batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")


def normalise(text: str) -> str:
    """NFKC and lower case. ASCII needs no NFKC."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


def words(text: str | None) -> list[str]:
    """All words in order; none for null."""
    return WORD.findall(normalise(text)) if text else []


class WordHashes(dict):
    """Word to 64-bit hash, remembered up to a bound so that a worker's memory stays flat."""

    LIMIT = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def flat_word_hashes(texts: Iterable[str | None], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of a batch one after another, and the offsets of the texts in them (one more than texts)."""
    flat: list[int] = []
    ends = [0]
    for text in texts:
        if text:
            flat += [known[w] for w in words(text)]
        ends.append(len(flat))
    return np.array(flat, dtype=np.uint64), np.array(ends, dtype=np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(flat: np.ndarray, size: int) -> np.ndarray:
    """Rolling hash of every `size` consecutive words; position i covers words i .. i+size-1. Shorter by size-1 than the input."""
    if len(flat) < size:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(flat) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + flat[k : len(flat) - size + 1 + k])
    return out


def split_grams(grams: np.ndarray, ends: np.ndarray, size: int) -> list[np.ndarray]:
    """The grams of each text, none across a border between texts."""
    return [grams[a : max(a, b - size + 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]
