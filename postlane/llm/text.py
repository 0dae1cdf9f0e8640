"""Words and shingles as 64-bit hashes.

Words: A-Z lower-cased, split at blanks and the five controls U+0009 to U+000D.
Hashes are of whole words and shingles; two different ones of a corpus agree
with a chance of 2^-64 each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits


class Words(dict):
    """Word -> hash, each distinct word hashed once while it is remembered."""

    def __init__(self, memory: int = 150_000) -> None:
        self.memory = memory

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.memory:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def hashes(self, text: str | None) -> np.ndarray:
        w = words(text)
        return np.fromiter(map(self.__getitem__, w), np.uint64, len(w))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; with fewer words, of the whole sequence; nothing for no words."""
    if len(h) < k:
        k = max(len(h), 1)
    x = mix(h[: len(h) - k + 1] + GOLD)
    for i in range(1, k):
        x = mix(x * GOLD + h[i : len(h) - k + 1 + i])
    return x


def hashed(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, end to end, each distinct word hashed once; and how many words each text has."""
    rows = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
    words = rows.flatten().dictionary_encode()
    kinds = words.dictionary.cast(pa.large_binary())
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, kinds.to_numpy(zero_copy_only=False)), np.uint64, len(kinds))
    at = words.indices.to_numpy()
    real = (pa.compute.binary_length(kinds).to_numpy() > 0)[at]  # white space at an end makes an empty word
    return h[at[real]], np.diff(np.concatenate([[0], np.cumsum(real)])[rows.offsets.to_numpy()])


def sequences(texts: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The `shingles` of each text, end to end, and where each text's begin, and the end of the last."""
    h, counts = hashed(texts)
    start = np.cumsum(counts) - counts
    sizes = np.where(counts < k, np.minimum(counts, 1), counts - k + 1)
    first = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(first[-1]) + np.repeat(start - first[:-1], sizes)
    out = shingles(h, k)[np.minimum(place, max(len(h) - k, 0))] if len(h) else h
    for i in np.flatnonzero((counts > 0) & (counts < k)).tolist():
        out[first[i]] = shingles(h[start[i] : start[i] + counts[i]], k)[0]
    return out, first


def chunks(texts: list, size: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of about `size` characters, so that long texts don't add up."""
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total > size:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
