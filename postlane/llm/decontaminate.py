"""Benchmark decontamination by SimHash of item-sized windows.

Every window of a document that is as long as a benchmark item has a SimHash
(64 bits) of its five-word shingles, each weighted by its count; the votes roll
along the text as differences of running sums. Where a window would begin
before the document or end after it, it is cut off there. Items whose sizes
differ by an eighth at most share their windows: those of the middle size,
around the same centre.

Item fingerprints are indexed by four blocks of 16 bits: fingerprints within
RADIUS bits of each other are within RADIUS // 4 bits in one block at least, so
looking up all block values that close finds every item within the radius.
What is within the radius is verified on the item-sized window itself: weighted
Jaccard similarity (sum of smaller counts over sum of larger ones) of the two
shingle multisets is 0.8 or more; windows with too few shingles of any item
for that are passed over first. At a similarity of exactly 0.8 fingerprints
differ in 10 or 11 bits on average, with a deviation of 3.

Items of fewer than five words have one shingle, the whole item, and are found
as that run of words; items without words match nothing. Null texts match
nothing. Null ids and repeated rows are reported like others, once for each
row; of equally similar windows the first counts. Items are held in bounded
chunks, one pass for each; texts are worked off some MB at a time, long ones
like others. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlane.llm import store, text, tokens

BLOCKS, RADIUS = 4, 19
#: Characters of items that are sent to every task at once; more are worked off in several passes.
ITEM_CHARS = 1_000_000
#: Words that are fingerprinted at once.
PART = 8192
FOUND = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, similarity double"
_BIT = np.arange(16)[:, None, None]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two shingle multisets."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(names)), np.bincount(at[len(a) :], minlength=len(names))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Votes:
    """Running sums of the votes for each bit, +1 or -1 by each shingle, nothing where `there` is 0."""

    def __init__(self, shingle_hashes: np.ndarray, there: np.ndarray, longest: int) -> None:
        self.kind, self.top = (np.uint16, 15) if longest < 1 << 15 else (np.uint32, 31)
        blocks = np.ascontiguousarray(shingle_hashes.astype("<u8").view("<u2").reshape(-1, BLOCKS).T)
        one = ((blocks[None] >> _BIT.astype(np.uint16)) & np.uint16(1)).astype(self.kind)
        vote = (one + one - self.kind(1)) * there.astype(self.kind)  # -1 wraps, and so do sums: differences are right
        self.sums = np.zeros((16, BLOCKS, len(there) + 1), self.kind)
        np.cumsum(vote, axis=2, dtype=self.kind, out=self.sums[:, :, 1:])

    def simhash(self, size: int, n: int) -> np.ndarray:
        """The fingerprints of the first `n` windows of `size`, as four rows of 16-bit blocks."""
        e = self.sums[:, :, :n] - self.sums[:, :, size : size + n]  # the top bit says that the votes are for the bit
        e >>= (self.top - _BIT).astype(self.kind)
        e &= (1 << _BIT).astype(self.kind)
        return np.bitwise_or.reduce(e, axis=0).astype(np.uint16)


class Index:
    """Items by size, with their fingerprints by block."""

    def __init__(self, items: list[tuple[int, str]], k: int, percent: int, radius: int) -> None:
        memo = text.Words()
        self.k, self.percent, self.radius = k, percent, radius
        hashes = [(i, h) for i, h in ((i, memo.hashes(t)) for i, t in items) if len(h)]
        #: Shingle width -> whole items that short -> item ids.
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, h in hashes:
            if len(h) < k:
                self.short[len(h)][int(text.shingles(h, k)[0])].append(i)
        self.items = sorted(((i, text.shingles(h, k)) for i, h in hashes if len(h) >= k), key=lambda x: (len(x[1]), x[0]))
        self.known = np.unique(np.concatenate([np.empty(0, np.uint64), *(s for _, s in self.items)]))
        #: (window size, fewest known shingles, items, their sizes, fingerprints, block tables) of items of like size, 64 at most.
        self.groups: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]] = []
        sizes = np.array([len(s) for _, s in self.items])
        flips = np.arange(1 << 16, dtype=np.uint16)
        flips = flips[np.bitwise_count(flips) <= radius // BLOCKS]
        at = 0
        while at < len(sizes):
            end = int(np.searchsorted(sizes, sizes[at] * 9 // 8, "right"))
            window = int(sizes[at] + sizes[end - 1] + 1) // 2
            for lo in range(at, end, 64):
                own = np.arange(lo, min(lo + 64, end))
                # A window of an item's own size needs that share of its shingles, and this one holds all of them but for the difference in size.
                least = int((-(-percent * sizes[own] // 100) - np.maximum(sizes[own] - window, 0)).min())
                kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if 8 * t().itemsize >= len(own))
                marks = np.array([Votes(s, np.ones(len(s), np.uint8), len(s)).simhash(len(s), 1)[:, 0] for _, s in (self.items[i] for i in own)], np.uint16)
                tables = [np.zeros(1 << 16, kind) for _ in range(BLOCKS)]
                for j, mark in enumerate(marks):
                    for table, value in zip(tables, mark):
                        table[value ^ flips] |= kind(1 << j)
                self.groups.append((window, least, own, sizes[own], marks, tables))
            at = end
        self.longest = max((g[0] for g in self.groups), default=1)
        #: Empty places after each text: a window with too many of them has too few shingles, and none with enough reaches the next text.
        self.gap = max((g[0] - g[1] + 1 for g in self.groups), default=1)

    def near(self, flat: np.ndarray, there: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, items) of item-sized windows within the radius, for texts laid out with gaps; a place is where the window begins, in its gap or not."""
        part = max(PART, 2 * self.longest)
        count = np.concatenate([[0], np.cumsum(there)])
        hits = np.concatenate([[0], np.cumsum(self._is_known(flat) & there.astype(bool))])
        marks: dict[int, list[np.ndarray]] = {g[0]: [] for g in self.groups}
        for lo in range(0, len(flat), part):
            hi = min(lo + part + self.longest, len(flat))
            votes = Votes(flat[lo:hi], there[lo:hi], self.longest)
            for size, found in marks.items():
                found.append(votes.simhash(size, max(min(part, hi - lo - size + 1), 0)))
        for size, least, own, sizes, prints, tables in self.groups:
            mark = np.concatenate(marks[size], axis=1)
            mask = tables[0][mark[0]] | tables[1][mark[1]] | tables[2][mark[2]] | tables[3][mark[3]]
            some = np.flatnonzero((mask != 0) & (hits[size : size + mark.shape[1]] - hits[: mark.shape[1]] >= least))
            mask, whole = mask[some], np.ascontiguousarray(mark[:, some].T).view("<u8")[:, 0]
            for j, item in enumerate(own.tolist()):
                place = np.flatnonzero(mask & mask.dtype.type(1 << j))
                place = some[place[np.bitwise_count(whole[place] ^ prints[j].view("<u8")[0]) <= self.radius]]
                n = int(sizes[j])
                start = np.maximum(place + (size - n) // 2, 0)
                stop = np.minimum(start + n, len(flat))
                both, real = hits[stop] - hits[start], count[stop] - count[start]
                start = start[100 * both >= self.percent * (real + n - both)]
                if len(start):
                    yield start, np.full(len(start), item)

    def _is_known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), bool)
        return self.known[np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)] == hashes

    def match(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, item id, first word, words, similarity) of each item's best window in each text of word hashes."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        seqs = [text.shingles(h, self.k) if len(h) >= self.k else np.empty(0, np.uint64) for h in texts]
        if self.items and sum(map(len, seqs)):
            empty = np.zeros(self.gap, np.uint64)
            flat = np.concatenate([empty, *(x for s in seqs for x in (s, empty))])
            sizes = np.array([len(s) for s in seqs])
            begin = self.gap + np.cumsum(sizes + self.gap) - (sizes + self.gap)
            there = np.zeros(len(flat), np.uint8)
            owner = np.zeros(len(flat), np.int64)
            for t, (a, n) in enumerate(zip(begin.tolist(), sizes.tolist())):
                there[a : a + n] = 1
                owner[max(a - self.gap, 0) : a + n] = t
            for starts, found in self.near(flat, there):
                for start, i in zip(starts.tolist(), found.tolist()):
                    name, own = self.items[i]
                    # The window's text is that of its first shingle.
                    t = int(owner[start])
                    if start >= begin[t] + sizes[t]:
                        t += 1
                    if t == len(seqs):
                        continue
                    lo, hi = max(start - int(begin[t]), 0), min(start - int(begin[t]) + len(own), len(seqs[t]))
                    if hi <= lo:
                        continue
                    sim = similarity(seqs[t][lo:hi], own)
                    if 100 * sim >= self.percent and (-sim, lo) < (-best.get((t, name), (0.0, 0, 0))[0], best.get((t, name), (0.0, 0, 0))[1]):
                        best[t, name] = (sim, lo, hi - lo + self.k - 1)
        for width, wanted in self.short.items():
            keys = np.array(sorted(wanted), np.uint64)
            for t, h in enumerate(texts):
                if len(h) >= width:
                    s = text.shingles(h, width)
                    for at in np.flatnonzero(np.isin(s, keys)).tolist():
                        for name in wanted[int(s[at])]:
                            if (-1.0, at) < (-best.get((t, name), (0.0, 0, 0))[0], best.get((t, name), (0.0, 0, 0))[1]):
                                best[t, name] = (1.0, at, width)
        for (t, name), (sim, start, size) in sorted(best.items()):
            yield t, name, start, size, sim


@lru_cache(2)
def _index(items: tuple, k: int, percent: int, radius: int) -> Index:
    return Index(list(items), k, percent, radius)


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): the best window of each document for each item that it holds."""
    docs = store.lean(docs)
    spark = docs.sparkSession
    known = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text is not null")
    chars = known.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = -(-chars // ITEM_CHARS) or 1
    found = []
    for p in range(passes):
        own = known if passes == 1 else known.filter(F.pmod(F.xxhash64("text"), F.lit(passes)) == p)
        items = spark.sparkContext.broadcast(tuple(sorted((r.item_id, r.text) for r in own.collect() if r.item_id is not None)))

        def task(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            tokens.forget()
            index, memo = _index(items.value, k, percent, radius), text.Words()
            for batch in batches:
                names, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                out = []
                for lo, hi in text.chunks(texts):
                    out += [(names[lo + t], *found) for t, *found in index.match([memo.hashes(x) for x in texts[lo:hi]])]
                cols = list(zip(*out)) or [()] * 5
                types = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "start_word", "n_words", "similarity"])

        found.append(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(task, FOUND))
    return reduce(DataFrame.unionByName, found)
