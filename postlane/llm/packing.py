"""Bounded-space online best-fit packing of token sequences.

Pieces arrive one by one; each goes to the open bin with the least free space
that still takes it. Open bins are a fixed number; their free spaces are the
bits of one integer, so the best bin is the lowest bit at or above the piece's
length. When a new bin is needed and none may be opened, the fullest closes
for good. A bin that is full closes too.

Null texts are empty, and an empty document is its end id alone. A text of any
length is encoded whole and cut into pieces of the capacity. Repeated rows and
null document ids are packed like any others; pieces that are alike in all
columns may change places. An empty table gives no rows. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlane.llm import store, tokens

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


class Packer:
    """State: at most `open_bins` open bins; `take` returns (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.limit = capacity, open_bins
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.open, self.made, self.closed = 0, 0, 0, 0

    def _pop(self, space: int) -> int:
        at = self.free[space]
        name = at.pop()
        if not at:
            self.bits ^= 1 << space
        self.open -= 1
        return name

    def take(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            name = self._pop(space)
        else:
            if self.open == self.limit:
                self._pop((self.bits & -self.bits).bit_length() - 1)  # least free space: the fullest
                self.closed += 1
            space, name, self.made = self.capacity, self.made, self.made + 1
        if left := space - length:
            self.free[left].append(name)
            self.bits |= 1 << left
            self.open += 1
        return name, self.capacity - space


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, remembered: int = tokens.REMEMBERED) -> DataFrame:
    """Each document's ids and `end_id`, cut to at most `capacity`; the first piece takes the remainder."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.trim()
        encoder, end = tokens.shared(tokenizer, True, remembered), np.array([end_id], "<u4")
        for batch in batches:
            out: list[tuple] = []
            for name, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                ids = np.concatenate([ids, end])
                at = 0
                for k in range(-(-len(ids) // capacity)):
                    stop = at + (((len(ids) - 1) % capacity + 1) if k == 0 else capacity)
                    out.append((name, k, at, stop - at, zlib.crc32(ids[at:stop])))
                    at = stop
            cols = list(zip(*out)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(task, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, open_bins: int = 256, bins_per_run: int = 2000, remembered: int = tokens.REMEMBERED) -> DataFrame:
    """Pieces of (doc_id, text) with their sequence and place in it.

    Texts are read once and never shuffled; the pieces' lengths are. They are
    dealt by hash into runs of about `bins_per_run` full sequences, a number
    that depends on the tokens alone, and each run is packed as a stream with
    `open_bins` bins of state. Pieces arrive in the order of a hash of theirs, so
    that no partitioning of the input changes the result.
    """
    docs = store.lean(docs)
    spark = docs.sparkSession
    cut = store.saved(pieces(docs, tokenizer, end_id, capacity, remembered))
    total = cut.agg(F.sum("length")).first()[0] or 0
    runs = max(1, total // (capacity * bins_per_run))
    order = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32")
    dealt = cut.withColumn("o", order).withColumn("run", F.pmod(F.xxhash64("o", F.lit(1)), F.lit(runs)).cast("int"))
    dealt = dealt.repartition(min(runs, 4 * store.partitions(spark)), "run").sortWithinPartitions("run", "o", "doc_id", "piece")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, packer = None, None
        for batch in batches:
            names, places = [], []
            for r, length in zip(batch.column("run").to_pylist(), batch.column("length").to_pylist()):
                if r != run:
                    run, packer = r, Packer(capacity, open_bins)
                name, place = packer.take(length)
                names.append((run << 40) + name)
                places.append(place)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(names, pa.int64()), pa.array(places, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return dealt.mapInArrow(task, PACKED)
