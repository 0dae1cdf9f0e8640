"""Exact top-k by inner product with MaxScore.

A vector's components, as whole numbers floor(256 x), are its terms. Vectors
lie in shards of at most 4096, each with the largest and smallest value of
every component. For a query and a shard, a term's gain is at most the
difference of the extreme products; terms are sorted by that bound, and those
with small bounds, whose sum cannot lift a row over the k-th best score known,
are non-essential. Essential terms are traversed for all rows; the others are
probed, largest bound first, only for rows that are still competitive.

The k-th best score known starts from the shard with the longest vectors, which
every query meets first, and rises from shard to shard; a shard whose bound is
below it is passed over. Queries and shards meet in groups of a few blocks
each, the query set against all rows; results merge by score, then by smaller
id.

Vectors that are null or hold null or non-finite components (after scaling,
too) take no part, nor do rows without an id. Missing components of shorter
vectors count as 0. Repeated rows are candidates as often as they occur. An id
with several vectors that take part is asked once, with the least of them.
Scores are exact: in doubles where no sum can reach 2^53, else in whole numbers
of any length; those beyond a long are given as the nearest long, and rank as
that. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlane.llm import store

SHARD, QUERIES, GROUP = 4096, 256, 8
EXACT, LONGEST = float(1 << 53), (1 << 63) - 1
_BLOCK = "block bigint, ids binary, dims int, matrix binary, norm double"
_FOUND = "query_id bigint, vec_id bigint, score bigint"


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows (vec_id, embedding) packed into matrices of at most `size` rows of one length, with the largest norm in each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def packed(dims: int) -> pa.RecordBatch:
            nonlocal name
            rows = sorted(held.pop(dims), key=lambda r: r[0])
            name += 1
            ids, matrix = np.array([r[0] for r in rows], "<i8"), np.array([r[1] for r in rows], "<f8").reshape(len(rows), dims)
            norm = float(np.abs(matrix).max(1).max()) * dims**0.5 if dims else 0.0
            return pa.RecordBatch.from_pydict({"block": pa.array([name], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "dims": pa.array([dims], pa.int32()), "matrix": pa.array([matrix.tobytes()], pa.binary()), "norm": pa.array([norm])})

        for batch in batches:
            for vec_id, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                v = np.floor(256 * x.values.to_numpy(zero_copy_only=False).astype(np.float64))
                held.setdefault(len(v), []).append((vec_id, v))
                if len(held[len(v)]) == size:
                    yield packed(len(v))
        for dims in list(held):
            yield packed(dims)

    return vectors.mapInArrow(task, _BLOCK)


def _exact(query: np.ndarray, rows: np.ndarray) -> list[int]:
    """Scores in whole numbers of any length."""
    q = [int(x) for x in query]
    return [sum(a * int(b) for a, b in zip(q, row) if b) for row in rows]


def max_score(query: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray, k: int, least: float = -np.inf, work: list | None = None) -> tuple[np.ndarray, list[int]]:
    """Places and scores of the k best of `rows`, ties to the smaller place, without any below `least`; `own` marks rows that take no
    part. `work[0]` grows by the products made."""
    with np.errstate(over="ignore"):
        a, b = query * low, query * high
    if np.maximum(np.abs(a), np.abs(b)).sum() >= EXACT:
        scores = _exact(query, rows)
        best = sorted((i for i in range(len(rows)) if not own[i]), key=lambda i: (-scores[i], i))[:k]
        return np.array(best, np.int64), [scores[i] for i in best]
    floor, gain = np.minimum(a, b), np.abs(a - b)
    order = np.argsort(-gain, kind="stable")
    left = np.concatenate([np.cumsum(gain[order][::-1])[::-1], [0]])  # left[i]: what terms order[i:] can still add
    base = floor.sum()
    if base + left[0] < least:
        return np.empty(0, np.int64), []
    # Essential: without any of these, what is left cannot lift a row to the k-th best.
    essential = int(np.searchsorted(-left, -(least - base), side="left")) if np.isfinite(least) else len(order)
    essential = min(max(essential, min(8, len(order))), len(order))
    head = order[:essential]
    alive = np.flatnonzero(~own)
    score = (rows[:, head] @ query[head])[alive]
    made, at = len(rows) * essential, essential
    while True:
        rest = floor[order[at:]].sum() + left[at]
        # What a row has plus the largest value of every term to come: the rows under the k-th best known are out.
        keep = score + rest >= least
        alive, score = alive[keep], score[keep]
        if at == len(order) or not len(alive):
            break
        sure = score + floor[order[at:]].sum()
        if len(sure) >= k:
            least = max(least, np.partition(sure, len(sure) - k)[len(sure) - k])
        step = order[at : at + max(4, len(order) // 8)]
        score = score + rows[np.ix_(alive, step)] @ query[step]
        made += len(alive) * len(step)
        at += len(step)
    if work is not None:
        work[0] += made
    best = np.lexsort((alive, -score))[:k]
    return alive[best], [int(s) for s in score[best]]


class Block:
    """A block's rows as arrays."""

    def __init__(self, ids: bytes, dims: int, matrix: bytes) -> None:
        self.ids = np.frombuffer(ids, "<i8")
        self.rows = np.frombuffer(matrix, "<f8").reshape(len(self.ids), dims)
        self.low, self.high = self.rows.min(0), self.rows.max(0)


def meet(queries: Block, shards: list[Block], least: np.ndarray, k: int, work: list | None = None) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score): each query's k best in the shards, none surely below `least`, which rises from shard to shard."""
    found: list[tuple[int, int, int]] = []
    for q, query, known in zip(queries.ids.tolist(), queries.rows, least.tolist()):
        best: list[tuple[int, int]] = []
        for s in shards:
            dims = min(len(query), s.rows.shape[1])
            places, scores = max_score(query[:dims], s.rows[:, :dims], s.low[:dims], s.high[:dims], s.ids == q, k, known, work)
            best = sorted([*best, *((-x, v) for x, v in zip(scores, s.ids[places].tolist()))])[:k]
            if len(best) == k:
                known = max(known, float(-best[-1][0]) if abs(best[-1][0]) < EXACT else -np.inf)
        found += [(q, v, max(min(-x, LONGEST), -LONGEST - 1)) for x, v in best]
    return found


@lru_cache(1)
def _seed(raw: tuple) -> Block:
    return Block(*raw)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row of (vec_id, embedding) that `is_query` holds for, against all other ids."""
    spark, p = vectors.sparkSession, store.partitions(vectors.sparkSession)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x * 256) == float("inf"))
    named = store.lean(vectors).withColumn("_asked", is_query).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "_asked")
    valid = named.filter("vec_id is not null and embedding is not null").filter(~F.exists("embedding", odd))
    shards = store.saved(blocks(valid.select("vec_id", "embedding"), SHARD))
    asked = blocks(valid.filter("_asked").groupBy("vec_id").agg(F.min("embedding").alias("embedding")), QUERIES)
    first = shards.orderBy(F.desc("norm"), "block").limit(1).collect()  # one block, SHARD rows at most
    if not first:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    seed, seed_name = spark.sparkContext.broadcast((bytes(first[0].ids), first[0].dims, bytes(first[0].matrix))), first[0].block

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, found = [], []
            for r in batch.to_pylist():
                block = Block(r["ids"], r["dims"], r["matrix"])
                rows = meet(block, [_seed(seed.value)], np.full(len(block.ids), -np.inf), k)
                by: dict[int, list[int]] = {}
                for q, _, s in rows:
                    by.setdefault(q, []).append(s)
                known = [min(by[q]) if len(by.get(q, ())) == k and abs(min(by[q])) < EXACT else -np.inf for q in block.ids.tolist()]
                least.append(np.array(known, "<f8").tobytes())
                found.append(rows)
            pair = pa.list_(pa.struct([(c.split()[0], pa.int64()) for c in _FOUND.split(", ")]))
            names = [c.split()[0] for c in _FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "ids", "dims", "matrix")), pa.array(least, pa.binary()), pa.array([[dict(zip(names, x)) for x in rows] for rows in found], pair)], names=["block", "ids", "dims", "matrix", "least", "found"])

    queries = store.saved(asked.mapInArrow(start, f"block bigint, ids binary, dims int, matrix binary, least binary, found array<struct<{_FOUND.replace(' ', ': ').replace(',:', ',')}>>"))
    # A group holds a few blocks of either side: its size does not grow with the tables, the number of groups does.
    side = lambda n: max(1, -(-n // max(1, min(GROUP, n // max(1, int((4 * p) ** 0.5))))))
    n_shards, n_queries = side(shards.count()), side(queries.count())
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    left = shards.filter(F.col("block") != seed_name).select(dealt(n_shards).alias("s"), all_of(n_queries).alias("q"), "block", "ids", "dims", "matrix", "norm")
    right = queries.select(dealt(n_queries).alias("q"), all_of(n_shards).alias("s"), "ids", "dims", "matrix", "least")

    def group(shard_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        rows = sorted(shard_rows.to_pylist(), key=lambda r: (-r["norm"], r["block"]))
        there = [Block(r["ids"], r["dims"], r["matrix"]) for r in rows]
        out: list[tuple[int, int, int]] = []
        for r in query_rows.to_pylist() if there else []:
            out += meet(Block(r["ids"], r["dims"], r["matrix"]), there, np.frombuffer(r["least"], "<f8"), k)
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table({c.split()[0]: pa.array(x, pa.int64()) for c, x in zip(_FOUND.split(", "), cols)})

    rest = left.groupBy("s", "q").cogroup(right.groupBy("s", "q")).applyInArrow(group, _FOUND)
    found = queries.select(F.inline("found")).unionByName(rest)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
