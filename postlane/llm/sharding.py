"""Histogram sort: shards of near equal weight in key order, with one exchange.

Rows have a key: the text's hash, then the document id, as hexadecimal digits.
Candidate boundaries are key prefixes. A pass counts the exact bytes and rows
below each of them on all partitions; only cells that still hold a splitter
(or too many rows for one task) are probed again, by as many digits as they
need. When every splitter stands at a boundary, rows are dealt once. A splitter
that falls among rows of equal text moves behind them where these weigh at most
a hundredth of a shard, so that small groups of copies stay together.

The driver holds counts of cells: some hundred for each shuffle partition and
each splitter, whatever the rows are.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlane.llm import store

#: Digits of the first boundaries at least, and of a text's hash.
DIGITS, TEXT = 3, 32
#: A group of equal texts stays together up to this share of a shard.
SNAP = 100
#: The table of cells is sent to all tasks up to this many rows (some 5 MB), beyond it is joined by a shuffle.
BROADCAST_CELLS = 100_000


def order_hex(number: Column) -> Column:
    """16 hexadecimal digits that sort as the signed number; null sorts first."""
    flipped = F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))), 16, "0")
    return F.coalesce(F.lower(flipped), F.lit(""))


def key_of(text: Column, doc_id: Column) -> Column:
    return F.concat(F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")), order_hex(doc_id))


def _common(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _digits(parts: float) -> int:
    """Hexadecimal digits that make so many parts at least."""
    return max(1, math.ceil(math.log(max(parts, 1), 16)))


def _cells(slim: DataFrame, shards: int, max_rows: int, first: int) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, list[str]]]]:
    """Cells (prefix, bytes, rows) in key order, none with a splitter inside unless its keys are equal or it is a small group of one
    text; and the refinements (from length, to length, prefixes) that lead to them."""
    count = lambda df, cell: df.groupBy(cell.alias("cell")).agg(F.sum("size"), F.count("*"), F.min("key"), F.max("key")).collect()
    cells = {r[0]: r[1:] for r in count(slim, F.substring("key", 1, first))}
    total, steps = sum(c[0] for c in cells.values()), []
    while True:
        active, below = {}, 0
        for p in sorted(cells):
            size, rows, lo, hi = cells[p]
            split = below * shards // max(total, 1) != (below + size - 1) * shards // max(total, 1)
            small = len(p) >= TEXT and size * shards * SNAP <= total
            if ((split and not small) or rows > max_rows) and lo != hi:
                same = _common(lo, hi)
                to = same + max(2 if split else 1, _digits(rows / max_rows))
                active[p] = min(to, TEXT) if len(p) < TEXT else to
            below += size
        if not active:
            return [(p, *cells[p][:2]) for p in sorted(cells)], steps
        now: dict[tuple[int, int], list[str]] = {}
        for p, to in active.items():
            now.setdefault((len(p), to), []).append(p)
        steps += [(a, b, ps) for (a, b), ps in sorted(now.items())]
        cell = reduce(lambda e, s: F.when(F.substring("key", 1, s[0]).isin(s[2]), F.substring("key", 1, s[1])).otherwise(e), [(a, b, ps) for (a, b), ps in now.items()], F.lit(None))
        finer = count(slim.withColumn("c", cell).filter("c is not null"), F.col("c"))
        for p in active:
            del cells[p]
        cells |= {r[0]: r[1:] for r in finer}


def shard_rows(rows: DataFrame, shards: int) -> DataFrame:
    """`rows` (key string, size bigint, and any others) with `shard` and `slot`, in place of columns of these names.

    A row's shard is floor(shards * bytes of all rows before it / all bytes), in key order: shards differ by a row's
    size and a hundredth at most. Small groups of equal texts stay together, in the shard of their first row. `slot`
    counts a shard's rows in key order from 0. Rows with equal keys stay together, at neighbouring slots. Keys are at
    least as long as a text's hash. Sizes must be positive. An empty table gives no rows.
    """
    spark = rows.sparkSession
    slim = store.saved(rows.select("key", "size"))
    parts = 4 * store.partitions(spark)
    max_rows, first = max(1000, slim.count() // parts), max(DIGITS, _digits(parts))
    cells, steps = _cells(slim, shards, max_rows, first)
    total, below, bases, table = sum(c[1] for c in cells), 0, [0] * shards, []
    group, at = "", 0
    for p, size, count in cells:
        if p[:TEXT] != group or len(p) < TEXT:
            group, at = p[:TEXT], min(below * shards // max(total, 1), shards - 1)
        shard = at if len(p) == TEXT else min(below * shards // max(total, 1), shards - 1)
        table.append((p, shard, bases[shard]))
        bases[shard] += count
        below += size
    own = lambda base: next(n for n in (f"{base}{i}" for i in range(len(rows.columns) + 1)) if n not in rows.columns)
    cell_name, base_name = own("_cell"), own("_base")
    placed = spark.createDataFrame(table, f"{cell_name} string, shard int, {base_name} bigint")
    placed = F.broadcast(placed) if len(table) <= BROADCAST_CELLS else placed.hint("merge")
    # Later refinements start from longer prefixes, so they are tested first.
    cell = reduce(lambda e, s: F.when(F.substring("key", 1, s[0]).isin(s[2]), F.substring("key", 1, s[1])).otherwise(e), steps, F.substring("key", 1, first))
    dealt = rows.drop("shard", "slot").withColumn(cell_name, cell).join(placed, cell_name)
    place = F.row_number().over(Window.partitionBy(cell_name).orderBy("key"))
    return dealt.withColumn("slot", F.col(base_name) + place - 1).drop(cell_name, base_name)


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """Documents (doc_id, text, others) with size (UTF-8 bytes, 8 more), shard and slot, which take the place of columns of these names.
    Other columns stay. Null text has 8 bytes and sorts as an empty one; null ids come first among equal texts. Texts of any
    length are hashed whole. Rows alike in id and text may change slots."""
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), size.alias("size"), key_of(F.col("text"), F.col("doc_id").cast("bigint")).alias("key"))
    return shard_rows(keyed, shards).select("row.*", "size", "shard", "slot")
