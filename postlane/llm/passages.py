"""Near-duplicate passages by compact windows.

A text is its sequence of five-word shingles. For each of six hash functions,
the Cartesian tree of a text's hashes gives its compact windows: a shingle is
the minimum of every subsequence that holds it and stays within its window, so
one (centre, window) stands for all of them. Only windows as long as the
shortest passage matter; their centres are the minima of sliding windows, and
the tree is built of these alone.

Windows with the same minimum under the same hash meet. Those that are equal
for the shortest passage's length to both sides form a class, with its first
window as representative. A class meets its own representative and each one of
an earlier document, unless one that it meets has all that this one shares
with it there. Copies make as many pairs as windows, never their square.
An interval join gives the stretches of two texts that at least two hash
functions cover with overlapping windows on nearby diagonals. These are
verified on the shingles themselves: a passage is a stretch between shared
shingles, of `min_words` words or more, whose shingle set has a Jaccard
similarity of 0.8 or more with that of the hub's stretch. Runs of shared
shingles on nearby diagonals are joined, whatever the gap, while this holds.

A passage is reported for every document but the first that holds it, by
smallest id; repeats within one document are not. How rows are dealt changes nothing. A
passage can be reported more than once, with different sources. Null and short
texts have no passages; texts of any length are read whole; rows with null ids
take no part, and rows with equal ids count as one document. Empty tables give
no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlane.llm import store, text, tokens

HASHES, ENOUGH, SHINGLE = 6, 2, 5
#: Values with so many classes of windows at most make all pairs of these.
FEW = 4
#: Diagonals this close belong to one alignment; stretches to be verified are longer by this at both ends.
DRIFT, GAP = 32, 6
BROADCAST_IDS = 500_000
FACTORS = text.mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64) * text.GOLD) | np.uint64(1)
PAIRS = "bucket bigint, pairs binary"
FOUND = "doc_id bigint, start_word bigint, end_word bigint, source_doc_id bigint, source_start bigint, source_end bigint, similarity double"


def _sliding(best, x: np.ndarray, t: int) -> np.ndarray:
    """`best` (minimum or maximum) over each run of t."""
    w = 1
    while 2 * w <= t:
        x, w = best(x[:-w], x[w:]), 2 * w
    return best(x[: len(x) - (t - w)], x[t - w :]) if w < t else x


def _nearest(value: np.ndarray, beyond, few: int = 64) -> np.ndarray:
    """For each value, the place of the nearest before it that is not `beyond` it. Zeros, of which one is the first value, look for nothing
    and end every search. All go on at once from the place that the one they stopped at has found; the last `few` one by one."""
    out = np.maximum(np.arange(-1, len(value) - 1), 0)
    far = np.flatnonzero((value[1:] > 0) & beyond(value[:-1], value[1:])) + 1
    at, own = far - 1, value[far]
    while len(far) > few:
        at = out[at]
        out[far] = at
        more = beyond(value[at], own)
        far, at, own = far[more], at[more], own[more]
    for i, j, x in zip(far.tolist(), at.tolist(), own):
        while beyond(value[j], x):
            j = int(out[j])
        out[i] = j
    return out


def compact_windows(h: np.ndarray, first: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, left, right), inclusive, of the windows of t or more in sequences laid end to end; `first`: where each begins,
    and the end of the last. Of equal minima the leftmost counts."""
    n = len(h)
    stop = np.repeat(first[1:], np.diff(first))
    low = _sliding(np.minimum, h, t)
    low[stop[: len(low)] - np.arange(len(low)) < t] = 0  # runs over a border
    pad = np.zeros(t - 1, np.uint64)
    centres = np.flatnonzero(_sliding(np.maximum, np.concatenate([pad, low, pad]), t)[:n] == h)
    begin = np.repeat(first[:-1], np.diff(first))[centres]
    place = np.arange(1, len(centres) + 1) + np.cumsum(np.diff(begin, prepend=begin[:1]) > 0)
    value = np.zeros(len(centres) + 2 + int((begin[1:] > begin[:-1]).sum()), np.uint64)  # zeros part the sequences
    value[place] = np.maximum(h[centres], 1)
    left, right = np.full(len(value), -1), np.full(len(value), n)
    left[place] = right[place] = centres
    left = left[_nearest(value, np.greater)]
    right = right[len(value) - 1 - _nearest(value[::-1], np.greater_equal)[::-1]]
    return centres, np.maximum(left[place] + 1, begin), np.minimum(right[place], stop[centres]) - 1


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length, each value's bytes apart, so that small numbers compress."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)


def _unpacked(blob: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(blob) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


#: value, context, document, centre, places before and after it.
_WINDOW = ("<u8", "<u8", "<i8", "<u4", "<u4", "<u4")
#: document, that of the one it meets, centres in both, places before and after that both have, hash function.
_PAIR = ("<i8", "<i8", "<u4", "<u4", "<u4", "<u4", "u1")
_MEMBER = np.dtype([("doc", "<i8"), ("at", "<u4"), ("before", "<u4"), ("after", "<u4")])


def _bucketed(columns: list[np.ndarray], keys: np.ndarray, buckets: int, within: np.ndarray | int = 0) -> tuple[pa.Array, pa.Array]:
    """Buckets by key, and the rows of each, packed, in order of `within`, which is less than 2^32."""
    bucket = (text.mix(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort((bucket << 32) + within, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
    columns = [c[order] for c in columns]
    keep = [b for b in range(buckets) if edges[b + 1] > edges[b]]
    return pa.array(keep, pa.int64()), pa.array([_packed(*(c[edges[b] : edges[b + 1]] for c in columns)) for b in keep], pa.binary())


def _by_bucket(batches: Iterator[pa.RecordBatch], kinds: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """The columns of each bucket, of rows (bucket, packed) in order of bucket."""
    bucket, held = None, []
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if b != bucket and held:
                yield [np.concatenate(c) for c in zip(*(_unpacked(h, kinds) for h in held))]
                held = []
            bucket = b
            held.append(blob.as_py())
    if held:
        yield [np.concatenate(c) for c in zip(*(_unpacked(h, kinds) for h in held))]


def _parcels(stream: Iterator, buckets: int, size: int = 500_000) -> Iterator:
    """Pairs, `size` or more at a time, in buckets by x; what else is in `stream` goes through."""
    held: list[list[np.ndarray]] = []
    n = 0
    for pairs in itertools.chain(stream, [None]):
        if isinstance(pairs, pa.RecordBatch):
            yield pairs
            continue
        if pairs is not None:
            held.append(pairs)
            n += len(pairs[0])
        if n and (pairs is None or n >= size):
            columns = [np.concatenate(c) for c in zip(*held)]
            yield _bucketed(columns, columns[0].astype(np.uint64), buckets)
            held, n = [], 0


def _contexts(seq: np.ndarray, centre: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A hash of the stretch around each centre, and of the centre's place in it."""
    power, back = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(seq), f, np.uint64))]) for f in (text.GOLD, np.uint64(pow(int(text.GOLD), -1, 1 << 64))))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text.mix(seq.astype(np.uint64)) * power[:-1])])
    lo, hi = centre - before, centre + after + 1
    return text.mix((sums[hi] - sums[lo]) * back[lo] + text.mix((before.astype(np.uint64) << np.uint64(32)) + after.astype(np.uint64)))


def _windows(docs: DataFrame, t: int, buckets: int) -> DataFrame:
    """(bucket, windows): all windows of each batch of texts, packed, in buckets by value."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for lo, hi in text.chunks(texts, 2_000_000):
                flat, first = text.sequences(texts[lo:hi], SHINGLE)
                sizes = np.diff(first)
                long = (sizes >= t) & np.array([d is not None for d in names[lo:hi]])
                if not long.any():
                    continue
                flat, sizes = flat[np.repeat(long, sizes)], sizes[long]
                first = np.concatenate([[0], np.cumsum(sizes)])
                ids, owner = np.array([d for d, ok in zip(names[lo:hi], long) if ok], "<i8"), np.repeat(np.arange(len(sizes)), sizes)
                parts = []
                for j in range(HASHES):
                    h = flat * FACTORS[j]
                    c, left, right = compact_windows(h, first, t)
                    parts.append(((h[c] & ~np.uint64(7)) | np.uint64(j), c, c - left, right - c))
                value, c, before, after = (np.concatenate(p) for p in zip(*parts))
                context = _contexts(flat >> np.uint64(32), c, np.minimum(before, t - 1), np.minimum(after, t - 1))
                columns = [value, context, ids[owner[c]], (c - first[owner[c]]).astype("<u4"), before.astype("<u4"), after.astype("<u4")]
                yield pa.RecordBatch.from_arrays([*_bucketed(columns, value, buckets, c)], names=["bucket", "windows"])
        tokens.trim()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(task, "bucket bigint, windows binary")


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a sort: numpy's own `unique` hashes, at several times the cost for such lengths."""
    s = np.sort(x)
    return s[_starts(s)]


def _classes(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of windows, those whose value another document holds too, by value, class (equal contexts), document and place; each one's
    class; and for each class, by value and its first window (its representative): that window, its rank, how many its value has."""
    order = np.argsort(columns[0], kind="stable")
    for check in (0, 2):  # values that occur once, then those of one document
        v = columns[0][order]
        begin = _starts(v)
        if not len(begin):
            break
        sizes = np.diff(np.append(begin, len(v)))
        d = columns[2][order]
        many = sizes > 1 if check == 0 else np.minimum.reduceat(d, begin) < np.maximum.reduceat(d, begin)
        order = order[np.repeat(many, sizes)]
    value, context, doc, at = (c[order] for c in columns[:4])
    order = order[np.lexsort((at, doc, context, value))]
    columns = [c[order] for c in columns]
    value, context, doc, at = columns[:4]
    heads = _starts(value, context)
    sizes = np.diff(np.append(heads, len(value)))
    by_first = np.lexsort((at[heads], doc[heads], value[heads]))
    place = np.empty(len(heads), np.int64)
    place[by_first] = np.arange(len(heads))
    heads = heads[by_first]
    begin = _starts(value[heads])
    counts = np.diff(np.append(begin, len(heads)))
    return columns, np.repeat(place, sizes), heads, np.arange(len(heads)) - np.repeat(begin, counts), np.repeat(counts, counts)


def _paired(x: list[np.ndarray], y: list[np.ndarray], hashes: np.ndarray) -> list[np.ndarray]:
    """Pairs in the columns of _PAIR; x, y: document, centre, before, after."""
    columns = [x[0], y[0], x[1], y[1], np.minimum(x[2], y[2]), np.minimum(x[3], y[3]), hashes]
    return [c.astype(kind) for c, kind in zip(columns, _PAIR)]


def _met(windows: DataFrame, buckets: int) -> DataFrame:
    """PAIRS of values with FEW classes at most, all of them; and the classes of the other values, their other members packed:
    rows with a value, a rank, and the representative as x, at, before and after."""
    schema = pa.schema([("bucket", pa.int64()), ("pairs", pa.binary()), ("value", pa.int64()), ("rank", pa.int32()), ("x", pa.int64()), *((n, pa.int32()) for n in ("at", "before", "after")), ("members", pa.binary())])

    def filled(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def met(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch | list[np.ndarray]]:
        columns, own, heads, rank, counts = _classes(columns)
        value, _, *window = columns
        few = counts[own] <= FEW
        for back in range(FEW):  # the class itself, then each one before it
            w = np.flatnonzero(few & (rank[own] >= back))
            y = heads[own[w] - back]
            w, y = (i[window[0][y] < window[0][w]] for i in (w, y))
            yield _paired([c[w] for c in window], [c[y] for c in window], value[w] & np.uint64(7))
        many = np.flatnonzero(counts > FEW)
        by_class = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[by_class], np.arange(len(heads) + 1))
        for lo in range(0, len(many), 10_000):
            some = many[lo : lo + 10_000]
            first = heads[some]
            sizes = edges[some + 1] - edges[some] - 1  # but the first window, the representative
            ends = np.cumsum(sizes)
            held = by_class[np.arange(int(ends[-1])) + np.repeat(edges[some] + 1 - ends + sizes, sizes)]
            records = np.empty(len(held), _MEMBER)
            for n, c in zip(_MEMBER.names, window):
                records[n] = c[held]
            offsets = np.concatenate([[0], ends]) * _MEMBER.itemsize
            members = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(records.tobytes())])
            yield filled(
                len(some), x=pa.array(window[0][first], pa.int64()), **{n: pa.array(c[first].astype(np.int32)) for n, c in zip(("at", "before", "after"), window[1:])},
                value=pa.array(value[first].view(np.int64)), rank=pa.array(rank[some].astype(np.int32)), members=members.cast(pa.binary()),
            )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _parcels(itertools.chain.from_iterable(map(met, _by_bucket(batches, _WINDOW))), buckets):
            yield out if isinstance(out, pa.RecordBatch) else filled(len(out[0]), bucket=out[0], pairs=out[1])

    kinds = "value bigint, rank int, x bigint, at int, before int, after int, members binary"
    return windows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(task, f"{PAIRS}, {kinds}")


def _bits(x: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of words."""
    wide = np.zeros((len(x), -(-x.shape[1] // 64) * 64), bool)
    wide[:, : x.shape[1]] = x
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def partners(value: np.ndarray, doc: np.ndarray, around: np.ndarray, there: np.ndarray, entries: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of classes of the same value that must meet; rows are in order of value and rank.

    `around`: the shingles around the centre, where `there`. x meets each class y of an earlier document, unless one that it
    meets, of a smaller rank, has all that y has of x: the same places at the same distance from the centre, and the same
    shingles elsewhere around it. So the first class meets all others, and others are looked for only where one of the shingles
    that x does not share with the first occurs before x.
    """
    n, wide = around.shape
    hub = np.zeros(n, np.int64)
    begin = _starts(value)
    hub[:] = np.repeat(begin, np.diff(np.append(begin, n)))
    docs = _starts(value, doc)
    before = np.repeat(docs, np.diff(np.append(docs, n)))  # classes hub to here are of earlier documents
    out_x, out_y = [np.flatnonzero(hub < before)], [hub[hub < before]]
    shared = there & there[hub] & (around == around[hub])
    # The earlier class that shares most with x, of those that are the first to hold one of its shingles at its place.
    row, place = np.nonzero(there & ~shared)
    order = np.argsort(text.mix(text.mix(around[row, place] + (place.astype(np.uint64) << np.uint64(32))) + hub[row].astype(np.uint64)), kind="stable")
    row, place = row[order], place[order]
    runs = _starts(hub[row], place, around[row, place])
    x, y = row, np.repeat(row[runs], np.diff(np.append(runs, len(row))))
    pair = _distinct((x * n + y)[y < before[x]])
    x, y = pair // n, pair % n
    most, full = hub.copy(), shared.copy()
    for lo in range(0, len(x), 50_000):
        some_x, some_y = x[lo : lo + 50_000], y[lo : lo + 50_000]
        same = there[some_x] & there[some_y] & (around[some_x] == around[some_y])
        size = same.sum(1)
        order = np.lexsort((size, some_x))
        order = order[np.append(some_x[order][1:] != some_x[order][:-1], True)]
        order = order[size[order] > full[some_x[order]].sum(1)]
        most[some_x[order]], full[some_x[order]] = some_y[order], same[order]
    # Postings: which rows of a value hold a shingle, each once, with its first place there.
    cell = np.flatnonzero(there)
    row, place = cell // wide, cell % wide
    order = np.lexsort((around.ravel()[cell], hub[row]))
    row, place, code = row[order], place[order], around.ravel()[cell[order]]
    once = _starts(hub[row], code, row)
    alone, beyond = (np.logical_or.reduceat(~s[row, place], once) if len(once) else np.empty(0, bool) for s in (shared, full))
    row, place, code = row[once], place[once], code[once]
    runs = _starts(hub[row], code)
    sizes = np.diff(np.append(runs, len(row)))
    lo, posting = np.repeat(runs, sizes), np.repeat(np.arange(len(runs)), sizes) * n + row
    adds = np.zeros(n, bool)
    adds[row[alone & (row[lo] < before[row])]] = True
    open_ = np.flatnonzero((alone | beyond) & (row[lo] < before[row]) & adds[row])
    open_ = open_[np.argsort(row[open_], kind="stable")]
    # Up to the class that shares most, others must add to the first one; after it, to both, so either's shingles list them.
    alone, beyond, base = alone[open_], beyond[open_], posting[open_] - row[open_]
    split, last = np.searchsorted(posting, base + most[row[open_]] + 1), np.searchsorted(posting, base + before[row[open_]])
    by_first, by_most = (np.bincount(row[open_], (last - split) * s, n) for s in (alone, beyond))
    listed = np.where((by_first <= by_most)[row[open_]], alone, beyond)
    begins = np.where(alone, lo[open_], split)
    sizes = np.maximum(np.where(listed, last, split) - begins, 0)
    heads = _starts(row[open_])
    stops = np.append(heads, len(open_))
    work = np.concatenate([[0], np.cumsum(np.add.reduceat(sizes, heads) * np.diff(stops))]) if len(heads) else np.zeros(1, np.int64)
    a = 0
    while a < len(heads):
        b = max(int(np.searchsorted(work, work[a] + entries, "right")) - 1, a + 1)
        some, count = open_[stops[a] : stops[b]], sizes[stops[a] : stops[b]]
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begins[stops[a] : stops[b]], count)
        pair = _distinct((np.repeat(row[some], count) - row[some[0]]) * n + row[at])
        x, y = pair // n + row[some[0]], pair % n
        # Which of the open shingles of x each y holds.
        own = np.searchsorted(row[open_[heads[a:b]]], x)
        count = np.diff(stops[a : b + 1])[own]
        which = np.repeat(np.arange(len(x)), count)
        u = open_[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(stops[a:b][own], count)]
        a = b

        def holds(z: np.ndarray) -> np.ndarray:
            wanted = posting[u] - row[u] + z[which]
            found = posting[np.minimum(np.searchsorted(posting, wanted), len(posting) - 1)] == wanted
            out = np.zeros((len(x), wide), bool)
            out[which[found], place[u[found]]] = True
            return _bits(out)

        has = np.concatenate([_bits(there[x] & there[y] & (around[x] == around[y])), holds(y)], axis=1)
        alive = (has & ~np.concatenate([_bits(shared[x]), holds(hub[x])], axis=1)).any(1)
        while alive.any():
            x, y, has = x[alive], y[alive], has[alive]
            xs = _starts(x)
            out_x.append(x[xs])
            out_y.append(y[xs])
            alive = (has & ~np.repeat(has[xs], np.diff(np.append(xs, len(x))), axis=0)).any(1)
    return np.concatenate(out_x), np.concatenate(out_y)


def _held(classes: DataFrame, seqs: DataFrame, t: int, buckets: int) -> DataFrame:
    """PAIRS of the values with many classes."""
    wide = 2 * t - 1
    side = lambda c: f"least({c}, {t - 1})"
    around = F.expr(f"substring(seq, cast(4 * (at - {side('before')}) + 1 as int), cast(4 * ({side('before')} + {side('after')} + 1) as int))")
    dealt = classes.join(seqs.withColumnRenamed("id", "x"), "x").select("value", "rank", "x", "at", "before", "after", "members", around.alias("around"))

    def joined(column: pa.ChunkedArray, keep: np.ndarray) -> bytes:
        return b"".join((column if len(keep) == len(column) else column.take(pa.array(keep))).to_pylist())

    def met(rows: pa.Table) -> Iterator[list[np.ndarray]]:
        value, rank, doc, at, before, after = (rows.column(c).to_numpy() for c in ("value", "rank", "x", "at", "before", "after"))
        left, right = np.minimum(before, t - 1), np.minimum(after, t - 1)
        full = pa.compute.binary_length(rows.column("around")).to_numpy() == 4 * (left + right + 1)  # others are of another row with this id
        full[1:] &= ~((value[1:] == value[:-1]) & (rank[1:] == rank[:-1]) & full[:-1])
        keep = np.flatnonzero(full)
        value, doc, at, before, after, left, right = (c[keep] for c in (value, doc, at, before, after, left, right))
        around, cols = np.zeros((len(keep), wide), np.uint32), np.arange(wide) - (t - 1)
        there = (cols >= -left[:, None]) & (cols <= right[:, None])
        if len(keep):
            around[there] = np.frombuffer(joined(rows.column("around"), keep), "<u4")
        x, y = partners(value, doc, around, there)
        if not len(keep):
            return
        sizes = pa.compute.binary_length(rows.column("members")).to_numpy()[keep].astype(np.int64) // _MEMBER.itemsize + 1
        records = np.frombuffer(joined(rows.column("members"), keep), _MEMBER)
        begin, rest = np.cumsum(sizes) - sizes, np.ones(int(sizes.sum()), bool)
        rest[begin] = False
        member = [np.empty(len(rest), np.int64) for _ in _MEMBER.names]
        for m, n, own in zip(member, _MEMBER.names, (doc, at, before, after)):
            m[begin], m[rest] = own, records[n]
        x, y = np.concatenate([x, np.arange(len(sizes))]), np.concatenate([y, np.arange(len(sizes))])  # a class meets its first window too
        chunk = np.cumsum(sizes[x]) // 500_000
        for some in np.split(np.arange(len(x)), np.flatnonzero(np.diff(chunk)) + 1):
            n = sizes[x[some]]
            w = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[x[some]], n)
            z = np.repeat(y[some], n)
            later = doc[z] < member[0][w]
            w, z = w[later], z[later]
            yield _paired([c[w] for c in member], [c[z] for c in (doc, at, before, after)], value[z] & 7)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            v = batch.column("value").to_numpy()
            if not len(v):
                continue
            if n + len(v) >= 4096:  # values that end here; the last one may go on in the next batch
                cut = int(np.flatnonzero(v == v[-1])[0])
                if cut or held and held[-1].column("value")[-1].as_py() != v[-1]:
                    yield from met(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held, n, batch = [], 0, batch.slice(cut)
            held.append(batch)
            n += batch.num_rows
        if held:
            yield from met(pa.Table.from_batches(held))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _parcels(pairs(batches), buckets):
            yield pa.RecordBatch.from_arrays([*out], names=["bucket", "pairs"])

    return dealt.repartition("value").sortWithinPartitions("value", "rank", "around").mapInArrow(task, PAIRS)


def covered(at: np.ndarray, before: np.ndarray, after: np.ndarray, hashes: np.ndarray, t: int) -> list[tuple[int, int]]:
    """Stretches [lo, hi] of t or more that windows of ENOUGH different hash functions cover: an interval join by a sweep."""
    events: list[tuple[int, int]] = []
    for j in np.unique(hashes):
        mine = np.flatnonzero(hashes == j)
        lo, hi = at[mine] - before[mine], at[mine] + after[mine] + 1
        order = np.argsort(lo, kind="stable")
        lo, reach = lo[order], np.maximum.accumulate(hi[order])
        gap = np.flatnonzero(lo[1:] > reach[:-1])
        events += [(x, 1) for x in lo[np.concatenate([[0], gap + 1])].tolist()] + [(x, -1) for x in reach[np.concatenate([gap, [len(lo) - 1]])].tolist()]
    out, depth, start = [], 0, 0
    for place, step in sorted(events, key=lambda e: (e[0], -e[1])):
        depth += step
        if step == 1 and depth == ENOUGH:
            start = place
        elif step == -1 and depth == ENOUGH - 1 and place - start >= t - DRIFT // 2:
            out.append((start, place - 1))
    return out


def _stretches(pairs: DataFrame, t: int) -> DataFrame:
    """(x, x_lo, x_hi, hub, hub_lo, hub_hi) to be verified, in shingles."""

    names = ["x", "x_lo", "x_hi", "hub", "hub_lo", "hub_hi"]

    def stretches(columns: list[np.ndarray]) -> Iterator[tuple]:
        x, hub, at, hub_at, before, after, hashes = (c.astype(np.int64) for c in columns)
        diagonal = at - hub_at
        order = np.lexsort((diagonal, hub, x))
        x, hub, at, before, after, hashes, diagonal = (c[order] for c in (x, hub, at, before, after, hashes, diagonal))
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (hub[1:] != hub[:-1]) | (np.diff(diagonal) > DRIFT)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(x))
        kinds = np.bitwise_count(np.bitwise_or.reduceat(1 << hashes, begin))
        for a, b in zip(begin[kinds >= ENOUGH].tolist(), end[kinds >= ENOUGH].tolist()):
            for lo, hi in covered(at[a:b], before[a:b], after[a:b], hashes[a:b], t):
                lo, hi = max(lo - GAP, 0), hi + GAP
                yield int(x[a]), lo, hi, int(hub[a]), max(lo - int(diagonal[b - 1]) - GAP, 0), hi - int(diagonal[a]) + GAP

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _by_bucket(batches, _PAIR):
            cols = list(zip(*stretches(columns))) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return pairs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(task, ", ".join(f"{n} bigint" for n in names))


def _before(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in order of value, and for each place the one before it with the same value, or -1."""
    order = np.argsort(x, kind="stable")
    out = np.full(len(x), -1)
    same = x[order][1:] == x[order][:-1]
    out[order[1:][same]] = order[:-1][same]
    return order, out


def verified(x: np.ndarray, hub: np.ndarray, t: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """(x from, x to, hub from, hub to, similarity) of the passages in two stretches of shingles, inclusive.

    Runs of shared shingles are aligned with the hub; from each run's begin, the farthest end of a run is taken at which the
    stretch is similar enough to the hub's stretch between the same runs, or to the whole hub. All ends are scored at once, by
    running counts of distinct shingles; only stretches inside one that was found before are left out.
    """
    x_before = _before(x)[1]
    by_value, hub_before = _before(hub)
    ranked = hub[by_value]
    begins = np.flatnonzero(hub_before[by_value] < 0)  # where each value of the hub begins
    kind = np.searchsorted(ranked[begins], x)
    kind[kind == len(begins)] = 0
    shares = ranked[begins][kind] == x
    hit = np.flatnonzero(shares)
    if not len(hit):
        return []
    wide = len(hub) + 1
    keyed = (np.cumsum(hub_before[by_value] < 0) - 1) * wide + by_value  # values' places, in order

    def following(places: np.ndarray, least) -> np.ndarray:
        """Where the hub has the shingles at `places` next, from `least` on; `wide` if nowhere."""
        k = kind[places]
        found = np.minimum(np.searchsorted(keyed, k * wide + least), len(keyed) - 1)
        there = keyed[found] - k * wide
        return np.where((there >= least) & (there < wide), there, wide)

    cuts = np.flatnonzero(np.diff(hit) > 1) + 1
    begin, end = hit[np.concatenate([[0], cuts])], hit[np.concatenate([cuts - 1, [len(hit) - 1]])]
    n = len(begin)
    # Each run's distance from its place in the hub: that of the middle one of the shingles that the hub holds once; else the nearest to that of the run before.
    lone = np.diff(np.append(begins, len(hub)))[kind] == 1
    there = by_value[begins[kind]]
    alone = np.flatnonzero(lone & shares)
    low, high = np.searchsorted(alone, begin), np.searchsorted(alone, end, "right")
    known = high > low
    middle = alone[np.minimum((low + high) // 2, len(alone) - 1)] if len(alone) else begin
    shift = np.where(known, there[middle] - middle, 0)
    last = shift[known][0] if known.any() else int(there[begin[0]] - begin[0])
    after_last = np.append(begins, len(hub))

    def nearest(place: int, to: int) -> int:
        """Where the hub has the shingle at `place`, as near to `to` as can be."""
        places = by_value[after_last[kind[place]] : after_last[kind[place] + 1]]
        return int(places[0] if len(places) == 1 else places[np.argmin(np.abs(places - to))])

    begin_there, end_there = there[begin], there[end]
    for j in np.flatnonzero(~(known & lone[begin] & lone[end])).tolist():
        lo, hi = int(begin[j]), int(end[j])
        last = int(shift[j - 1]) if j else last
        if not known[j]:
            shift[j] = nearest(lo, lo + last) - lo
        last = int(shift[j])
        begin_there[j], end_there[j] = nearest(lo, lo + last), nearest(hi, hi + last)
    # Shingles that the other side lacks, each where it is first: what surely counts against a stretch.
    lacking = np.concatenate([[0], np.cumsum(~shares & (x_before < 0))])
    held = np.zeros(len(begins), bool)
    held[kind[hit]] = True
    other = np.zeros(len(hub), bool)
    other[by_value[begins[~held]]] = True
    spare = np.concatenate([[0], np.cumsum(other)])
    total = int(np.count_nonzero(held))
    length = np.concatenate([[0], np.cumsum(end - begin + 1)])
    # No passage goes on where too much is missing, or between far diagonals.
    gap = lacking[begin[1:]] - lacking[end[:-1] + 1]
    apart = (100 * total < percent * (total + gap)) | (known[1:] & known[:-1] & (np.abs(np.diff(shift)) > DRIFT))
    stops = np.append(np.flatnonzero(apart) + 1, n)
    # The starts from which some end is near enough by what the hub lacks alone.
    gain = (100 - percent) * length - percent * lacking[np.append(begin, end[-1] + 1)]
    upto = (100 - percent) * length[1:] - percent * lacking[end + 1]
    for lo, hi in zip([0, *stops[:-1].tolist()], stops.tolist()):
        upto[lo:hi] = np.maximum.accumulate(upto[lo:hi][::-1])[::-1]
    after = np.repeat(stops, np.diff(stops, prepend=0))
    least = np.searchsorted(end, begin + t - 1)
    out: list[tuple[int, int, int, int, float]] = []
    reached = -1
    for i in np.flatnonzero((least < after) & (upto[np.minimum(least, n - 1)] >= gain[:-1])).tolist():
        stop = int(after[i])
        lo, a = int(begin[i]), min(max(int(begin[i] + shift[i]), 0), len(hub) - 1)
        if end[stop - 1] <= reached or end[stop - 1] - lo + 1 < t:
            continue
        ends = end[i:stop]
        b = np.clip(np.maximum.accumulate(ends + shift[i:stop]), a, len(hub) - 1)
        fits = (ends - lo + 1 >= t) & (ends > reached)
        have, lack = length[i + 1 : stop + 1] - length[i], lacking[ends + 1] - lacking[lo]
        a_near, b_near = int(begin_there[i]), np.maximum(np.maximum.accumulate(end_there[i:stop]), begin_there[i])
        options = [(a, b), (0, np.full(len(b), len(hub) - 1))]
        if a_near != a or (b_near != b).any():
            options.append((a_near, b_near))
        best = None
        for low, high in options:
            theirs = spare[high + 1] - spare[low]
            may = np.flatnonzero(fits & (100 * np.minimum(have, total) >= percent * (np.minimum(have, total) + lack + theirs)))
            if not len(may) or best and ends[may[-1]] <= best[1]:
                continue
            m = int(may[-1]) + 1
            places = np.arange(lo, int(ends[m - 1]) + 1)
            first = x_before[lo : lo + len(places)] < lo
            own = np.cumsum(first)[ends[:m] - lo]
            of_hub = np.cumsum(hub_before[low : int(high[m - 1]) + 1] < low)[high[:m] - low]
            mine = places[first & shares[lo : lo + len(places)]]
            when = np.maximum(np.searchsorted(ends[:m], mine), np.searchsorted(high[:m], following(mine, low)))
            both = np.cumsum(np.bincount(when, minlength=m + 1)[:m])
            union = own + of_hub - both
            good = may[100 * both[may] >= percent * union[may]]
            if len(good) and (not best or ends[good[-1]] > best[1]):
                j = int(good[-1])
                best = (lo, int(ends[j]), low, int(high[j]), int(both[j]) / int(union[j]))
        if best:
            out.append(best)
            reached = best[1]
    return out


def _sequences(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, seq): four bytes of each shingle's hash."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in text.chunks(texts, 2_000_000):
                flat, first = text.sequences(texts[lo:hi], SHINGLE)
                seqs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((4 * first).astype("<i8")), pa.py_buffer((flat >> np.uint64(32)).astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), seqs.cast(pa.binary())], names=["id", "seq"])
        tokens.trim()

    named = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    few = ids.count() <= BROADCAST_IDS
    return store.saved(named.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(task, "id bigint, seq binary"))


def passages(docs: DataFrame, min_words: int = 50, percent: int = 80) -> DataFrame:
    """Passages of (doc_id, text) that an earlier document holds too, in words, ends exclusive:
    (doc_id, start_word, end_word, source_doc_id, source_start, source_end, similarity)."""
    docs, t = store.lean(docs), min_words - SHINGLE + 1
    buckets = 4 * store.partitions(docs.sparkSession)
    met = store.saved(_met(_windows(docs, t, buckets), buckets))
    pairs, classes = met.filter("value is null"), met.filter("value is not null")
    first = store.saved(classes.select(F.col("x").alias("id")).distinct())
    seqs = _sequences(docs, first)
    found = store.saved(_stretches(pairs.select("bucket", "pairs").union(_held(classes, seqs, t, buckets)), t))
    rest = found.select(F.col("x").alias("id")).union(found.select("hub")).distinct().join(first, "id", "left_anti")
    seqs = seqs.union(_sequences(docs, store.saved(rest)))
    part = lambda lo, hi: F.expr(f"substring(seq, cast(4 * {lo} + 1 as int), cast(4 * ({hi} - {lo} + 1) as int))")
    with_hub = found.join(seqs.withColumnRenamed("id", "hub"), "hub").withColumn("hub_seq", part("hub_lo", "hub_hi")).drop("seq", "hub_hi")
    with_both = with_hub.join(seqs.withColumnRenamed("id", "x"), "x").withColumn("x_seq", part("x_lo", "x_hi"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FOUND.split(", ")]
        for batch in batches:
            out = []
            for d, lo, own, source, source_lo, theirs in zip(*(c.to_pylist() for c in batch.columns)):
                if own and theirs:
                    for a, b, c, e, sim in verified(np.frombuffer(own, "<u4"), np.frombuffer(theirs, "<u4"), t, percent):
                        out.append((d, lo + a, lo + b + SHINGLE, source, source_lo + c, source_lo + e + SHINGLE, sim))
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 6 else pa.float64()) for k, c in enumerate(cols)], names=names)

    return with_both.select("x", "x_lo", "x_seq", "hub", "hub_lo", "hub_seq").mapInArrow(task, FOUND)


def merged(found: DataFrame) -> DataFrame:
    """(doc_id, spans): each document's passages as disjoint [start, end) stretches of words, in order."""
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start_word", "end_word"))).alias("s"))
    pair = "struct<a: bigint, b: bigint>"
    folded = F.expr(
        f"aggregate(s, cast(array() as array<{pair}>), (acc, e) -> case when size(acc) > 0 and e.start_word <= element_at(acc, -1).b "
        f"then concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, e.end_word)))) "
        f"else concat(acc, array(named_struct('a', e.start_word, 'b', e.end_word))) end)"
    )
    return spans.select("doc_id", folded.alias("spans"))


def without_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """`docs` without the words of the passages in `found`, n_chars (if there) to match; documents of which nothing is left go.
    All columns stay, whatever their names."""
    own_id, own_spans = (next(n for n in (f"{base}{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for base in ("_id", "_spans"))
    word = re.compile(rb"[^\x20\x09-\x0d]+")

    def cut(t: str, gone: list[dict]) -> str:
        raw = t.encode()
        at = [m.span() for m in word.finditer(raw)]
        out, last = [], 0
        for s in gone:
            a, b = s["a"], min(s["b"], len(at))
            if a < b:
                out.append(raw[last : at[a][0]])
                last = at[b][0] if b < len(at) else len(raw)
        return b"".join([*out, raw[last:]]).decode().strip()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = batch.column(own_spans), batch.column("text")
            hit = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False) & texts.is_valid().to_numpy(zero_copy_only=False))
            new = dict(zip(hit.tolist(), (cut(texts[i].as_py(), spans[i].as_py()) for i in hit.tolist())))
            rows = batch.drop_columns([own_spans])
            for name, change in (("text", lambda t: t), ("n_chars", len)):
                if name in rows.schema.names:
                    kind, k = rows.schema.field(name).type, rows.schema.get_field_index(name)
                    mask = np.zeros(batch.num_rows, bool)
                    mask[hit] = True
                    column = pa.compute.replace_with_mask(rows.column(k), pa.array(mask), pa.array([change(new[i]) for i in hit.tolist()], kind)) if len(hit) else rows.column(k)
                    rows = rows.set_column(k, name, column)
            keep = np.ones(batch.num_rows, bool)
            keep[[i for i, t in new.items() if not t]] = False
            yield rows.filter(pa.array(keep))

    spans = store.saved(merged(found))
    gone = spans.select(F.col("doc_id").alias(own_id), F.col("spans").alias(own_spans))
    few = gone.count() <= BROADCAST_IDS // 5
    joined = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone[own_id], "left")
    return joined.select(*docs.columns, own_spans).mapInArrow(task, docs.schema)
