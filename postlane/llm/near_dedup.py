"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with the same shingle set form a class; one of each takes part. A
class's signature has 128 components. Each of 32 trees orders the signatures
from another component on; a region is a run of one order whose signatures
share a prefix of 4 components. Within a region, members stand in the tree's
order, so that those with the longest common prefixes are neighbours, and are
compared in runs of `region`, each of which overlaps the next one by half and
also holds the first member of every run before it, its representatives: the
depth of a run adapts to how dense the region is, and no run is cut off from
the others. A region too large for one task (`piece` members) is parted by
prefixes 4 components longer, up to 24 deep, then by hash; its heads, drawn by
hash, go into every part.

Runs are compared by whole signatures. First each member is paired with its
two most similar ones, the pairs are confirmed on full shingle sets, and
components found; then each member is paired with every other component of a
run in which signatures, five times as long now, allow the similarity: with its
8 members that agree in most. So copies of one another never make all their
pairs. Where more than 8 allow the similarity, and the components are still
apart then, the member is held against the full set of every member of that
component, without a pair made. Two documents at 0.8 share no region with
probability below 1e-7; in regions above `region` members they must also be
near in one of 32 orders, or meet through a representative.

Null and empty texts have an empty set and are linked with nothing. Null ids
are never smaller than others: such a row's component is its class's, or null.
Texts of any length are hashed whole. Ties between equally similar members go
to the earlier one in the order. Repeated rows each get a row; equal ids are one
node. An empty table gives no rows. Other columns are not read, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlane.llm import store, text, tokens
from postlane.llm.components import components

SIGNATURE, TREES, DEPTH, DEEPEST = 128, 32, 4, 24
STEP = SIGNATURE // TREES
#: Components that are added for documents between whose components links are still open.
FINER = 512
#: Of one other component, how many members are confirmed for a member by pairs, by how many components agree; the rest by `against_all`.
PARTNERS = 8
#: Members of a component that one task holds the full sets of.
CHUNK = 512
#: Members of a region too large for one task that all its parts hold.
HEADS = 8
BROADCAST_IDS = 500_000
FACTORS = text.mix(np.arange(1, SIGNATURE + FINER + 1, dtype=np.uint64) * text.GOLD) | np.uint64(1)


def allowed(components: int) -> int:
    """Agreeing components that sets at 0.8 have at least, but for one in 30,000: four deviations below the mean."""
    return int(0.8 * components - 4 * (0.16 * components) ** 0.5)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_hash, signature) of (doc_id, text); both binaries are null for an empty set."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        memo = text.Words()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in text.chunks(texts):
                sets = [np.unique(text.shingles(memo.hashes(t), k)) if t else np.empty(0, np.uint64) for t in texts[lo:hi]]
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                sig = np.empty((len(sets), SIGNATURE), "<u2")
                if len(full):
                    flat = np.concatenate(sets)
                    starts = (np.cumsum(sizes) - sizes)[full]
                    for j in range(SIGNATURE):
                        sig[full, j] = text.mix(np.minimum.reduceat(flat * FACTORS[j], starts)) >> np.uint64(48)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(lo, hi - lo), "n_shingles": pa.array(sizes, pa.int64()),
                        "set_hash": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        "signature": pa.array([row.tobytes() if n else None for row, n in zip(sig, sizes)], pa.binary()),
                    }
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(task, "doc_id bigint, n_shingles bigint, set_hash binary, signature binary")


def finer_signatures(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, finer): FINER further components of the documents that `ids` (id) names."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("set"):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                step = max(1, 500_000 // len(s))  # so that long texts stay small in memory
                least = np.concatenate([(s[None, :] * FACTORS[lo : lo + step, None]).min(1) for lo in range(SIGNATURE, SIGNATURE + FINER, step)])
                out.append((text.mix(least[:FINER]) >> np.uint64(48)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "finer"])

    return store.saved(shingle_sets(docs, ids, k).mapInArrow(task, "id bigint, finer binary"))


def shingle_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, set): sorted 64-bit shingle hashes of the documents that `ids` (id) names."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        memo = text.Words()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in text.chunks(texts):
                sets = [np.unique(text.shingles(memo.hashes(t), k)).tobytes() if t else b"" for t in texts[lo:hi]]
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").slice(lo, hi - lo), "set": pa.array(sets, pa.binary())})

    named = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    few = ids.count() <= BROADCAST_IDS
    return store.saved(named.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(task, "id bigint, set binary"))


def regions(classes: DataFrame, piece: int) -> DataFrame:
    """(tree, prefix, id): the members of every region of two or more, in parts of at most `piece` and HEADS more."""
    ring = F.concat("signature", "signature")
    prefix = lambda depth: F.substring(ring, (F.col("tree") * 2 * STEP + 1).cast("int"), F.lit(2 * depth))
    trees = F.array(*[F.substring("signature", 2 * STEP * t + 1, 2 * DEPTH) for t in range(TREES)])
    rows = classes.select("id", F.posexplode(trees).alias("tree", "prefix"))
    found = []
    for depth in range(DEPTH, DEEPEST + 1, DEPTH):
        sizes = rows.groupBy("tree", "prefix").agg(F.count("*").alias("members")).filter("members > 1")
        split = store.saved(rows.join(sizes, ["tree", "prefix"]))
        found.append(split.filter(F.col("members") <= piece))
        dense = split.filter(F.col("members") > piece)
        if not dense.limit(1).count():
            break
        draws = [F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("draw"), F.col("id").alias("head")))["head"] for i in range(HEADS)]
        heads = dense.groupBy("tree", "prefix").agg(F.array_distinct(F.array(*draws)).alias("heads"))
        if depth < DEEPEST:
            longer = dense.drop("members").join(classes.select("id", "signature"), "id").select("tree", "prefix", prefix(depth + DEPTH).alias("part"), "id")
        else:  # so alike that heads will do
            part = F.concat("prefix", F.encode(F.format_string("#%08d", F.pmod(F.xxhash64("id"), F.ceil(2 * F.col("members") / piece))), "UTF-8"))
            longer = dense.select("tree", "prefix", part.alias("part"), "id")
        shared = longer.select("tree", "prefix", "part").distinct().join(heads, ["tree", "prefix"]).select("tree", F.col("part").alias("prefix"), F.explode("heads").alias("id"))
        rows = longer.select("tree", F.col("part").alias("prefix"), "id").unionByName(shared).distinct()
    else:
        found.append(rows)
    out = found[0].select("tree", "prefix", "id")
    for more in found[1:]:
        out = out.unionByName(more.select("tree", "prefix", "id"))
    return store.saved(out)


def runs(members: int, region: int) -> Iterator[np.ndarray]:
    """Places, in order, of overlapping runs of `region`, each with the first place of every run before it."""
    if members <= region:
        yield np.arange(members)
        return
    step = max(region // 2, 1)
    first: list[int] = []
    for lo in range(0, members - (region - step), step):
        yield np.concatenate([np.array(first, np.int64), np.arange(lo, min(lo + region, members))])
        first.append(lo)


def candidates(members: DataFrame, best: int | None, region: int, partners: int = PARTNERS) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, of (tree, prefix, id, label, n, signature, with or without finer) whose labels differ and whose signatures and sizes allow
    the similarity: each member's `best` most similar ones in a run, or its `partners` most similar ones of each other component; and (x, other) of
    the members and components between which there are more of the latter."""

    def pairs(label: np.ndarray, n: np.ndarray, sig: np.ndarray, sig2: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        out_a, out_b, out_score, out_more = [], [], [], []
        some = np.arange(len(n))
        if best is None:  # the largest component is met by all others, and need not look for them
            names, at = np.unique(label, return_inverse=True)
            some = np.flatnonzero(at != np.bincount(at).argmax())
        for lo in range(0, len(some), 64):
            mine = some[lo : lo + 64]
            near = (sig[mine, None, :] == sig[None, :, :]).sum(2, dtype=np.int16)
            sizes = n[mine, None]
            near[(near < allowed(SIGNATURE)) | (label[mine, None] == label[None, :]) | (5 * np.minimum(sizes, n[None, :]) < 4 * np.maximum(sizes, n[None, :]))] = 0
            more = None
            if best is None:
                a, b = np.nonzero(near)
                if sig2 is not None:
                    both = near[a, b] + np.concatenate([(sig2[mine[a[i : i + 4096]]] == sig2[b[i : i + 4096]]).sum(1) for i in range(0, len(a), 4096)] or [np.empty(0, np.int64)])
                    keep = np.flatnonzero(both >= allowed(SIGNATURE + FINER))
                    order = keep[np.lexsort((b[keep], -both[keep], at[b[keep]], a[keep]))]
                    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (at[b[order]][1:] != at[b[order]][:-1])])[: len(order)]
                    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
                    # A pair says whether its member has more in that component than are kept.
                    group = np.cumsum(new) - 1
                    more = (np.bincount(group, minlength=1)[group] > partners)[rank < partners]
                    keep = order[rank < partners]
                    a, b, score = a[keep], b[keep], both[keep]
                else:
                    score = near[a, b]
            else:
                top = np.argsort(-near, axis=1, kind="stable")[:, :best]
                a, k = np.nonzero(np.take_along_axis(near, top, 1))
                b = top[a, k]
                score = near[a, b]
            out_a.append(mine[a])
            out_b.append(b)
            out_score.append(score)
            out_more.append(np.zeros(len(a), np.int64) if more is None else more)
        none = np.empty(0, np.int64)
        return np.concatenate([none, *out_a]), np.concatenate([none, *out_b]), np.concatenate([none, *out_score]), np.concatenate([none, *out_more])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(table: pa.RecordBatch) -> pa.RecordBatch | None:
            ids, label, n = (table.column(c).to_numpy() for c in ("id", "label", "n"))
            if len(ids) < 2 or label.min() == label.max():
                return None
            sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u2").reshape(len(ids), SIGNATURE)
            sig2 = np.frombuffer(b"".join(table.column("finer").to_pylist()), "<u2").reshape(len(ids), FINER) if "finer" in table.schema.names else None
            found = []
            for run in runs(len(ids), region):
                if (label[run] != label[run[0]]).any():
                    a, b, score, more = pairs(label[run], n[run], sig[run], None if sig2 is None else sig2[run])
                    found.append((run[a], run[b], score, more))
            if not found:
                return None
            a, b, score, more = (np.concatenate(x) for x in zip(*found))
            each = np.unique(np.stack([ids[a], ids[b], label[b], score.astype(np.int64), more]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in each], names=["x", "y", "other", "score", "more"])

        held: pa.Table | None = None  # the region that a batch's end may have cut
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            table = table.combine_chunks()
            keys = list(zip(table.column("tree").to_pylist(), table.column("prefix").to_pylist()))
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            whole = table.to_batches()[0] if len(table) else None
            for lo, hi in zip([0, *cuts], cuts):
                if (out := rows(whole.slice(lo, hi - lo))) is not None:
                    yield out
            held = table.slice(cuts[-1] if cuts else 0)
        if held is not None and len(held) and (out := rows(held.combine_chunks().to_batches()[0])) is not None:
            yield out

    order = F.substring(F.concat("signature", "signature"), (F.col("tree") * 2 * STEP + 1).cast("int"), F.lit(2 * SIGNATURE))
    dealt = members.repartition("tree", "prefix").sortWithinPartitions("tree", "prefix", order, "id")
    found = dealt.mapInArrow(task, "x bigint, y bigint, other bigint, score bigint, more bigint").groupBy("x", "y", "other", "score").agg(F.max("more").alias("more"))
    if best is None:
        rank = F.row_number().over(Window.partitionBy("x", "other").orderBy(F.desc("score"), "y"))
        found = store.saved(found.withColumn("rank", rank).filter(F.col("rank") <= partners + 1))
    rest = found.filter((F.col("rank") > partners) | (F.col("more") > 0)).select("x", "other").distinct() if best is None else found.limit(0).select("x", "other")
    found = found.filter(F.col("rank") <= partners) if best is None else found
    return store.saved(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()), rest


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, on full sets."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = shingle_sets(docs, ids, k)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    with_x = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    with_both = with_x.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return store.saved(with_both.select("a", "b", "x", "y").mapInArrow(task, "a bigint, b bigint"))


def against_all(open_: DataFrame, members: DataFrame, docs: DataFrame, k: int, percent: int, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) of each (x, other) of `open_` to a member of the component `other`, by full sets of all `members` (id, label): one for each
    chunk of a component at most, none where it has none. A component's sets lie in inverted order, in chunks, and members are counted there."""
    sizes = members.join(open_.select(F.col("other").alias("label")).distinct(), "label", "left_semi").groupBy("label").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    sizes = store.saved(sizes)
    held = members.join(sizes, "label").select(F.col("label").alias("other"), F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk"), F.lit(0).alias("kind"), "id")
    asked = open_.join(sizes, open_["other"] == sizes["label"]).select("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("kind"), F.col("x").alias("id"))
    rows = store.saved(held.unionByName(asked))
    sets = shingle_sets(docs, store.saved(rows.select("id").distinct()), k)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, own = None, [], []  # of the chunk at hand
        index: tuple | None = None
        for batch in batches:
            out_a, out_b = [], []
            for key, kind, i, raw in zip(zip(batch.column("other").to_pylist(), batch.column("chunk").to_pylist()), batch.column("kind").to_pylist(), batch.column("id").to_pylist(), batch.column("set")):
                if key != now:
                    now, ids, own, index = key, [], [], None
                s = np.frombuffer(raw.as_py(), np.uint64)
                if kind == 0:
                    ids.append(i)
                    own.append(s)
                    continue
                if index is None:
                    sizes = np.array([len(o) for o in own], np.int64)
                    flat = np.concatenate([np.empty(0, np.uint64), *own])
                    order = np.argsort(flat, kind="stable")
                    index, own = (flat[order], np.repeat(np.arange(len(ids)), sizes)[order], sizes), []
                flat, owner, sizes = index
                lo = np.searchsorted(flat, s)
                n = np.searchsorted(flat, s, "right") - lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(ids))
                linked = np.flatnonzero(100 * both >= percent * (len(s) + sizes - both))
                if len(linked):
                    out_a.append(min(i, ids[linked[0]]))
                    out_b.append(max(i, ids[linked[0]]))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    dealt = rows.join(sets, "id").repartition("other", "chunk").sortWithinPartitions("other", "chunk", "kind", "id")
    return store.saved(dealt.select("other", "chunk", "kind", "id", "set").mapInArrow(task, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, region: int = 1024, piece: int = 20_000, partners: int = PARTNERS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of (doc_id, text)."""
    docs = store.lean(docs)
    signed = store.saved(signatures(docs, k))
    classes = store.saved(signed.filter("set_hash is not null").groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")))
    named = classes.filter("id is not null")
    spots = regions(named, piece)
    whole = spots.join(named.select("id", "n", "signature"), "id").withColumn("label", F.col("id"))
    first = confirmed(candidates(whole, 2, region)[0], docs, k, percent)
    labels = components(first)
    relabelled = whole.drop("label").join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    # Only regions where components still meet are compared again.
    mixed = spots.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = mixed.groupBy("tree", "prefix").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("tree", "prefix")
    open_ = store.saved(relabelled.join(mixed, ["tree", "prefix"], "left_semi"))
    finer = finer_signatures(docs, store.saved(open_.select("id").distinct()), k)
    pairs, rest = candidates(open_.join(finer, "id"), None, region, partners)
    before, labels = labels, components(confirmed(pairs, docs, k, percent), labels)
    now = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))
    apart = rest.join(now("x"), "x", "left").join(now("other"), "other", "left").filter(F.coalesce("x_label", "x") != F.coalesce("other_label", "other"))
    apart = store.saved(apart.select("x", "other"))
    if apart.limit(1).count():
        members = named.select("id").join(before.select(F.col("node").alias("id"), "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
        labels = components(against_all(apart, members, docs, k, percent), labels)
    class_label = classes.join(labels, classes["id"] == labels["node"], "left").select("set_hash", F.coalesce("label", "id").alias("component"))
    out = signed.join(class_label, "set_hash", "left").withColumn("component_id", F.coalesce("component", F.when(F.col("n_shingles") == 0, F.col("doc_id"))))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
