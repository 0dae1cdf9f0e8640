import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

from postlane.llm import sharding
from postlane.llm.registry import op8_histogram_shards


def brute(docs, shards):
    rows = sorted((hashlib.md5((t or "").encode()).hexdigest(), d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    total, below, slots, out = sum(r[2] for r in rows), 0, [0] * shards, []
    weight = Counter()
    for key, _, size, _ in rows:
        weight[key] += size
    group, first = None, 0
    for key, d, size, crc in rows:
        if key != group:
            group, first = key, below * shards // total
        s = first if weight[key] * shards * 100 <= total else below * shards // total
        out.append((d, size, crc, s, slots[s]))
        slots[s] += 1
        below += size
    return sorted(out)


def test_op8_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = op8_histogram_shards(spark, "/root/testdata/sf0.01").select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(map(tuple, got)) == brute(docs, 24)


def test_hot_text_is_split_and_nulls_are_kept(spark):
    docs = [(i, "hot") for i in range(-3000, 3000)] + [(i, None) for i in range(5000, 5500)] + [(9000 + i, "x" * i) for i in range(100)]
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id bigint, text string, slot int, key string")
    got = sharding.shard_documents(df, 7).collect()
    want = {(d, s, k) for d, _, _, s, k in brute(docs, 7)}
    assert {(r.doc_id, r.shard, r.slot) for r in got} == want
    assert {r.key for r in got} == {"k"}
    assert sharding.shard_documents(df.limit(0), 7).count() == 0
    assert sharding.shard_documents(spark.createDataFrame([(None, None)], "doc_id bigint, text string"), 3).count() == 1


def test_small_groups_of_copies_stay_together(spark):
    docs = [(i, f"text {i % 900} " * 3) for i in range(9000)]
    got = sharding.shard_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), 4).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(d, s, k) for d, _, _, s, k in brute(docs, 4)}
    homes = {}
    for r in got:
        homes.setdefault(r.text, set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_probes_stay_few_for_any_number_of_partitions(spark):
    docs = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(20_000)], "doc_id bigint, text string")
    slim = docs.select(sharding.key_of(F.col("text"), F.col("doc_id")).alias("key"), F.lit(10).cast("bigint").alias("size"))
    cells, _ = sharding._cells(slim, 24, 20, 3)
    assert len(cells) < 20_000 and sum(c[2] for c in cells) == 20_000
