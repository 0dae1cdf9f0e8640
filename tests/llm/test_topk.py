import math
import random

import numpy as np
from pyspark.sql import functions as F

from postlane.llm import topk
from postlane.llm.registry import ORACLE_SQL, QUERIES
from tests.compare import differences


def test_op2_equals_sql(spark):
    assert differences(spark, QUERIES["op2_maxscore_top_k"], ORACLE_SQL["op2_maxscore_top_k"], "/root/testdata/sf0.01") == []


MOST = (1 << 63) - 1


def brute(rows, k):
    """Scores beyond a long rank as the nearest one."""
    clip = lambda s: max(min(s, MOST), -MOST - 1)
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % 3 == 0:
            found = sorted((-clip(sum(x * y for x, y in zip(a, b))), i) for i, b in good if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


def test_ties_repeats_and_odd_vectors(spark, monkeypatch):
    rng = random.Random(7)
    hot = [rng.uniform(-1, 1) for _ in range(12)]
    rows = [(i, hot if i % 4 == 0 else [rng.uniform(-1, 1) for _ in range(12)]) for i in range(400)]
    rows += [(1000, None), (1002, [0.5, None] + [0.1] * 10), (1005, [float("nan")] * 12), (1008, [float("inf")] * 12), (None, hot), (1011, []), (1014, [1.0, -1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, rank string").repartition(3)
    monkeypatch.setattr(topk, "SHARD", 64)
    monkeypatch.setattr(topk, "QUERIES", 16)
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 3 == 0, 5).collect()}
    assert got == brute(rows, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 3 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]


def test_large_components_and_repeated_ids(spark):
    rows = [(0, None), (0, [1.0, 2.0]), (1, [float(1 << 40), 3.0]), (2, [float(1 << 23), -5.0]), (3, [1.0, 1e300]), (4, [1e308, 0.0]), (6, [float(1 << 40), 7.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 3 == 0, 5).collect()}
    assert got == brute([r for r in rows if r[0] != 4], 5)
    # An id with two vectors is asked once, with the lesser one, and is a candidate twice.
    twice = spark.createDataFrame([(0, [2.0]), (0, [1.0]), (1, [1.0]), (1, [3.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(twice, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 768), (0, 2, 1, 256 * 256)]


def test_max_score_prunes_and_stays_exact():
    rng = np.random.default_rng(1)
    rows = np.floor(256 * rng.normal(size=(3000, 32)) * np.geomspace(1, 0.01, 32))
    work, full_work = [0], 0
    for _ in range(20):
        q = np.floor(256 * rng.normal(size=32) * np.geomspace(1, 0.01, 32))
        own = rng.random(3000) < 0.01
        full = np.where(own, -np.inf, rows @ q)
        want = np.lexsort((np.arange(3000), -full))[:5]
        for least in (-np.inf, full[want[-1]], full[want[2]]):
            places, scores = topk.max_score(q, rows, rows.min(0), rows.max(0), own, 5, least, work)
            sure = [i for i in want.tolist() if full[i] >= least]
            assert places.tolist()[: len(sure)] == sure and scores[: len(sure)] == full[sure].tolist()
            full_work += rows.size
    assert work[0] < 0.6 * full_work
