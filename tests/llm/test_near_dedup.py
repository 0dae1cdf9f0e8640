import random

import pytest

from postlane.llm import near_dedup
from postlane.llm.components import components
from postlane.llm.registry import ORACLE_SQL, QUERIES
from tests.compare import differences


def test_op1_equals_sql(spark):
    assert differences(spark, QUERIES["op1_minhash_near_dedup"], ORACLE_SQL["op1_minhash_near_dedup"], "/root/testdata/sf0.01") == []


def sets(text, k):
    w = text.encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute(docs, k, percent):
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    have = [(d, sets(t or "", k)) for d, t in docs]
    for i, (d, x) in enumerate(have):
        for e, y in have[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y) and find(d) != find(e):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return {d: (len(x), find(d)) for d, x in have}


@pytest.mark.parametrize("region", [1024, 64])
def test_dense_group_equals_brute_force(spark, region):
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    docs = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, region=region).collect()}
    want = brute(docs, 4, 80)
    wrong = [d for d in want if got[d] != want[d]]
    assert wrong == []


@pytest.mark.parametrize("region,piece", [(1024, 20_000), (64, 100), (32, 40)])
def test_large_groups_are_one_component(spark, region, piece):
    rng = random.Random(6)
    body = [f"w{rng.randrange(10**6)}" for _ in range(303)]
    tails = [(i, " ".join([*body, *(f"t{i}-{j}" for j in range(4))])) for i in range(1100)]
    other = [f"v{rng.randrange(10**6)}" for _ in range(400)]
    words = [(5000 + i, " ".join([*other[: i % 400], f"x{i}", *other[i % 400 + 1 :]])) for i in range(1500)]
    near = near_dedup.near_duplicates(spark.createDataFrame(tails + words, "doc_id bigint, text string"), region=region, piece=piece)
    got = {}
    for r in near.collect():
        got.setdefault(r.component_id, []).append(r.doc_id)
    assert {k: len(v) for k, v in got.items()} == {0: 1100, 5000: 1500}


@pytest.mark.parametrize("seed", range(3))
def test_a_link_behind_many_pairs_just_below_it(spark, seed):
    # One document at 0.8004 of a component, and 90 others of it at 0.7988, which look as good by any signature.
    rng = random.Random(seed)
    body = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    tail = lambda name, n: " ".join([*body, *(f"{name}-{seed}-{j}" for j in range(n))])
    docs = [(i, tail(f"y{i}", 45)) for i in range(90)] + [(90, tail("z", 44)), (500, tail("x", 55))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    want = brute(docs, 4, 80)
    assert want[500][1] == 0 and got == want


def test_against_all_counts_full_sets_in_chunks(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(words[j] if rng.random() > 0.04 else f"e{rng.randrange(99)}" for j in range(60)) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    members = spark.createDataFrame([(i, 10 + i // 30) for i in range(20, 60)], "id bigint, label bigint")
    asked = [(x, other) for x in range(20) for other in (10, 11)]
    near = lambda a, b: 100 * len(sets(texts[a], 4) & sets(texts[b], 4)) >= 80 * len(sets(texts[a], 4) | sets(texts[b], 4))
    label = {i: 10 + i // 30 for i in range(20, 60)}
    for chunk in (4, 512):
        got = near_dedup.against_all(spark.createDataFrame(asked, "x bigint, other bigint"), members, docs, 4, 80, chunk).collect()
        assert all(near(r.a, r.b) for r in got)
        assert {(r.a, label[r.b]) for r in got} == {(x, label[y]) for x in range(20) for y in label if near(x, y)}


def test_runs_cover_all_places_and_hold_representatives():
    for members, region in ((1, 4), (4, 4), (5, 4), (23, 4), (100, 7)):
        got = [r.tolist() for r in near_dedup.runs(members, region)]
        assert {x for r in got for x in r} == set(range(members))
        assert all(a[-1] >= b[k] for k, (a, b) in enumerate(zip(got, got[1:]))) and all(r[:k] == [g[j] for j, g in enumerate(got[:k])] for k, r in enumerate(got))


def test_odd_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \t ", 9), (4, "One two", 9), (5, "one  TWO", 9), (5, "one  TWO", 9), (None, "one two", 9), (7, "é " * 30_000, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(-1, 1, 4, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (7, 1, 7, True)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([*zip(order, order[1:]), (900, 800)], "a bigint, b bigint")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(300)}, 800: 800, 900: 800}


def test_components_of_stars_with_salted_hubs(spark, monkeypatch):
    from postlane.llm import components as C

    monkeypatch.setattr(C, "HUB", 10)
    links = [(50, i) for i in range(51, 120)] + [(119, 3)] + [(200, i) for i in range(201, 215)] + [(400, 401)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint"), None).collect()}
    assert got == {3: 3, **{i: 3 for i in range(50, 120)}, **{i: 200 for i in range(200, 215)}, 400: 400, 401: 400}
