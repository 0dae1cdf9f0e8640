import random
from collections import Counter

from postlane.llm import decontaminate as D

SF = "/root/testdata/sf0.001"


def brute(docs, items, k=5, percent=80):
    """Every window of an item's size, cut off at the ends of the text, against every item."""
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    split = lambda t: (t or "").encode().lower().split()
    out = {}
    for i, t in items:
        w = split(t)
        if not w:
            continue
        width = min(k, len(w))
        own = Counter(grams(w, width))
        m = sum(own.values())
        for d, text in docs:
            there = grams(split(text), width)
            for start in range(1 - m, len(there)):
                part = there[max(start, 0) : start + m]
                both = sum(min(own[g], n) for g, n in Counter(part).items())
                if 100 * both >= percent * (m + len(part) - both):
                    out[d, i] = max(out.get((d, i), 0), both / (m + len(part) - both))
    return out


def test_op6_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 1500]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = D.contaminated(df, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == set(want) and len(want) >= 2
    assert all(abs(r.similarity - want[r.doc_id, r.item_id]) < 1e-9 for r in got)


def test_edits_moves_and_swaps_equal_brute_force(spark):
    rng = random.Random(9)
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    around = [w for r in spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect() for w in (r.text or "").split()]
    docs = []
    for d in range(240):
        w = items[d % len(items)][1].split()
        n = len(w)
        kind = d % 6
        if kind == 0:  # halves swapped
            w = w[n // 2 :] + w[: n // 2]
        elif kind == 1:  # a part moved to the end
            a = rng.randrange(n)
            w = w[:a] + w[a + 4 :] + w[a : a + 4]
        elif kind == 2:  # words replaced
            for _ in range(rng.randrange(1, 3)):
                w[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
        elif kind == 3:  # words left out
            for _ in range(rng.randrange(1, 4)):
                w.pop(rng.randrange(len(w)))
        elif kind == 4:  # words put in
            w.insert(rng.randrange(n), f"y{rng.randrange(10**6)}")
        else:  # said twice
            w = w + w
        lead, tail = (rng.randrange(0, 60) * rng.randrange(2) for _ in range(2))
        at = rng.randrange(len(around) - 200)
        docs.append((d, " ".join([*around[at : at + lead], *w, *around[at + 100 : at + 100 + tail]])))
    want = brute(docs, items)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in D.contaminated(df, spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")).collect()}
    assert len(want) > 100 and {d % 6 for d, _ in want} == set(range(6))
    assert all(abs(want[x] - sim) < 1e-9 for x, sim in got.items())
    missed = {x: sim for x, sim in want.items() if x not in got}
    assert len(missed) <= len(want) // 100 and all(sim < 0.85 for sim in missed.values()), missed


def test_swapped_halves_are_found(spark):
    rng = random.Random(10)
    items = [(n, [f"n{rng.randrange(10**6)}" for _ in range(n)]) for n in (100, 60, 57, 400)]
    docs = [(n, [*w[n // 2 :], *w[: n // 2]]) for n, w in items]
    rows = lambda x: [(i, " ".join(w)) for i, w in x]
    got = D.contaminated(spark.createDataFrame(rows(docs), "doc_id bigint, text string"), spark.createDataFrame(rows(items), "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(n, n) for n, _ in items} == set(brute(rows(docs), rows(items)))


def test_many_items_of_one_size(spark):
    rng = random.Random(11)
    items = [(i, " ".join(f"n{rng.randrange(10**6)}" for _ in range(30 + i % 3))) for i in range(150)]
    docs = [(i, "before it " + t + " and after") for i, t in items]
    got = D.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.start_word, r.similarity) for r in got) == [(i, i, 2, 1.0) for i, _ in items]


def test_edits_short_items_and_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    new = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    item = new(50)
    items = [(1, " ".join(item)), (2, "Only THREE words"), (3, ""), (4, None)]
    docs = [(1, " ".join([*new(100), *item, *new(50)])), (2, " ".join([*new(9), *item[:25], "x", *item[26:], *new(9)])), (3, "so only three  words here"), (4, None), (5, ""), (None, " ".join(item)), (6, " ".join(new(30_000)))]
    benchmark, df = spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id bigint, text string, item_id int")
    want = {(1, 1), (2, 1), (3, 2), (None, 1)}
    assert {(r.doc_id, r.item_id) for r in D.contaminated(df, benchmark).collect()} == want
    monkeypatch.setattr(D, "ITEM_CHARS", 40)  # several passes
    assert {(r.doc_id, r.item_id) for r in D.contaminated(df, benchmark).collect()} == want
    assert D.contaminated(df.limit(0), benchmark).count() == 0 and D.contaminated(df, benchmark.limit(0)).count() == 0


def test_items_cut_off_by_the_ends_of_a_document(spark):
    rng = random.Random(7)
    new = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    item = new(60)
    docs = [
        (1, item[:-1]), (2, item[1:]), (3, [*item[:30], *item[31:]]), (4, [*new(40), *item[:-4]]), (5, [*item[4:], *new(40)]),
        (6, item[5:-5]), (7, [*new(9), *item[:-20]]), (8, item[:3]), (9, [*new(5), *item, *new(5)]),
    ]
    items = [(1, item), (2, [*item[:50], *new(10)])]
    want = brute([(d, " ".join(w)) for d, w in docs], [(i, " ".join(w)) for i, w in items])
    assert {(d, 1) for d in (1, 2, 3, 4, 5, 6, 9)} <= set(want) and not {(7, 1), (8, 1)} & set(want)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string")
    got = D.contaminated(df, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(want)
    size = {d: len(w) for d, w in docs}
    assert all(abs(r.similarity - want[r.doc_id, r.item_id]) < 1e-9 and r.start_word + r.n_words <= size[r.doc_id] for r in got)
