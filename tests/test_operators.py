"""Edge cases of the index, intersection and codec operators."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from postlane.operators import codec as C
from postlane.operators import intersect as I
from postlane.operators import postings as P


def make(spark, lists):
    return spark.createDataFrame([(t, d) for t, ids in lists.items() for d in ids], "term_id bigint, doc_id bigint")


def ask(spark, queries):
    return spark.createDataFrame([(q, i, t) for q, terms in queries.items() for i, t in enumerate(terms)], "query_id bigint, ord int, term_id bigint")


def brute(lists, queries):
    out = set()
    for q, terms in queries.items():
        if terms:
            out |= {(q, d) for d in set.intersection(*(set(lists.get(t, ())) for t in terms))}
    return out


LISTS = {0: [3, 4], 1: [1, 2, 4, *range(6, 3000, 2)], 2: list(range(1, 1501)), 3: list(range(1, 1501)), 4: [1, 2, 3], 5: [1, 3], 6: [3000000000, 3000000007], 7: [1, 3]}
QUERIES = {0: [2, 3], 1: [0, 1], 2: [4, 5, 7], 3: [2], 4: [4, 4, 5], 5: [4, 99], 6: [0], 7: [6, 6], 8: [6, 1], 9: [0, 1, 2, 3, 4, 5, 7]}


@pytest.mark.parametrize("name", sorted(I.STRATEGIES))
def test_every_strategy_equals_brute_force(spark, name):
    got = I.STRATEGIES[name](make(spark, LISTS), ask(spark, QUERIES)).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(LISTS, QUERIES)


def test_small_blocks_ranges_and_buckets(spark):
    posts, queries = make(spark, LISTS), ask(spark, QUERIES)
    for got in (I.and_adp_block(posts, queries, size=4), I.and_adp_range(posts, queries, width=8), I.and_svs_range(posts, queries, width=8), I.and_hash_bucket(posts, queries, width=4), I.and_hash_dealt(posts, queries, width=4)):
        assert {tuple(r) for r in got.collect()} == brute(LISTS, QUERIES)


def test_sparse_lists_cost_no_more_than_others(spark):
    lists = {1: [i * 10**12 for i in range(1000)], 2: [i * 2 * 10**12 for i in range(1000)], 3: [5, 10**15]}
    for name in ("adp_block", "adp_range", "svs_range", "hash_bucket", "hash_dealt"):
        got = I.STRATEGIES[name](make(spark, lists), ask(spark, {0: [1, 2], 1: [1, 3], 2: [2, 3]})).collect()
        assert {tuple(r) for r in got} == brute(lists, {0: [1, 2], 1: [1, 3], 2: [2, 3]})


def test_plans_of_the_strategies_differ(spark):
    posts, queries = make(spark, LISTS), ask(spark, QUERIES)
    plan = lambda f: I.STRATEGIES[f](posts, queries)._jdf.queryExecution().optimizedPlan().toString()
    assert "forall" in plan("adp_range") and "forall" not in plan("svs_range") and "array_intersect" in plan("hash_dealt")
    # Ranges stay where they are: the joins by list and by query, and no shuffle by document.
    assert "doc_id" not in "".join(line for line in I.and_svs_range(posts, queries)._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(query_id" in line)


def shuffled(spark, df) -> tuple[int, int]:
    """(rows written to shuffles, rows of the result) of a query."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before, n = written(), len(df.collect())
    return written() - before, n


@pytest.fixture
def no_broadcast(spark):
    """Joins by shuffles, as over large tables."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["svs_range", "adp_range", "hash_dealt", "adp_block"])
def test_ids_that_another_list_rules_out_are_not_shuffled_by_query(spark, no_broadcast, name):
    lists = {t: range(t, 400_000 + t, 10_000) for t in range(100)}  # 40 ids each, in ranges of their own, all apart
    queries = {q: [q % 100, (q + 1) % 100, (q + 2) % 100] for q in range(2000)}
    rows, n = shuffled(spark, I.STRATEGIES[name](make(spark, lists), ask(spark, queries)))
    assert n == 0 and rows < 70_000  # 4000 postings, 6000 terms of queries; these would meet 240,000 ids


def test_pairs_of_short_documents_do_not_join_whole_lists(spark, no_broadcast):
    lists = {t: range(t, 4000 + t, 100) for t in range(100)}
    queries = {(q, k): [(q + i * k) % 100 for i in range(4)] for q in range(100) for k in range(1, 12)}
    rows, n = shuffled(spark, I.pair_counts(make(spark, lists), ask(spark, {i: t for i, t in enumerate(queries.values())})))
    assert n > 1500 and rows < 50_000  # 4000 postings, 4400 terms of queries; the pairs would meet 40 ids each


def test_pairs_of_short_and_long_documents(spark):
    lists = {t: [0, *range(t, 60, t + 2), 100 + t] for t in range(40)}  # document 0 holds all terms, and few pairs are asked for
    queries = {0: [1, 2, 3], 1: [2, 3, 39], 2: [5, 77], 3: [8, 8, 9], 4: [6]}
    want = {(a, b): len(set(lists.get(a, ())) & set(lists.get(b, ()))) for q in queries.values() for a in q for b in q if a < b}
    assert {(r.term_a, r.term_b): r.n for r in I.pair_counts(make(spark, lists), ask(spark, queries)).collect()} == want


def test_marks_keep_what_all_lists_hold(spark):
    posts, queries = make(spark, LISTS), ask(spark, QUERIES)
    marks = P.query_marks(posts, queries)
    kept = marks.join(posts.select("doc_id").distinct(), P.marked(posts["doc_id"], marks["marks"])).select("query_id", "doc_id").collect()
    assert {tuple(r) for r in kept} >= brute(LISTS, QUERIES) and not [r for r in kept if r.query_id == 5]
    assert {tuple(r) for r in I.and_division(posts, queries, sift=True).collect()} == brute(LISTS, QUERIES)


def test_spans_of_long_lists(spark):
    lists = {1: [0, 3, 4, 9, 10, 11, 30, 31], 2: [7], 3: [2**32 - 1]}
    got = {(r.term_id, r.doc_id): (r.pos, r.before) for r in P.positions(make(spark, lists), span=5).collect()}
    assert got == {(t, d): (i, ids[i - 1] if i else None) for t, ids in lists.items() for i, d in enumerate(ids)}
    probes = spark.createDataFrame([(t, x) for t in (1, 2, 9) for x in range(0, 40)], "term_id bigint, target bigint")
    got = {(r.term_id, r.target): r.pos for r in P.lower_bound(make(spark, lists), probes, span=5).collect()}
    assert got == {(t, x): sum(d < x for d in lists.get(t, [])) for t in (1, 2, 9) for x in range(40)}
    blocks = spark.createDataFrame([(1, 3), (1, 10), (1, 30)], "term_id bigint, lo bigint")
    got = {(r.term_id, r.doc_id): r.lo for r in P.block_of(blocks, probes.withColumnRenamed("target", "doc_id"), span=5).collect()}
    assert all(got[1, x] == max((lo for lo in (3, 10, 30) if lo <= x), default=None) for x in range(40)) and got[2, 7] is None


@pytest.mark.parametrize("ids", [[-3, 9], [2**32], [5, 2**40]])
def test_ids_that_the_format_cannot_hold_raise(spark, ids):
    for f in (C.compress, C.pack_stream, C.headers, C.pack_words):
        with pytest.raises(Exception, match="outside 0 to 4294967295"):
            f(make(spark, {1: ids})).collect()


def test_metrics_of_an_empty_index(spark):
    got = {r.metric: r.value for r in C.metrics(make(spark, {1: [1]}).limit(0)).collect()}
    assert got["lists"] == got["postings"] == got["bits"] == 0 and got["max_doc_id"] is None and got["bits_per_posting"] is None


def test_no_queries_and_chooser(spark):
    none = ask(spark, {}).limit(0)
    assert all(f(make(spark, LISTS), none).count() == 0 for f in I.STRATEGIES.values())
    assert I.choose(make(spark, LISTS), ask(spark, {0: [0, 2]})) == "svs_semi" and I.choose(make(spark, LISTS), ask(spark, {0: [2, 3]})) == "division"


def test_multiset_membership_keeps_repeats_of_the_first_list(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id bigint")
    assert [r.doc_id for r in I.semi_multiset(ids(5, 5, 6), [ids(5), ids(5, 5, 7)]).collect()] == [5, 5]


def test_lower_bound(spark):
    probes = spark.createDataFrame([(4, 0), (4, 2), (4, 3), (4, 9), (99, 1), (6, 3000000001)], "term_id bigint, target bigint")
    got = {(r.term_id, r.target): r.pos for r in P.lower_bound(make(spark, LISTS), probes).collect()}
    assert got == {(4, 0): 0, (4, 2): 1, (4, 3): 2, (4, 9): 3, (99, 1): 0, (6, 3000000001): 1}


def test_stats_count_empty_lists(spark):
    terms = spark.createDataFrame([(t,) for t in (1, 2, 3)], "term_id bigint")
    assert tuple(P.index_stats(make(spark, {1: [5, 9], 2: [7, 8]}), terms).first()) == (3, 4, 9, 4 / 3)


# Words of single lists.
GOLDEN = [
    ([1, 5, 9], [3, 18499]), ([0], [1, 0]), ([0, 0, 0], [3, 0]), ([7, 7, 8], [3, 4547]), (list(range(100, 107)), [7, 135280903, 66052]),
    ([3000000000, 3000000007], [2, 3021439008, 492, 0]), ([4294967295], [1, 4294967264, 63]),
]


def test_golden_words(spark):
    lists = {i: ids for i, (ids, _) in enumerate(GOLDEN)}
    got = {r.term_id: r.words for r in C.compress(make(spark, lists)).collect()}
    assert got == {i: words for i, (_, words) in enumerate(GOLDEN)}


def test_golden_stream_and_offsets(spark):
    posts = make(spark, {0: [1, 5, 9], 1: [2, 3, 10, 11, 40]})
    assert [r.word for r in C.pack_stream(posts).orderBy("k").collect()] == [3, 182339, 2218950656, 14867]
    offsets = C.stream_offsets(C.headers(posts))
    assert sorted((r.start_bit, r.end_bit) for r in offsets.collect()) == [(0, 47), (47, 110)]
    back = C.decode(C.unpack_stream(C.pack_stream(posts), offsets)).collect()
    assert sorted(map(tuple, back)) == [(0, 1), (0, 5), (0, 9), (1, 2), (1, 3), (1, 10), (1, 11), (1, 40)]


def test_empty_list_is_a_header(spark):
    terms = spark.createDataFrame([(0,), (1,)], "term_id bigint")
    lists = C.compress(make(spark, {0: [7]}), terms)
    assert {r.term_id: (r.n, r.w, r.words) for r in lists.collect()} == {0: (1, 3, [1, 3 | 7 << 6]), 1: (0, 0, [0, 0])}
    assert [tuple(r) for r in C.decode(lists).collect()] == [(0, 7)]


@pytest.mark.parametrize("gap,width", [(0, 0), (1, 1), (2, 2), (3, 2), (4, 3), (2**29 - 1, 29), (2**31 - 1, 31), (2**31, 32), (2**32 - 1, 32)])
def test_bit_width(spark, gap, width):
    assert C.headers(make(spark, {0: [gap]})).first().w == width


ids = st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**32 - 1)), max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 9), ids, min_size=1, max_size=5))
def test_round_trips(spark, lists):
    posts = make(spark, lists) if any(lists.values()) else make(spark, {0: [1]}).limit(0)
    want = sorted((t, d) for t, x in lists.items() for d in x)
    packed = C.compress(posts)
    for f in (C.decode, C.decode_two_level):
        assert sorted(map(tuple, f(packed).collect())) == want
    assert C.roundtrip_diff(posts).first().n_diff == 0
