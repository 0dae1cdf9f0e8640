import struct

import pytest

from postlane import sources as S
from postlane import streaming
from postlane.operators import intersect as I
from postlane.operators import postings as P
from postlane.sources import places


def test_index_file_round_trip(spark, tmp_path):
    lists = [[9, 1, 5], [], [3000000000, 7]]
    (tmp_path / "a.bin").write_bytes(b"".join(struct.pack(f"<i{len(x)}I", len(x), *x) for x in lists))
    got = S.read_index(spark, str(tmp_path / "a.bin")).orderBy("term_id").collect()
    assert [(r.term_id, r.len, r.doc_ids) for r in got] == [(0, 3, [1, 5, 9]), (1, 0, []), (2, 2, [7, 3000000000])]
    S.write_index(S.read_index(spark, str(tmp_path / "a.bin")), str(tmp_path / "out"))
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").iterdir()))
    assert whole == b"".join(struct.pack(f"<i{len(x)}I", len(x), *sorted(x)) for x in lists)
    (tmp_path / "short.bin").write_bytes(struct.pack("<iI", 3, 1))
    with pytest.raises(Exception, match="cut short"):
        S.read_index(spark, str(tmp_path / "short.bin")).collect()


def test_query_file(spark, tmp_path):
    (tmp_path / "q.txt").write_text("1 2 3 \n5 0 7\n\n  1 2 3 4 5 6\n8 9")
    got = S.read_queries(spark, str(tmp_path / "q.txt")).orderBy("query_id", "ord").collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r.term_id)
    assert by == {0: [1, 2, 3], 1: [5, 0, 7], 3: [1, 2, 3, 4, 5, 6], 4: [8, 9]}
    (tmp_path / "bad.txt").write_text("1 x")
    with pytest.raises(Exception, match="x"):
        S.read_queries(spark, str(tmp_path / "bad.txt")).collect()


def test_word_file_round_trip(spark, tmp_path):
    words = [3, 182339, 2218950656, 14867, 0, 4294967295]
    df = spark.createDataFrame(list(enumerate(words)), "k bigint, word bigint")
    S.write_words(df, str(tmp_path / "w"))
    S.write_words(df, str(tmp_path / "w"))  # overwrites
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").iterdir()))
    assert whole == struct.pack("<6I", *words)
    (tmp_path / "one.bin").write_bytes(whole + b"\x01")
    assert [(r.pos, r.word) for r in S.read_words(spark, str(tmp_path / "one.bin")).orderBy("pos").collect()] == list(enumerate(words))


def test_files_count_on_and_uris_are_taken(spark, tmp_path):
    lists = spark.createDataFrame([(i, [i, i + 5] if i % 7 else []) for i in range(60)], "term_id bigint, doc_ids array<bigint>")
    S.write_index(lists, f"file://{tmp_path}/index")
    got = S.numbered(S.read_index(spark, f"file://{tmp_path}/index"), "term_id", "term_id").collect()
    assert {r.term_id: r.doc_ids for r in got} == {i: [i, i + 5] if i % 7 else [] for i in range(60)}
    queries = spark.createDataFrame([(2, 0, 9), (2, 1, 3), (5, 0, 7)], "query_id bigint, ord int, term_id bigint")
    S.write_queries(queries, str(tmp_path / "q"))
    assert sorted(map(tuple, S.read_queries(spark, str(tmp_path / "q")).collect())) == [(2, 0, 9), (2, 1, 3), (5, 0, 7)]
    S.write_queries(queries.limit(0), str(tmp_path / "none"))
    assert S.read_queries(spark, str(tmp_path / "none")).count() == 0


def test_offsets_from_a_word_file(spark, tmp_path):
    for name, words, want in (
        ("a", [3, 182339, 2218950656, 14867], [(0, 0, 47), (1, 47, 110)]), ("b", [1, 0], [(0, 0, 38)]), ("c", [], []),
        ("d", [2, 3021439008, 492, 0], [(0, 0, 102)]),
    ):
        (tmp_path / name).write_bytes(struct.pack(f"<{len(words)}I", *words))
        assert sorted(map(tuple, S.stream_offsets(spark, str(tmp_path / name)).collect())) == want
    (tmp_path / "short").write_bytes(struct.pack("<2I", 9, 63))
    with pytest.raises(Exception, match="cut short"):
        S.stream_offsets(spark, str(tmp_path / "short")).collect()


def test_no_machine_local_folder_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://https://x"):
        with pytest.raises(ValueError, match="checkpoint"):
            places.own_root(master)
    assert places.own_root("local[4]") == places.own_root("local") == places.own_root("local[*]")


def test_streamed_queries(spark, tmp_path):
    posts = spark.createDataFrame([(1, 5), (1, 6), (2, 6)], "term_id bigint, doc_id bigint")
    spark.createDataFrame([(7, 0, 1), (7, 1, 2), (8, 0, 1)], "query_id bigint, ord int, term_id bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id bigint, ord int, term_id bigint").parquet(str(tmp_path / "in"))
    found = []
    query = streaming.answer(stream, posts, lambda df, _: found.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(found) == [(7, 6), (8, 5), (8, 6)]


def test_index_from_tables(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (None, 3), (4, None)], "a int, b int")
    assert [tuple(r) for r in P.postings_from(df, "a", "b").collect()] == [(1, 2)]
    assert P.postings_from(df, "a", "b", multiset=True).count() == 2
    assert I.search(P.postings_from(df, "a", "b"), P.queries_from(df, "b", "a")).collect()[0][:2] == (2, 2)
