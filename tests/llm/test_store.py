from postlane.llm import store


def test_lean_only_lowers_the_default(spark):
    key, df = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(1)
    was = spark.conf.get(key)
    try:
        for given, want in (("67108864b", store.BATCH_BYTES), ("1048576b", "1048576b"), ("64kb", "64kb")):
            spark.conf.set(key, given)
            assert store.lean(df) is df and spark.conf.get(key) == want
    finally:
        spark.conf.set(key, was)


def test_saved_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, None, [1.0]), (None, "x", None)], "a bigint, b string, c array<double>")
    back = store.saved(df)
    assert back.schema == df.schema and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_without_ids_either_way(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id bigint, text string")
    ids = spark.createDataFrame([(1,), (1,), (None,)], "doc_id bigint")
    for few in (0, 500_000):
        assert sorted(r.text for r in store.without_ids(docs, ids, few).collect()) == ["b", "c"]


def test_settled_keeps_the_last_table_only(spark):
    import os

    since = store.mark()
    a = store.saved(spark.range(5))
    was = store._MADE[-1].removeprefix("file://")
    b = store.settled(a.filter("id > 1"), since)
    (left,) = store._MADE[since:]
    assert sorted(r.id for r in b.collect()) == [2, 3, 4] and os.path.isdir(left.removeprefix("file://"))
    assert not os.path.isdir(was)



def test_what_was_shuffled_for_a_saved_table_goes_with_the_write(spark):
    jvm, key = spark.sparkContext._jvm, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = lambda: {f for f in str(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")).split() if "/shuffle_" in f}
    was, before = spark.conf.get(key, None), files()
    df = spark.range(1000).repartition(7, "id")
    back = store.saved(df)
    assert not files() - before and spark.conf.get(key, None) == was
    assert back.count() == df.count() == 1000
