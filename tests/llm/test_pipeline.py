import corpus_pipeline
from postlane.llm import store
from tests.llm.test_near_dedup import brute
from tests.llm.test_tokens import check_packing, expected

SF = "/root/testdata/sf0.01"


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, store.saved(stage(spark, docs, SF))
        seen[name] = (before, docs)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.dtypes == before.dtypes
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    gone = ids(seen["toxicity"][0]) - ids(seen["toxicity"][1])
    assert gone and not [d for d in gone if labels.get(d) == 0]
    pairs = [(r.doc_id, r.text) for r in seen["near_dedup"][0].collect()]
    assert ids(seen["near_dedup"][1]) == {d for d, (_, root) in brute(pairs, 5, 80).items() if d == root}
    was, now = ({r.doc_id: r for r in df.collect()} for df in seen["passages"])
    cut = [d for d in now if now[d].text != was[d].text]
    assert cut and all(now[d].n_chars == len(now[d].text) for d in cut) and len(now) >= len(was) - 5
    assert ids(seen["decontamination"][1]) < ids(seen["decontamination"][0])
    left = [(r.doc_id, r.text) for r in docs.collect()]
    want = dict(zip([d for d, _ in left], expected([t for _, t in left], "byte_bpe_50k.json", 0)))
    bins, least = check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), want)
    assert bins <= 1.02 * least + 1
    assert len(corpus_pipeline.run(spark, SF).collect()) == sum(-(-len(x) // 2048) for x in want.values())


def test_stages_take_empty_tables_and_nulls(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", None, None, 0), (2, "", None, None, 0), (3, "word " * 30_000, "en", "s", 150_000)], schema)
    for start in (odd, odd.limit(0)):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = store.saved(stage(spark, docs, SF))
        assert docs.count() == start.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= start.count()
