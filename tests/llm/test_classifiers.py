import numpy as np
from pyspark.sql import functions as F

from postlane.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def test_op3_held_out_accuracy(spark):
    got = toxicity.toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").select("toxic", "predicted", "score").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    false = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(caught) > 0.7 and np.mean(false) < 0.01
    ones, zeros = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    assert np.mean([a > b for a in ones for b in zeros]) > 0.93
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_held_out_labels_and_other_columns_change_nothing(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.toxicity(docs.withColumn("lang", F.lit("xx")), flipped).collect()}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_label_model_finds_accuracies_and_correlated_copies():
    rng = np.random.default_rng(0)
    y = rng.random(60_000) < 0.2
    hit, miss = np.array([0.7, 0.6, 0.5, 0.4, 0.65, 0.3]), np.array([0.05, 0.1, 0.02, 0.3, 0.08, 0.3])
    votes = (rng.random((60_000, 6)) < np.where(y[:, None], hit, miss)).astype(float)
    votes = np.concatenate([votes, np.abs(votes[:, 2:3] - (rng.random((60_000, 1)) < 0.02))], 1)
    none = (rng.random((60_000, 1)) < np.where(y, 0.1, 0.9)[:, None]).astype(float)
    votes = np.concatenate([votes, none], 1)
    marked = rng.random(60_000) < 0.3
    by_class = np.array([votes[marked & ~y].sum(0), votes[marked & y].sum(0)])
    model = toxicity.LabelModel(votes.T @ votes, len(votes), by_class, np.array([(marked & ~y).sum(), (marked & y).sum()]))
    assert np.abs(model.accuracy[0][:5] - hit[:5]).max() < 0.06 and np.abs(model.accuracy[1][:5] - miss[:5]).max() < 0.03
    assert abs(model.correlation[2, 6]) > 0.3 and abs(model.correlation[0, 1]) == 0
    assert model.weights[2] + model.weights[6] < 1.5 * np.log(hit[2] / miss[2])
    assert ((model.log_odds(votes) > 0) == y).mean() > 0.9


def test_targets_are_posteriors_that_can_overrule_labels(spark):
    rng = np.random.default_rng(1)
    bad, good = [f"vile{i}" for i in range(6)] + [f"foul{i}" for i in range(6)], [f"n{i}" for i in range(400)]
    docs, labels = [], []
    for d in range(1500):
        toxic = d % 5 == 0
        words = list(rng.choice(good, 30)) + (list(rng.choice(bad, 6, replace=False)) if toxic else [])
        docs.append((d, " ".join(words)))
        if d % 3:
            labels.append((d, int(toxic)))
    # Wrong labels on texts where the votes leave no doubt, a text without any vote that is labelled toxic, and a null id.
    docs += [(2001, " ".join([*good[:30], *bad[3:9]])), (2003, " ".join(good[:30])), (None, " ".join(bad))]
    labels += [(2001, 0), (2003, 1), (None, 0)]
    known = ~toxicity.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").filter(known)
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int").filter(known)
    texts, posterior, label = toxicity.targets(frame, marks)
    gold = np.array([any(b in t.split() for b in bad) for t in texts])
    overruled = (label >= 0) & ((posterior > 0.5) != (label == 1))
    assert overruled.any() and (posterior[gold] > 0.5).all()
    plain = label < 0
    assert plain.sum() > 300 and ((posterior[plain] > 0.5) == gold[plain]).all()
    assert len(texts) == frame.count()


def odd(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "some words", "c"), (3, "some words", "d"), (3, "some words", "d"), (4, "w " * 40_000, "e")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(1, None, None), (2, 1, 0), (None, 0, 1), (3, 0, 1), (4, 1, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_odd_rows(spark):
    docs, labels = odd(spark)
    for rows in (toxicity.toxicity(docs, labels), toxicity.toxicity(docs, labels.limit(0))):
        got = rows.collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    for rows in (quality.quality(docs, labels), quality.quality(docs, labels.limit(0))):
        got = rows.collect()
        assert len(got) == 6 and all(0 <= r.p_selected <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0 and quality.quality(docs.limit(0), labels).count() == 0


def test_op9_separates_grades(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train, test = labels.filter("doc_id % 5 <> 0"), labels.filter("doc_id % 5 = 0")
    rows = quality.quality(docs, train).join(test, "doc_id").collect()
    assert np.mean([r.selected == (r.quality == 1) for r in rows]) > 0.97
    by = [np.mean([r.expected_grade for r in rows if (r.quality, r.toxic) == k]) for k in ((0, 0), (1, 1), (1, 0))]
    assert by == sorted(by)


def test_cumulative_link_recovers_ordered_thresholds():
    rng = np.random.default_rng(3)
    texts, grades = [], []
    for _ in range(1500):
        g = int(rng.integers(0, 4))
        texts.append(" ".join(rng.choice(["good", "Bad!!"], 40, p=[(g + 0.5) / 4, 1 - (g + 0.5) / 4])))
        grades.append(g)
    model = quality.fit(texts, np.array(grades), levels=4)
    assert (np.diff(model.thresholds) > 0).all()
    maker = quality.Features()
    scores = np.array([float(model.weights[at] @ value) for at, value in map(maker.of, texts)])
    expected = model.tails(scores).sum(1)
    assert np.abs(expected - np.array(grades)).mean() < 0.5


def test_scores_equal_the_sum_over_all_terms():
    weights = {"idio*": 1.5, "idiot": 0.5, "ab": 2.0, "xyz": -1.0, "réé*": 3.0}
    own = toxicity.Scorer(weights, -1.0)
    for text in ("an IDIOT, idiots! (idiotic", "ab. ,ab, abcdefgh", '"xyz" xyz-', "ab,,,,,, ...ab...", "rééux; Réé", "a--------", "", None, "clean words onlyhere"):
        z = -1.0 + sum(weights.get(t, 0) for t in {t for w in toxicity.distinct_words(text) for t in toxicity.terms(w)})
        assert abs(own.score(text) - 1 / (1 + np.exp(-z))) < 1e-12


def test_op9_reads_whole_words():
    maker = quality.Features()
    long = "a" * 40
    a, b = (maker.of(long + end)[0].tolist() for end in ("b", "7!"))
    assert quality.shape(long + "b") != quality.shape(long + "7!") and set(a[:1]).isdisjoint(b[:1])
