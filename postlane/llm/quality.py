"""Quality by ordinal regression: a cumulative-link model on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered
thresholds cut its score: P(grade > j) = sigmoid(score - threshold j). A
document's expected grade is the sum of these tail probabilities, and it is
selected by the tail probability of the grade that is asked for.

Features are counts per word, hashed into 2^18 places: word shapes (case,
letters, digits, the punctuation that follows), punctuation runs, words, and
binned statistics of the whole text (share of capitals, of repeated words, of
punctuation, of words that repeat the word before; word length; length).
Grades: 0 where quality is 0, 1 where quality is 1 and the text is toxic, 2
where quality is 1 and it is not, or is not labelled toxic either way; rows
without quality (null or neither 0 nor 1) are no ratings. Fitted on at most
FIT_ROWS labelled rows, by hash order; every text is scored whole, words of any
length too.

Null and empty texts have the one feature of an empty text. Null ids and
repeated rows get their rows; where an id repeats among the rated rows, its
least text counts. Equal scores stay equal: no order breaks ties. Without labels
(an empty table, or one grade only) all have score 0, and tails by thresholds 0
and 1. An empty table gives no rows. Other columns are not read, whatever their
names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlane.llm import store, tokens

PLACES, FIT_ROWS, GRADES = 1 << 18, 5_000, 3
_PARTS = re.compile(r"([^\W_]+)|([\W_]+)")


def shape(word: str) -> str:
    """A word's case and marks: runs of one kind of character as one sign."""
    out: list[str] = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
        elif kind not in "Aa0" and (len(out) < 2 or out[-2] != kind):
            out.append(kind)
    return "".join(out)


def place(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) & (PLACES - 1)


class Features:
    """(places, values) of a text; a word's own places are worked out once."""

    def __init__(self) -> None:
        self.words: dict[str, tuple[int, int, int, int, int]] = {}

    def _word(self, w: str) -> tuple[int, int, int, int, int]:
        got = self.words.get(w)
        if got is None:
            if len(self.words) > 300_000:
                self.words.clear()
            marks = sum(not c.isalnum() for c in w)
            got = self.words[w] = (place("s:" + shape(w)), place("w:" + w.lower()), sum(c.isupper() for c in w), marks, len(w))
        return got

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        if not words:
            return np.array([place("b:empty")]), np.array([1.0])
        count = Counter(words)
        got = [self._word(w) for w in count]
        n, times = len(words), np.fromiter(count.values(), np.float64, len(count))
        table = np.array(got)
        caps, marks, chars = (float((table[:, k] * times).sum()) for k in (2, 3, 4))
        same = sum(a == b for a, b in zip(words, words[1:])) / n
        bins = [("caps", caps / chars, 20), ("marks", marks / chars, 20), ("kinds", len(count) / n, 10), ("same", same, 20), ("chars", min(chars / n / 20, 1), 20), ("size", min(np.log2(n + 1) / 20, 1), 20)]
        fixed = [place(f"b:{name}:{int(x * steps)}") for name, x, steps in bins] + [place("b:one")]
        return np.concatenate([table[:, 0], table[:, 1], fixed]), np.concatenate([times / n, times / n * 0.5, np.full(len(fixed), 0.5)])


class Ordinal:
    """Weights and ascending thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j, one column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -50, 50)))


def fit(texts: list[str | None], grades: np.ndarray, levels: int = GRADES, rounds: int = 300) -> Ordinal:
    """Maximum likelihood of the cumulative model by Adagrad, weights shrunk a little.

    Thresholds are a first value and positive steps, so they stay in order.
    """
    maker = Features()
    rows = [maker.of(t) for t in texts]
    used, at = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    value, owner = np.concatenate([r[1] for r in rows]), np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    share = np.array([np.mean(grades > j) for j in range(levels - 1)]).clip(1e-3, 1 - 1e-3)
    cut = -np.log(share / (1 - share))
    first, steps = cut[0], np.log(np.maximum(np.diff(cut), 1e-2))
    w, hist, hf, hs = np.zeros(len(used)), np.full(len(used), 1e-8), 1e-8, np.full(levels - 2, 1e-8)
    cells = np.arange(len(rows))
    for _ in range(rounds):
        score = np.bincount(owner, w[at] * value, len(rows))
        cut = first + np.concatenate([[0], np.cumsum(np.exp(steps))])
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - cut, -50, 50)))
        edge = np.concatenate([np.ones((len(rows), 1)), tail, np.zeros((len(rows), 1))], 1)
        slope = edge * (1 - edge)
        prob = np.maximum(edge[cells, grades] - edge[cells, grades + 1], 1e-9)
        up, down = slope[cells, grades] / prob, slope[cells, grades + 1] / prob
        g = -np.bincount(at, (up - down)[owner] * value, len(used)) / len(rows) + 1e-6 * w
        per_cut = np.zeros(levels - 1)
        for j in range(levels - 1):
            per_cut[j] = (np.where(grades == j + 1, up, 0) - np.where(grades == j, down, 0)).sum() / len(rows)
        gf = per_cut.sum()
        gs = np.array([per_cut[j + 1 :].sum() for j in range(levels - 2)]) * np.exp(steps)
        hist, hf, hs = hist + g * g, hf + gf * gf, hs + gs * gs
        w, first, steps = w - 0.5 * g / np.sqrt(hist), first - 0.1 * gf / hf**0.5, np.clip(steps - 0.1 * gs / np.sqrt(hs), -5, 5)
    weights = np.zeros(PLACES, np.float32)
    weights[used] = w
    return Ordinal(weights, first + np.concatenate([[0], np.cumsum(np.exp(steps))]))


def train(docs: DataFrame, labels: DataFrame) -> Ordinal:
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)
    docs = store.lean(docs)
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), grade.alias("grade")).filter("doc_id is not null and grade is not null")
    chosen = marks.orderBy(F.xxhash64("doc_id")).limit(FIT_ROWS)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade").toPandas()  # at most FIT_ROWS rows
    rows = rows.sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
    if rows["grade"].nunique() < 2:
        return Ordinal(np.zeros(PLACES, np.float32), np.arange(GRADES - 1.0))
    return fit(rows["text"].tolist(), rows["grade"].to_numpy(np.int64))


def scored(docs: DataFrame, model: Ordinal, least_grade: int = 1, tail: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, p_selected, selected): selected where P(grade >= least_grade) is at least `tail`."""
    weights, thresholds = docs.sparkSession.sparkContext.broadcast(model.weights), model.thresholds

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        maker, own = Features(), Ordinal(weights.value, thresholds)
        for batch in batches:
            column = batch.column("text")
            texts = (t for lo in range(0, len(column), 256) for t in column.slice(lo, 256).to_pylist())
            tails = own.tails(np.array([float(own.weights[at] @ value) for at, value in map(maker.of, texts)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tails.sum(1)), pa.array(tails[:, least_grade - 1])], names=["doc_id", "expected_grade", "p_selected"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(task, "doc_id bigint, expected_grade double, p_selected double")
    return rows.withColumn("selected", F.col("p_selected") >= tail)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, train(docs, labels))
