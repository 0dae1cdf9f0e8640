"""Toxicity by weak supervision.

Voters: lexicons, each the words and word beginnings of one stem that labelled
toxic texts hold far more often than others (mined on a bounded sample of
labelled rows); a fixed list of insults; patterns (shouting, runs of
exclamation marks, a "you are" frame); and how many lexicon words a text holds:
one, two or three, four to seven, more, none. A lexicon votes when it finds
itself in a text that holds two lexicon words or more, else abstains. A row's
own label, where it has one, is one more voter.

Label model: a voter's accuracies (how often it votes on toxic and on other
texts) are read off the labelled training rows, all of them; its correlations
are what the votes' second moments over all training rows, labelled or not,
hold beyond what these accuracies explain, and they divide the evidence of
voters that repeat each other. The label's own accuracy is estimated too: how
often it agrees with votes that leave no doubt. So a posterior can overrule a
label, and rows without a label have one.

Classifier: logistic regression over the distinct words of a text and their
beginnings, trained on posteriors: of a bounded sample of labelled training
rows, and of a bounded sample of rows without a label. A score uses the text
alone. Rows whose crc32(doc_id) mod 5 is 0, or without an id, train nothing.

Null and empty texts have no features and get the score of the bias. Null ids
count as not held out. Texts of any length are read whole, their words once
each. Repeated rows each get a row; where an id repeats among the training
rows, its least text counts. A score of exactly 0.5 is predicted 1. Without
labels (an empty table, or one class only) every score is the class share. An
empty table gives no rows. Other columns are not read, whatever their names;
`clean` hands them on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlane.llm import store, tokens

#: Labelled rows that voters are mined from and the classifier learns from, at most; how many of them may be toxic; and
#: rows without a label that it learns from, at most.
MINE_ROWS, FIT_ROWS, PLAIN_ROWS = 8_000, 3_000, 2_000
#: A lexicon term is in a toxic text so many times as often as in others, at least.
LIFT, STEM = 20, 3
PLACES = 1 << 21
# English insults.
INSULTS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "fool", "jerk", "imbecile", "retard", "filth", "vermin", "bastard")
#: Voters that are no words: four shouted words, two exclamation marks, a "you are" frame, an insult.
PATTERNS = ("#shout", "#bang", "#you", "#insult")
#: Voters by the number of lexicon words: at least so many, but fewer than the next asks for; the last stands for none.
COUNTS = (("#1", 1), ("#2", 2), ("#4", 4), ("#8", 8))
NONE = "#none"
_SHOUT = re.compile(r"(?:[A-ZÀ-ÖØ-Þ]{3,}\W+){4}")
_YOU = re.compile(r"\byou(?:'re| are)? (?:an? |such |so )*\w")
_EDGE = ".,;:!?\"'()[]{}<>*%&$#@|-_/\\"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms(word: str) -> list[str]:
    """A word and its beginnings; a beginning ends in `*`."""
    return [word, *(word[:k] + "*" for k in range(3, 9) if len(word) > k)]


def distinct_words(text: str | None) -> set[str]:
    return {w.strip(_EDGE) for w in set((text or "").lower().split())} - {""}


def significant(texts: list[str | None], target: np.ndarray, z_least: float) -> dict[str, tuple[float, float]]:
    """Terms of four texts or more whose share differs between the classes by `z_least` standard errors: term -> (texts of the
    class, texts of the other). Counted by hash first, so that the names of the many others are never held."""
    n1, n0 = max(float(target.sum()), 1.0), max(float((1 - target).sum()), 1.0)
    sums = np.zeros((2, PLACES))
    places: dict[str, np.ndarray] = {}
    for t, y in zip(texts, target):
        if len(places) > 200_000:
            places.clear()
        mine = []
        for w in distinct_words(t):
            got = places.get(w)
            if got is None:
                got = places[w] = np.array([_place(x) for x in terms(w)])
            mine.append(got)
        if mine:
            at = np.unique(np.concatenate(mine))
            sums[0, at] += y
            sums[1, at] += 1 - y
    share = (sums[0] + sums[1] + 1) / (n1 + n0)
    z = np.abs(sums[0] / n1 - sums[1] / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    open_ = (z >= z_least / 2) & (sums[0] + sums[1] >= 4)
    out: dict[str, list[float]] = {}
    for t, y in zip(texts, target):
        for f in {x for w in distinct_words(t) for x in terms(w) if open_[_place(x)]}:
            both = out.setdefault(f, [0.0, 0.0])
            both[0] += y
            both[1] += 1 - y
    kept = {}
    for f, (a, b) in out.items():
        of_all = (a + b + 1) / (n1 + n0)
        if a + b >= 4 and abs(a / n1 - b / n0) >= z_least * (of_all * (1 - of_all) * (1 / n1 + 1 / n0)) ** 0.5:
            kept[f] = (a, b)
    return kept


def _place(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term) & (PLACES - 1)


def mine(texts: list[str | None], toxic: np.ndarray) -> dict[str, list[str]]:
    """Lexicons: stem -> its terms, longer ones that toxic texts hold at least LIFT times as often as others. A stem alone begins too
    many words, and a term gives way to one that goes on from it, is in nine of ten of its toxic texts and in fewer others."""
    n1, n0 = max(int(toxic.sum()), 1), max(int((1 - toxic).sum()), 1)
    found = {f: n for f, n in significant(texts, toxic, 5.0).items() if len(f.rstrip("*")) > STEM and n[0] >= 6 and n[0] / n1 > LIFT * (n[1] + 0.5) / n0}
    lexicons: dict[str, list[str]] = {}
    for f, (a, b) in sorted(found.items()):
        longer = (n for g, n in found.items() if f[-1] == "*" and len(g.rstrip("*")) >= len(f) - 1 and g != f and g.startswith(f[:-1]))
        if not any(x >= 0.9 * a and y < b for x, y in longer):
            lexicons.setdefault(f[:STEM], []).append(f)
    return lexicons


def candidates(low: str, stems: set[str]) -> Iterator[str]:
    """Distinct words of a lower-cased text, edges not stripped, but those that no term can be in: long ones that begin
    with three letters or digits that no term begins with."""
    for raw in set(low.split()):
        start = raw[:3]
        if start in stems or len(raw) < 6 or not start.isalnum():
            yield raw


class Voting:
    """Votes of all voters on a text, as the places of those that vote."""

    def __init__(self, lexicons: dict[str, list[str]]) -> None:
        self.names = [*lexicons, *PATTERNS, *(name for name, _ in COUNTS), NONE]
        self.at = {f: i for i, terms_ in enumerate(lexicons.values()) for f in terms_}
        self.first = len(lexicons)
        self.insults = {x for w in INSULTS for x in (w, w + "s")}
        self.stems = {t.rstrip("*")[:3] for t in (*self.at, *self.insults)}
        self.words: dict[str, tuple[str, tuple[int, ...], bool]] = {}

    def _voters(self, raw: str) -> tuple[str, tuple[int, ...], bool]:
        if len(self.words) > 200_000:
            self.words.clear()
        word = raw.strip(_EDGE)
        hits = tuple({self.at[t] for t in terms(word) if t in self.at}) if word else ()
        self.words[raw] = got = (word, hits, word in self.insults)
        return got

    def places(self, text: str | None) -> list[int]:
        text = text or ""
        low, known = text.lower(), self.words
        on, held, insult = set(), set(), False
        for raw in candidates(low, self.stems):
            got = known.get(raw)
            if got is None:
                got = self._voters(raw)
            word, hits, bad = got
            if hits:
                held.add(word)
                on.update(hits)
            insult |= bad
        if len(held) < 2:
            on.clear()
        shouts = (_SHOUT.search(text) is not None, "!!" in text, "you" in low and _YOU.search(low) is not None, insult)
        on.update(self.first + i for i, yes in enumerate(shouts) if yes)
        level = sum(len(held) >= least for _, least in COUNTS)
        on.add(len(self.names) - 1 if not level else self.first + len(PATTERNS) + level - 1)
        return sorted(on)

    def rows(self, texts: list[str | None]) -> np.ndarray:
        """Votes as 0 and 1, a row for each text."""
        out = np.zeros((len(texts), len(self.names)))
        for row, t in zip(out, texts):
            row[self.places(t)] = 1
        return out


def moments(docs: DataFrame, marks: DataFrame, lexicons: dict[str, list[str]]) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Of all rows of (doc_id, text): sums of vote products, and the rows; of those in `marks` (doc_id, toxic): votes by class (0, 1)
    and rows by class. Texts are read once and never shuffled; what is sent are the places of the votes, and counts of them."""
    size = len(Voting(lexicons).names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        voting = Voting(lexicons)
        for batch in batches:
            votes = [voting.places(text.as_py()) for text in batch.column("text")]  # one string at a time
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(votes, pa.list_(pa.int32()))], names=["doc_id", "votes"])

    votes = store.saved(docs.mapInArrow(task, "doc_id bigint, votes array<int>"))
    sums, by_class, rows = np.zeros((size, size)), np.zeros((2, size)), np.zeros(2)
    for r in votes.select(F.explode("votes").alias("i"), "votes").select("i", F.explode("votes").alias("j")).groupBy("i", "j").count().collect():  # voters squared
        sums[r.i, r.j] = r["count"]
    marked = votes.join(marks, "doc_id")
    for r in marked.select("toxic", F.explode("votes").alias("i")).groupBy("toxic", "i").count().collect():
        by_class[r.toxic, r.i] = r["count"]
    for r in marked.groupBy("toxic").count().collect():
        rows[r.toxic] = r["count"]
    return sums, votes.count(), by_class, rows


class LabelModel:
    """Posterior log odds of the hidden class from votes: `bias` + votes @ `weights`, and `label` for each label."""

    def __init__(self, sums: np.ndarray, n: int, by_class: np.ndarray, rows: np.ndarray) -> None:
        n, share = max(n, 1), float(np.clip(rows[1] / max(rows.sum(), 1), 1e-6, 1 - 1e-6))
        miss, hit = (by_class + 0.5) / (rows[:, None] + 1)
        self.accuracy = hit, miss
        mean = np.diag(sums) / n
        cov = sums / n - np.outer(mean, mean)
        gap = hit - miss
        inside = cov - np.outer(gap, gap) * share * (1 - share)
        sd = np.sqrt(share * hit * (1 - hit) + (1 - share) * miss * (1 - miss))
        eye = np.eye(len(gap), dtype=bool)
        self.correlation = np.clip(inside / np.outer(sd, sd), -1, 1)
        self.correlation[eye | (np.abs(self.correlation) < 0.15)] = 0
        # What correlates inside the classes repeats evidence, which the inverse correlation divides; voters that exclude each other repeat none.
        value, vector = np.linalg.eigh(np.maximum(self.correlation, 0) + eye)
        joint = (vector * np.maximum(value, 0)) @ vector.T + 0.05 * eye
        alone = np.where(gap == 0, 1e-9, gap) / sd
        shared = np.clip(1.05 * np.linalg.solve(joint, alone) / alone, 0, 1)
        shared[-1] = 1  # no lexicon word at all: no other voter says that
        self.weights = np.clip(np.log(hit / miss), -6, 6) * shared
        self.bias = float(np.log(share / (1 - share)))
        self.label = 0.0

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        return np.clip(self.bias + votes @ self.weights, -30, 30)

    def with_labels(self, votes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """Posteriors of labelled rows. The label's error is the share that votes of 99 to 1 or more contradict, one row added to either side."""
        odds = self.log_odds(votes)
        sure = odds > np.log(99)
        wrong = (sure & (toxic == 0)).sum() + 1
        self.label = float(np.log(max(sure.sum() + 2 - wrong, 1) / wrong))
        return sigmoid(odds + np.where(toxic == 1, 1, -1) * self.label)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(texts: list[str | None], target: np.ndarray, rounds: int = 600, z_least: float = 5.0) -> tuple[dict[str, float], float]:
    """Logistic regression on soft labels: weights of terms, and the bias.

    Only terms whose share differs between the classes by `z_least` standard
    errors take part, so that words of single texts carry no weight.
    """
    names = sorted(significant(texts, target, z_least))
    at = {f: i for i, f in enumerate(names)}
    idx = [np.array(sorted({at[f] for w in distinct_words(t) for f in terms(w) if f in at}), np.int64) for t in texts]
    sizes = np.array([len(i) for i in idx], np.int64)
    flat, owner = np.concatenate([*idx, np.empty(0, np.int64)]), np.repeat(np.arange(len(idx)), sizes)
    w, bias, hist, hb = np.zeros(len(names)), 0.0, np.full(len(names), 1e-8), 1e-8
    for _ in range(rounds):
        z = bias + np.bincount(owner, w[flat], len(idx))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(target)
        g, gb = np.bincount(flat, err[owner], len(names)) + 2e-6 * w, err.sum()
        hist, hb = hist + g * g, hb + gb * gb
        w, bias = w - 0.5 * g / np.sqrt(hist), bias - 0.5 * gb / hb**0.5
    return {f: float(x) for f, x in zip(names, w)}, float(bias)


class Scorer:
    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias, self.words = weights, bias, {}
        self.stems = {t.rstrip("*")[:3] for t in weights}

    def score(self, text: str | None) -> float:
        total, known = self.bias, self.words
        words = {}
        for raw in candidates((text or "").lower(), self.stems):
            got = known.get(raw)
            if got is None:
                if len(known) > 200_000:
                    known.clear()
                word = raw.strip(_EDGE)
                got = known[raw] = tuple((t, self.weights[t]) for t in terms(word) if t in self.weights) if word else ()
            for t, x in got:
                words[t] = x
        total += sum(words.values())
        return 1 / (1 + np.exp(-min(max(total, -500), 500)))


def targets(docs: DataFrame, marks: DataFrame) -> tuple[list[str | None], np.ndarray, np.ndarray] | float:
    """Texts of the bounded training samples, the posteriors to learn, and the labels (-1 for none), of (doc_id, text) and
    (doc_id, toxic), training rows only; the share of toxic labels where these are of one class."""
    share = marks.agg(F.avg("toxic")).first()[0]
    if share is None or share in (0, 1):
        return 0.0 if share is None else float(share)
    order = F.xxhash64("doc_id")
    # Samples by hash order, chosen on ids before any text is read.
    chosen = marks.filter("toxic = 1").orderBy(order, "doc_id").limit(FIT_ROWS).unionByName(marks.filter("toxic = 0").orderBy(order, "doc_id").limit(MINE_ROWS - FIT_ROWS))
    plain = docs.select("doc_id").join(marks, "doc_id", "left_anti").distinct().orderBy(order, "doc_id").limit(PLAIN_ROWS)
    picked = docs.join(F.broadcast(chosen.unionByName(plain.withColumn("toxic", F.lit(-1)))), "doc_id").select("doc_id", "text", "toxic")
    # An id that is labelled twice keeps its higher label; at most MINE_ROWS + PLAIN_ROWS ids come to the driver.
    picked = picked.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).toPandas().sort_values("doc_id")
    texts, toxic = picked["text"].tolist(), picked["toxic"].to_numpy(np.int64)
    labelled = np.flatnonzero(toxic >= 0)
    lexicons = mine([texts[i] for i in labelled], toxic[labelled])
    model = LabelModel(*moments(docs, marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), lexicons))
    votes = Voting(lexicons).rows(texts)
    posterior = sigmoid(model.log_odds(votes))
    posterior[labelled] = model.with_labels(votes[labelled], toxic[labelled])
    return texts, posterior, toxic


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """A scorer from (doc_id, text) and (doc_id, toxic)."""
    known = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    named = store.lean(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(known)
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(known & F.col("toxic").isin(0, 1))
    got = targets(named, marks)
    if isinstance(got, float):
        return Scorer({}, float(np.log(max(got, 1e-6) / max(1 - got, 1e-6))))
    return Scorer(*fit_linear(*got[:2]))


def _with_scores(rows: DataFrame, scorer: Scorer, finish, schema) -> DataFrame:
    """`finish(batch, scores)` for each Arrow batch of `rows`; texts become Python strings a few hundred at a time."""
    weights, bias = rows.sparkSession.sparkContext.broadcast(scorer.weights), scorer.bias

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        own = Scorer(weights.value, bias)
        for batch in batches:
            column = batch.column("text")
            scores = [own.score(t) for lo in range(0, len(column), 256) for t in column.slice(lo, 256).to_pylist()]
            yield finish(batch, np.array(scores, np.float64))

    return rows.mapInArrow(task, schema)


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of (doc_id, text)."""
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id").cast("bigint")).alias("held_out"), "text")
    finish = lambda batch, scores: pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores)], names=["doc_id", "held_out", "score"])
    return _with_scores(named, scorer, finish, "doc_id bigint, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below `most`."""
    return _with_scores(docs, train(docs, labels), lambda batch, scores: batch.filter(pa.array(scores < most)), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, train(docs, labels))
