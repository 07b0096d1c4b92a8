"""Toxicity grades: cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import buffer, in_arrow, slices, span_hash, table
from quernstone.llm.sparse import BUCKET_BITS, Ftrl, Tokens, bucket, examples, linear, sample

#: Labelled documents of each grade that the model is fitted on at most.
SAMPLE = 4000
EPOCHS = 6
#: A document is toxic from this chance of a grade above 0.
REJECT = 0.5
PREFIXES = (4, 5, 6)


def presence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words a row has, and which first 4 to 6 bytes its longer words have, by the
    logarithm of how often. Nothing is divided by the text's length: a few toxic words weigh
    the same however long it is."""
    t = Tokens(data, offsets)
    rows, at = [t.row[t.is_word]], [bucket(t.word[t.is_word], 11)]
    for n in PREFIXES:
        long = t.is_word & (t.e - t.s > n)
        rows.append(t.row[long])
        at.append(bucket(span_hash(t.sums, t.s[long], t.s[long] + n), 11 + n))
    row, at = np.concatenate(rows).astype(np.int64), np.concatenate(at).astype(np.int64)
    key, n = np.unique(row << 32 | at, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, np.log2(1.0 + n)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Ordinal:
    """P(grade <= k) = logistic(threshold k - w.x): all thresholds share the weights w, which
    FTRL keeps sparse; the thresholds stay in order."""

    def __init__(self, grades: int, l1: float, l2: float):
        self.model = Ftrl(alpha=1.0, l1=l1, l2=l2)
        self.thresholds = np.arange(grades - 1) + 1.0
        self.slopes = np.ones(grades - 1)

    def learn(self, y: int, at: np.ndarray, x: np.ndarray) -> None:
        w, t = self.model.weights(at), self.thresholds
        eta = float(w @ x)
        high = logistic(t[y] - eta) if y < len(t) else 1.0
        low = logistic(t[y - 1] - eta) if y else 0.0
        p = max(high - low, 1e-9)
        self.model.update(at, w, (1 - high - low) * x)
        for k, g in ((y, -high * (1 - high) / p), (y - 1, low * (1 - low) / p)):
            if 0 <= k < len(t):
                g = min(5.0, max(-5.0, g))
                self.slopes[k] += g * g
                t[k] -= 1.0 * g / np.sqrt(self.slopes[k])
        for k in range(1, len(t)):
            t[k] = max(t[k], t[k - 1] + 0.05)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds. A first model with a strong L1 chooses the features, a second
    weighs them without it, as L1 would leave a few toxic words too light. No rows: no
    weights, and thresholds by which all is grade 0."""
    chosen = np.ones(1 << BUCKET_BITS, bool)
    for l1, l2 in ((30.0, 0.0), (0.0, 0.05)):
        model, rng = Ordinal(grades, l1, l2), np.random.default_rng(5)
        own = [(min(max(y, 0), grades - 1), at[chosen[at]], x[chosen[at]]) for y, at, x in rows]
        for _ in range(epochs):
            for k in rng.permutation(len(own)):
                model.learn(*own[k])
        weights = model.model.weights(slice(None))
        if l1:
            chosen = weights != 0
    return weights.astype(np.float32), model.thresholds


def graded(rows: list[tuple[int, np.ndarray, np.ndarray]], lift: float = 20.0) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Grades 0, 1, 2 from labels 0 and 1. Features that toxic rows of the sample have `lift`
    times as often as others mark toxicity; a toxic row with more marks than the median of
    toxic rows is grade 2."""
    size = 1 + max((int(at.max()) for _, at, _ in rows if len(at)), default=0)
    seen = np.zeros((2, size))
    n = np.zeros(2)
    for y, at, _ in rows:
        seen[int(y > 0), at] += 1
        n[int(y > 0)] += 1
    marks = (seen[1] >= 3) & ((seen[1] + 0.5) / (n[1] + 1) > lift * (seen[0] + 0.5) / (n[0] + 1))
    counts = [int(marks[at].sum()) for _, at, _ in rows]
    middle = float(np.median([c for c, (y, _, _) in zip(counts, rows, strict=True) if y > 0] or [0]))
    return [(0 if y <= 0 else 2 if c > middle else 1, at, x) for c, (y, at, x) in zip(counts, rows, strict=True)]


def train(docs: DataFrame, labels: DataFrame, grade: Column, grades: int | None = None, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Fits on at most `most` labelled rows with each grade, those whose doc_id has the least
    hash. grade: 0 and up; with grades unset it is 0 or 1, and severity is told by graded().
    Labels of null and ids without row are left out, repeated labels count once, null and empty
    texts are examples without words, extra columns are ignored; without labels all score alike."""
    rows = examples(docs, sample(labels, grade, most, max(16, grades or 0)), presence)
    return fit(graded(rows), 3) if grades is None else fit(rows, grades)


def _scores(col: pa.Array, weights: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Chances of each grade, a row each."""
    data, offsets = buffer(col)
    found = [np.zeros(0)]
    for i, j in slices(offsets):
        row, at, x = presence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        found.append(linear(row, weights[at] * x, j - i))
    below = logistic(thresholds[None, :] - np.concatenate(found)[:, None])
    edge = np.ones((len(below), 1))
    return np.diff(np.concatenate([0 * edge, below, edge], axis=1), axis=1)


def toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], reject: float = REJECT) -> DataFrame:
    """Returns a row per row of docs: doc_id, severity (the expected grade), grade (the
    likeliest), chance (of a grade above 0), toxic (chance >= reject).

    Only the text counts, all of it. Null, empty and word-free texts score as no words do,
    repeated rows alike; ties between grades take the lower; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _scores(batch.column(1), *shared.value)
            chance = 1 - p[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(chance), pa.array(chance >= reject)], ["doc_id", "severity", "grade", "chance", "toxic"])

    return docs.select("doc_id", "text").transform(in_arrow, work, f"doc_id {kind}, severity double, grade int, chance double, toxic boolean")


def reject_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], reject: float = REJECT) -> DataFrame:
    """docs without the rows that toxicity() calls toxic; all columns stay, whatever their names,
    and nothing is shuffled. Null, empty and word-free texts go only if no words at all score as
    toxic; repeated rows stay or go alike; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _scores(batch.column(place), *shared.value)
            yield batch.filter(pa.array(1 - p[:, 0] < reject))

    return docs.transform(in_arrow, work, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels"), F.col("toxic")))
