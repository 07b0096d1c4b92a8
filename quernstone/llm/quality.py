"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import BASE, buffer, in_arrow, mixed, slices, table
from quernstone.llm.sparse import Ftrl, Tokens, bucket, examples, linear, sample

#: Labelled documents of each label that the model is fitted on at most.
SAMPLE = 6000
EPOCHS = 3
SCALE = 8.0
THRESHOLD = 0.3


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and pairs of words, and runs of one to three word kinds, each weighted by the
    row's tokens. No run crosses a row's end."""
    t = Tokens(data, offsets)
    n = np.bincount(t.row, minlength=len(offsets) - 1)
    rows, at = [], []
    for salt, h, k in ((1, t.word, 1), (2, t.word, 2), (3, t.kind, 1), (4, t.kind, 2), (5, t.kind, 3)):
        if len(h) < k:
            continue
        run = h[: len(h) - k + 1]
        for i in range(1, k):
            run = run * BASE + h[i : len(h) - k + 1 + i]
        whole = t.row[: len(run)] == t.row[k - 1 :]
        rows.append(t.row[: len(run)][whole])
        at.append(bucket(mixed(run)[whole], salt))
    row = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    return row, np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64), SCALE / np.maximum(n, 1)[row]


def sigmoid(x: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], shares: dict[int, float] | None = None, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias. shares: each label's share among all labels, by which its sampled rows
    are weighted."""
    model, bias, slope, rng = Ftrl(alpha=0.5, l1=0.02, l2=0.01), 0.0, 1.0, np.random.default_rng(11)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, at, x = rows[k]
            w = model.weights(at)
            g = float((sigmoid(w @ x + bias) - (y > 0)) * (shares or {}).get(y, 1.0))
            model.update(at, w, g * x)
            slope += g * g
            bias -= 0.3 * g / np.sqrt(slope)
    return model.weights(slice(None)).astype(np.float32), bias


def train(docs: DataFrame, labels: DataFrame, value: str = "quality", most: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fits on at most `most` labelled rows with each label (those whose id has the least
    hash), weighted so that the labels count as often as they are. Rows of a doc_id without
    label, and labels without row, are left out; no labels at all: every score is 0.5."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(value).isNotNull())
    counts = {int(r[value]): r.n for r in known.groupBy(value).agg(F.count("*").alias("n")).collect()}
    over = {v: max(1.0, n / most) for v, n in counts.items()}
    top = max(over.values(), default=1.0)
    return fit(examples(docs, sample(labels, F.col(value), most), grams), {v: x / top for v, x in over.items()})


def scored(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row. Only the text enters the score, all of
    it; null and empty texts have the score of the bias alone. held_out: crc32 of the doc_id
    as text is a multiple of 5 (null: true, as it was never learnt from)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            data, offsets = buffer(batch.column(2))
            found = [np.zeros(0)]
            for i, j in slices(offsets):
                row, at, x = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found.append(sigmoid(linear(row, weights[at] * x, j - i) + bias))
            score = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").transform(in_arrow, work, f"doc_id {kind}, held_out boolean, score double, predicted int")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """scored() with a model trained on the labels of documents that aren't held out. A row per
    row, repeated ones alike; null and empty texts are scored as having no words; an empty table
    gives no rows; extra columns, those that clash too, are ignored."""
    return scored(docs, train(docs, labels.filter(~held_out()), most=most))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
