"""Sparse linear models: features hashed from words, and follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import LOWER, NOT_ALNUM, WHITE, buffer, in_arrow, mixed, prefix_sums, slices, span_hash, written

BUCKET_BITS = 18
#: Features of the sample that reach the driver at most, in bytes.
SAMPLE_BYTES = 192 << 20
#: A slice's features: (row, bucket), the value of each, sorted by row.
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return (mixed(h + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class Tokens:
    """Runs of word bytes and runs of other visible bytes of a slice, in order. word: their
    hash with A-Z lowered; row: whose they are; kind: what a token looks like, as a word of
    its own (lower, capitalised, capitals, with digits, again the same; marks as they are)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = LOWER[data]
        cls = np.where(WHITE[data], 0, np.where(NOT_ALNUM[low], 2, 1)).astype(np.int8)
        new = np.ones(len(data), bool)
        new[1:] = cls[1:] != cls[:-1]
        new[offsets[:-1][offsets[:-1] < len(data)]] = True
        at = np.append(np.flatnonzero(new), len(data))
        keep = cls[at[:-1]] > 0 if len(data) else np.zeros(0, bool)
        self.s, self.e = at[:-1][keep], at[1:][keep]
        self.row = np.searchsorted(offsets, self.s, "right") - 1
        self.sums = prefix_sums(low)
        self.word = span_hash(self.sums, self.s, self.e)
        self.low, self.is_word = low, cls[self.s] == 1
        capital = (data >= 65) & (data <= 90)
        digit = (data >= 48) & (data <= 57)
        caps, digits = (np.concatenate([[0], np.cumsum(x)]) for x in (capital, digit))
        n_caps, n_digits = caps[self.e] - caps[self.s], digits[self.e] - digits[self.s]
        kind = np.where(n_digits > 0, 3, np.where((n_caps > 1) & (2 * n_caps > self.e - self.s), 2, np.where(n_caps > 0, 1, 0)))
        kind = np.where(self.is_word, mixed(kind.astype(np.uint64)), self.word)
        same = np.zeros(len(kind), bool)
        same[1:] = (self.word[1:] == self.word[:-1]) & (self.row[1:] == self.row[:-1])
        self.kind = np.where(same & self.is_word, mixed(np.full(1, 9, np.uint64)), kind)


class Ftrl:
    """Per-coordinate FTRL-proximal weights with L1 and L2 regularisation."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        size = 1 << BUCKET_BITS
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sample(labels: DataFrame, value: Column, most: int, values: int = 16) -> DataFrame:
    """doc_id, value: at most `most` labelled rows with each value, those of least hash. More
    than `values` different ones are an error, as none is left out."""
    known = labels.select("doc_id", value.cast("int").alias("value")).filter("doc_id IS NOT NULL AND value IS NOT NULL").distinct()
    found = sorted(r.value for r in known.select("value").distinct().limit(values + 1).collect())
    if len(found) > values:
        raise ValueError(f"labels have more than {values} different values")
    parts = [known.filter(F.col("value") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for v in found]
    out = known.limit(0)
    for p in parts:
        out = out.unionAll(p)
    return out


def examples(docs: DataFrame, chosen: DataFrame, features: Features, most_bytes: int = SAMPLE_BYTES) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The sampled documents' value and features, in an order that only their ids decide. Of
    several rows with one doc_id the text of least hash counts, so chosen bounds the rows; of
    these, in their order, as many are brought to the driver as have `most_bytes` of features
    in all, and one at least."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer(batch.column(2))
            for i, j in slices(offsets):
                row, at, x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                key, back = np.unique(row << BUCKET_BITS | at, return_inverse=True)
                x = np.bincount(back, x, len(key)).astype(np.float32)
                cut = np.searchsorted(key >> BUCKET_BITS, np.arange(j - i + 1))
                at = (key & ((1 << BUCKET_BITS) - 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([at[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                    ["mark", "value", "at", "x"],
                )

    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("mark", F.xxhash64("doc_id", "text"))
    one = known.groupBy("doc_id", "value").agg(F.min_by("text", "mark").alias("text"), F.min("mark").alias("mark"))
    rows = written(one.select("mark", "value", "text").transform(in_arrow, work, "mark long, value int, at binary, x binary"), "examples")
    sizes = sorted((r.mark, r.value, r.n) for r in rows.select("mark", "value", F.length("at").alias("n")).collect())
    total = np.cumsum([2 * n for _, _, n in sizes])
    last = sizes[max(0, int(np.searchsorted(total, most_bytes, "right")) - 1)][0] if sizes else 0
    got = sorted(rows.filter(F.col("mark") <= last).collect(), key=lambda r: (r.mark, r.value))
    return [(r.value, np.frombuffer(r["at"], np.int32), np.frombuffer(r.x, np.float32).astype(np.float64)) for r in got]


def linear(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the features' shares of a score by row."""
    return np.bincount(row, value, rows)
