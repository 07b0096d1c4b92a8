"""Cosines of many vectors with many queries, a block at a time within a task."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DIGITS = 6
SCHEMA = "q long, doc_id long, score double"
#: Queries that meet a batch at once, and pairs whose cosines are summed up at once.
BLOCK, PAIRS = 512, 1 << 20


def rounded(x: np.ndarray) -> np.ndarray:
    """x in units of the last digit, as Spark rounds it: by its decimal form, halves away from 0."""
    y = np.abs(x) * 10.0**DIGITS
    out = np.floor(y + 0.5)
    for i in np.flatnonzero(np.abs(y % 1 - 0.5) < 1e-6):
        out[i] = int(Decimal(repr(abs(float(x[i])))).scaleb(DIGITS).quantize(Decimal(1), ROUND_HALF_UP))
    return np.copysign(out, x) + 0.0


def places(*keys: np.ndarray) -> np.ndarray:
    """The place of each row among those of its run of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([key[1:] != key[:-1] for key in keys], axis=0)
    start = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(start, np.diff(np.append(start, len(new))))


def folded(number: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows, by number, that can be among the best k of any query. Equal vectors
    score the same, so the first of them go: k of a number, as it may be the query's, and 2k."""
    _, like = np.unique(np.ascontiguousarray(rows).view(f"V{8 * rows.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((number, like))
    order = order[places(like[order], number[order]) < k]
    order = order[places(like[order]) < 2 * k]
    return order[np.argsort(number[order], kind="stable")]


class Best:
    """The best k of all rows met so far for each query, by rounded cosine, then by number. The
    product of unit vectors in single precision rules out what cannot be among them; the rest is
    summed up in double precision, one component after another, as Spark does."""

    def __init__(self, q: np.ndarray, asked: np.ndarray, k: int):
        self.q, self.k = q, k
        self.asked, self.length, self.unit = self._sides(asked)
        self.slack = 2 * 10.0**-DIGITS + 2 * (asked.shape[1] + 8) * 2.0**-23
        self.least = np.full(len(q), -np.inf)
        self.held = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, float, float)) for _ in range(0, len(q), BLOCK)]

    @staticmethod
    def _sides(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Components (each in a row), lengths, unit vectors."""
        flat = np.ascontiguousarray(v.T)
        square = np.zeros(len(v))
        for x in flat:
            square += x * x
        length = np.sqrt(square)
        return flat, length, (v / length[:, None]).astype(np.float32)

    def meet(self, number: np.ndarray, rows: np.ndarray) -> None:
        keep = folded(number, rows, self.k)
        number, rows = number[keep], rows[keep]
        flat, length, unit = self._sides(rows)
        for n, i in enumerate(range(0, len(self.q), BLOCK)):
            j = min(i + BLOCK, len(self.q))
            about = self.unit[i:j] @ unit.T
            low, high = (np.searchsorted(number, self.q[i:j], side) for side in ("left", "right"))
            for a in np.flatnonzero(high > low):
                about[a, low[a] : high[a]] = -2
            bound = self.least[i:j]
            if len(number) > self.k and np.isneginf(bound).any():
                bound = np.maximum(bound, np.partition(about, -self.k, axis=1)[:, -self.k])
            at, row = np.nonzero(about >= np.maximum(bound - self.slack, -1.5)[:, None].astype(np.float32))
            if not len(at):
                continue
            at += i
            score = np.concatenate([self._scores(flat, length, at[c : c + PAIRS], row[c : c + PAIRS]) for c in range(0, len(at), PAIRS)])
            both = tuple(map(np.concatenate, zip(self.held[n], (at, number[row], score, rounded(score)), strict=True)))
            order = np.lexsort((both[1], -both[3], both[0]))
            place = places(both[0][order])
            order = order[place < self.k]
            self.held[n] = tuple(x[order] for x in both)
            last = order[places(both[0][order]) == self.k - 1]
            self.least[both[0][last]] = both[3][last] / 10.0**DIGITS

    def _scores(self, flat: np.ndarray, length: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at))
        for x, y in zip(self.asked, flat, strict=True):
            out += x[at] * y[row]
        return out / (self.length[at] * length[row])

    def found(self) -> Iterator[pa.RecordBatch]:
        for at, number, score, _ in self.held:
            yield pa.RecordBatch.from_arrays([pa.array(self.q[at]), pa.array(number), pa.array(score)], ["q", "doc_id", "score"])


def _arrays(t: pa.Table | pa.RecordBatch, number: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    flat = t.column(vector)
    flat = (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy(zero_copy_only=False)
    n = t.column(number).to_numpy()
    return n, flat.reshape(len(n), -1) if len(n) else np.zeros((0, 0))


def met(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """rows: doc_id, v; queries: q, v, small enough to be broadcast. The best k of each task."""
    asked = rows.sparkSession.sparkContext.broadcast(_arrays(queries.toArrow(), "q", "v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(asked.value[0]):
            return
        best = Best(*asked.value, k)
        for batch in batches:
            if batch.num_rows:
                best.meet(*_arrays(batch, "doc_id", "v"))
        yield from best.found()

    return rows.mapInArrow(work, SCHEMA)


def met_in_cells(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """rows: doc_id, v, tile, block; queries: q, asked, tile, block. The best k of each cell."""

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        best = Best(*_arrays(right, "q", "asked"), k)
        number, flat = _arrays(left, "doc_id", "v")
        for i in range(0, len(number), 1 << 13):
            best.meet(number[i : i + (1 << 13)], flat[i : i + (1 << 13)])
        return pa.Table.from_batches(list(best.found()))

    return rows.groupBy("tile", "block").cogroup(queries.groupBy("tile", "block")).applyInArrow(cell, SCHEMA)
