"""Centroid clustering of integer vectors, each round's search pruned by norms: only centroids
in the annulus that a vector's upper bound leaves are compared."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import in_arrow, table, written

CENTROIDS, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
#: Components below this have squared distances that 64 bits hold, in up to 64 dimensions; with
#: larger ones numbers of any size are used.
EXACT = 1 << 26
MOST_LONG = (1 << 63) - 1


def integers(flat: np.ndarray, dimensions: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, in rows; scale: a power of two."""
    x = flat.reshape(-1, dimensions)
    if not x.size or np.abs(x).max() < EXACT / scale:
        return np.floor(scale * x).astype(np.int64)
    exact = [[math.floor(v) * scale if abs(v) >= 2**53 else math.floor(scale * v) for v in row] for row in x.tolist()]
    out = np.empty(x.shape, object)
    out[:] = exact
    return out


class Rings:
    """Centroids sorted by norm."""

    def __init__(self, centroids: list[list[int]]):
        self.small = all(abs(v) < EXACT for c in centroids for v in c)
        each = np.array(centroids, np.int64 if self.small else object)
        if self.small:
            norm = np.sqrt((each * each).sum(1).astype(np.float64))
            self.number = np.lexsort((np.arange(len(each)), norm))
            self.norm, self.each = norm[self.number], each[self.number]
        else:
            self.number, self.each = np.arange(len(each)), each

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest centroid; of equally near ones the
        smallest number. The centroid with the nearest norm gives a first bound r; any that is as
        near or nearer has a norm of at most r above or below the row's own."""
        wide = x.dtype == object or not self.small
        last = len(self.each) - 1
        if wide:
            x = x.astype(object)
            best, number = np.full(len(x), None, object), np.zeros(len(x), np.int64)
            low, high = np.zeros(len(x), np.int64), np.full(len(x), last + 1)
        else:
            norm = np.sqrt((x * x).sum(1).astype(np.float64))
            right = np.clip(np.searchsorted(self.norm, norm), 0, last)
            left = np.maximum(right - 1, 0)
            first = np.where(norm - self.norm[left] <= self.norm[right] - norm, left, right)
            apart = x - self.each[first]
            best, number = (apart * apart).sum(1), self.number[first].astype(np.int64)
            r = np.sqrt(best.astype(np.float64))
            slack = 1e-9 * (norm + r) + 1e-6  # what square roots may be wrong by
            low, high = np.searchsorted(self.norm, norm - r - slack), np.searchsorted(self.norm, norm + r + slack, "right")
        for k in range(last + 1):
            met = np.flatnonzero((low <= k) & (k < high))
            apart = x[met] - self.each[k]
            d = (apart * apart).sum(1)
            if wide:
                closer = np.array([b is None or a < b or (a == b and self.number[k] < n) for a, b, n in zip(d, best[met], number[met], strict=True)], bool)
            else:
                closer = (d < best[met]) | ((d == best[met]) & (self.number[k] < number[met]))
            best[met[closer]], number[met[closer]] = d[closer], self.number[k]
        return number, best


def usable(embedding: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector has that many components, none null or without a finite value."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(embedding) == dimensions) & F.forall(embedding, finite), F.lit(False))


def _pieces(v: int) -> Iterator[tuple[int, int]]:
    """(k, part) with v the sum of part * 2 ** (32 k): one part where 64 bits hold v."""
    if abs(v) <= MOST_LONG:
        yield 0, v
        return
    sign, v, k = (1 if v > 0 else -1), abs(v), 0
    while v:
        yield k, sign * (v & 0xFFFFFFFF)
        v, k = v >> 32, k + 1


def _moved(vectors: DataFrame, centroids: list[list[int]], dimensions: int, scale: int) -> list[list[int]]:
    """The centroids after a round: sums by cluster and component, added up where the vectors
    are read. At most a number for each centroid and component reaches the driver."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings, total = Rings(shared.value), {}
        for batch in batches:
            x = integers(batch.column(0).flatten().to_numpy(), dimensions, scale)
            number, _ = rings.nearest(x)
            for c in np.unique(number).tolist():
                own = x[number == c]
                sums = [*map(int, own.sum(0)), len(own)]
                total[c] = [a + b for a, b in zip(total.get(c, [0] * len(sums)), sums, strict=True)]
        rows = [(c, i, k, part) for c, sums in total.items() for i, v in enumerate(sums) for k, part in _pieces(v)]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], ["cluster", "at", "k", "part"])

    parts = vectors.select("embedding").transform(in_arrow, work, "cluster int, at int, k int, part long")
    summed = parts.groupBy("cluster", "at", "k").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    sums: dict[int, list[int]] = {}
    for r in summed.collect():
        sums.setdefault(r.cluster, [0] * (dimensions + 1))[r.at] += int(r.part) << (32 * r.k)
    return [[s // sums[c][-1] for s in sums[c][:-1]] if c in sums else old for c, old in enumerate(centroids)]


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vectors: vec_id, embedding. vec_id, cluster, distance, cluster_inertia, inertia and
    centroid_sha256 of each usable vector, as floor(scale * x) of its components; others have no
    row. Centroids start as the k vectors with the smallest sha256 of "1:<vec_id>" (of repeated
    ids the smaller vector first; null ids never) and move to their vectors' mean, rounded down,
    `rounds` times.

    Repeated rows are vectors of their own; ties go to the smaller number; fewer than k vectors
    make fewer centroids; without any vector with an id there is no row. All sums are exact at
    any size; a distance or an inertia that 64 bits cannot hold is null. Extra columns, those
    that clash too, are ignored.
    """
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(usable(F.col("embedding"), dimensions))
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    seeds = kept.filter("vec_id IS NOT NULL").orderBy(order, "embedding").limit(k).collect()
    centroids = [[int(v) for v in integers(np.array(r.embedding, np.float64), dimensions, scale)[0]] for r in seeds]
    if not centroids:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = _moved(kept, centroids, dimensions, scale)
    shared = spark.sparkContext.broadcast(centroids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = Rings(shared.value)
        for batch in batches:
            number, d = rings.nearest(integers(batch.column(1).flatten().to_numpy(), dimensions, scale))
            fits = pa.array([v if v <= MOST_LONG else None for v in d.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), fits], ["vec_id", "cluster", "distance"])

    assigned = written(kept.transform(in_arrow, work, f"vec_id {kind}, cluster int, distance long"), "assigned")
    summed = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), (F.count("*") == F.count("distance")).alias("whole")).collect()
    own = {r.cluster: int(r.d) if r.whole else None for r in summed}
    inertia = sum(own.values()) if all(v is not None for v in own.values()) else None
    fit = lambda v: v if v is not None and v <= MOST_LONG else None
    rows = [(c, fit(v), fit(inertia), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, v in own.items()]
    figures = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The same in DuckDB's SQL. Components are small whole numbers there, so doubles hold the
    sums exactly."""
    out = f"""WITH kept AS (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {CENTROIDS})"""
    for k in range(ROUNDS + 1):
        out += f""",
a{k} AS (SELECT uid, vec_id, v, unnest(near) FROM (SELECT uid, vec_id, any_value(k.v) AS v, min({{'d': list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v), 'c': c}}) AS near FROM kept k CROSS JOIN c{k} c GROUP BY uid, vec_id))"""
        if k < ROUNDS:
            out += f""",
s{k} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({DIMENSIONS})) AS i FROM a{k}) GROUP BY ALL),
c{k + 1} AS (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{k} o LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS v FROM s{k} GROUP BY c) m USING (c))"""
    return (
        out
        + f"""
SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a{ROUNDS} JOIN (SELECT c, sha256(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM c{ROUNDS}) h USING (c)"""
    )


SQL = _sql()
