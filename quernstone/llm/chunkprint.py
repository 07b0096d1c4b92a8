"""Document fingerprints: digests of content-defined chunks, weighted by their length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import in_arrow, prefix_sums, span_hash, table

#: Chunk sizes in bytes. Before NORMAL a boundary is rarer, after it more frequent.
SHORTEST, NORMAL, LONGEST = 16, 48, 192
STRICT, LOOSE = 1 << 9, 1 << 11  # of 2 ** 16: one place in 128, one in 32
GEAR = np.random.default_rng(7).integers(0, 1 << 16, 256, dtype=np.uint16)
#: Text held back until a batch is fingerprinted.
BATCH_BYTES = 1 << 17


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: h = 2h + GEAR[byte], so 16 bits know the last 16 bytes.
    Doubling the window four times gives all places at once."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint16(step)
    return h


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of each chunk. All rows take their next chunk in step. No chunk is
    shorter than the hash's window but a row's last, so chunks depend on their own bytes."""
    h = gear(data)
    loose = np.append(np.flatnonzero(h < LOOSE), len(data) + LONGEST) + 1
    strict = np.append(np.flatnonzero(h < STRICT), len(data) + LONGEST) + 1
    row = np.flatnonzero(np.diff(offsets) > 0)
    at, end = offsets[row], offsets[row + 1]
    rows, starts, ends = [], [], []
    while len(row):
        near = strict[np.searchsorted(strict, at + SHORTEST)]
        far = loose[np.searchsorted(loose, at + NORMAL)]
        to = np.minimum(np.minimum(np.where(near < at + NORMAL, near, far), at + LONGEST), end)
        rows.append(row)
        starts.append(at)
        ends.append(to)
        go = to < end
        row, at, end = row[go], to[go], end[go]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(rows or none), np.concatenate(starts or none), np.concatenate(ends or none)


#: A chunk's digest and the bytes that it takes up in all.
RECORD = np.dtype([("digest", ">u8"), ("size", ">u4")])


def prints(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, its chunks' records, sorted by digest. No text: no records."""
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    row, s, e = cuts(data, offsets)
    digest = span_hash(prefix_sums(data), s, e)
    order = np.lexsort((digest, row))
    row, digest, size = row[order], digest[order], (e - s)[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
    at = np.flatnonzero(first)
    records = np.empty(len(at), RECORD)
    records["digest"], records["size"] = digest[at], np.add.reduceat(size, at) if len(at) else size
    return np.split(records, np.searchsorted(row[at], np.arange(1, len(texts)))) if texts else []


def shown(records: np.ndarray) -> str:
    """24 hex digits for each chunk: 16 of its digest, 8 of its length."""
    return records.tobytes().hex()


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's bytes in chunks that b has too, 0 to 1. Equal: 1, even if empty."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    _, i, j = np.intersect1d(a["digest"], b["digest"], True, True)
    return float(np.minimum(a["size"][i], b["size"][j]).sum(dtype=np.int64)) / float(a["size"].sum(dtype=np.int64))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint of each row. Null and empty texts: an empty fingerprint."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                got = prints([(t or "").encode() for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(shown, got), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", F.col(text).alias("text")).transform(in_arrow, work, f"doc_id {ids}, fingerprint string")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranged(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """bucket, tail, doc_id, mark, text: rows dealt out in ranges of doc_id. The first row of
    each range is dealt to the range before, too, as its tail; the very first to the last. The
    ranges' bounds and first rows' marks are broadcast and searched by halves, so the plan is
    the same for any number of ranges."""
    spark = docs.sparkSession
    ranges = ranges or 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"doc_id is {kind}; the next document is found for whole numbers only")
    # rows of one doc_id go by their text's hash; those alike in both can change places
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("mark"), "text")
    found = source.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))
    bounds = spark.sparkContext.broadcast(np.unique(np.array(found, np.float64)).astype(np.int64))

    def bucket(ids: pa.Array) -> np.ndarray:
        return np.where(ids.is_null().to_numpy(False), 0, np.searchsorted(bounds.value, ids.fill_null(0).to_numpy(), "right"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket(batch.column(0))), batch.column(0), batch.column(1)], ["bucket", "doc_id", "mark"])

    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "mark")).alias("f")
    first = source.select("doc_id", "mark").transform(in_arrow, mark, "bucket long, doc_id long, mark long").groupBy("bucket").agg(least).select("bucket", "f.mark").collect()
    first = sorted((r.bucket, r.mark) for r in first)
    before = sorted((m, first[k - 1][0]) for k, (_, m) in enumerate(first))
    heads = spark.sparkContext.broadcast((np.array([m for m, _ in before], np.int64), np.array([b for _, b in before], np.int64)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, back = heads.value
        for batch in batches:
            names = ["bucket", "tail", "doc_id", "mark", "text"]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(bucket(batch.column(0))), pa.array(np.zeros(n, np.int32)), *batch.columns], names)
            own = batch.column(1).to_numpy()
            at = np.minimum(np.searchsorted(marks, own), len(marks) - 1)
            if len(take := np.flatnonzero(marks[at] == own)):
                again = batch.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([pa.array(back[at[take]]), pa.array(np.ones(len(take), np.int32)), *again.columns], names)

    rows = source.transform(in_arrow, dealt, "bucket long, tail int, doc_id long, mark long, text string")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_first(), "mark")


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Returns a row per row of docs: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The next document is by ascending doc_id; rows of one doc_id follow by a hash of their
    text, null doc_ids come first, and after the last comes the first (a lone row follows itself).
    Likeness is the share of the document's bytes in chunks that the other has too. Null text
    is empty; extra columns, n_chars too, are ignored; an empty table gives no rows. doc_id is
    a whole number; other kinds are a TypeError.
    """
    ids = docs.schema["doc_id"].dataType.simpleString()

    def flush(held: list[tuple]) -> pa.RecordBatch:
        raw = [t.encode() for _, t, _ in held]
        new = [edited(t, n).encode() for _, t, n in held]
        got = prints([*raw, *new, held[-1][2].encode()])
        own, other = got[: len(held)], got[len(held) : 2 * len(held)]
        after = [*own[1:], got[-1]]
        for k in range(len(held) - 1):  # where a range ends, the next row held isn't the next document
            if held[k][2] is not held[k + 1][1]:
                after[k] = prints([held[k][2].encode()])[0]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([h[0] for h in held], pa.int64()),
                pa.array([len(h[1]) for h in held], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in new]),
                pa.array(map(shown, own), pa.string()),
                pa.array(map(shown, other), pa.string()),
                pa.array(map(containment, own, other), pa.float64()),
                pa.array(map(containment, own, after), pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size = None, [], 0
        for batch in batches:
            buckets, doc_ids, tails = (batch.column(k).to_pylist() for k in (0, 2, 1))
            for k in range(batch.num_rows):
                text = batch.column(4)[k].as_py() or ""
                if last is not None and last[0] == buckets[k]:
                    held.append((last[1], last[2], text))
                    size += len(last[2]) + len(text)
                    if size > BATCH_BYTES:
                        yield flush(held)
                        held, size = [], 0
                last = None if tails[k] else (buckets[k], doc_ids[k], text)
        if held:
            yield flush(held)

    out = _ranged(docs).transform(in_arrow, work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.col("doc_id").cast(ids))


def op8_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(table(spark, sf_dir, "documents"))
