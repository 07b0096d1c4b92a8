"""SimHash near-duplicates over a Gray-ordered hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import buffer, in_arrow, signed, table, with_uid, written
from quernstone.llm.components import connected_components

SEED = 42
BITS = 2
FANOUT = 16
#: A bucket of more distinct fingerprints is dealt out once more by the bits that it does not share.
BUCKET = 20_000


def hashes(text: bytes, width: int = 3, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of width words, repeats included. Fewer words: of all of them."""
    w = text.lower().split()
    if len(w) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed)] if w else [], np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, len(w) - width + 1)


def fingerprint(h: np.ndarray, block: int = 1 << 16) -> int:
    """64 bits, the highest first: 1 where over half of the hashes have it. No hashes: 0."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), block):
        ones += np.unpackbits(h[i : i + block].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the Gray code's order, in which neighbours differ by one bit."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """A tree over fingerprints in Gray order. An upper node holds the bits on which all
    below it agree (mask and pattern), less those that its parent already holds, so that the
    differences on the way down add up to the distance at a leaf."""

    def __init__(self, values: np.ndarray, fanout: int = FANOUT):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        self.fanout = fanout
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        masks, patterns = [np.full(len(values), full)], [self.values]
        while len(masks[-1]) > fanout:
            cuts = np.arange(0, len(masks[-1]), fanout)
            every = np.bitwise_and.reduceat(patterns[-1] | ~masks[-1], cuts)
            some = np.bitwise_or.reduceat(patterns[-1] | ~masks[-1], cuts)
            agree = np.bitwise_and.reduceat(masks[-1], cuts) & ~(every ^ some)
            masks.append(agree)
            patterns.append(every & agree)
        for level in range(len(masks) - 1):
            above = np.repeat(masks[level + 1], fanout)[: len(masks[level])]
            masks[level] = masks[level] & ~above
        self.masks, self.patterns = masks, patterns

    def near(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place in values) at most so many bits apart."""
        top = len(self.masks) - 1
        q = np.repeat(np.arange(len(queries)), len(self.masks[top]))
        node = np.tile(np.arange(len(self.masks[top])), len(queries))
        differ = np.zeros(len(q), np.uint8)
        for level in range(top, -1, -1):
            if level < top:
                n = len(self.masks[level])
                node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                q, differ = np.repeat(q, self.fanout), np.repeat(differ, self.fanout)
                inside = node < n
                q, node, differ = q[inside], node[inside], differ[inside]
            differ = differ + np.bitwise_count((queries[q] ^ self.patterns[level][node]) & self.masks[level][node])
            keep = differ <= most
            q, node, differ = q[keep], node[keep], differ[keep]
        return q, node


def linked(values: np.ndarray, most: int = BITS, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A forest over distinct values: each with the root of its group in this bucket. The
    links themselves are never listed beyond a block of queries."""
    index = GrayIndex(values)
    v, parent = index.values, np.arange(len(values))
    for i in range(0, len(v), block):
        a, b = index.near(v[i : i + block], most)
        a = a + i
        while True:
            ra, rb = parent[a], parent[b]
            if (ra == rb).all():
                break
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while (parent[parent] != parent).any():
                parent = parent[parent]
    keep = parent != np.arange(len(v))
    return v[keep], v[parent[keep]]


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long). Null and empty texts: 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffer(batch.column(1))
            raw = data.tobytes()
            out = np.array([fingerprint(hashes(raw[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(out))], ["doc_id", "fp"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).transform(in_arrow, work, f"doc_id {ids}, fp long")


def _blocks(fp: F.Column, bits: int) -> tuple[list[F.Column], list[int]]:
    """bits + 2 blocks of a fingerprint, and how wide they are."""
    edge = [64 * i // (bits + 2) for i in range(bits + 3)]
    wide = [b - a for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in zip(edge[:-1], wide, strict=True)], wide


def _keys(fp: F.Column, bits: int) -> F.Column:
    """Each two of bits + 2 blocks. Of values so many bits apart, two blocks at least are equal."""
    block, wide = _blocks(fp, bits)
    pairs = list(combinations(range(bits + 2), 2))
    return F.array(*(F.struct(F.lit(n).alias("pair"), (F.shiftleft(block[i], wide[j]) + block[j]).alias("bits")) for n, (i, j) in enumerate(pairs)))


def _finer(fp: F.Column, pair: F.Column, bits: int) -> F.Column:
    """The bits that a bucket does not share, in bits + 1 parts, of which one is equal still."""
    block, wide = _blocks(fp, bits)
    out = F.lit(None).cast("array<bigint>")
    for n, two in enumerate(combinations(range(bits + 2), 2)):
        rest, size = F.lit(0).cast("long"), 0
        for x in range(bits + 2):
            if x not in two:
                rest, size = F.shiftleft(rest, wide[x]) + block[x], size + wide[x]
        cut = [size * k // (bits + 1) for k in range(bits + 2)]
        out = F.when(pair == n, F.array(*(F.shiftrightunsigned(rest, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) * (bits + 1) + F.lit(k) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))))).otherwise(out)
    return out


def links(distinct: DataFrame, bucket: int = BUCKET, bits: int = BITS) -> DataFrame:
    """distinct: fp, each once. Returns u, v: edges that join what lies within so many bits.

    A bucket holds fingerprints with two equal blocks. One of more than `bucket` is dealt out
    again by a part of its other bits; of two bits by a third, after which at most 2 ** 22
    values can meet.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0)
            flat, at = groups.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum([0, *groups.value_lengths().to_pylist()])
            us, vs = [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                u, v = linked(flat[a:b], bits)
                us.append(u)
                vs.append(v)
            us, vs = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (us, vs))
            yield pa.RecordBatch.from_arrays([pa.array(signed(us)), pa.array(signed(vs))], ["u", "v"])

    routed = distinct.select("fp", F.explode(_keys(F.col("fp"), bits)).alias("k")).select("fp", "k.pair", "k.bits")
    counts = routed.groupBy("pair", "bits").agg(F.count("*").alias("n"))
    heavy = written(counts.filter(F.col("n") > bucket).select("pair", "bits"), "heavy")
    if heavy.isEmpty():
        dealt = routed.withColumn("sub", F.lit(-1).cast("long"))
    else:
        hot = routed.join(heavy, ["pair", "bits"]).select("fp", "pair", "bits", F.explode(_finer(F.col("fp"), F.col("pair"), bits)).alias("sub"))
        dealt = routed.join(heavy, ["pair", "bits"], "left_anti").select("fp", "pair", "bits", F.lit(-1).cast("long").alias("sub")).union(hot)
    met = dealt.groupBy("pair", "bits", "sub").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return met.select("fps").transform(in_arrow, work, "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Returns doc_id, fingerprint (16 hex digits), component_id: the least doc_id that links of
    at most two bits reach. One row for each row of docs, repeated rows too; extra columns are
    ignored. Null, empty and blank texts have fingerprint zero and link like any other. A null
    doc_id keeps its row and is never the least unless alone with its like. Equal fingerprints
    are folded before anything is linked, so copies cost a row each and no pairs."""
    fps = written(fingerprints(docs, text), "fingerprints")
    folded = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "folded")
    roots = connected_components(links(folded.select("fp"), bucket)).select(F.col("node").alias("fp"), "root")
    rooted = written(folded.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the least doc_id (null
    first; of repeated ids the first row). All columns stay."""
    source = with_uid(docs, F.struct(*docs.columns).alias("row"))
    groups = near_duplicates(source.select(F.struct("row.doc_id", "uid").alias("doc_id"), "row.text"), bucket=bucket)
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id.uid").alias("uid"))
    return source.join(first, "uid", "left_semi").select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
