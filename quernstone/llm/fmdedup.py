"""Substring dedup: an FM-index over wavelet trees for each shard of the corpus's pieces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.anchors import FIRST, HEAVY, LATER, Shard, Units, repeated_spans, runs
from quernstone.llm.common import WHITE, in_arrow, prefix_sums, span_hash, table, with_uid, words

WINDOW = 20
GRAM = 8
#: Rows of a shard, in bytes.
SHARD_BYTES = 4 << 20


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All 64 bits of each word's hash."""
    s, e, of = words(data, offsets, WHITE)
    h = np.maximum(span_hash(prefix_sums(data), s, e), np.uint64(1))
    return h, of, h


class Bits:
    """A bit vector with rank: packed words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.pad(packed, (0, -len(packed) % 8 + 8)).view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i."""
        at = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & below).astype(np.int64)


class WaveletTree:
    """Ranks of symbols in a sequence, a level for each bit of a symbol, the highest first.
    Each level's zeros go before its ones, so a level is one bit vector."""

    def __init__(self, sequence: np.ndarray, top: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(max(top, 1).bit_length() - 1, -1, -1):
            ones = (sequence >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones), int((~ones).sum())))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        every = np.arange(1 << max(top, 1).bit_length())
        self.begins = self.walked(every, np.zeros(len(every)))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first i: where the first i lead to on the last
        level, less where the symbol begins there."""
        return self.walked(symbol, i) - self.begins[symbol]

    def walked(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        for bit, ones, zeros in self.levels:
            a = ones.rank(i)
            i = np.where(symbol >> bit & 1 > 0, zeros + a, i - a)
        return i


class FmIndex:
    """Segments (rows of words, 0: none) as one text, with its suffixes sorted by their first
    `window` words, which is as far as any search goes: patterns of up to that length have the
    same ranges as with a full sort."""

    def __init__(self, rows: np.ndarray, window: int):
        self.window, (self.n_rows, self.width) = window, rows.shape
        alphabet, text = np.unique(np.append(rows.ravel(), rows.dtype.type(0)), return_inverse=True)
        text = np.concatenate([text[:-1].reshape(rows.shape), np.zeros((self.n_rows, 1), np.int64)], 1).ravel()
        self.symbols = text.reshape(self.n_rows, self.width + 1)[:, : self.width]
        n = len(text)
        rank, done = text.astype(np.int64), 1
        while done < window:
            step = min(done, window - done)
            after = np.concatenate([rank[step:], np.zeros(step, np.int64)])
            key = rank * (int(rank.max()) + 1) + after
            order = np.argsort(key)
            new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            done += step
        self.suffixes = np.argsort(rank, kind="stable") if window == 1 else order
        #: The range of suffixes that share their first `window` words, by rank.
        self.rank = rank
        self.class_at = np.concatenate([np.flatnonzero(np.diff(rank[self.suffixes], prepend=-1)), [n]])
        before = text[self.suffixes - 1]
        self.tree = WaveletTree(before, len(alphabet) - 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(before, minlength=len(alphabet)))])
        self.n = n

    def matching(self, symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Backward search of all streamed rows in step, last word first: (place, length of the
        longest match from there, at most the window; first and last + 1 suffix that has it).
        Words past a row's end match nothing, and a match cut to the window is widened to all
        suffixes that begin with it."""
        lo = np.zeros(len(symbols), np.int64)
        hi = np.full(len(symbols), self.n, np.int64)
        length = np.zeros(len(symbols), np.int64)
        for place in range(symbols.shape[1] - 1, -1, -1):
            c = symbols[:, place]
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
            a, b = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
            found = (c > 0) & (a < b)
            lo, hi, length = np.where(found, a, 0), np.where(found, b, self.n), np.where(found, length + 1, 0)
            # a word that ends the match starts a new one
            again = ~found & (c > 0)
            lo, hi, length = np.where(again, self.first[c], lo), np.where(again, self.first[c + (again)], hi), np.where(again & (self.first[np.minimum(c + 1, len(self.first) - 1)] > self.first[c]), 1, length)
            full = np.flatnonzero(length >= self.window)
            own = self.rank[self.suffixes[lo[full]]]
            lo[full], hi[full], length[full] = self.class_at[own], self.class_at[own + 1], self.window
            yield place, length, lo, hi


def statistics(rows: np.ndarray, key: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """rows: pieces; key: the place in the corpus of each one's first word, to which words add;
    n: how often each stands there. Every piece is streamed through the index of all. Flags
    (row, start) of the windows found at an earlier place too, and of those found at two places
    or more: of an interval's suffixes, the least place and the sum of n tell."""
    index = FmIndex(rows, window)
    where = np.arange(index.n)[index.suffixes]
    row, col = where // (index.width + 1), where % (index.width + 1)
    least = np.minimum.reduceat(key[row] + col, index.class_at[:-1])
    total = np.add.reduceat(n[row], index.class_at[:-1])
    earlier = np.zeros((len(rows), max(0, index.width - window + 1)), bool)
    again = earlier.copy()
    for at, length, lo, _ in index.matching(index.symbols):
        if at <= index.width - window:
            full = np.flatnonzero(length == window)
            interval = index.rank[index.suffixes[lo[full]]]
            earlier[full, at] = least[interval] < key[full] + at
            again[full, at] = total[interval] > 1
    return earlier, again


def find(window: int):
    def told(shard: Shard) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        sizes = np.array([len(s) // 8 for s in shard.segments], np.int64)
        rows = np.zeros((len(sizes), int(sizes.max(initial=0))), np.uint64)
        rows[np.arange(rows.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(shard.segments), np.uint64)
        earlier, again = statistics(rows, (shard.order << 32) + shard.at - shard.off, shard.n, window)
        # a piece's first copy goes by places; of a window found again every later copy goes
        again[shard.n < 2] = False
        return [(piece, first, last - 1 + window, whom) for whom, flags in ((FIRST, earlier), (LATER, again)) for piece, first, last in [runs(flags)]]

    return told


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY, shard_bytes: int = SHARD_BYTES, **limits: int) -> DataFrame:
    """Returns a row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept.

    A word goes if a window of 20 that covers it also starts earlier: at a lesser doc_id (null
    before all; rows of one doc_id in the files' order), or before in the same row. Windows are
    judged on the input. Texts of fewer words, null and empty ones keep all; extra columns are
    ignored; an empty table gives no rows; doc_id is of any type that has an order. Words are
    compared by 64 bits each.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = with_uid(docs, "doc_id", "text")
    spans = repeated_spans(source, Units(window, gram, word_units), find(window), True, heavy, shard_bytes, **limits)
    spans = spans.groupBy("uid").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, digest, kept = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                w = (text or "").encode().split()
                n.append(len(w))
                if batch.column(2)[k].is_valid:
                    change = np.zeros(len(w) + 1, np.int32)
                    np.add.at(change, batch.column(2)[k].values.to_numpy(), 1)
                    np.add.at(change, batch.column(3)[k].values.to_numpy(), -1)
                    stay = np.cumsum(change)[:-1] == 0
                    w = list(compress(w, stay.tolist()))
                left = b" ".join(w)
                removed.append(n[-1] - len(w))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    joined = source.join(spans, "uid", "left").select("doc_id", "text", "s", "e")
    return joined.transform(in_arrow, work, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
