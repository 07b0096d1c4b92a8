"""Suffix dedup: column-wise construction of the Burrows-Wheeler transform of many documents."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.anchors import EVERY, HEAVY, Shard, Units, repeated_spans, runs
from quernstone.llm.common import BASE, in_arrow, table, with_uid

WINDOW = 200
GRAM = 48
#: Rows of a shard, in bytes: what a core's caches hold with the transform.
SHARD_BYTES = 1 << 18
SPAN = 8
#: Common prefixes are kept up to this length.
LONGEST = 255
#: Bytes of a symbol.
EACH = 8
ROW = np.uint64(0xFFFFFFFF)


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of the eight bytes from each place on, read at once."""
    n = max(0, len(data) - SPAN + 1)
    h = np.ndarray((n,), "<u8", data if n else np.zeros(SPAN, np.uint8), strides=(1,)) * BASE
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h, offsets, data


class Sequence:
    """A sequence of numbers in an unnamed file that is read and written in order only; each new
    version takes the place of the one before. The file goes with the object."""

    def __init__(self, values: np.ndarray):
        self.file, self.kind = tempfile.TemporaryFile(), values.dtype
        self.write(values)

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        self.file.write(values.data)
        self.size = values.nbytes

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(self.size), self.kind)

    def merge(self, kept: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        """A new version: what was there, in order, where kept is set, then values at the places
        `at`."""
        out = np.empty(len(kept), self.kind)
        out[kept] = self.read()
        out[at] = values
        self.write(out)

    def close(self) -> None:
        self.file.close()


class Columns:
    """Segments as documents of symbols, a symbol being EACH bytes: a document for each of EACH
    places that the first symbol can start at, so that every suffix of a segment is one of one
    document. The documents' symbols by their number from the end, one column after another, in
    a file that is read in order. A symbol is the number, from 1, of its bytes in their order;
    0 stands before a segment's start. Bytes count from 1, and zeros stand past the end."""

    def __init__(self, segments: list[bytes]):
        self.sizes = np.array([len(d) for d in segments], np.int64)
        ends = np.cumsum(self.sizes + EACH)
        data = np.frombuffer(b"".join(d + b"\xff" * EACH for d in segments), np.uint8) + np.uint8(1)
        whole = np.zeros(max(0, len(data) - EACH + 1), np.uint64)
        for k in range(EACH):
            whole = whole << np.uint64(8) | data[k : k + len(whole)]
        #: The bytes of each symbol.
        self.bytes, symbol = np.unique(np.append(whole, np.uint64(0)), return_inverse=True)
        symbol = symbol.astype(np.uint32)
        left, ends = np.repeat(self.sizes, EACH), np.repeat(ends - EACH, EACH)
        self.n, self.width = len(left), int(self.sizes.max(initial=0)) // EACH + 2
        #: Bytes of the last symbol.
        self.rest = np.tile((np.arange(EACH) - 1) % EACH + 1, len(segments))
        self.file = tempfile.TemporaryFile()
        for k in range(self.width):
            back = self.rest + EACH * k
            column = np.zeros(self.n, np.uint32)
            own = np.flatnonzero(left >= back)
            column[own] = symbol[ends[own] - back[own]]
            self.file.write(column.data)
        self.file.seek(0)

    def __iter__(self) -> Iterator[np.ndarray]:
        for _ in range(self.width):
            yield np.frombuffer(self.file.read(4 * self.n), np.uint32)
        self.file.close()


def least_between(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of x[low ... high], high included, of each range."""
    out = x[high]
    wide = np.flatnonzero(high > low)
    if len(wide):
        low, high = low[wide], high[wide]
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        best, t = np.empty(len(wide), x.dtype), x
        for k in range(int(level.max()) + 1):
            if k:
                half = 1 << (k - 1)
                t = np.minimum(t[:-half], t[half:])
            own = np.flatnonzero(level == k)
            best[own] = np.minimum(t[low[own]], t[high[own] - (1 << k) + 1])
        out[wide] = best
    return out


class Transform:
    """The Burrows-Wheeler transform of a collection and the common prefix of each suffix with
    the one before (in bytes, up to LONGEST), built by inserting one symbol of every document
    each round, from the documents' ends on.

    After round k the rows are the sorted suffixes of up to k symbols, each with the symbol
    before it (zero: none). The next suffix of a document stands where its first symbol, counted
    in the transform, says: after all rows that begin with lesser symbols and after those that
    the equal symbols above it stand for. It shares one symbol more with the row above than the
    least common prefix between the rows that the two symbols stand at; only that row and the
    one below it are new. The documents' own ends differ, so none is shared.

    `ranked` has the transform's symbols in order, each with its row: where the symbols above
    are counted. Transform and prefixes are files that a round reads and writes in order.
    """

    def __init__(self, segments: list[bytes]):
        columns = Columns(segments)
        self.n, self.sizes, self.rest, self.bytes = columns.n, columns.sizes, columns.rest, columns.bytes
        rounds = iter(columns)
        symbols = next(rounds)
        self.symbols, self.prefixes = Sequence(symbols), Sequence(np.zeros(self.n, np.uint8))
        self.ranked = np.sort(symbols.astype(np.uint64) << np.uint64(32) | np.arange(self.n, dtype=np.uint64))
        #: Documents with a symbol left, by where it is ranked.
        live = (self.ranked & ROW)[self.ranked > ROW].astype(np.int64)
        self.ends = self.n - len(live)
        ranks = self.ends + np.arange(len(live))
        for symbols in rounds:
            live, ranks = self.insert(live, ranks, symbols[live])

    def insert(self, live: np.ndarray, ranks: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A round: the symbols before the documents' next suffixes, which begin with what is
        ranked at `ranks`. Returns the documents that go on, and their symbols' ranks."""
        shift = self.n - self.ends
        rows = shift + ranks
        kept = np.ones(shift + len(self.ranked), bool)
        kept[rows] = False
        # the new rows and those below them
        near = np.zeros(len(self.ranked) + 1, bool)
        near[ranks] = near[ranks + 1] = True
        at = np.flatnonzero(near[:-1])
        one, above = self.ranked[at], self.ranked[at - 1]
        a = self.bytes[(one >> np.uint64(32)).view(np.int64)]
        differ = a ^ self.bytes[(above >> np.uint64(32)).view(np.int64)]
        shared = np.zeros(len(at), np.uint8)
        for k in range(1, EACH):
            shared += differ < 1 << (64 - 8 * k)
        same = differ == 0
        if (cut := same & (a & np.uint64(255) == 0)).any():  # by the segments' ends
            shared[cut] = (a[cut, None] >> np.arange(0, 64, 8, dtype=np.uint64) & np.uint64(255) > 0).sum(axis=1)
            same &= ~cut
        same = np.flatnonzero(same)
        shared[same] = np.minimum(least_between(self.prefixes.read(), (above[same] & ROW).view(np.int64) + 1, (one[same] & ROW).view(np.int64)), LONGEST - EACH) + EACH
        shared[at == self.ends] = 0
        self.prefixes.merge(kept, shift + at, shared)
        self.symbols.merge(kept, rows, symbols)
        # rows that were there move down by the new ones above them
        to = np.flatnonzero(kept)
        self.ranked += (to - np.arange(len(to))).astype(np.uint32).take((self.ranked & ROW).view(np.int64))
        new = symbols.astype(np.uint64) << np.uint64(32) | rows.astype(np.uint64)
        order = np.argsort(new)
        new, live = new[order], live[order]
        ranks = np.searchsorted(self.ranked, new) + np.arange(len(new))
        kept = np.ones(len(kept), bool)
        kept[ranks] = False
        both = np.empty(len(kept), np.uint64)
        both[kept] = self.ranked
        both[ranks] = new
        self.ranked = both
        go = new > ROW
        self.ends += int((~go).sum())
        return live[go], ranks[go]

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Walks the transform back: (k, documents, their suffixes' rows, the symbols before
        these) for suffixes of k = 0, 1, ... symbols."""
        symbols = self.symbols.read()
        before = np.empty(len(symbols), np.int64)
        before[(self.ranked & ROW).view(np.int64)] = self.n - self.ends + np.arange(len(symbols))
        documents, at, k = np.arange(self.n), np.arange(self.n), 0
        while len(at):
            yield k, documents, at, symbols[at]
            go = symbols[at] > 0
            documents, at, k = documents[go], before[at[go]], k + 1

    def repeated(self, window: int, n: np.ndarray) -> np.ndarray:
        """n: how often each segment stands in the corpus. Flags (segment, start) of each string
        of `window` bytes that starts elsewhere too."""
        same = self.prefixes.read() >= window
        same[:-1] |= same[1:]
        flags = np.zeros((len(n), max(0, int(self.sizes.max(initial=0)) - window + 1)), bool)
        for k, documents, at, _ in self.rows():
            segment = documents // EACH
            size = self.rest[documents] + EACH * (k - 1)
            own = (k > 0) & (size >= window) & (same[at] | (n[segment] > 1))
            flags[segment[own], (self.sizes[segment] - size)[own]] = True
        return flags

    def close(self) -> None:
        self.symbols.close()
        self.prefixes.close()


def find(window: int):
    def told(shard: Shard) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        transform = Transform(shard.segments)
        piece, first, last = runs(transform.repeated(window, shard.n))
        transform.close()
        return [(piece, first, last - 1 + window, EVERY)]

    return told


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY, shard_bytes: int = SHARD_BYTES, **limits: int) -> DataFrame:
    """Returns a row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Every byte goes that a string of 200 bytes covers which also starts anywhere else, in the
    same text too; no string crosses texts, and all are judged on the input. Shorter, null
    (empty) and empty texts keep all; repeated rows count as texts of their own; an empty table
    gives no rows; extra columns are ignored; doc_id is of any type. kept is binary: a cut may
    part a character. A window is of 255 bytes at most.
    """
    if window > LONGEST:
        raise ValueError(f"a window of {window} bytes is above {LONGEST}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = with_uid(docs, "doc_id", "text")
    spans = repeated_spans(source, Units(window, gram, byte_units, SPAN), find(window), False, heavy, shard_bytes, **limits)
    spans = spans.groupBy("uid").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts, ends in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                raw = (text or "").encode()
                kept, at, n = [], 0, 0
                for s, e in sorted(zip(starts or [], ends or [], strict=True)):
                    if s > at or not n:
                        kept.append(raw[at:s])
                        n += 1
                    at = max(at, e)
                kept.append(raw[at:])
                left = b"".join(kept)
                rows.append((len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = source.join(spans, "uid", "left").select("doc_id", "text", "s", "e")
    return joined.transform(in_arrow, work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
