"""Benchmark decontamination with suffix arrays over shards of the training text."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import LOWER, NOT_ALNUM, buffer, in_arrow, prefix_sums, ranges, slices, span_hash, table, with_uid, words

WINDOW = 10
#: Benchmark text sent to the workers at once. A larger benchmark goes in several blocks.
BLOCK_BYTES = 16 << 20
#: Blocks that one pass over the documents searches for.
PASS_BLOCKS = 4
#: The name of items whose id is null: not a string that an id can be, shown without its zero.
NAMELESS = "\0null"


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows and each row's range of them."""
    found, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for i, j in slices(offsets):
        part, at = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        s, e, of = words(part, at, NOT_ALNUM)
        found.append(span_hash(prefix_sums(part), s, e))
        counts.append(np.diff(of))
    return np.concatenate(found), np.cumsum(np.concatenate(counts))


class Probe:
    """The test suffixes of a block of benchmark items, ready to be searched for.

    A window is `window` consecutive words of an item, or the whole of a shorter item. Equal
    windows are searched once and stand for all their items. Items without words have none.
    """

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        text = pa.array([t for _, t in items], pa.string())
        h, of = word_hashes(*buffer(text))
        self.vocabulary = np.unique(h)
        ids = (np.searchsorted(self.vocabulary, h) + 1).astype(np.int32)
        self.flags = np.zeros(1 << 18, bool)
        self.flags[(self.vocabulary >> np.uint64(46)).astype(np.int64)] = True
        self.names = sorted({str(n) for n, _ in items})
        place = {n: k for k, n in enumerate(self.names)}
        self.name = np.array([place[str(n)] for n, _ in items], np.int64)
        owners: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.deepest = 1
        for k in range(len(items)):
            own = ids[of[k] : of[k + 1]]
            size = min(window, len(own))
            self.deepest = max(self.deepest, size)
            for j in range(len(own) - size + 1 if size else 0):
                owners[own[j : j + size].tobytes()].append((k, j))
        keys = sorted(owners)
        self.sizes = np.array([len(k) // 4 for k in keys], np.int64)
        self.windows = np.zeros((len(keys), self.deepest), np.int32)
        for k, key in enumerate(keys):
            self.windows[k, : self.sizes[k]] = np.frombuffer(key, np.int32)
        #: The items that have a window, and its place in each.
        self.owner, self.place = np.array([o for k in keys for o in owners[k]], np.int64).reshape(-1, 2).T
        self.owner_at = np.cumsum([0, *(len(owners[k]) for k in keys)])
        self.lead = int(min(self.sizes.min(), 3)) if len(keys) else 0
        self.leads = np.unique(self.led(self.windows)) if len(keys) else np.zeros(0, np.uint64)

    def led(self, rows: np.ndarray) -> np.ndarray:
        key = np.zeros(len(rows), np.uint64)
        for d in range(self.lead):
            key = key * np.uint64(0x9E3779B97F4A7C15) + rows[:, d].astype(np.uint64)
        return key

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of words; 0 for words of no item."""
        out = np.zeros(len(h), np.int32)
        maybe = np.flatnonzero(self.flags[(h >> np.uint64(46)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, h[maybe])
        at[at == len(self.vocabulary)] = 0
        same = self.vocabulary[at] == h[maybe]
        out[maybe[same]] = at[same] + 1
        return out


class Shard:
    """A suffix array over a shard's word numbers. Suffixes that begin with no lead of any
    window are left out: no test suffix can match them. A row's end stops every comparison."""

    def __init__(self, probe: Probe, ids: np.ndarray, of: np.ndarray):
        n, depth = len(ids), probe.deepest
        self.probe, self.n = probe, n
        room = np.zeros(n, np.int64)  # words left in the row
        sizes = np.diff(of)
        room[:] = np.repeat(of[1:], sizes) - np.arange(n)
        self.ids = np.concatenate([ids, np.zeros(depth + 1, np.int32)])
        ok = np.ones(n, bool)
        for d in range(probe.lead):
            ok &= (self.ids[d : n + d] > 0) & (room > d)
        at = np.flatnonzero(ok)
        lead = probe.led(np.stack([self.ids[at + d] for d in range(probe.lead)], 1)) if len(at) else np.zeros(0, np.uint64)
        where = np.searchsorted(probe.leads, lead)
        where[where == len(probe.leads)] = 0
        at = at[probe.leads[where] == lead] if len(at) else at
        # columns of the suffixes as far as a window reaches; -1 past the row's end
        cols = np.full((depth, len(at)), -1, np.int32)
        for d in range(depth):
            inside = room[at] > d
            cols[d, inside] = self.ids[at[inside] + d]
        order = np.lexsort(cols[::-1]) if len(at) else at
        self.suffixes, self.cols = at[order], cols[:, order]

    def bounds(self, upper: bool) -> np.ndarray:
        """Binary search of all windows at once: first suffix not below (or above) each."""
        w, sizes = self.probe.windows, self.probe.sizes
        lo, hi = np.zeros(len(w), np.int64), np.full(len(w), len(self.suffixes), np.int64)
        while (lo < hi).any():
            mid = np.minimum((lo + hi) // 2, max(0, len(self.suffixes) - 1))
            below, tied = np.zeros(len(w), bool), lo < hi
            for d in range(self.probe.deepest):
                tied &= d < sizes
                if not tied.any():
                    break
                t = np.flatnonzero(tied)
                x = self.cols[d, mid[t]]
                below[t[x < w[t, d]]] = True
                tied[t[x != w[t, d]]] = False
                if upper:
                    below[t[(x == w[t, d]) & (sizes[t] == d + 1)]] = True
            go = lo < hi
            lo, hi = np.where(go & below, mid + 1, lo), np.where(go & ~below, mid, hi)
        return lo

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, window) of every verbatim match."""
        a, b = self.bounds(False), self.bounds(True)
        return self.suffixes[ranges(a, b - a)], np.repeat(np.arange(len(a)), b - a)


Longest = tuple[int, int, int]


def longest(probe: Probe, p: np.ndarray, w: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, Longest]]:
    """Occurrences of windows, followed item by item: where neighbouring windows of an item
    occur at neighbouring words, the item goes on verbatim. (row, name) of all items that occur,
    and each row's longest match: words, item name, first word in the row; of equal ones the
    first place, then the least name."""
    counts = probe.owner_at[w + 1] - probe.owner_at[w]
    owner = ranges(probe.owner_at[w], counts)
    at, size = np.repeat(p, counts), np.repeat(probe.sizes[w], counts)
    item, lag = probe.owner[owner], probe.place[owner] - at
    row = np.searchsorted(of, at, "right") - 1
    both = np.unique(row * len(probe.names) + probe.name[item])
    order = np.lexsort((at, lag, item))
    at, item, lag, row, size = at[order], item[order], lag[order], row[order], size[order]
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at))) - 1 + size[first]
    row, at, name = row[first], at[first] - of[row[first]], probe.name[item[first]]
    order = np.lexsort((name, at, -length, row))
    best = order[np.concatenate([[True], np.diff(row[order]) > 0])]
    return both // len(probe.names), both % len(probe.names), {int(row[k]): (int(length[k]), int(name[k]), int(at[k])) for k in best}


def findings(probes: list[Probe], col: pa.Array) -> list[tuple]:
    """For each row: words, runs of hit words (start, end), item names, and the longest match
    (words, item name, first word) or None. The words are hashed once for all probes."""
    h, of = word_hashes(*buffer(col))
    n = np.diff(of)
    change = np.zeros(len(h) + 1, np.int32)
    items: dict[int, set[str]] = defaultdict(set)
    best: dict[int, tuple[int, str, int]] = {}
    for probe in probes:
        if not len(probe.sizes):
            continue
        p, w = Shard(probe, probe.ids(h), of).occurrences()
        if not len(p):
            continue
        np.add.at(change, p, 1)
        np.add.at(change, p + probe.sizes[w], -1)
        rows, names, found = longest(probe, p, w, of)
        for r, k in zip(rows.tolist(), names.tolist(), strict=True):
            items[r].add(probe.names[k])
        for r, (size, k, at) in found.items():
            best[r] = min([(size, probe.names[k], at), *([best[r]] if r in best else [])], key=lambda x: (-x[0], x[2], x[1]))
    out = [(int(k), [], [], None) for k in n]
    hit = np.cumsum(change)[:-1] > 0
    for r, found in items.items():
        own = np.diff(np.concatenate([[0], hit[of[r] : of[r + 1]].astype(np.int8), [0]]))
        runs = list(zip(np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist(), strict=True))
        out[r] = (int(n[r]), runs, sorted(found), best[r])
    return out


def blocks(benchmark: DataFrame, text: str = "text", most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in parts of bounded size; at least one, if empty. A null id has a name that
    no other id can have."""
    part, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        part.append((r.i if r.i is not None else NAMELESS, r.t or ""))
        size += len(part[-1][1]) + 64
        if size > most:
            yield part
            part, size = [], 0
    yield part


def passes(benchmark: DataFrame, window: int, most: int) -> Iterator:
    """Broadcast lists of up to PASS_BLOCKS probes, built once, on the driver. A benchmark of so
    many blocks is searched for in one pass over the documents."""
    sc, held = benchmark.sparkSession.sparkContext, []
    for part in blocks(benchmark, most=most):
        held.append(Probe(part, window))
        if len(held) == PASS_BLOCKS:
            yield sc.broadcast(held)
            held = []
    if held:
        yield sc.broadcast(held)


MATCH = "struct<size: long, item: string, at: long>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Returns a row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, and items (ids as strings, sorted), spans ([start, end) in words), longest
    (words of the longest verbatim match with one item; 0: none), longest_item and longest_at
    (that item, and the match's first word).

    Null, empty and word-free texts have no words and are clean; items without words match
    nothing; an empty benchmark leaves all clean; repeated rows are told apart; repeated item
    ids count once and a null one, shown as null, is an item of its own. Extra columns are
    ignored, ids are of any type. The benchmark goes to the workers in blocks of bounded size,
    several to a pass; several passes are merged row by row.
    """
    ids = docs.schema["doc_id"].dataType.simpleString()
    raw = f"uid long, doc_id {ids}, n_words long, spans array<array<int>>, items array<string>, longest {MATCH}"
    source = with_uid(docs, "doc_id", "text")
    match = pa.struct([("size", pa.int64()), ("item", pa.string()), ("at", pa.int64())])

    def scan(shared):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = findings(shared.value, batch.column(2))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.int64()), pa.array([[list(s) for s in g[1]] for g in got], pa.list_(pa.list_(pa.int32()))), pa.array([g[2] for g in got], pa.list_(pa.string())), pa.array([g[3] and dict(zip(("size", "item", "at"), g[3], strict=True)) for g in got], match)],
                    ["uid", "doc_id", "n_words", "spans", "items", "longest"],
                )

        return work

    found = [source.transform(in_arrow, scan(shared), raw) for shared in passes(benchmark, window, block_bytes)]
    if len(found) == 1:
        one = found[0]
    else:
        every = reduce(DataFrame.unionAll, found)
        first = F.struct(-F.col("longest.size"), "longest.at", "longest.item")
        one = every.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.min_by("longest", F.when(F.col("longest").isNotNull(), first)).alias("longest"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, merged, digest, named = [], [], [], []
            for spans, items in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                runs: list[list[int]] = []
                for s, e in spans:
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(e, runs[-1][1])
                    else:
                        runs.append([s, e])
                merged.append(runs)
                hit.append(sum(e - s for s, e in runs))
                named.append(sorted(x.lstrip("\0") for x in items))
                digest.append(hashlib.sha256(",".join(named[-1]).encode()).hexdigest())
            best = [x or {"size": 0, "item": None, "at": None} for x in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(hit, pa.int64()), pa.array([len(x) for x in named], pa.int64()), pa.array(digest, pa.string()), pa.array([x > 0 for x in hit], pa.bool_()), pa.array(named, pa.list_(pa.string())), pa.array(merged, pa.list_(pa.list_(pa.int32()))), pa.array([x["size"] for x in best], pa.int64()), pa.array([x["item"] and x["item"].lstrip("\0") for x in best], pa.string()), pa.array([x["at"] for x in best], pa.int64())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans", "longest", "longest_item", "longest_at"],
            )

    return one.transform(in_arrow, finish, f"doc_id {ids}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<array<int>>, longest long, longest_item string, longest_at long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold any window of the benchmark; all columns stay. Nothing
    is shuffled: the benchmark filters the rows where they are. Null, empty and word-free texts
    stay, repeated rows stay or go alike, an empty benchmark leaves all, clashing columns are
    of no account as none is added."""
    place = docs.columns.index("text")

    def keep(shared):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not g[1] for g in findings(shared.value, batch.column(place))], pa.bool_()))

        return work

    for shared in passes(benchmark, window, block_bytes):
        docs = docs.transform(in_arrow, keep(shared), docs.schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
