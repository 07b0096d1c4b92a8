"""Packing token sequences by minimum bin slack over a histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.llm.common import buffer, in_arrow, prefix_sums, ranges, slices, span_hash, table, written

WINDOW = 2048
END_ID = 1
#: Text encoded at once, in bytes: the more, the fewer calls for new words.
SLICE = 1 << 20
#: Words whose ids a worker remembers at most.
REMEMBERED = 1 << 20
#: Classes of bytes: white space that no token spans, ASCII letters, ASCII marks, the rest.
#: An apostrophe is of the rest, as it begins a suffix such as 's.
CLASS = np.full(256, 3, np.int8)
CLASS[list(b" \n\t\r")] = 0
CLASS[[*range(65, 91), *range(97, 123)]] = 1
CLASS[[i for i in range(33, 127) if not chr(i).isalnum() and i != 39]] = 2


class Encoder:
    """Token ids of whole texts. Tokens span neither white space nor a letter and a mark next
    to it, so each distinct piece between is encoded once and a text's ids are its pieces' in
    a row. Texts that might hold a special token ("<|") are encoded as they are, and so are all
    if a sample shows that the tokenizer's tokens span such edges."""

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items()]
        #: Parts the pieces that are encoded in one call.
        self.parting = next(((t, i) for t, i in sorted(special) if t.startswith("<|")), None)
        self.plain = all(t.startswith("<|") for t, _ in special)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end_id = end_id
        self.forget()
        self.proven = not self.plain

    def forget(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes, and their words
        self.pool = np.array([self.end_id], self.kind)  # the ids of word 0: a document's end
        self.starts, self.counts = np.zeros(1, np.int32), np.ones(1, np.int32)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        if self.parting is None or len(texts) == 1:
            each = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in each for i in x], self.kind), np.array(list(map(len, each)), np.int64)
        out = np.array(self.tokenizer.encode_batch_fast([self.parting[0].join(texts)], add_special_tokens=False)[0].ids, np.int64)
        at = np.flatnonzero(out == self.parting[1])
        return out[out != self.parting[1]].astype(self.kind), np.diff(np.concatenate([[-1], at, [len(out)]])) - 1

    def places(self, h: np.ndarray, s: np.ndarray, e: np.ndarray, raw: bytes) -> np.ndarray:
        if len(self.keys) > REMEMBERED:
            self.forget()
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        near = np.minimum(place, max(0, len(self.keys) - 1))
        known = self.keys[near] == keys if len(self.keys) else np.zeros(len(keys), bool)
        got = np.zeros(len(keys), np.int32)
        got[known] = self.at[near[known]]
        if len(new := np.flatnonzero(~known)):
            at = first[new]
            ids, n = self.ids([raw[a:b].decode() for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)])
            got[new] = np.arange(len(new)) + len(self.starts)
            self.keys, self.at = np.insert(self.keys, place[new], keys[new]), np.insert(self.at, place[new], got[new])
            self.starts = np.concatenate([self.starts, (len(self.pool) + np.cumsum(n) - n).astype(np.int32)])
            self.counts = np.concatenate([self.counts, n.astype(np.int32)])
            self.pool = np.concatenate([self.pool, ids])
        return got[back]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice's rows, each with the end id, and n + 1 offsets."""
        raw = data.tobytes()
        if b"<|" in raw or not self.plain:
            return self.whole(raw, offsets)
        if not self.proven:
            self.prove(raw, offsets)
        cls = CLASS[data]
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = (cls[1:] != cls[:-1]) & (cls[1:] < 3) & (cls[:-1] < 3) | (cls[1:] == 0) | (cls[:-1] == 0)
        cut[offsets] = True
        at = np.flatnonzero(cut)
        s, e = at[:-1], at[1:]
        inside = cls[s] > 0 if len(data) else np.zeros(0, bool)
        s, e = s[inside], e[inside]
        of = np.searchsorted(s, offsets)
        place = np.insert(self.places(span_hash(prefix_sums(data), s, e), s, e, raw), of[1:], 0)
        counts = self.counts[place].astype(np.int64)
        at = np.concatenate([[0], np.cumsum(counts)])
        return self.pool[ranges(self.starts[place], counts)], at[of + np.arange(len(of))]

    def prove(self, raw: bytes, offsets: np.ndarray) -> None:
        """Whether the tokenizer keeps to the pieces: the worker's first texts, and one of all
        kinds of edges, encoded both ways. Another tokenizer encodes whole texts."""
        self.proven = True
        edges = " ".join(f"{a}{b}{c}" for a in ("Ab", "'s", "9", "\u00e9", "-") for b in ("", ".", "'", " ", "\n", "\t  ") for c in ("Cd", "(", "7", "\u00fc'"))
        texts = [edges.encode(), *(raw[a:b] for a, b in zip(offsets[:-1][:64], offsets[1:][:64], strict=True))]
        raw, at = b"".join(texts), np.cumsum([0, *map(len, texts)])
        a, b = self.encode(np.frombuffer(raw, np.uint8), at), self.whole(raw, at)
        self.plain = all(len(x) == len(y) and bool((x == y).all()) for x, y in zip(a, b, strict=True))

    def whole(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        each = [[*x.ids, self.end_id] for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in each for i in x], self.kind), np.cumsum([0, *map(len, each)])


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One for each worker: its later tasks know the words of its earlier ones."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def tokenized(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """part, uid, doc_id, n (ids with the end id), rest (n modulo window), nth (rows with this
    rest before it in its part), full (whole windows before it in its part), ids (binary)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, full = TaskContext.get().partitionId(), 0, 0
        seen = np.zeros(window, np.int64)
        own = encoder(path, end_id)
        for batch in batches:
            data, offsets = buffer(batch.column(1))
            for i, j in slices(offsets, SLICE):
                ids, at = own.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.diff(at)
                rest = n % window
                order = np.argsort(rest, kind="stable")
                group = rest[order]
                within = np.arange(len(group)) - np.searchsorted(group, group)
                nth = np.empty(len(n), np.int64)
                nth[order] = within + seen[group]
                seen += np.bincount(rest, minlength=window)
                whole = full + np.cumsum(n // window) - n // window
                full += int((n // window).sum())
                raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((at * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int64)), pa.array((np.int64(part) << 33) + row + np.arange(len(n))), batch.column(0).slice(i, j - i), pa.array(n), pa.array(rest), pa.array(nth), pa.array(whole), raw],
                    ["part", "uid", "doc_id", "n", "rest", "nth", "full", "ids"],
                )
                row += len(n)

    return docs.select("doc_id", "text").transform(in_arrow, work, f"part long, uid long, doc_id {kind}, n long, rest long, nth long, full long, ids binary")


def fill(counts: dict[int, int], largest: int, target: int) -> tuple[dict[int, int], int]:
    """Subset sum over a multiset of lengths by bitset: bit s of `reach` is set if some of them
    add up to s. Returns how often each is taken for the sum closest to target, and that sum.
    Longer ones first; it stops once target is reached."""
    reach, mask, steps = 1, (1 << (target + 1)) - 1, []
    for size in sorted((x for x in counts if x <= target), reverse=True):
        left = min(counts[size] - (size == largest), target // size)
        take = 1
        while left > 0:
            take = min(take, left)
            more = (reach | reach << size * take) & mask
            if more != reach:
                steps.append((size, take, reach))
                reach = more
            left -= take
            take *= 2
        if reach >> target & 1:
            break
    best = at = reach.bit_length() - 1
    need: dict[int, int] = defaultdict(int)
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            at -= size * take
            need[size] += take
    return dict(need), best


class Plan:
    """Where the rest of every document goes, as rows over ranges of (rest, rank).

    A step takes the longest length left, fills the window to the brim by fill(), cuts one
    more piece if a slack is left, and repeats this as often as the counts allow. So the steps
    follow the number of lengths, not of documents, and every window is full but the last,
    which is cut into powers of two. What is kept: (rest, first rank, count, start, length,
    first sequence, pieces in each sequence, pieces before, offset)."""

    def __init__(self, counts: dict[int, int], window: int = WINDOW):
        self.window, self.sequences = window, 0
        self.rows: list[tuple[int, ...]] = []
        self.sources: dict[int, deque] = {size: deque([(size, 0, n, 0)]) for size, n in counts.items() if size and n}
        self.counts = {size: n for size, n in counts.items() if size and n}
        while self.counts:
            total = sum(size * n for size, n in self.counts.items())
            if total <= window:
                self.last(total)
            else:
                self.step()
        self.index()

    def take(self, size: int, n: int) -> Iterator[tuple[tuple[int, int, int, int], int]]:
        """Takes n pieces of a length: (source, first rank, count, start) and those before."""
        before = 0
        while before < n:
            rest, rank, count, start = self.sources[size].popleft()
            k = min(count, n - before)
            if k < count:
                self.sources[size].appendleft((rest, rank + k, count - k, start))
            yield (rest, rank, k, start), before
            before += k
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size], self.sources[size]

    def put(self, size: int, n: int, each: int, offset: int, keep: int = 0) -> None:
        """Deals n * each pieces of a length to n sequences; only `keep` ids of each, if set,
        and the remnants return to the pool."""
        for (rest, rank, k, start), before in list(self.take(size, n * each)):
            self.rows.append((rest, rank, k, start, keep or size, self.sequences, each, before, offset))
            if keep:
                self.counts[size - keep] = self.counts.get(size - keep, 0) + k
                self.sources.setdefault(size - keep, deque()).append((rest, rank, k, start + keep))

    def step(self) -> None:
        longest = max(self.counts)
        need, best = fill(self.counts, longest, self.window - longest)
        need[longest] = need.get(longest, 0) + 1
        slack, cut = self.window - longest - best, 0
        if slack:
            spare = [x for x in self.counts if x > slack and self.counts[x] > need.get(x, 0)]
            cut = min(spare)  # else all that is left would have fitted
        times = min(self.counts[x] // (n + (x == cut)) for x, n in [*need.items(), *([(cut, need.get(cut, 0))] if cut else [])])
        offset = 0
        for size in sorted(need, reverse=True):
            self.put(size, times, need[size], offset)
            offset += size * need[size]
        if cut:
            self.put(cut, times, 1, offset, slack)
        self.sequences += times

    def last(self, total: int) -> None:
        """What is left, less than a window or one: sequences of a power of two each."""
        rooms = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        room, offset = rooms.pop(0), 0
        for size in sorted(self.counts, reverse=True):
            for (rest, rank, count, start), _ in list(self.take(size, self.counts[size])):
                for r in range(rank, rank + count):
                    at, left = start, size
                    while left:
                        k = min(left, room - offset)
                        self.rows.append((rest, r, 1, at, k, self.sequences, 1, 0, offset))
                        at, left, offset = at + k, left - k, offset + k
                        if offset == room:
                            self.sequences += 1
                            room, offset = (rooms.pop(0) if rooms else 0), 0

    def index(self) -> None:
        """For each rest, ranges of rank without overlap and the rows of each."""
        by: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for row in self.rows:
            by[row[0]].append(row)
        self.at: dict[int, tuple[list[int], list[list[tuple[int, ...]]]]] = {}
        for rest, rows in by.items():
            edges = sorted({x for r in rows for x in (r[1], r[1] + r[2])})
            place = {x: k for k, x in enumerate(edges)}
            held: list[list[tuple[int, ...]]] = [[] for _ in edges]
            for r in sorted(rows, key=lambda r: r[3]):
                for k in range(place[r[1]], place[r[1] + r[2]]):
                    held[k].append(r)
            self.at[rest] = (edges, held)
        self.rows = []

    def pieces(self, rest: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of one document's rest."""
        edges, held = self.at[rest]
        out = []
        for _, first, _, start, size, sequence, each, before, offset in held[bisect_right(edges, rank) - 1]:
            t = before + rank - first
            out.append((start, size, sequence + t // each, offset + t % each * size))
        return out


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset.

    A document's whole windows are sequences of their own; the rest of it goes where Plan says,
    which sees only how many documents have each rest (fewer than `window` numbers). Null and
    empty texts have the end id alone and are packed like any other; repeated rows and ids are
    packed once each; an empty table gives no rows; extra columns are ignored. Sequences of
    rests are numbered from 0; those of whole windows follow, numbered by partition.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    tokens = written(tokenized(docs, path, window, end_id), "tokens")
    by_part = written(tokens.filter("rest > 0").groupBy("rest", "part").agg(F.count("*").alias("n")), "rests")
    plan = Plan({r.rest: r.n for r in by_part.groupBy("rest").agg(F.sum("n").alias("n")).collect()}, window)
    before = by_part.select("rest", "part", (F.sum("n").over(W.partitionBy("rest").orderBy("part")) - F.col("n")).alias("before"))
    shared = spark.sparkContext.broadcast(plan)
    wide = Encoder(path).kind

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            _, _, n, rest, nth, full, before = (batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 5, 6))
            part, owner, out = batch.column(0).to_pylist(), [], []
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(7)[i].as_buffer(), wide).astype("<u4")
                first = plan.sequences + (part[i] << 33) + full[i]
                found = [(k * window, window, first + k, 0) for k in range(n[i] // window)]
                if rest[i]:
                    found += [(n[i] - rest[i] + s, size, q, o) for s, size, q, o in plan.pieces(rest[i], before[i] + nth[i])]
                for s, size, q, o in found:
                    owner.append(i)
                    out.append((s, size, zlib.crc32(ids[s : s + size]), n[i], q, o))
            cols = [pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 6)]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(owner, pa.int64())), *cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = tokens.join(before, ["rest", "part"], "left").select("part", "doc_id", "n", "rest", "nth", "full", F.coalesce("before", F.lit(0)).cast("long").alias("before"), "ids")
    return placed.transform(in_arrow, work, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
