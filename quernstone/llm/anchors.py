"""Where repeated windows can meet: the gram that any window picks by its own content.

A window of `size` units (bytes or words) holds size - gram + 1 grams and picks the leftmost of
those with the least hash, its anchor, so equal windows pick equal anchors at equal places. The
windows in a row that pick one anchor make up a piece, so each window lies in one piece. Pieces
of one anchor are sent to one shard, where an index tells which windows are repeated.

Equal pieces are one entry of an index, with their number and first place; what is repeated, the
index alone says. An anchor with too many different pieces is parted by what its windows hold
besides: they fall into classes by where they start, and those of a class share a core around
the anchor, by which they are dealt. At the last level the core is the window.

Bit filters spare most of the work: anchors that stand once in the corpus are never sent. They
are sized by what they hold, and a bit set by chance costs time, never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import BASE, buffer, in_arrow, long_hash, mixed, powers, prefix_sums, ranges, signed, slices, span_hash, written

#: A filter's bits as powers of two: its standard size, and the least and most (32 MB) of one
#: that is sized by what it holds.
FILTER_BITS, LEAST_BITS, MOST_BITS = 26, 16, 28
#: Pieces of a slice whose contents are held at once.
AT_ONCE = 4096
#: Pieces that a filter can choose; more are chosen by a join.
CHOSEN = 1 << (MOST_BITS - 2)
#: Different pieces of an anchor that one shard takes; an anchor with more is parted.
HEAVY = 1 << 14


def sliding(x: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """best (np.minimum or np.maximum) of each `width` neighbours: len(x) - width + 1 values."""
    if len(x) < width:
        return x[:0]
    done = 1
    while 2 * done <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    if done == width:
        return x
    rest = width - done
    return best(x[: len(x) - rest], x[rest:])


@dataclass(frozen=True)
class Units:
    """Texts as rows of units. units(data, offsets) gives hashes for grams, each row's range of
    units, and what pieces carry: a byte or a word's 64-bit hash for each unit."""

    size: int
    gram: int
    units: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: Units that one hash covers; it starts at each of them.
    span: int = 1

    @property
    def before(self) -> int:
        """How far before its anchor a window starts at most."""
        return self.size - self.gram

    @property
    def widths(self) -> tuple[int, ...]:
        """Places at which the windows of a piece may start, by level."""
        whole = self.before + 1
        return (whole, -(-whole // 8), 1)

    def grams(self, h: np.ndarray) -> np.ndarray:
        """Hashes of each `gram` units by doubling: h of 2k units from two of k. h has one
        value for each unit, or for each run of `span` units."""
        out, done = None, 0
        run, width = h, self.span
        power = _power(width)
        for bit in bin(self.gram // self.span)[:1:-1]:
            if bit == "1":
                if out is None:
                    out, done = run, width
                else:  # the part of `width` units goes before that of `done`
                    n = len(run) - done
                    n = min(n, len(out) - width)
                    if n <= 0:
                        return h[:0]
                    out = run[:n] * _power(done) + out[width : width + n]
                    done += width
            if len(run) - width <= 0:
                run = run[:0]
            else:
                run = run[:-width] * power + run[width:]
            width *= 2
            power = _power(width)
        return mixed(out) if out is not None and done == self.gram else h[:0]

    def picked(self, h: np.ndarray, of: np.ndarray) -> Pieces:
        """The pieces of a slice's rows, each with its anchor's hash as key."""
        starts = ranges(of[:-1], np.maximum(np.diff(of) - self.size + 1, 0))
        if not len(starts):
            none = np.zeros(0, np.int64)
            return Pieces(none, none, none, np.zeros(0, np.uint64))
        g = self.grams(h)
        # the upper half of a hash, then the place: a window past a row's end is never looked up
        order = g & np.uint64(0xFFFFFFFF00000000) | np.arange(len(g), dtype=np.uint64)
        at = (sliding(order, self.before + 1, np.minimum)[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        return Pieces(at[first], starts[first], starts[last] + self.size, g[at[first]])

    def sums(self, payload: np.ndarray) -> np.ndarray:
        """Prefix sums by which span_hash() tells runs of units apart."""
        if payload.dtype == np.uint8:
            return prefix_sums(payload)
        return np.concatenate([[np.uint64(0)], np.cumsum(payload * powers("up", len(payload)), dtype=np.uint64)])


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


@dataclass
class Pieces:
    """Anchor, start and end of pieces (places in a slice), and the key each is dealt by."""

    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray

    def only(self, wanted: np.ndarray) -> Pieces:
        return Pieces(self.at[wanted], self.start[wanted], self.end[wanted], self.key[wanted])

    def parted(self, units: Units, sums: np.ndarray, width: int) -> Pieces:
        """Each piece's windows in classes of `width` starting places; the key is a hash of the
        class and of the core that all windows of the class have around the anchor."""
        base = self.at - units.before
        low, high = (self.start - base) // width, (self.end - units.size - base) // width
        own = np.repeat(np.arange(len(low)), high - low + 1)
        which = ranges(low, high - low + 1)
        first = base[own] + which * width
        last = np.minimum(first + width - 1, self.at[own])
        core = span_hash(sums, last, first + units.size)
        start, end = np.maximum(self.start[own], first), np.minimum(self.end[own] - units.size, last) + units.size
        return Pieces(self.at[own], start, end, mixed(core + which.astype(np.uint64) * BASE + np.uint64(width)))


def bitmap(hashes: DataFrame, bits: int | None = None) -> np.ndarray:
    """A bit for the lower `bits` of each h: if not set, some twenty for each hash, up to
    MOST_BITS. At most 2 ** (bits - 6) words reach the driver."""
    bits = bits or min(MOST_BITS, max(LEAST_BITS, hashes.count().bit_length() + 4))
    # the least hashes of anchors have small upper halves: the lower bits are the even ones
    word = F.shiftrightunsigned("h", 6).bitwiseAND((1 << (bits - 6)) - 1).alias("word")
    got = hashes.select(word, F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return out


def marked(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bits[(h >> np.uint64(6) & np.uint64(len(bits) - 1)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) > 0


def found_again(docs: DataFrame, units: Units) -> DataFrame:
    """docs: uid, doc_id, text. h: the anchors of more than one piece."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer(batch.column(2))
            for i, j in slices(offsets):
                h, of, _ = units.units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                key, n = np.unique(units.picked(h, of).key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(n)], ["h", "n"])

    return docs.transform(in_arrow, work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")


class Cut:
    """The pieces of a slice at one level, equal ones of one row folded: row, key, mark (a hash
    of the content and of the anchor's place in it), places (offsets into at), at (places of the
    anchor in its row), and start, end and off (of the first such piece: its place in the slice,
    and of the anchor in it)."""

    def __init__(self, units: Units, text: tuple, keeps: tuple[np.ndarray, ...]):
        h, of, self.payload = text
        p = units.picked(h, of)
        p = p.only(marked(p.key, keeps[0]))
        sums = units.sums(self.payload) if len(p.at) else np.zeros(1, np.uint64)
        for bits, width in zip(keeps[1:], units.widths[1:], strict=False):
            p = p.only(marked(p.key, bits)).parted(units, sums, width)
        row = np.searchsorted(of, p.at, "right") - 1
        mark = mixed(span_hash(sums, p.start, p.end) ^ mixed((p.at - p.start + 1).astype(np.uint64)))
        _, first, back = np.unique(mixed(mark + row.astype(np.uint64) * BASE) ^ p.key, return_index=True, return_inverse=True)
        order = np.lexsort((p.at, back))
        self.places = np.searchsorted(back[order], np.arange(len(first) + 1)).astype(np.int32)
        self.at = (p.at - of[row])[order].astype(np.int32)
        self.row, self.key, self.mark = row[first], p.key[first], mark[first]
        self.start, self.end, self.off = p.start[first], p.end[first], (p.at - p.start)[first]

    def own(self, uid: np.ndarray) -> np.ndarray:
        """A key for each piece and row: xxhash64(h, mark, uid)."""
        return long_hash(self.key, self.mark, uid.view(np.uint64))

    def contents(self, which: np.ndarray) -> pa.Array:
        size = (self.end - self.start)[which]
        cells = self.payload[ranges(self.start[which], size)]
        at = np.concatenate([[0], np.cumsum(size)]) * cells.itemsize
        return pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(cells))])


def _cuts(batch: pa.RecordBatch, units: Units, keeps: tuple[np.ndarray, ...]) -> Iterator[tuple[int, Cut]]:
    """(first row of the slice, its pieces) of a batch of uid, doc_id, text."""
    data, offsets = buffer(batch.column(2))
    for i, j in slices(offsets):
        cut = Cut(units, units.units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), keeps)
        if len(cut.row):
            yield i, cut


def placed(docs: DataFrame, units: Units, keeps: tuple[np.ndarray, ...], kind: str | None) -> DataFrame:
    """docs: uid, doc_id, text. h (key), mark, uid, at (places of the anchor in the row at which
    the piece is the same), and doc_id if its kind is given, of the pieces of a level."""
    shared = docs.sparkSession.sparkContext.broadcast(keeps)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, c in _cuts(batch, units, shared.value):
                row = pa.array(c.row + i)
                at = pa.ListArray.from_arrays(pa.array(c.places), pa.array(c.at))
                cols = {"h": pa.array(signed(c.key)), "mark": pa.array(signed(c.mark)), "uid": batch.column(0).take(row), "at": at}
                yield pa.RecordBatch.from_pydict(cols | ({"doc_id": batch.column(1).take(row)} if kind else {}))

    return docs.transform(in_arrow, work, "h long, mark long, uid long, at array<int>" + (f", doc_id {kind}" if kind else ""))


def contents(docs: DataFrame, units: Units, keeps: tuple[np.ndarray, ...], chosen: DataFrame, most: int = CHOSEN) -> DataFrame:
    """chosen: uid, own. h, own, at (the anchor's first place in the row), off (its place in the
    segment), segment of the pieces of a level that are chosen, and of some others, which their
    own key tells apart. Up to `most` are chosen by a filter that is broadcast; of more, each row
    gets its own by a join."""
    by_join = chosen.count() > most
    bits = None if by_join else bitmap(chosen.select(F.col("own").alias("h")))
    shared = docs.sparkSession.sparkContext.broadcast((keeps, bits))
    if by_join:
        docs = docs.join(chosen.groupBy("uid").agg(F.collect_list("own").alias("wanted")), "uid").select("uid", "doc_id", "text", "wanted")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps, bits = shared.value
        for batch in batches:
            for i, c in _cuts(batch, units, keeps):
                own = c.own(batch.column(0).take(pa.array(c.row + i)).to_numpy())
                if by_join:
                    known = batch.column(3).slice(i, int(c.row.max()) + 1).flatten().to_numpy().view(np.uint64)
                    wanted = np.flatnonzero(np.isin(own, known))
                else:
                    wanted = np.flatnonzero(marked(own, bits))
                for k in range(0, len(wanted), AT_ONCE):
                    some = wanted[k : k + AT_ONCE]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(c.key[some])), pa.array(signed(own[some])), pa.array(c.at[c.places[some]]), pa.array(c.off[some].astype(np.int32)), c.contents(some)], ["h", "own", "at", "off", "segment"])

    return docs.transform(in_arrow, work, "h long, own long, at int, off int, segment binary")


@dataclass
class Shard:
    """The different pieces of some keys: segments (each one's content), off (the anchor's place
    in it), n (how often it stands in the corpus), and order (of its first place among the rows
    of the shard) and at (of the anchor in that row)."""

    segments: list[bytes]
    off: np.ndarray
    n: np.ndarray
    order: np.ndarray
    at: np.ndarray


#: Which copies of a piece a finding is about.
FIRST, LATER, EVERY = 0, 1, 2
#: A shard's findings: (piece, first unit, last unit + 1, whom it is about).
Find = Callable[[Shard], list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]]


def _told(sent: DataFrame, find: Find, shard_bytes: int) -> DataFrame:
    """sent: h, own, at, off, segment of contents, and h, own, mark, n, uid, doc_id of what is
    known of a piece. h, mark, uid1 (of its first place), from, to (units, from the anchor), whom."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in shards(batches, shard_bytes):
            known = t.filter(pc.is_valid(t.column("n"))).combine_chunks()
            held = t.filter(pc.is_null(t.column("n"))).combine_chunks()
            # by its own key each known piece finds its content; others were chosen by chance
            others, where = np.unique(held.column("own").to_numpy(), return_index=True)
            held = held.take(pa.array(where[np.searchsorted(others, known.column("own").to_numpy())]))
            uid = known.column("uid").to_numpy()
            doc = pc.rank(known.column("doc_id").combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
            order = np.lexsort((uid, doc))
            new = np.ones(len(uid), np.int64)
            new[1:] = (doc[order][1:] != doc[order][:-1]) | (uid[order][1:] != uid[order][:-1])
            rank = np.empty(len(uid), np.int64)
            rank[order] = np.cumsum(new)
            at, off = (held.column(c).to_numpy().astype(np.int64) for c in ("at", "off"))
            for piece, first, last, whom in find(Shard(held.column("segment").to_pylist(), off, known.column("n").to_numpy(), rank, at)):
                take = pa.array(piece)
                cols = [known.column(c).take(take) for c in ("h", "mark", "uid")]
                yield from pa.table([*cols, pa.array((first - off[piece]).astype(np.int32)), pa.array((last - off[piece]).astype(np.int32)), pa.array(np.full(len(piece), whom, np.int32))], ["h", "mark", "uid1", "from", "to", "whom"]).to_batches()

    return sent.transform(in_arrow, work, "h long, mark long, uid1 long, from int, to int, whom int")


def repeated_spans(docs: DataFrame, units: Units, find: Find, ordered: bool = False, heavy: int = HEAVY, shard_bytes: int = 1 << 18, most: int = CHOSEN) -> DataFrame:
    """docs: uid, doc_id, text. Returns uid, s, e: ranges of units that find() tells of. ordered:
    the first place of a piece is in the least doc_id, else in any row.

    A level's pieces are folded and counted; each different one is sent once, to the shard of
    its key, and what the shard's index tells goes to all places of the piece. Keys with over
    `heavy` different pieces are parted at the next level instead.
    """
    kind = docs.schema["doc_id"].dataType.simpleString() if ordered else None
    keeps = (bitmap(written(found_again(docs, units), "anchors")),)
    found: list[DataFrame] = []
    for level in range(len(units.widths)):
        places = written(placed(docs, units, keeps, kind), "placed")
        first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "uid") if ordered else F.col("uid")).alias("first")
        pieces = written(places.groupBy("h", "mark").agg(F.sum(F.size("at")).alias("n"), first), "pieces")
        pieces = pieces.select("h", "mark", "n", *([F.col("first.uid"), F.col("first.doc_id")] if ordered else [F.col("first").alias("uid"), F.lit(0).alias("doc_id")]))
        kinds = written(pieces.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).filter("total > 1"), "kinds")
        last = level + 1 == len(units.widths)
        light = pieces.join(kinds if last else kinds.filter(F.col("kinds") <= heavy), "h", "left_semi").withColumn("own", F.xxhash64("h", "mark", "uid"))
        sent = light.unionByName(contents(docs, units, keeps, light.select("uid", "own"), most), allowMissingColumns=True)
        told = _told(sent.repartition("h").sortWithinPartitions("h"), find, shard_bytes)
        each = places.select("h", "mark", "uid", "at").join(told, ["h", "mark"]).select("uid", F.posexplode("at").alias("nth", "at"), "uid1", "from", "to", "whom")
        first = (F.col("uid") == F.col("uid1")) & (F.col("nth") == 0)
        each = each.filter((F.col("whom") == EVERY) | ((F.col("whom") == FIRST) == first))
        found.append(each.select("uid", (F.col("at") + F.col("from")).alias("s"), (F.col("at") + F.col("to")).alias("e")))
        many = kinds.filter(F.col("kinds") > heavy).select("h")
        if last or many.isEmpty():
            break
        keeps = (*keeps, bitmap(many))
    return reduce(DataFrame.unionAll, found)


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows in the order of their first column, cut into tables of about `most` bytes that
    part no value of it."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            part = batch.slice(k, 1024)
            held.append(part)
            size += part.nbytes
            if size > most:
                whole = pa.Table.from_batches(held)
                key = whole.column(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield whole.slice(0, cut)
                rest = whole.slice(cut).combine_chunks()
                held, size = rest.to_batches(), rest.nbytes if cut else 0
    if held:
        yield pa.Table.from_batches(held)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last + 1) of the runs of set flags."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1]
