"""Near copies by SimHash: fingerprints of word shingles in a Gray-ordered index, whose groups are
held to the exact Jaccard similarity of the sets; similar sets that no radius of 64 bits brings
together are found by prefix filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import simhash
from quernstone.llm.anchors import FILTER_BITS, bitmap, marked, shards
from quernstone.llm.common import LOWER, WHITE, buffer, in_arrow, mixed, prefix_sums, ranges, run_hash, signed, slices, span_hash, with_uid, words, written
from quernstone.llm.components import connected_components

WIDTH = 5
SIMILARITY = 0.8
#: Bits in which fingerprints of one group differ from their neighbours.
RADIUS = 4
#: Shingles found more often than each of these come later in the order of a set.
LEVELS = (1, 16, 256)
#: Shingles of the sets that are compared in one place.
CELL = 1 << 21
#: Sets with one key that are listed in one row; of more, each two parts of them are.
CROWD = 1 << 18


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the different shingles of a slice's rows, sorted. A-Z are lowered; a row
    of fewer words has one shingle of all of them, a row of none has none."""
    low = LOWER[data]
    s, e, at = words(low, offsets, WHITE)
    h = span_hash(prefix_sums(low), s, e)
    n = np.diff(at)
    count = np.maximum(n - width + 1, 0)
    row, g = [np.repeat(np.arange(len(n)), count)], [run_hash(h, width)[ranges(at[:-1], count)]]
    for k in range(1, width):
        short = np.flatnonzero(n == k)
        row.append(short)
        g.append(mixed(run_hash(h, k)[at[short]] + np.uint64(k)) if len(short) else np.zeros(0, np.uint64))
    row, g = np.concatenate(row), np.concatenate(g)
    order = np.lexsort((g, row))
    row, g = row[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
    return row[new], g[new]


def groups(flat: np.ndarray, at: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Sets (flat, cut at `at`): for each the least one of those that links of at least that
    similarity reach. A set met is not compared again, so a group of like sets costs no pairs."""
    n, root = np.diff(at), np.arange(len(at) - 1)
    _, code = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(n)), n)
    left = np.ones(len(n), bool)
    listed, todo, seed = 0, [], 0
    while True:
        alive = int(left.sum())
        if not alive:
            return root
        if not listed or 2 * alive < listed:
            keep = left[owner]
            order = np.argsort(code[keep], kind="stable")
            held, sorted_code = owner[keep][order], code[keep][order]
            cut = np.searchsorted(sorted_code, np.arange(int(code.max(initial=-1)) + 2))
            listed = alive
        if todo:
            x = todo.pop()
        else:
            while not left[seed]:
                seed += 1
            x = seed
            left[x] = False
        c = code[at[x] : at[x + 1]]
        both = np.bincount(held[ranges(cut[c], cut[c + 1] - cut[c])], minlength=len(n))
        near = np.flatnonzero(left & (both > 0) & (both * (1 + similarity) >= similarity * (n + n[x]) - 1e-9))
        left[near] = False
        root[near] = root[x]
        todo += near.tolist()


def _counted(source: DataFrame, width: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer(batch.column(2))
            for i, j in slices(offsets):
                _, g = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                h, n = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n)], ["h", "n"])

    return source.transform(in_arrow, work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")


def _sets(source: DataFrame, levels: list[np.ndarray], width: int, similarity: float, kind: str) -> DataFrame:
    """uid, doc_id, mark (hash of the set), n (its size), keys, shingles, fp (SimHash). The prefix of a set,
    rare shingles first, is so long that similar sets share one of it; keys are those of it that
    may be found elsewhere. Without keys nothing can be similar, and shingles and fp are null."""
    shared = source.sparkSession.sparkContext.broadcast(levels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer(batch.column(2))
            raw = data.tobytes()
            for i, j in slices(offsets):
                row, g = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                at = np.searchsorted(row, np.arange(j - i + 1))
                n = np.diff(at)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(g), dtype=np.uint64)])
                mark = mixed(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64))
                level = sum((marked(g, bits).astype(np.int8) for bits in shared.value), np.zeros(len(g), np.int8))
                order = np.lexsort((g, level, row))
                prefix = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
                place = np.arange(len(g)) - at[row]
                key = order[(place < prefix[row]) & (level[order] > 0)]
                keys = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[key], np.arange(j - i + 1)).astype(np.int32)), pa.array(signed(g[key])))
                some = np.bincount(row[key], minlength=j - i) > 0
                whole = pa.array([g[a:b].tobytes() if k else None for a, b, k in zip(at[:-1], at[1:], some, strict=True)], pa.binary())
                fp = np.array([simhash.fingerprint(simhash.hashes(raw[offsets[x] : offsets[x + 1]], width)) if k else 0 for x, k in zip(range(i, j), some, strict=True)], np.uint64)
                columns = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(signed(mark)), pa.array(n), keys, whole, pa.array(signed(fp), mask=~some)]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "mark", "n", "keys", "shingles", "fp"])

    return source.transform(in_arrow, work, f"uid long, doc_id {kind}, mark long, n long, keys array<long>, shingles binary, fp long")


def cells(n: np.ndarray, similarity: float, most: int) -> Iterator[np.ndarray]:
    """Sizes in rising order: places of the sets that meet. All at once if they have at most so
    many shingles; else each two parts of half of that, where sizes allow any similar pair."""
    if n.sum() <= most:
        yield np.arange(len(n))
        return
    part = np.cumsum(n) // max(1, most // 2)
    cut = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(n))
    for i in range(len(cut) - 1):
        for j in range(i, len(cut) - 1):
            if n[cut[i + 1] - 1] < similarity * n[cut[j]] - 1e-9:
                break
            if j > i or cut[i + 1] - cut[i] > 1:
                yield np.unique(np.concatenate([np.arange(cut[i], cut[i + 1]), np.arange(cut[j], cut[j + 1])]))


def _companies(sets: DataFrame, crowd: int) -> DataFrame:
    """met: size and mark of the sets that have a key. A key that more than `crowd` sets have is
    never listed whole: its sets are dealt out in parts, and each two parts of it are a row, so
    that any two of its sets still meet. Sets of one group, if `group` is given, need not meet."""
    keyed = sets.select(F.struct("mark", "n", (F.col("group") if "group" in sets.columns else F.col("mark")).alias("group")).alias("set"), F.explode("keys").alias("key"))
    heavy = keyed.groupBy("key").agg(F.count("*").alias("sets")).filter(F.col("sets") > crowd)
    heavy = written(heavy.select("key", F.ceil(2 * F.col("sets") / crowd).alias("parts")), "crowds")
    if not heavy.isEmpty():
        light = keyed.join(heavy, "key", "left_anti").select("key", "set", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
        own = keyed.join(heavy, "key").withColumn("own", F.pmod(F.xxhash64("set.mark"), "parts"))
        each = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: F.struct(F.least(x, "own").alias("i"), F.greatest(x, "own").alias("j")))
        keyed = light.unionAll(own.select("key", "set", F.explode(each).alias("cell")).select("key", "set", "cell.i", "cell.j"))
    met = keyed.groupBy([c for c in keyed.columns if c != "set"]).agg(F.sort_array(F.collect_list(F.struct("set.n", "set.mark"))).alias("met"), F.min("set.group").alias("low"), F.max("set.group").alias("high"))
    return met.filter("low < high").select("met").distinct()


def links(sets: DataFrame, similarity: float = SIMILARITY, most: int = CELL, crowd: int = CROWD, known: DataFrame | None = None) -> DataFrame:
    """sets: mark (each once), n, keys, shingles; known: node (a mark), root, of sets that are
    joined already. Returns u, v: edges that join similar sets, those left.

    Sets with a common key meet, if not all of them are joined already. Keys with the same sets are folded, so that a set is sent once
    for each different company that it is in."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for met in batch.column(0):
                n, mark = (met.values.field(k).to_numpy() for k in (0, 1))
                for c in cells(n, similarity, most):
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(mark[c]))], ["marks"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in shards(batches, 8 << 20):
            cell, mark = t.column(0).to_numpy(), t.column(1).to_numpy()
            held = t.column(2).to_pylist()
            edge = np.append(np.flatnonzero(np.diff(cell, prepend=cell[0] - 1)), len(cell))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                flat = np.frombuffer(b"".join(held[a:b]), np.uint64)
                root = groups(flat, np.cumsum([0, *(len(x) // 8 for x in held[a:b])]), similarity)
                own = np.flatnonzero(root != np.arange(b - a))
                yield pa.RecordBatch.from_arrays([pa.array(mark[a:b][own]), pa.array(mark[a:b][root[own]])], ["u", "v"])

    keyed = sets.select("mark", "n", "keys")
    if known is not None:
        keyed = keyed.join(known.select(F.col("node").alias("mark"), "root"), "mark", "left").select("mark", "n", "keys", F.coalesce("root", "mark").alias("group"))
    met = _companies(keyed, crowd).transform(in_arrow, deal, "marks array<long>").distinct()
    sent = met.select(F.xxhash64("marks").alias("cell"), F.explode("marks").alias("mark")).join(sets.select("mark", "shingles"), "mark")
    return sent.select("cell", "mark", "shingles").repartition("cell").sortWithinPartitions("cell", "mark").transform(in_arrow, work, "u long, v long")


def near_links(sets: DataFrame, similarity: float = SIMILARITY, most: int = CELL, crowd: int = CROWD, radius: int = RADIUS) -> DataFrame:
    """sets: mark (each once), n, shingles, fp. Returns u, v as links() does, for those similar
    sets that fingerprints within the radius of a neighbour bring into one group."""
    fps = simhash.links(sets.select("fp").distinct(), bits=radius)
    roots = connected_components(fps).select(F.col("node").alias("fp"), "root")
    alike = sets.select("mark", "n", "fp").join(roots, "fp", "left").select("mark", "n", F.array(F.coalesce("root", "fp")).alias("keys"))
    alike = written(alike, "alike")
    return links(alike.join(sets.select("mark", "shingles"), "mark"), similarity, most, crowd)


def representatives(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, most: int = CELL, crowd: int = CROWD) -> DataFrame:
    """docs with one row of each group of near copies: that of the least doc_id (null first; of
    repeated ids the first row). All columns stay.

    Texts are near copies if the Jaccard similarity of their sets of `width`-word shingles is at
    least `similarity`; a group is what such links reach. SimHash brings the nearest copies
    together, and what is similar among them is joined. Every other such pair is found too: texts
    that similar share a shingle of their prefixes, and meet unless they are joined already; and similarities are of whole sets, compared by
    64 bits. Blank and null texts are alike; extra columns stay, whatever their names; an empty
    table gives no rows.
    """
    source = with_uid(docs, F.struct(*docs.columns).alias("row"))
    texts = source.select("uid", "row.doc_id", "row.text")
    counted = written(_counted(texts, width), "shingles")
    levels = [bitmap(counted.filter(F.col("n") > n), FILTER_BITS) for n in LEVELS]
    placed = written(_sets(texts, levels, width, similarity, docs.schema["doc_id"].dataType.simpleString()), "sets")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "uid")
    folded = written(placed.groupBy("mark").agg(F.min(place).alias("least")), "folded")
    # of equal sets one is sent: the first row's
    own = placed.filter("shingles IS NOT NULL").join(folded.select("mark", F.col("least.uid").alias("uid")), ["mark", "uid"], "left_semi")
    own = written(own, "compared")
    near = written(near_links(own, similarity, most, crowd), "near")
    known = written(connected_components(near).select("node", "root"), "known")
    roots = connected_components(near.unionAll(links(own, similarity, most, crowd, known))).select(F.col("node").alias("mark"), "root")
    least = folded.join(roots, "mark", "left").groupBy(F.coalesce("root", "mark").alias("root")).agg(F.min("least").alias("least"))
    return source.join(least.select(F.col("least.uid").alias("uid")), "uid", "left_semi").select("row.*")
