"""Phrase collocations: count tries of limited depth for each shard of the corpus, level by level
written sorted and merged by ranges of prefixes.

A node of a trie is a phrase of one language. It is known by its parent (the node of all its
words but the last) and its suffix link (that of all but the first); a word's name is a hash of
the language and its text, a longer phrase's a hash of its parent's and its link's name. What
can't be frequent is never inserted, as a phrase is no more frequent than its parts: a level holds
only phrases whose parent and link the level above kept.

A shard's level is a list sorted by parent and link. Those of all shards are dealt out by ranges
of parents, cut by links where a parent is common, and merged there in a stream. Walks up the
merged trie give the counts of a phrase's first words, and the links those of its last words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.llm.anchors import bitmap, marked
from quernstone.llm.common import BASE, LOWER, buffer, in_arrow, mixed, prefix_sums, ranges, separators, signed, slices, span_hash, table, words, written

DEPTH, LEAST, REPORTED = 5, 100, 2000
#: Percent of a phrase's occurrences that lie in a longer one, from which it is left out.
WITHIN = 100
#: Text of one trie.
SHARD_BYTES = 4 << 20
PARTING = separators(b".,;:!?\n\x0b\x0c\r")
OUTSIDE = PARTING | separators(b" \t")
#: Parts of a language that are ranked before their best are.
PARTS = 64
#: Ranges that the nodes of a level are dealt out by, at least.
RANGE_BITS = 12
RANGES = 1 << RANGE_BITS
MASK = (1 << 64) - 1


def named(parent: np.ndarray, link: np.ndarray) -> np.ndarray:
    return mixed(parent * BASE + link)


class Filter:
    """Names that may be frequent, by two bits of each. What it holds by chance, one in some 400
    others, is counted in vain."""

    def __init__(self, names: DataFrame):
        self.low = bitmap(names.select(F.col("name").alias("h")))
        self.high = bitmap(names.select(F.shiftrightunsigned("name", 32).alias("h")))

    def holds(self, name: np.ndarray) -> np.ndarray:
        return marked(name, self.low) & marked(name >> np.uint64(32), self.high)


class Tokens:
    """The words of a shard: their bytes (data, start, end), lang (places in langs), h (of
    language and word), and joined: whether the next word follows in the same piece."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]], langs: list[str]):
        self.langs, code = np.unique(np.array(langs, object), return_inverse=True)
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        self.data = LOWER[np.concatenate([d for d, _ in texts])]
        ends = np.cumsum([0, *(len(d) for d, _ in texts)])
        offsets = np.concatenate([o[:-1] + e for (_, o), e in zip(texts, ends, strict=False)] + [ends[-1:]])
        starts, stops, hashes, rows = [], [], [], []
        for i, j in slices(offsets):
            part = self.data[offsets[i] : offsets[j]]
            s, e, of = words(part, offsets[i : j + 1] - offsets[i], OUTSIDE)
            starts.append(s + offsets[i])
            stops.append(e + offsets[i])
            hashes.append(span_hash(prefix_sums(part), s, e))
            rows.append(np.repeat(np.arange(i, j), np.diff(of)))
        self.start, self.end, row = np.concatenate(starts), np.concatenate(stops), np.concatenate(rows)
        self.lang = code[row]
        self.h = mixed(np.concatenate(hashes) + salt[self.lang] * BASE)
        parted = np.zeros(len(self.data) + 1, np.int32)
        np.cumsum(PARTING[self.data], out=parted[1:])
        self.joined = np.zeros(len(row), bool)
        self.joined[:-1] = (row[1:] == row[:-1]) & (parted[self.start[1:]] == parted[self.end[:-1]])

    def strings(self, at: np.ndarray) -> pa.Array:
        size = self.end[at] - self.start[at]
        cells = self.data[ranges(self.start[at], size)]
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(cells))])

    def phrases(self, filters: list[Filter]) -> tuple[np.ndarray, np.ndarray]:
        """Parent and link wherever a phrase starts that is a word longer than those the last
        filter holds, and whose own two are in it."""
        name, ok = self.h, filters[0].holds(self.h)
        for k, f in enumerate(filters):
            if k:
                at = np.flatnonzero(both)
                here = named(name[at], name[at + 1])
                held = f.holds(here)
                name, ok = np.zeros(len(name), np.uint64), np.zeros(len(name), bool)
                name[at[held]], ok[at[held]] = here[held], True
            both = ok[:-1] & ok[1:]
            if not k:
                both &= self.joined[:-1]
        at = np.flatnonzero(both)
        return name[at], name[at + 1]


def _cut(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A long text in parts of some `most` bytes that end where a piece does, if one does."""
    at = 0
    while len(data) - at > most:
        ends = np.flatnonzero(PARTING[data[at : at + most]])
        if not len(ends):
            further = np.flatnonzero(PARTING[data[at + most :]])
            if not len(further):
                break
            ends = further[:1] + most
        yield data[at : at + int(ends[-1]) + 1]
        at += int(ends[-1]) + 1
    yield data[at:]


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Tokens]:
    """Batches of lang, text as the words of about `most` bytes of text each."""
    texts: list[tuple[np.ndarray, np.ndarray]] = []
    langs: list[str] = []
    size = 0
    for batch in batches:
        data, offsets = buffer(batch.column(1))
        names = batch.column(0).to_pylist()
        for i, j in slices(offsets, most):
            for part in _cut(data[offsets[i] : offsets[j]], most) if j == i + 1 else [data[offsets[i] : offsets[j]]]:
                texts.append((part, offsets[i : j + 1] - offsets[i] if j > i + 1 else np.array([0, len(part)])))
                langs += names[i:j]
                size += len(part)
                if size >= most:
                    yield Tokens(texts, langs)
                    texts, langs, size = [], [], 0
    if langs:
        yield Tokens(texts, langs)


def _words(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """name, lang, word, n of every word: the first level."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _shards(batches, shard_bytes):
            name, first, n = np.unique(t.h, return_index=True, return_counts=True)
            langs = pa.array(t.langs[t.lang[first]], pa.string())
            yield from pa.table([pa.array(signed(name)), langs, t.strings(first), pa.array(n)], ["name", "lang", "word", "n"]).to_batches(max_chunksize=1 << 16)

    parts = docs.transform(in_arrow, work, "name long, lang string, word string, n long")
    return parts.groupBy("name", "lang", "word").agg(F.sum("n").alias("n"))


def _common(level: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the nodes that have more than one range's share of all words, sorted, and the
    numbers of ranges that each is cut into. There are at most RANGES of them."""
    rows = sorted((r.name & MASK, 1 + r.n * RANGES // total) for r in level.filter(F.col("n") > total // RANGES).select("name", "n").collect())
    return np.array([n for n, _ in rows], np.uint64), np.array([k for _, k in rows], np.uint64)


def ranged(parent: np.ndarray, link: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The range of each node: by its parent, and by its link where that is common."""
    names, cuts = common
    part = (parent >> np.uint64(64 - RANGE_BITS)).astype(np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, parent), len(names) - 1)
        cut = np.where(names[at] == parent, cuts[at], np.uint64(1))
        part += (((link >> np.uint64(32)) * cut) >> np.uint64(32)).astype(np.int64) << RANGE_BITS
    return part


def _counted(docs: DataFrame, filters: list[Filter], common: tuple[np.ndarray, np.ndarray], shard_bytes: int) -> DataFrame:
    """part, parent, link, n: the next level of each shard, sorted."""
    shared = docs.sparkSession.sparkContext.broadcast((filters, common))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, common = shared.value
        for t in _shards(batches, shard_bytes):
            parent, link = t.phrases(filters) if len(t.h) else (t.h, t.h)
            order = np.lexsort((link, parent))
            parent, link = parent[order], link[order]
            first = _first(parent, link)
            n = np.diff(np.append(first, len(parent)))
            parent, link = parent[first], link[first]
            cols = [pa.array(ranged(parent, link, common)), pa.array(signed(parent)), pa.array(signed(link)), pa.array(n)]
            yield from pa.table(cols, ["part", "parent", "link", "n"]).to_batches(max_chunksize=1 << 16)

    return docs.transform(in_arrow, work, "part long, parent long, link long, n long")


def _first(parent: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Where other nodes begin in a sorted list."""
    new = np.ones(len(parent), bool)
    new[1:] = (parent[1:] != parent[:-1]) | (link[1:] != link[:-1])
    return np.flatnonzero(new)


def _merged(counted: DataFrame, least: int) -> DataFrame:
    """name, parent, link, n of the frequent nodes of a level: each range's sorted lists are
    merged, and equal nodes, which follow one another, added up."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(parent: np.ndarray, link: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            often = n >= least
            parent, link = parent[often], link[often]
            name = named(parent.view(np.uint64), link.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(signed(name)), pa.array(parent), pa.array(link), pa.array(n[often])], ["name", "parent", "link", "n"])

        for batch in batches:
            parent, link, n = (np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held))
            first = _first(parent, link)
            parent, link, n = parent[first], link[first], np.add.reduceat(n, first) if len(n) else n
            held = parent[-1:], link[-1:], n[-1:]
            yield out(parent[:-1], link[:-1], n[:-1])
        yield out(*held)

    dealt = counted.repartition("part").sortWithinPartitions("parent", "link").select("parent", "link", "n")
    return dealt.transform(in_arrow, work, "name long, parent long, link long, n long")


def _walked(level: DataFrame, above: DataFrame) -> DataFrame:
    """A level with what its parents and links know: lang, phrase, last (its last word), total,
    left (counts of its first words, 1, 2, ... of them) and right (of what is left of it after
    them). above: the level above, with the same."""
    up = above.select(F.col("name").alias("parent"), "lang", "phrase", "total", F.concat("left", F.array("n")).alias("left"))
    across = above.select(F.col("name").alias("link"), "last", F.concat(F.array("n"), "right").alias("right"))
    both = level.join(up, "parent").join(across, "link")
    return both.select("name", "parent", "link", "n", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "total", "left", "right")


def collocations(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, within: int = WITHIN, most: int = REPORTED, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs: lang, text. The first `most` phrases of each language: lang, rank, phrase, a (its
    occurrences), l and r (those of its parts at the lowest-scoring cut), n (words of the
    language), score (floor of 1000 a n / (l r)). Phrases of up to `depth` words with at least
    `least` occurrences are candidates; those of which `within` percent lie in a longer candidate
    are left out.

    Null texts have no words; a null language is "und", as is one of that name; repeated rows
    all count; ties go to the more frequent phrase, then by its bytes; a table without words
    gives no rows; other columns, those that clash too, are ignored. A text of any length is
    counted in parts that end where a piece does; one without any such place for hundreds of MB
    is held whole.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text IS NOT NULL")
    counted = written(_words(texts, shard_bytes), "words")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    total = max(1, int(counted.agg(F.sum("n").alias("n")).first().n or 0))
    level = written(counted.filter(F.col("n") >= least).select("name", "lang", "word", "n"), "level-1")
    filters, levels = [Filter(level)], []
    while len(levels) + 1 < depth:
        level = written(_merged(_counted(texts, filters, _common(level, total), shard_bytes), least), f"level-{len(levels) + 2}")
        levels.append(level)
        if level.isEmpty():
            break
        filters.append(Filter(level))

    none = F.array().cast("array<long>")
    known = written(counted.filter(F.col("n") >= least).join(totals, "lang").select("name", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "total", "n", none.alias("left"), none.alias("right")), "walked-1")
    found = []
    for k, level in enumerate(levels):
        known = written(_walked(level, known), f"walked-{k + 2}")
        found.append(known.withColumn("size", F.lit(k + 2)))
    nodes = reduce(DataFrame.unionAll, found)

    # of a phrase's cuts the lowest-scoring one counts, of several the first
    wide = lambda c: c.cast("decimal(19,0)")
    each = nodes.select("name", F.posexplode(F.arrays_zip("left", "right")).alias("k", "cut"), (wide(F.col("n")) * F.lit(1000) * wide(F.col("total"))).alias("above"))
    each = each.withColumn("below", wide(F.col("cut.left")) * wide(F.col("cut.right")))
    cuts = each.groupBy("name").agg(F.min(F.struct(F.expr("above div below").alias("score"), "k", F.col("cut.left").alias("l"), F.col("cut.right").alias("r"))).alias("best"))

    # a longer candidate that holds enough of a phrase's occurrences has one a word longer within
    held = lambda c: 100 * F.col("n") >= within * c
    shorter = F.array(F.when(held(F.element_at("left", -1)), F.col("parent")), F.when(held(F.col("right")[0]), F.col("link")))
    inner = nodes.filter("size > 2").select(F.explode(shorter).alias("name")).filter("name IS NOT NULL").distinct()
    left = nodes.join(inner, "name", "left_anti").join(cuts, "name").select("lang", "phrase", F.col("n").alias("a"), "best.l", "best.r", F.col("total").alias("n"), "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    left = left.withColumn("rank", F.row_number().over(W.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= most)
    left = left.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return left.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def sql(least: int = LEAST, depth: int = DEPTH, within: int = WITHIN, most: int = REPORTED) -> str:
    """The same in DuckDB's SQL."""
    starts = ", ".join(f"toks[i : i + {k - 1}]" for k in range(1, depth + 1))
    return f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
toked AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS toks FROM pieces),
placed AS (SELECT lang, toks, unnest(range(1, len(toks) + 1)) AS i FROM toked),
grams AS (SELECT lang, unnest([{starts}]) AS path, unnest(range(1, {depth + 1})) AS k, len(toks) - i + 1 AS room FROM placed),
f AS (SELECT lang, path, count(*) AS f FROM grams WHERE k <= room GROUP BY ALL HAVING count(*) >= {least}),
total AS (SELECT lang, sum(len(toks)) AS n FROM toked GROUP BY ALL),
cut AS (SELECT c.lang, c.path, c.f AS a, unnest(range(1, len(c.path))) AS k FROM f c WHERE len(c.path) > 1),
scored AS (SELECT cut.*, l.f AS l, r.f AS r, t.n, (CAST(1000 AS HUGEINT) * a * t.n) // (CAST(l.f AS HUGEINT) * r.f) AS score FROM cut JOIN f l ON l.lang = cut.lang AND l.path = cut.path[1 : k] JOIN f r ON r.lang = cut.lang AND r.path = cut.path[k + 1 :] JOIN total t ON t.lang = cut.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, path ORDER BY score, k) = 1),
inner_of AS (SELECT DISTINCT x.lang, x.sub FROM (SELECT lang, f, unnest(flatten(list_transform(range(2, len(path)), lambda m: list_transform(range(1, len(path) - m + 2), lambda i: path[i : i + m - 1])))) AS sub FROM f WHERE len(path) > 2) x JOIN f ON f.lang = x.lang AND f.path = x.sub WHERE 100 * x.f >= {within} * f.f),
kept AS (SELECT lang, array_to_string(path, ' ') AS phrase, a, l, r, n, score FROM best WHERE NOT EXISTS (SELECT 1 FROM inner_of i WHERE i.lang = best.lang AND i.sub = best.path)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {most}"""


SQL = sql()
