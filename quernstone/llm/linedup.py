"""Line dedup: a log-template tree whose recurring templates are dropped."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.anchors import bitmap, marked
from quernstone.llm.common import WHITE, buffer, in_arrow, mixed, powers, prefix_sums, signed, slices, span_hash, table, with_uid, words, written

#: Documents in which a template must recur.
MIN_DOCS = 5
#: Documents in which a line of more than LONG tokens must stand, its fields apart.
LONG_DOCS = 2
LONG = 50
#: Leading tokens that choose a leaf, below the number of tokens.
DEPTH = 3
#: Share of a template's tokens that must be constant.
SIMILARITY = 0.8
LEAF_BITS = 26
VARIABLE = np.uint64(0x5EED)


class Lines:
    """The lines of a slice's rows: of (each row's range of lines), start, end (bytes, without
    the line feed), n (tokens), leaf and mark (hashes of the leaf and of the whole line), and
    the tokens' hashes with each line's range of them. Tokens with a digit, @ or :// are
    variable fields wherever they stand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        feed = np.flatnonzero(data == 10) + 1
        edges = np.unique(np.concatenate([offsets, feed]))
        self.start, stop = edges[:-1], edges[1:]
        self.end = stop - (data[stop - 1] == 10) if len(data) else stop
        self.of = np.searchsorted(self.start, offsets)
        s, e, self.at = words(data, edges, WHITE)
        h = span_hash(prefix_sums(data), s, e)
        field = (data >= 48) & (data <= 57) | (data == 64)
        if len(data) > 2:
            field[:-2] |= (data[:-2] == 58) & (data[1:-1] == 47) & (data[2:] == 47)
        odd = np.zeros(len(data) + 1, np.int32)
        np.cumsum(field, out=odd[1:])
        self.token = np.where(odd[e] > odd[s], VARIABLE, h)
        self.n = np.diff(self.at)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.token * powers("up", len(h)), dtype=np.uint64)])
        first, last = self.at[:-1], self.at[1:]
        scale, n = powers("down", len(sums))[first], self.n.astype(np.uint64)
        lead = np.minimum(first + DEPTH, last)
        self.leaf = mixed((sums[lead] - sums[first]) * scale + n)
        self.mark = mixed((sums[last] - sums[first]) * scale + n * np.uint64(3))


def _hot_leaves(source: DataFrame, min_docs: int, long_docs: int | None) -> np.ndarray:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer(batch.column(2))
            for i, j in slices(offsets):
                lines = Lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                row = np.repeat(np.arange(j - i), np.diff(lines.of))
                real = lines.n > 0
                # each document counts once for a leaf
                order = np.lexsort((row[real], lines.leaf[real]))
                leaf, row = lines.leaf[real][order], row[real][order]
                new = np.ones(len(leaf), bool)
                new[1:] = (leaf[1:] != leaf[:-1]) | (row[1:] != row[:-1])
                key, first, n = np.unique(leaf[new], return_index=True, return_counts=True)
                long = (lines.n[real] > LONG)[order][new][first]
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(n), pa.array(long)], ["h", "n", "long"])

    counted = source.transform(in_arrow, work, "h long, n long, long boolean").groupBy("h").agg(F.sum("n").alias("n"), F.max("long").alias("long"))
    least = F.when(F.col("long"), min(min_docs, long_docs or min_docs)).otherwise(min_docs)
    return bitmap(counted.filter(F.col("n") >= least), LEAF_BITS)


def _members(source: DataFrame, leaves: np.ndarray, kind: str) -> DataFrame:
    """leaf, mark, uid, doc_id, tokens: each different line of each row in a leaf that may be
    found in enough documents."""
    shared = source.sparkSession.sparkContext.broadcast(leaves)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer(batch.column(2))
            for i, j in slices(offsets):
                lines = Lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                row = np.repeat(np.arange(j - i), np.diff(lines.of))
                keep = np.flatnonzero((lines.n > 0) & marked(lines.leaf, shared.value))
                order = keep[np.lexsort((row[keep], lines.mark[keep]))]
                new = np.ones(len(order), bool)
                new[1:] = (lines.mark[order][1:] != lines.mark[order][:-1]) | (row[order][1:] != row[order][:-1])
                for k in np.array_split(order[new], max(1, len(order) // 2048)):
                    n = lines.n[k]
                    at = np.repeat(lines.at[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(signed(lines.token[at])))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(lines.leaf[k])), pa.array(signed(lines.mark[k])), batch.column(0).take(pa.array(row[k] + i)), batch.column(1).take(pa.array(row[k] + i)), tokens], ["leaf", "mark", "uid", "doc_id", "tokens"])

    return source.transform(in_arrow, work, f"leaf long, mark long, uid long, doc_id {kind}, tokens array<long>")


def recurring(source: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, long_docs: int | None = None) -> DataFrame:
    """source: uid, doc_id, text. Returns uid, mark: lines of recurring templates, but for
    those of the first document that has the template.

    Within a leaf (the number of tokens, then the leading ones) a token may be constant where at
    least min_docs documents have it at its place. A line counts if such tokens are at least
    `similarity` of its own. Its template is that share of its tokens which most documents of
    the leaf have (with all that tie), so a field's common value, which fewer documents have
    than what stands around it, stays variable however many they are. A template recurs if
    min_docs documents have it. With long_docs set, a line of more than LONG tokens also recurs
    if so many documents have it, its fields apart: no chance makes two such lines alike. All of
    this is counted, so no leaf is ever gathered.
    """
    kind = source.schema["doc_id"].dataType.simpleString()
    members = written(_members(source, _hot_leaves(source, min_docs, long_docs), kind), "lines")
    lines = members.groupBy("leaf", "mark").agg(F.count("*").alias("docs"), F.first("tokens").alias("tokens"))
    each = lines.select("leaf", "mark", "docs", F.size("tokens").alias("n"), F.posexplode("tokens").alias("pos", "token"))
    constant = each.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    held = each.drop("docs").join(constant, ["leaf", "pos", "token"])
    templates = held.groupBy("leaf", "mark").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("docs", "pos", "token")), asc=False).alias("held"))
    least = F.ceil(F.lit(similarity) * F.col("n")).cast("int")
    templates = templates.filter(F.size("held") >= least).withColumn("least", F.element_at("held", least)["docs"])
    templates = templates.select("leaf", "mark", F.xxhash64("leaf", F.filter("held", lambda x: x["docs"] >= F.col("least"))).alias("template"), F.lit(min_docs).alias("least"))
    if long_docs:
        alike = lines.filter((F.size("tokens") > LONG) & (F.col("docs") >= long_docs))
        templates = templates.unionAll(alike.select("leaf", "mark", F.xxhash64("leaf", "mark", F.lit("line")).alias("template"), F.lit(long_docs).alias("least")))
    # written, so that both sides of the join are dealt out as they are: where a very common line
    # makes a part too large, the session splits its members and gives each part the template
    templates = written(templates, "kinds")
    found = members.select("leaf", "mark", "uid", "doc_id").join(templates, ["leaf", "mark"]).select("template", "least", "mark", "uid", F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "uid").alias("place"))
    found = written(found, "templates")
    first = found.groupBy("template", "least", "uid", "place").agg(F.lit(1).alias("one")).groupBy("template", "least").agg(F.count("*").alias("docs"), F.min("place").alias("first")).filter(F.col("docs") >= F.col("least"))
    return found.join(first, "template").filter("place.uid != first.uid").select("uid", "mark")


def _applied(docs: DataFrame, min_docs: int, similarity: float, long_docs: int | None, work, schema) -> DataFrame:
    """docs with the marks to drop as a last column, through work."""
    source = with_uid(docs, F.struct(*docs.columns).alias("row"))
    gone = recurring(source.select("uid", "row.doc_id", "row.text"), min_docs, similarity, long_docs)
    gone = gone.groupBy("uid").agg(F.collect_set("mark").alias("marks"))
    wide = source.join(gone, "uid", "left")
    return wide.select(F.col("row.text").alias("text"), "marks", "row").transform(in_arrow, work, schema)


def _kept(batch: pa.RecordBatch) -> Iterator[tuple[str | None, int, int]]:
    """(text, lines, lines dropped) of each row."""
    texts, marks = batch.column(0), batch.column(1)
    data, offsets = buffer(texts)
    for i, j in slices(offsets):
        raw = data[offsets[i] : offsets[j]].tobytes()
        lines = Lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        mark = signed(lines.mark)
        for r in range(j - i):
            a, b = int(lines.of[r]), int(lines.of[r + 1])
            gone = marks[i + r].as_py()
            if not gone:
                yield texts[i + r].as_py(), b - a, 0
                continue
            drop = np.isin(mark[a:b], np.array(gone, np.int64)) & (lines.n[a:b] > 0)
            kept = [raw[s:e] for s, e, d in zip(lines.start[a:b].tolist(), lines.end[a:b].tolist(), drop.tolist(), strict=True) if not d]
            yield b"\n".join(kept).decode(), b - a, int(drop.sum())


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, long_docs: int | None = None) -> DataFrame:
    """docs with their recurring lines dropped: all rows and columns stay, text is changed.

    The first document (least doc_id, null last) with a recurring template keeps its lines, so
    no passage is lost. Blank lines stay; null texts stay null; a text whose lines all go is
    empty. An empty table gives no rows; repeated rows are told apart, in the files' order; extra
    columns stay, whatever their names.
    """
    place, schema = docs.columns.index("text"), docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.column(2).flatten()
            cols[place] = pa.array([t for t, _, _ in _kept(batch)], pa.string())
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return _applied(docs, min_docs, similarity, long_docs, work, schema)


def line_report(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, long_docs: int | None = None) -> DataFrame:
    """dedup_lines() as figures: doc_id, n_lines, n_dropped, kept_sha256 (null text: empty)."""
    place = docs.columns.index("doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(_kept(batch))
            yield pa.RecordBatch.from_arrays([batch.column(2).flatten()[place], pa.array([n for _, n, _ in got], pa.int64()), pa.array([d for _, _, d in got], pa.int64()), pa.array([hashlib.sha256((t or "").encode()).hexdigest() for t, _, _ in got], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return _applied(docs, min_docs, similarity, long_docs, work, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents").select("doc_id", "text"), long_docs=LONG_DOCS)
