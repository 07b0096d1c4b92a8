"""A stored inverted index: written once, searched without the texts, and grown by segments.

A segment is a set of immutable Parquet tables: texts, each once, postings of their windows (in
blocks, bucketed and sorted by term), and the sums that statistics are made of. The sums of all
segments add up, so documents are added by writing a segment and nothing else; documents that go
are listed, with the sums that go with them, until their segment is merged into another.

Windows stay in the task that reads their text, which makes the blocks of its tiles and sorts them
into files of its own: no posting is shuffled, so a segment takes no more disk than its files and
what the tasks that run spill.

A block holds what a term has in a tile, TILE neighbouring windows of a segment, with its largest
count and its least length: no window of the tile scores more than such a one would. A search sums
up these bounds by tile from the blocks' heads alone, scores the best few tiles, and then reads
only those tiles whose bound reaches the k-th best score found.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone import catalog as C
from quernstone.functions import text as T
from quernstone.operators import index as I
from quernstone.operators import retrieve as R
from quernstone.sources.snapshots import Conflict, Snapshots

TILE_BITS = 7
BUCKETS = 16
KEY = ["segment", "corpus_id", "doc_id"]
#: Segments of like size that are merged into one.
FAN = 4
#: Tiles of a field and corpus that are scored to find how good the k-th best is, and tiles of
#: an index from which that pays.
SEEDS, PRUNED_FROM = 16, 2048
#: Documents that went, up to so many, are broadcast, so that texts are not shuffled to lose them.
GONE = 1 << 18
#: Windows whose blocks are made at once, or a tile if it has more.
STEP = 1 << 10
ZSTD = {"compression": "zstd"}
#: What rounding may hide.
SLACK = 10.0**-R.DIGITS


def _cut(texts: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each window of each text: the columns, chunk_idx, dl, tokens and others."""
    split = texts.select(*columns, T.tokens(F.col("text")).alias("tokens"))
    return I.exploded(split.select(*columns, T.windows(F.col("tokens"), C.WINDOW, C.STRIDE).alias("windows"))).withColumn("dl", F.size("tokens"))


def _counted(windows: DataFrame) -> DataFrame:
    """Adds tf: (term, tf) of each window's terms, folded; from the runs of its sorted tokens."""
    out = windows.withColumn("folded", F.sort_array(F.transform("tokens", F.lower)))
    n = F.size("folded")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    new = lambda i: (i == 0) | (F.get("folded", i) != F.coalesce(F.get("folded", i - 1), F.lit("")))
    out = out.withColumn("starts", F.filter(places, new))
    tf = F.transform("starts", lambda i, k: F.struct(F.get("folded", i).alias("term"), (F.coalesce(F.get("starts", k + 1), n) - i).alias("tf")))
    return out.withColumn("tf", tf).drop("folded", "starts")


def _bucket(term: Column, buckets: int) -> Column:
    return (F.crc32(term.cast("binary")) % buckets).cast("int")


def _text(x: str) -> str:
    """A literal in SQL, whatever x holds."""
    return f"cast(X'{x.encode().hex()}' AS string)"


def _few(ids: DataFrame, count: int) -> DataFrame:
    return F.broadcast(ids) if count <= GONE else ids


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows (corpus_id, doc_id, chunk_idx, dl, tile, tf), by tile, to the blocks of each tile."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
        tile = t.column("tile").to_numpy()
        i = 0
        while len(tile):
            j = np.searchsorted(tile, tile[min(i + STEP, len(tile) - 1)])
            if j <= i:  # one tile, which may go on
                j = np.searchsorted(tile, tile[i], "right")
                if j == len(tile):
                    break
            yield _grouped(t.slice(i, j - i))
            i = j
        held = t.slice(i)
    if held is not None and held.num_rows:
        yield _grouped(held)


def _grouped(t: pa.Table) -> pa.RecordBatch:
    c = {n: t.column(n).combine_chunks() for n in t.column_names}
    each = c["tf"].flatten()
    window = np.repeat(np.arange(t.num_rows), c["tf"].value_lengths().to_numpy(zero_copy_only=False))
    term, corpus = each.field("term").dictionary_encode(), c["corpus_id"].dictionary_encode("encode")
    terms, corpora = len(term.dictionary), len(corpus.dictionary)
    tile = c["tile"].to_numpy()
    group = ((tile - tile[0]) * corpora + corpus.indices.to_numpy())[window] * terms + term.indices.to_numpy()
    order = np.argsort(group, kind="stable")
    group, window = group[order], window[order]
    start = np.flatnonzero(np.diff(group, prepend=-1))
    tf, dl = each.field("tf").to_numpy()[order].astype(np.int32), c["dl"].to_numpy()[window].astype(np.int32)
    n = np.diff(np.append(start, len(group))).astype(np.int32)
    postings = pa.StructArray.from_arrays([c["doc_id"].take(pa.array(window)), pa.array(c["chunk_idx"].to_numpy()[window]), pa.array(tf), pa.array(dl)], ["doc_id", "chunk_idx", "tf", "dl"])
    columns = {
        "corpus_id": c["corpus_id"].take(pa.array(window[start])),
        "term": term.dictionary.take(pa.array(group[start] % terms)),
        "tile": pa.array(tile[window[start]]),
        "n": pa.array(n),
        "top_tf": pa.array(np.maximum.reduceat(tf, start)),
        "least_dl": pa.array(np.minimum.reduceat(dl, start)),
        "postings": pa.ListArray.from_arrays(pa.array(np.append(start, len(group)).astype(np.int32)), postings),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _types(rows: DataFrame) -> list[str]:
    return [rows.schema[c].dataType.simpleString() for c in ("corpus_id", "doc_id")]


class StoredIndex:
    """An index in a folder. Each method works on the last version; a version that others add
    to meanwhile is never seen half done.

    Documents: corpus_id, doc_id, text, the pair of ids once in each call. Null and empty texts
    have no windows; other columns are ignored; ids are of any type, the same in all calls.
    """

    def __init__(self, spark: SparkSession, at: str, buckets: int = BUCKETS, tile_bits: int = TILE_BITS):
        self.spark, self.at = spark, at.rstrip("/")
        self.snapshots = Snapshots(spark, at)
        self.buckets, self.tile_bits = buckets, tile_bits

    # writing

    def _segment(self, texts: DataFrame) -> dict:
        """texts: corpus_id, doc_id, text. Writes a segment of them."""
        name = uuid.uuid4().hex
        at = f"{self.at}/{name}"
        n = T.window_count(F.size("tokens"))
        held = texts.select("corpus_id", "doc_id", T.tokens(F.col("text")).alias("tokens")).select("corpus_id", "doc_id", n.cast("int").alias("n"), (F.size("tokens") + (n - 1) * (C.WINDOW - C.STRIDE)).cast("long").alias("dl"), I.chunk_text().alias("text"))
        held.filter("n > 0").write.parquet(f"{at}/texts", **ZSTD)
        ids = _types(texts)
        held = self.spark.read.schema(self._schema("texts", ids)).parquet(f"{at}/texts").drop("segment")
        each = _counted(_cut(held, ["corpus_id", "doc_id"])).select("corpus_id", "doc_id", "chunk_idx", "dl", F.shiftright(F.monotonically_increasing_id(), self.tile_bits).alias("tile"), "tf")
        blocks = each.mapInArrow(_blocks, self._schema("postings", ids).removesuffix(", bucket int"))
        blocks = blocks.withColumn("bucket", _bucket(F.col("term"), self.buckets))
        blocks.sortWithinPartitions("bucket", "term", "corpus_id", "tile").write.partitionBy("bucket").parquet(f"{at}/postings", **ZSTD)
        heads = self.spark.read.schema(self._schema("postings", ids)).parquet(f"{at}/postings")
        heads.groupBy("bucket", "corpus_id", "term").agg(F.sum("n").alias("df")).write.partitionBy("bucket").parquet(f"{at}/terms", **ZSTD)
        held.groupBy("corpus_id").agg(F.sum("n").alias("n_chunks"), F.sum("dl").alias("dl")).write.parquet(f"{at}/sums")
        sums = self.spark.read.schema(self._schema("sums", ids)).parquet(f"{at}/sums")
        return {"name": name, "windows": sums.agg(F.sum("n_chunks")).first()[0] or 0, "ids": ids}

    def _gone(self, segments: list[dict], removed: list[dict], ids: DataFrame) -> dict:
        """ids: corpus_id, doc_id. Writes which of them the segments hold, and their sums."""
        name = uuid.uuid4().hex
        at = f"{self.at}/{name}"
        held = self._texts(segments, removed, "n", "dl").join(ids.select("corpus_id", "doc_id").distinct(), ["corpus_id", "doc_id"], "left_semi")
        held.write.parquet(f"{at}/ids")
        types = _types(held)
        held = self.spark.read.schema(self._schema("ids", types) + ", n int, dl long").parquet(f"{at}/ids")
        held.groupBy("segment", "corpus_id").agg((-F.sum("n")).alias("n_chunks"), (-F.sum("dl")).alias("dl")).write.parquet(f"{at}/sums")
        count = held.count()
        texts = self._read(segments, "texts").select(*KEY, "text").join(_few(held.select(*KEY), count), KEY, "left_semi")
        terms = _counted(_cut(texts, KEY)).select("segment", "corpus_id", F.explode_outer("tf.term").alias("term")).filter("term IS NOT NULL").groupBy("segment", "corpus_id", "term").agg((-F.count("*")).alias("df"))
        terms.withColumn("bucket", _bucket(F.col("term"), self.buckets)).write.partitionBy("bucket").parquet(f"{at}/terms", **ZSTD)
        return {"name": name, "from": [r.segment for r in held.select("segment").distinct().collect()], "ids": types, "documents": count}

    def add(self, docs: DataFrame) -> None:
        """Adds documents; those that the index has already are replaced."""
        segment = self._segment(docs.select("corpus_id", "doc_id", "text"))
        self._change(docs, segment)

    def remove(self, ids: DataFrame) -> None:
        """ids: corpus_id, doc_id. What the index does not have is no error."""
        self._change(ids, None)

    def _change(self, ids: DataFrame, segment: dict | None) -> None:
        seen: list[dict] | None = None
        gone: dict = {}

        def change(content: dict) -> dict:
            nonlocal seen, gone
            segments, removed = content.get("segments", []), content.get("removed", [])
            if seen != [segments, removed]:  # else the version before was only asked again
                seen, gone = [segments, removed], self._gone(segments, removed, ids) if segments else {}
            return {"buckets": self.buckets, "segments": [*segments, *([segment] if segment and segment["windows"] else [])], "removed": [*removed, *([gone] if gone.get("from") else [])]}

        self.snapshots.update(change)

    def compact(self, fan: int = FAN) -> None:
        """Merges segments of like size, `fan` to a tier, as long as there are any: so a window
        is written as often as the logarithm of the number of adds. What was removed goes."""
        while True:
            version, content = self.snapshots.current()
            tiers: dict[int, list[dict]] = {}
            for s in content.get("segments", []):
                tier = 0
                while fan ** (tier + 1) <= s["windows"]:
                    tier += 1
                tiers.setdefault(tier, []).append(s)
            full = next((group for _, group in sorted(tiers.items()) if len(group) >= fan), None)
            if full is None:
                return
            self._merge(version, content, full)

    def _merge(self, version: int, content: dict, full: list[dict]) -> None:
        new = self._segment(self._texts(full, content["removed"], "text").drop("segment"))
        names = {s["name"] for s in full}
        left = [{**g, "from": [s for s in g["from"] if s not in names]} for g in content["removed"]]
        segments = [*(s for s in content["segments"] if s["name"] not in names), *([new] if new["windows"] else [])]
        try:
            self.snapshots.commit(version + 1, {**content, "segments": segments, "removed": [g for g in left if g["from"]]})
        except Conflict:  # done again from what is there now
            return

    # reading

    def _schema(self, table: str, ids: list[str]) -> str:
        """A table's columns, given the types of its ids: known, so no file is opened for them."""
        corpus, doc = (f"{n} {t}" for n, t in zip(("corpus_id", "doc_id"), ids, strict=True))
        return {
            "texts": f"{corpus}, {doc}, n int, dl long, text string, segment string",
            "postings": f"{corpus}, term string, tile long, n int, top_tf int, least_dl int, postings array<struct<{doc.replace(' ', ': ', 1)}, chunk_idx: int, tf: int, dl: int>>, bucket int",
            "terms": f"segment string, {corpus}, term string, df long, bucket int",
            "sums": f"segment string, {corpus}, n_chunks long, dl long",
            "ids": f"segment string, {corpus}, {doc}",
        }[table]

    def _state(self) -> tuple[list[dict], list[dict]]:
        _, content = self.snapshots.current()
        if content.get("buckets", self.buckets) != self.buckets:
            raise ValueError(f"the index at {self.at} has {content['buckets']} buckets")
        return content.get("segments", []), content.get("removed", [])

    def _read(self, parts: list[dict], table: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame | None:
        """A table of segments (with their names) or of what was removed from them."""
        frames = []
        for p in parts:
            df = keep(self.spark.read.schema(self._schema(table, p["ids"])).parquet(f"{self.at}/{p['name']}/{table}"))
            frames.append(df.filter(F.col("segment").isin(p["from"])) if "from" in p else df.withColumn("segment", F.lit(p["name"])))
        return reduce(DataFrame.unionByName, frames) if frames else None

    def _live(self, rows: DataFrame, segments: list[dict], removed: list[dict]) -> DataFrame:
        """rows: segment, corpus_id, doc_id and others, without those of documents that went."""
        names = {s["name"] for s in segments}
        went = [g for g in removed if names & set(g["from"])]
        gone = self._read(went, "ids")
        return rows if gone is None else rows.join(_few(gone, sum(g.get("documents", GONE + 1) for g in went)), KEY, "left_anti")

    def _texts(self, segments: list[dict], removed: list[dict], *columns: str) -> DataFrame:
        return self._live(self._read(segments, "texts").select(*KEY, *columns), segments, removed)

    def windows(self) -> DataFrame:
        """corpus_id, doc_id, chunk_idx, dl, text of all windows."""
        segments, removed = self._state()
        if not segments:
            raise ValueError(f"nothing is indexed at {self.at}")
        return _cut(self._texts(segments, removed, "text"), ["corpus_id", "doc_id"]).select(*I.KEY, "dl", I.chunk_text().alias("text"))

    def _summed(self, table: str, key: list[str], values: list[str], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """Sums over all segments less those of what was removed: of one segment, its own."""
        segments, removed = self._state()
        if not segments:
            raise ValueError(f"nothing is indexed at {self.at}")
        own = self._read(segments, table, keep).select(*key, *values)
        if len(segments) == 1 and not removed:
            return own
        if removed:
            own = own.unionByName(self._read(removed, table, keep).select(*key, *values))
        return own.groupBy(*key).agg(*(F.sum(v).alias(v) for v in values)).filter(F.col(values[0]) > 0)

    def stats(self) -> DataFrame:
        """corpus_id, n_chunks, avg_dl."""
        return self._summed("sums", ["corpus_id"], ["n_chunks", "dl"]).select("corpus_id", "n_chunks", (F.col("dl") / F.col("n_chunks")).alias("avg_dl"))

    def doc_freq(self, terms: list[str] | None = None) -> DataFrame:
        """corpus_id, term, df; of some terms, from their files alone."""
        return self._summed("terms", ["corpus_id", "term"], ["df"], self._of(terms))

    def _of(self, terms: list[str] | None) -> Callable[[DataFrame], DataFrame]:
        if terms is None:
            return lambda df: df
        asked = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        return lambda df: df.filter(f"bucket IN ({', '.join(map(str, asked))}) AND term IN ({', '.join(map(_text, terms))})" if terms else "false")

    def search(self, fields: DataFrame | tuple[C.Field, ...], k: int = C.SEARCH_K, k1: float = C.K1, b: float = C.B, delta: float = C.DELTA, seeds: int = SEEDS, pruned_from: int = PRUNED_FROM) -> DataFrame:
        """The best k windows of each corpus for each field, as R.search() finds them in the
        texts: corpus_id, field, doc_id, chunk_idx, score, rank."""
        return Search(self, R.asked_terms(fields) if isinstance(fields, DataFrame) else asked_of(fields), k, (k1, b, delta), seeds).best(pruned_from)


def asked_of(fields: tuple[C.Field, ...]) -> dict[str, dict[str, int]]:
    """qtf by field and term of a catalog's fields."""
    return {f.name: dict(Counter(t for t in re.split("[ \\t\\n\\x0B\\f\\r]+", f.query.lower()) if t)) for f in fields}


class Search:
    """One search. weights: corpus_id, term, idf, avg_dl of the asked terms."""

    def __init__(self, index: StoredIndex, asked: dict[str, dict[str, int]], k: int, parameters: tuple[float, float, float], seeds: int):
        self.index, self.k, self.parameters, self.seeds = index, k, parameters, seeds
        self.segments, self.removed = index._state()
        by: dict[str, list[tuple[str, int]]] = {}
        for field, qtf in asked.items():
            for term, n in qtf.items():
                by.setdefault(term, []).append((field, n))
        self.terms = sorted(by)
        # as text: a call for each literal would take longer than a small search
        each = lambda t: ", ".join(f"named_struct('field', {_text(f)}, 'qtf', {float(n)}D)" for f, n in sorted(by[t]))
        self.fields = F.expr(f"map({', '.join(f'{_text(t)}, array({each(t)})' for t in self.terms)})") if by else F.expr("cast(map() as map<string, array<struct<field: string, qtf: double>>>)")
        self.keep = index._of(self.terms)
        stats = index.stats().withColumnRenamed("corpus_id", "corpus")
        df = index.doc_freq(self.terms)
        both = df.join(stats, df.corpus_id == stats.corpus).select("corpus_id", "term", "n_chunks", "avg_dl", "df")
        self.weights = both.select("corpus_id", "term", "avg_dl", I.idf(F.col("df"), F.col("n_chunks")).alias("idf"))

    def _part(self, tf: Column, dl: Column) -> Column:
        k1, b, delta = self.parameters
        return F.col("idf") * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avg_dl"))) + delta)

    def blocks(self, *columns: str) -> DataFrame:
        """Blocks of the asked terms with their weights and a row for each field that asks."""
        rows = self.index._read(self.segments, "postings", self.keep).select("segment", "corpus_id", "term", "tile", *columns)
        asked = rows.join(self.weights, ["corpus_id", "term"]).withColumn("f", F.explode(F.try_element_at(self.fields, F.col("term"))))
        return asked.select("segment", "corpus_id", "tile", *columns, "idf", "avg_dl", "f.field", "f.qtf")

    def bounds(self) -> DataFrame:
        """bound: what no window of a tile can pass, from the heads of blocks."""
        heads = self.blocks("top_tf", "least_dl")
        part = F.col("qtf") * self._part(F.col("top_tf"), F.col("least_dl"))
        return heads.groupBy("corpus_id", "field", "segment", "tile").agg(F.sum(part).alias("bound"))

    def scores(self, tiles: DataFrame | None = None) -> DataFrame:
        """corpus_id, field, doc_id, chunk_idx, score of all windows, or of those of some tiles
        (corpus_id, field, segment, tile), whose blocks alone are unpacked."""
        rows = self.blocks("postings")
        if tiles is not None:
            rows = rows.join(tiles.select("corpus_id", "field", "segment", "tile"), ["corpus_id", "field", "segment", "tile"], "left_semi")
        each = rows.select("segment", "corpus_id", "field", "qtf", "idf", "avg_dl", F.explode("postings").alias("p"))
        each = each.select("segment", "corpus_id", "field", "p.doc_id", "p.chunk_idx", (F.col("qtf") * self._part(F.col("p.tf"), F.col("p.dl"))).alias("score"))
        each = self.index._live(each, self.segments, self.removed)
        summed = each.groupBy("corpus_id", "field", "doc_id", "chunk_idx").agg(F.sum("score").alias("score"))
        return summed.withColumn("score", F.round("score", R.DIGITS))

    def chosen(self) -> DataFrame:
        """The tiles that can hold one of the best k: those whose bound reaches the k-th best
        score of the tiles with the highest bounds; all, where those have fewer windows."""
        bounds = self.bounds()
        first = R.top_k(bounds.withColumn("doc_id", F.col("segment")).withColumn("chunk_idx", F.col("tile")).withColumnRenamed("bound", "score"), self.seeds)
        least = R.top_k(self.scores(first), self.k).filter(F.col("rank") == self.k).select("corpus_id", "field", F.col("score").alias("least"))
        return bounds.join(least, ["corpus_id", "field"], "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))

    def best(self, pruned_from: int) -> DataFrame:
        tiles = sum(s["windows"] for s in self.segments) >> self.index.tile_bits
        found = self.scores(self.chosen() if tiles >= pruned_from else None)
        return R.top_k(found, self.k).select("corpus_id", "field", "doc_id", "chunk_idx", "score", "rank")
