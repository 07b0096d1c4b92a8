"""BM25+ ranking of a corpus's windows for a catalog's queries, and the hybrid rerank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone import catalog as C
from quernstone.catalog import Field
from quernstone.operators import index as I
from quernstone.operators import neighbours
from quernstone.sources.snapshots import saved

RANK = ["doc_id", "chunk_idx"]
DIGITS = neighbours.DIGITS
#: Query vectors that are broadcast at once, and rows that a block of more of them meets in a cell.
QUERY_BYTES = 16 << 20
TILE = 1 << 16
#: Squared lengths of vectors between which no product leaves the range of doubles.
LENGTHS = (1e-200, 1e200)


def fields_frame(spark: SparkSession, fields: tuple[Field, ...]) -> DataFrame:
    """field, control, query, ordinal: the catalog's order is part of its meaning."""
    rows = [(f.name, f.control, f.query, k) for k, f in enumerate(fields)]
    return spark.createDataFrame(rows, "field string, control string, query string, ordinal int")


def query_terms(fields: DataFrame) -> DataFrame:
    """qtf: a term that a query repeats counts as often."""
    words = fields.select("field", F.explode(F.filter(F.split(F.lower("query"), "\\s+"), lambda x: x != "")).alias("term"))
    return words.groupBy("field", "term").agg(F.count("*").alias("qtf"))


def asked_terms(fields: DataFrame) -> dict[str, dict[str, int]]:
    """qtf by field and term. A catalog is configuration: it is known to the driver, and its
    terms become literals of the plan."""
    out: dict[str, dict[str, int]] = {}
    for r in query_terms(fields).collect():
        out.setdefault(r.field, {})[r.term] = r.qtf
    return out


def scored(windows: DataFrame, asked: dict[str, dict[str, int]], k1: float = C.K1, b: float = C.B, delta: float = C.DELTA) -> DataFrame:
    """windows: corpus_id, doc_id, chunk_idx, dl, tf (of I.term_counts) and n_chunks, avg_dl, df
    (of the corpus), and others, which stay. A row for each field with any of whose terms a
    window has: its score, rounded, so that ranks do not hang on the order of sums. All of it is
    arithmetic within the row."""
    part = lambda tf: tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl"))) + delta
    weighed = windows.withColumn("weight", F.transform("tf", lambda x: F.struct(x["term"].alias("term"), (I.idf(F.try_element_at("df", x["term"]), F.col("n_chunks")) * part(x["tf"])).alias("w"))))

    def score(qtf: dict[str, int]) -> Column:
        times = F.create_map(*(F.lit(v) for t, n in sorted(qtf.items()) for v in (t, float(n))))
        own = F.filter("weight", lambda x: x["term"].isin(*sorted(qtf)))
        return F.aggregate(own, F.lit(0.0), lambda s, x: s + F.try_element_at(times, x["term"]) * x["w"])

    each = F.array(*(F.struct(F.lit(f).alias("field"), score(qtf).alias("score")) for f, qtf in sorted(asked.items())))
    out = weighed.withColumn("s", F.explode(each)).filter("s.score > 0")
    return out.select(*(c for c in windows.columns if c not in ("dl", "tf", "n_chunks", "avg_dl", "df")), "s.field", F.round("s.score", DIGITS).alias("score"))


def bm25(chunks: DataFrame, fields: DataFrame, k1: float = C.K1, b: float = C.B, delta: float = C.DELTA) -> DataFrame:
    """corpus_id, doc_id, chunk_idx, field, score of each window that has any term of a field's
    query, within its corpus.

    Only the catalog's terms are counted, once, where the text is read; the counts, some numbers
    for each window, are written to the shared folder. From them one pass sums up each corpus (a
    row for it and for each of its terms), and a second scores every window against what its
    corpus sums up to. Windows are never shuffled.
    """
    asked = asked_terms(fields)
    windows = saved(I.term_counts(chunks, sorted({t for qtf in asked.values() for t in qtf})), "counts")
    return scored(windows.join(I.corpus_index(windows), "corpus_id"), asked, k1, b, delta)


def top_k(scores: DataFrame, k: int, by: tuple[str, ...] = ("corpus_id", "field")) -> DataFrame:
    """The best k of each group, with rank; ties go by document and window. Each task passes on
    its own best k only."""
    w = W.partitionBy(*by).orderBy(F.col("score").desc(), *RANK)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def gate(ranked: DataFrame, least: float = C.MIN_SCORE) -> DataFrame:
    return ranked.filter(F.col("score") >= least)


def shortlist(chunks: DataFrame, fields: DataFrame, k: int = C.CANDIDATES, least: float = C.MIN_SCORE) -> DataFrame:
    return gate(top_k(bm25(chunks, fields), k), least)


def search(chunks: DataFrame, fields: DataFrame, k: int = C.SEARCH_K) -> DataFrame:
    return top_k(bm25(chunks, fields), k)


def normalised(ranked: DataFrame) -> DataFrame:
    """norm: scores of one field's shortlist from 0 to 1; all 0 if they are equal."""
    w = W.partitionBy("corpus_id", "field")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return ranked.withColumn("norm", (F.col("score") - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0)))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, query_bytes: int = QUERY_BYTES, tile: int = TILE) -> DataFrame:
    """vectors: doc_id, embedding; queries: q, asked. Returns q, doc_id, chunk_idx (0), score,
    rank: the k rows with the highest cosine for each query, without that of its own number.

    Queries of at most query_bytes are broadcast. More of them are dealt out in blocks of that
    size and the rows in tiles, and each block meets each tile in a cell of its own, so neither
    side has to fit anywhere whole and no cell grows with the tables. Of a cell's pairs only the
    best k of each query are passed on. Null numbers meet nothing, null vectors score 0.

    Finite vectors of the queries' usual size meet in neighbours.Best, blocks of them at a time;
    all others are compared pair by pair. Of vectors without a length, which all score the same,
    the first k + 1 numbers are: one of them may be the query's own."""
    size = F.size("asked")
    told = queries.agg(F.sum(F.greatest(size, F.lit(0)).cast("long")).alias("n"), F.mode(size).alias("usual")).first()
    total, usual = 8 * (told.n or 0), told.usual or 0
    blocks = -(-total // query_bytes) if total > query_bytes else 1
    tiles = -(-vectors.count() // tile) if blocks > 1 else 1
    kind = F.when(F.coalesce((F.size("v") == usual) & dot(F.col("v"), F.col("v")).between(*LENGTHS), F.lit(False)), "plain").when(F.coalesce(dot(F.col("v"), F.col("v")) == 0, F.lit(True)), "blank").otherwise("odd")
    rows = vectors.select("doc_id", F.col("embedding").alias("v")).filter("doc_id IS NOT NULL").withColumn("kind", kind)
    asked = queries.select("q", F.col("asked").alias("v")).filter("q IS NOT NULL").withColumn("kind", kind)
    plain, others = rows.filter("kind = 'plain'").drop("kind"), rows.filter("kind != 'plain'")

    def first(blank: DataFrame, *by: Column) -> DataFrame:
        w = W.partitionBy(*by).orderBy("doc_id")
        return blank.withColumn("place", F.dense_rank().over(w)).filter(F.col("place") <= k + 1).select("doc_id", "v")

    dealt = lambda number, n: F.pmod(F.xxhash64(number), F.lit(n).cast("long"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def cells(rows: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        return (
            rows.select("doc_id", "v", dealt("doc_id", tiles).alias("tile"), each(blocks).alias("block")),
            asked.select("q", F.col("v").alias("asked"), dealt("q", blocks).alias("block"), each(tiles).alias("tile")),
        )

    def compared(rows: DataFrame, asked: DataFrame) -> DataFrame:
        if blocks == 1:
            met = rows.join(F.broadcast(asked.select("q", F.col("v").alias("asked"))), F.col("doc_id") != F.col("q"))
        else:
            left, right = cells(rows, asked)
            met = left.join(right, ["tile", "block"]).filter("doc_id != q")
        return met.select("q", "doc_id", cosine(F.col("asked"), F.col("v")).alias("score"))

    alike = others.filter("kind = 'blank'")
    found = compared(others.filter("kind = 'odd'").drop("kind").unionAll(first(alike, F.size("v"), F.exists("v", lambda x: x.isNull()))), asked)
    strange = {r.kind for r in asked.filter("kind != 'plain'").select("kind").distinct().collect()}
    if "blank" in strange:
        found = found.unionAll(compared(first(plain, F.lit(0)), asked.filter("kind = 'blank'")))
    if "odd" in strange:
        found = found.unionAll(compared(plain, asked.filter("kind = 'odd'")))
    vector = F.col("v").cast("array<double>").alias("v")
    plain, asked = plain.select(F.col("doc_id").cast("long"), vector), asked.filter("kind = 'plain'").select(F.col("q").cast("long"), vector)
    if blocks == 1:
        near = neighbours.met(plain, asked, k)
    else:
        near = neighbours.met_in_cells(*cells(plain, asked), k)
    near = near.select(F.col("q").cast(queries.schema["q"].dataType), F.col("doc_id").cast(vectors.schema["doc_id"].dataType), "score")
    scores = near.unionAll(found).select("q", "doc_id", F.lit(0).alias("chunk_idx"), F.round("score", DIGITS).alias("score"))
    return top_k(scores, k, ("q",))


def rerank(ranked: DataFrame, similarity: DataFrame | None, alpha: float = C.ALPHA, k: int = C.FINAL) -> DataFrame:
    """The first k by alpha * norm + (1 - alpha) * similarity, stable by rank. similarity:
    corpus_id, field, doc_id, chunk_idx, similarity; a candidate without one has 0. With none
    at all, or one candidate, the order stays."""
    out = normalised(ranked)
    w = W.partitionBy("corpus_id", "field")
    if similarity is None:
        out = out.withColumn("blended", F.col("norm"))
        order = [F.col("rank")]
    else:
        out = out.join(similarity, ["corpus_id", "field", "doc_id", "chunk_idx"], "left")
        mixed = F.round(alpha * F.col("norm") + (1 - alpha) * F.coalesce("similarity", F.lit(0.0)), DIGITS)
        out = out.withColumn("blended", mixed).drop("similarity")
        order = [F.col("blended").desc(), F.col("rank")]
    out = out.withColumn("final_rank", F.row_number().over(w.orderBy(*order)))
    return out.filter(F.col("final_rank") <= k)
