"""Windows of documents and the statistics of an index over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.catalog import STRIDE, WINDOW
from quernstone.functions import text as T
from quernstone.operators.prefix import before

KEY = ["corpus_id", "doc_id", "chunk_idx"]


def chunk(docs: DataFrame, window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """docs: corpus_id, doc_id, text. A row per window: corpus_id, doc_id, chunk_idx,
    token_start, token_end, tokens. Nothing is shuffled; a document without tokens has none."""
    # tokens are a column of their own: within the lambda each window would split the text again
    split = docs.select("corpus_id", "doc_id", T.tokens(F.col("text")).alias("tokens"))
    return exploded(split.select("corpus_id", "doc_id", T.windows(F.col("tokens"), window, stride).alias("windows")))


def exploded(documents: DataFrame) -> DataFrame:
    """A row for each of a document's windows. The inner generator would be given a filter on
    their number, which builds them a second time, below a repartition even."""
    others = [c for c in documents.columns if c != "windows"]
    return documents.select(*others, F.explode_outer("windows").alias("w")).filter("w IS NOT NULL").select(*others, "w.*")


def chunk_text() -> Column:
    return F.array_join("tokens", " ")


def term_freq(chunks: DataFrame) -> DataFrame:
    """tf by chunk and term, folded to lower case: the postings of every term."""
    found = chunks.select(*KEY, F.explode("tokens").alias("term")).withColumn("term", F.lower("term"))
    return found.groupBy(*KEY, "term").agg(F.count("*").alias("tf"))


def hits(tokens: Column, vocabulary: list[str]) -> Column:
    """The tokens that are terms of a vocabulary, folded."""
    return F.filter(F.transform(tokens, F.lower), lambda x: x.isin(*vocabulary)) if vocabulary else F.array().cast("array<string>")


def counts(hits: Column) -> Column:
    """(term, tf) of each different hit."""
    return F.transform(F.array_distinct(hits), lambda t: F.struct(t.alias("term"), (F.size(hits) - F.size(F.array_remove(hits, t))).alias("tf")))


def term_counts(chunks: DataFrame, vocabulary: list[str]) -> DataFrame:
    """corpus_id, doc_id, chunk_idx, dl, tf (term, tf: of each term of a catalog's vocabulary
    that the window has). Counted within the row."""
    # hits are a column of their own, as tokens are in chunk()
    found = chunks.select(*KEY, F.size("tokens").alias("dl"), hits(F.col("tokens"), vocabulary).alias("hits"))
    return found.select(*KEY, "dl", counts(F.col("hits")).alias("tf"))


def counted_windows(tokens: Column, vocabulary: list[str]) -> Column:
    """Array of (chunk_idx, dl, tf, tokens): the windows of a document and their counts."""
    each = F.transform(T.windows(tokens), lambda w: F.struct(w["chunk_idx"].alias("chunk_idx"), F.size(w["tokens"]).alias("dl"), hits(w["tokens"], vocabulary).alias("hits"), w["tokens"].alias("tokens")))
    return F.transform(each, lambda w: F.struct(w["chunk_idx"].alias("chunk_idx"), w["dl"].alias("dl"), counts(w["hits"]).alias("tf"), w["tokens"].alias("tokens")))


def corpus_index(windows: DataFrame) -> DataFrame:
    """windows: of term_counts(). corpus_id, n_chunks, avg_dl, df (windows by term). One pass:
    every window is a row of its corpus, and one of each of its terms, summed where it is read."""
    rows = F.concat(F.array(F.lit(None).cast("string")), F.transform("tf", lambda x: x["term"]))
    each = windows.select("corpus_id", "dl", F.explode(rows).alias("term"))
    summed = each.groupBy("corpus_id", "term").agg(F.count("*").alias("n"), F.sum("dl").alias("dl"))
    whole = F.col("term").isNull()
    return summed.groupBy("corpus_id").agg(
        F.max(F.when(whole, F.col("n"))).alias("n_chunks"),
        F.max(F.when(whole, F.col("dl") / F.col("n"))).alias("avg_dl"),
        F.map_from_entries(F.collect_list(F.when(~whole, F.struct("term", "n")))).alias("df"),
    )


def own_index(documents: DataFrame) -> DataFrame:
    """documents: windows (dl, tf). Adds n_chunks, avg_dl and df of each document as a corpus of
    its own."""
    terms = F.flatten(F.transform("windows", lambda w: F.transform(w["tf"], lambda x: x["term"])))
    # terms are a column of their own, as the lambda would gather them again for each
    out = documents.withColumn("terms", terms)
    df = F.map_from_entries(F.transform(F.array_distinct("terms"), lambda t: F.struct(t, F.size("terms") - F.size(F.array_remove("terms", t)))))
    dl = F.aggregate("windows", F.lit(0).cast("long"), lambda s, w: s + w["dl"])
    return out.withColumn("n_chunks", F.size("windows")).withColumn("avg_dl", F.try_divide(dl, F.size("windows"))).withColumn("df", df).drop("terms")


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """n_chunks and avg_dl of each corpus, from the windows' sizes alone."""
    return chunks.groupBy("corpus_id").agg(F.count("*").alias("n_chunks"), F.avg(F.size("tokens").cast("double")).alias("avg_dl"))


def doc_freq(tf: DataFrame) -> DataFrame:
    """Chunks of a corpus that have the term."""
    return tf.groupBy("corpus_id", "term").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def numbered(chunks: DataFrame) -> DataFrame:
    """chunk_id: a window's number within its corpus, from 0, by document and window. Only for
    showing: (corpus_id, doc_id, chunk_idx) is the key. Documents are numbered by their counts
    alone, in ranges; no window is sorted or shuffled, and no text leaves the task that reads it."""
    sizes = chunks.groupBy("corpus_id", "doc_id").agg(F.count("*").alias("n"))
    ahead = before(sizes, ["corpus_id"], ["doc_id"], F.col("n")).select("corpus_id", "doc_id", "before")
    return chunks.join(ahead, ["corpus_id", "doc_id"]).withColumn("chunk_id", (F.col("before") + F.col("chunk_idx")).cast("int")).drop("before")


def lookup(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: corpus_id, chunk_id. Adds text; empty where there is no such window. The wanted
    windows' keys are found first, and text is fetched for them alone."""
    keys = numbered(chunks.drop("tokens")).join(wanted.distinct(), ["corpus_id", "chunk_id"], "left_semi").select(*KEY, "chunk_id")
    found = chunks.join(keys, KEY).select("corpus_id", "chunk_id", chunk_text().alias("text"))
    return wanted.join(found, ["corpus_id", "chunk_id"], "left").fillna("", ["text"])
