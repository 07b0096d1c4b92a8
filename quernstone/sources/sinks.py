"""Writers: results as JSON, call logs by day, the vote cache and the index as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators import index as I
from quernstone.operators.voting import upserted


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def call_log(calls: DataFrame) -> DataFrame:
    """calls: at (ISO 8601), model, prompt, answer, error. Adds log_date (UTC) and stream, by
    which successes and errors are kept apart."""
    stream = F.when(F.col("error").isNull(), "calls").otherwise("errors")
    return calls.withColumn("log_date", F.substring("at", 1, 10)).withColumn("stream", stream)


def append_log(calls: DataFrame, path: str) -> None:
    call_log(calls).write.mode("append").partitionBy("stream", "log_date").json(path)


def write_cache(cache: DataFrame, new: DataFrame, path: str) -> None:
    """The cache with new votes put in, at another path than it is read from."""
    upserted(cache, new).write.mode("overwrite").parquet(path)


def write_index(chunks: DataFrame, path: str) -> None:
    """Postings, window sizes and corpus statistics, each a Parquet table by corpus."""
    tf = I.term_freq(chunks)
    tf.write.mode("overwrite").partitionBy("corpus_id").parquet(f"{path}/postings")
    sizes = chunks.select(*I.KEY, F.size("tokens").alias("dl"))
    sizes.write.mode("overwrite").partitionBy("corpus_id").parquet(f"{path}/chunk_stats")
    I.corpus_stats(chunks).write.mode("overwrite").parquet(f"{path}/corpus_stats")


def report_view(controls: DataFrame, integrity: DataFrame | None = None) -> DataFrame:
    """What a page shows: one decimal, a dash without evidence, 16 digits of the signature."""
    shown = F.when(F.col("has_evidence"), F.format_number("score", 1)).otherwise("—")
    out = controls.select("corpus_id", "control", shown.alias("score"), F.when(F.col("has_evidence"), F.col("maturity")).otherwise("—").alias("maturity"), "needs_review")
    return out if integrity is None else out.join(integrity.select("corpus_id", F.substring("hmac", 1, 16).alias("signature")), "corpus_id", "left")
