"""From windows to fields, controls and corpora. Each level averages the rounded one below."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.catalog import LABELS, MATURITY, REVIEW_BELOW


def bucket(score: Column, cuts: tuple[tuple[float | None, str], ...]) -> Column:
    out = F.when(score >= cuts[0][0], cuts[0][1])
    for least, name in cuts[1:-1]:
        out = out.when(score >= least, name)
    return out.otherwise(cuts[-1][1])


def maturity(score: Column) -> Column:
    return bucket(score, MATURITY)


def label(score: Column) -> Column:
    return bucket(score, LABELS)


def field_scores(evidence: DataFrame, fields: DataFrame, corpora: DataFrame) -> DataFrame:
    """evidence: corpus_id, field, final_rank, text, chunk_score, is_vote, confidence,
    suspicious. A row for each corpus and field of the catalog: without evidence its score is 0
    and its coverage null."""
    chunk = F.struct(F.col("chunk_score"), -F.col("final_rank"))
    confidence = F.bround(F.avg("confidence"), 2)
    found = evidence.groupBy("corpus_id", "field").agg(
        F.bround(F.avg("chunk_score") * 100, 2).alias("score"),
        F.max_by("text", chunk).alias("best_chunk"),
        F.bround(F.avg(F.col("is_vote").cast("double")), 2).alias("llm_coverage"),
        confidence.alias("confidence"),
        F.bool_or("suspicious").alias("injection_suspected"),
    )
    every = corpora.select("corpus_id").distinct().crossJoin(F.broadcast(fields.select("field", "control", "ordinal")))
    out = every.join(found, ["corpus_id", "field"], "left")
    review = F.coalesce(F.col("confidence") < REVIEW_BELOW, F.lit(False)) | F.coalesce("injection_suspected", F.lit(False))
    return out.select(
        "corpus_id", "control", "field", "ordinal",
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("best_chunk", F.lit("")).alias("best_chunk"),
        "llm_coverage", "confidence",
        review.alias("needs_review"),
        F.coalesce("injection_suspected", F.lit(False)).alias("injection_suspected"),
    )


def control_scores(fields: DataFrame) -> DataFrame:
    out = fields.groupBy("corpus_id", "control").agg(
        F.bround(F.avg("score"), 2).alias("score"),
        F.bool_or(F.col("best_chunk") != "").alias("has_evidence"),
        F.bround(F.avg("confidence"), 2).alias("confidence"),
        F.bool_or("needs_review").alias("needs_review"),
        F.bool_or("injection_suspected").alias("injection_suspected"),
    )
    return out.withColumn("maturity", maturity(F.col("score")))


def company_scores(controls: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of the catalog's controls; one that is missing counts as 0."""
    w = reduce(lambda out, cw: out.when(F.col("control") == cw[0], cw[1]), weights.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    return controls.groupBy("corpus_id").agg(F.bround(F.sum(F.col("score") * w) / sum(weights.values()), 2).alias("company_score"))


def nested(companies: DataFrame, controls: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per corpus: company_score and a map of controls, each with a map of fields, both
    in the order of their names."""
    f = F.struct("score", "best_chunk", "llm_coverage", "confidence", "needs_review", "injection_suspected")
    inner = fields.groupBy("corpus_id", "control").agg(_map(F.struct("field", f.alias("result"))).alias("fields"))
    c = F.struct("score", "maturity", "has_evidence", "confidence", "needs_review", "injection_suspected", "fields")
    both = controls.join(inner, ["corpus_id", "control"]).select("corpus_id", F.struct("control", c.alias("result")).alias("entry"))
    return companies.join(both.groupBy("corpus_id").agg(_map(F.col("entry"), "control").alias("controls")), "corpus_id")


def _map(entry: Column, key: str = "field") -> Column:
    """A map of (key, result) entries. Maps have no order of their own to sort entries by."""
    less = lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0)
    return F.map_from_entries(F.array_sort(F.collect_list(entry), less))
