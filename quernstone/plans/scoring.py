"""The whole plan: documents to windows, rankings, votes and scores of every corpus at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone import catalog as C
from quernstone.functions import text as T
from quernstone.functions.security import suspicious
from quernstone.operators import embed as E
from quernstone.operators import index as I
from quernstone.operators import retrieve as R
from quernstone.operators import rollup as U
from quernstone.operators import voting as V
from quernstone.sources.snapshots import saved


@dataclass
class Scores:
    """Results by level, each drawn from the evidence when it is read."""

    evidence: DataFrame
    fields: DataFrame
    controls: DataFrame
    companies: DataFrame


def _rolled(evidence: DataFrame, fields: DataFrame, corpora: DataFrame, catalog: C.Catalog) -> Scores:
    """evidence: with rule_score, vote_mean and confidence."""
    evidence = evidence.withColumn("chunk_score", F.coalesce("vote_mean", "rule_score")).withColumn("is_vote", F.col("vote_mean").isNotNull())
    by_field = U.field_scores(evidence, fields, corpora)
    controls = U.control_scores(by_field)
    return Scores(evidence, by_field, controls, U.company_scores(controls, catalog.weights))


def _without_votes(evidence: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("double")
    return evidence.withColumn("vote_mean", nothing).withColumn("confidence", nothing)


def score_corpora(
    docs: DataFrame,
    catalog: C.Catalog = C.DOMAIN,
    provider: V.VoteProvider | None = None,
    cache: DataFrame | None = None,
    similarity: DataFrame | None = None,
    embedder: E.Embedder | None = None,
    least: float = C.MIN_SCORE,
) -> Scores:
    """docs: corpus_id, doc_id, text. Only shortlisted windows are judged: their documents are
    read and cut again, rules run once per control and window, and providers see each field and
    window. Without a provider, or where all its calls fail, rules decide. Candidates are
    reranked by `similarity`, or by an embedder's vectors, if either is given.

    The shortlist and the judged windows, a few for each corpus and field, are written to the
    shared folder once. All levels of the result are drawn from there: reading several of them
    neither ranks again nor asks a provider again."""
    spark = docs.sparkSession
    fields = R.fields_frame(spark, catalog.fields)
    short = saved(R.shortlist(I.chunk(docs), fields, least=least), "shortlist")
    # all else needs the shortlisted documents only
    chunks = I.chunk(docs.join(short.select("corpus_id", "doc_id").distinct(), ["corpus_id", "doc_id"], "left_semi"))
    if similarity is None and embedder is not None:
        similarity = E.similarities(short, chunks, fields, embedder)
    final = R.rerank(short, similarity)
    final = final.join(F.broadcast(fields.select("field", "control")), "field")
    # a control's fields share windows: each is fetched and judged once for it
    wanted = final.groupBy(*I.KEY, "control").agg(F.collect_list(F.struct("field", "final_rank")).alias("asked"))
    texts = chunks.join(wanted, I.KEY).select(*I.KEY, "control", "asked", I.chunk_text().alias("text"))
    judged = V.rule_scores(texts, catalog).withColumn("suspicious", suspicious(F.col("text")))
    evidence = judged.withColumn("a", F.explode("asked")).select(*I.KEY, "control", "text", "rule_score", "suspicious", "a.field", "a.final_rank")
    if provider is None:
        evidence = _without_votes(evidence)
    else:
        evidence = saved(evidence, "judged")
        votes = V.cast_votes(evidence.select("field", "text").distinct(), provider, cache)
        evidence = evidence.join(V.ensemble(votes), ["field", "text"], "left")
    return _rolled(saved(evidence, "evidence"), fields, docs, catalog)


def per_document(docs: DataFrame, catalog: C.Catalog = C.DOMAIN, least: float = C.MIN_SCORE) -> Scores:
    """Each document scored as a corpus of its own, by rules, for corpora of two or more.

    A document's statistics are its own, so they are summed within its row, and as nearly every
    window is among the best of some field, each is judged where it is read: no text and no
    count is joined; only scores are ranked and summed by document.
    """
    fields = R.fields_frame(docs.sparkSession, catalog.fields)
    asked = R.asked_terms(fields)
    vocabulary = sorted({t for qtf in asked.values() for t in qtf})
    name = F.concat_ws("/", "corpus_id", F.col("doc_id").cast("string")).alias("corpus_id")
    # columns of their own, as lambdas and generators would build each again
    rows = docs.select(name, "doc_id", T.tokens(F.col("text")).alias("tokens"))
    rows = rows.select("corpus_id", "doc_id", I.counted_windows(F.col("tokens"), vocabulary).alias("windows"))
    rows = I.own_index(rows)
    rows = I.exploded(rows)
    rows = rows.withColumn("text", I.chunk_text()).drop("tokens")
    rows = rows.withColumn("rules", V.rules_by_control(F.col("text"), catalog)).withColumn("suspicious", suspicious(F.col("text")))
    final = R.rerank(R.gate(R.top_k(R.scored(rows, asked), C.CANDIDATES), least), None)
    evidence = final.join(F.broadcast(fields.select("field", "control")), "field").withColumn("rule_score", F.try_element_at("rules", F.col("control"))).drop("rules")
    several = docs.groupBy("corpus_id").agg(F.count("*").alias("n")).filter("n > 1").select("corpus_id")
    wanted = docs.select("corpus_id", "doc_id").join(several, "corpus_id").select(name).distinct()
    scores = _rolled(_without_votes(evidence), fields, wanted, catalog)
    scores.evidence = scores.evidence.join(wanted, "corpus_id", "left_semi")
    return scores
