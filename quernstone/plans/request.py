"""The whole answer to a request in one document: scores and findings of the collection, each
document's own scores, and the signature over all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone import catalog as C
from quernstone.functions import canonical
from quernstone.functions.security import ALGORITHM
from quernstone.operators import evidence as V
from quernstone.operators import rollup as U
from quernstone.plans.report import sealed
from quernstone.plans.scoring import per_document, score_corpora
from quernstone.sources.snapshots import saved


def by_document(docs: DataFrame, catalog: C.Catalog = C.DOMAIN) -> DataFrame:
    """corpus_id, per_document: a map of a document's id to its company_score and its controls'
    scores, of corpora of two or more. What documents score is written once."""
    own = per_document(docs, catalog)
    controls = saved(own.controls, "controls")
    scores = U.company_scores(controls, catalog.weights)
    each = controls.groupBy("corpus_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("control", "score")))).alias("controls"))
    names = docs.select(F.col("corpus_id").alias("of"), F.col("doc_id").cast("string").alias("doc"), F.concat_ws("/", "corpus_id", F.col("doc_id").cast("string")).alias("corpus_id")).distinct()
    both = scores.join(each, "corpus_id").join(names, "corpus_id")
    entry = F.struct("doc", F.struct("company_score", "controls").alias("result"))
    less = lambda a, b: F.when(a["doc"] < b["doc"], -1).when(a["doc"] > b["doc"], 1).otherwise(0)
    return both.groupBy(F.col("of").alias("corpus_id")).agg(F.map_from_entries(F.array_sort(F.collect_list(entry), less)).alias("per_document"))


def answers(docs: DataFrame, key: bytes, generated_at: str, catalog: C.Catalog = C.DOMAIN, findings: V.FindingProvider | None = None) -> DataFrame:
    """corpus_id, answer (canonical JSON of findings, per_document and scores), hmac,
    generated_at, algorithm. A corpus of one document has no per_document part."""
    scores = score_corpora(docs, catalog)
    said = V.findings(scores.controls, scores.fields, findings)
    by = said.groupBy("corpus_id").agg(F.map_from_entries(F.collect_list(F.struct("control", F.struct("finding", "remediation").alias("f")))).alias("findings"))
    whole = U.nested(scores.companies, scores.controls, scores.fields).join(by, "corpus_id").join(by_document(docs, catalog), "corpus_id", "left")
    rows = whole.select("corpus_id", F.struct("findings", "per_document", F.struct("company_score", "controls").alias("scores")).alias("payload"))
    out = rows.select("corpus_id", canonical.json(F.col("payload"), rows.schema["payload"].dataType).alias("answer"))
    return out.select("corpus_id", "answer", sealed(F.col("answer"), key, F.lit(generated_at)).alias("hmac"), F.lit(generated_at).alias("generated_at"), F.lit(ALGORITHM).alias("algorithm"))
