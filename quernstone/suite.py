"""The registered queries of the engine and their SQL.

Corpora are the sources of the documents table. The shared tables hold none of the domain's
words, so ranking and scoring run with a catalog of frequent words; rules and other operators
with signals of their own run on fixtures too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone import fixtures as X
from quernstone.catalog import DOMAIN, INJECTION, REDACTIONS, Catalog
from quernstone.functions import rules as R
from quernstone.functions import security as S
from quernstone.functions import session as N
from quernstone.functions import text as T
from quernstone.operators import evaluate as E
from quernstone.operators import evidence as V
from quernstone.operators import index as I
from quernstone.operators import retrieve as Q
from quernstone.operators import rollup as U
from quernstone.operators import voting as O
from quernstone.operators import watch as G
from quernstone.plans import report as P
from quernstone.plans import request as A
from quernstone.plans.scoring import per_document, score_corpora
from quernstone.sources import documents as D
from quernstone.sources import pages as M
from quernstone.sources import sinks
from quernstone.sources.ledger import Calling, Ledger, LedgerVotes
from quernstone.sources.snapshots import saved, scratch
from quernstone.sources.stored_index import StoredIndex
from quernstone.sources.vote_store import VoteStore
from quernstone.streaming import ratelimit

FLAGSHIP = "company_scores"
KEY = b"a key for tests"
AT = "2024-05-01T00:00:00+00:00"

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.from_table(D.spread(read(spark, sf_dir, "documents")), "source")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.chunk(corpus(spark, sf_dir))


def asked(spark: SparkSession) -> DataFrame:
    return Q.fields_frame(spark, X.DRIVER.fields)


# SQL that several oracles share


def lit(v) -> str:
    if v is None:
        return "NULL"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def chars(x: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in x)


def values(rows: list[tuple], names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names}))"


TOKENS = r"list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
CHUNKS = f"""tok AS (SELECT source AS corpus_id, doc_id, text, {TOKENS} AS toks FROM documents),
sized AS (SELECT *, len(toks) AS n, CASE WHEN len(toks) = 0 THEN 0 ELSE 1 + CAST(ceil(greatest(len(toks) - 512, 0) / 384.0) AS BIGINT) END AS k FROM tok),
chunks AS (SELECT corpus_id, doc_id, CAST(i AS INT) AS chunk_idx, CAST(i * 384 AS INT) AS token_start, CAST(least(i * 384 + 512, n) AS INT) AS token_end,
  toks[i * 384 + 1 : least(i * 384 + 512, n)] AS tokens FROM (SELECT *, unnest(range(0, k)) AS i FROM sized))"""
FIELDS = "fields AS " + values([(f.name, f.control, f.query, k) for k, f in enumerate(X.DRIVER.fields)], "field, control, query, ordinal")
TF = """tf AS (SELECT corpus_id, doc_id, chunk_idx, term, count(*) AS tf, any_value(dl) AS dl FROM
  (SELECT corpus_id, doc_id, chunk_idx, len(tokens) AS dl, lower(unnest(tokens)) AS term FROM chunks) GROUP BY ALL),
df AS (SELECT corpus_id, term, count(*) AS df FROM tf GROUP BY ALL),
stats AS (SELECT corpus_id, count(*) AS n_chunks, avg(CAST(len(tokens) AS DOUBLE)) AS avg_dl FROM chunks GROUP BY ALL)"""
SCORES = """qt AS (SELECT field, term, count(*) AS qtf FROM (SELECT field, unnest(string_split(lower(query), ' ')) AS term FROM fields) GROUP BY ALL),
scores AS (SELECT corpus_id, field, doc_id, chunk_idx, round(sum(qtf * ln((n_chunks - df + 0.5) / (df + 0.5) + 1.0)
  * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl)) + 1.0)), 6) AS score
  FROM tf JOIN qt USING (term) JOIN df USING (corpus_id, term) JOIN stats USING (corpus_id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, field ORDER BY score DESC, doc_id, chunk_idx) AS rank FROM scores),
short AS (SELECT * FROM ranked WHERE rank <= 15 AND score >= 1.0)"""
NORMS = """norms AS (SELECT *, (score - min(score) OVER w) / coalesce(nullif(max(score) OVER w - min(score) OVER w, 0), 1.0) AS norm
  FROM short WINDOW w AS (PARTITION BY corpus_id, field))"""
ALL = f"{CHUNKS}, {FIELDS}, {TF}, {SCORES}"


SUSPICIOUS = " OR ".join(f"regexp_matches(text, {lit('(?i)' + p)})" for p in INJECTION)


def sql_judged(catalog: Catalog) -> str:
    by = " ".join(f"WHEN '{c}' THEN {R.sql_score([R.sql_vote(r, 'text') for r in catalog.rules if r.control == c])}" for c in catalog.controls)
    return f"""judged AS (SELECT s.corpus_id, f.control, s.field, s.doc_id, s.chunk_idx, s.rank, array_to_string(c.tokens, ' ') AS text
  FROM short s JOIN chunks c USING (corpus_id, doc_id, chunk_idx) JOIN fields f ON f.field = s.field WHERE s.rank <= 5),
voted AS (SELECT *, CASE control {by} END AS chunk_score, {SUSPICIOUS} AS suspicious FROM judged)"""


BUCKET = "CASE WHEN {0} >= 80 THEN 'L5 Optimising' WHEN {0} >= 65 THEN 'L4 Managed' WHEN {0} >= 50 THEN 'L3 Defined' WHEN {0} >= 35 THEN 'L2 Developing' ELSE 'L1 Initial' END"
ROLLUP = f"""{ALL}, {sql_judged(X.DRIVER)},
found AS (SELECT corpus_id, field, round_even(avg(chunk_score) * 100, 2) AS score, first(text ORDER BY chunk_score DESC, rank) AS best_chunk, bool_or(suspicious) AS suspicious FROM voted GROUP BY ALL),
by_field AS (SELECT d.corpus_id, f.control, f.field, f.ordinal, coalesce(x.score, 0.0) AS score, coalesce(x.best_chunk, '') AS best_chunk, coalesce(x.suspicious, FALSE) AS suspicious, CASE WHEN x.score IS NOT NULL THEN 0.0 END AS llm_coverage
  FROM (SELECT DISTINCT source AS corpus_id FROM documents) d CROSS JOIN fields f LEFT JOIN found x ON x.corpus_id = d.corpus_id AND x.field = f.field),
by_control AS (SELECT corpus_id, control, round_even(avg(score), 2) AS score, bool_or(best_chunk <> '') AS has_evidence, bool_or(suspicious) AS suspicious FROM by_field GROUP BY ALL)"""
COMPANY = "SELECT corpus_id, round_even(sum(score * CASE control WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.9 ELSE 0.95 END) / 2.85, 2) AS company_score FROM by_control GROUP BY ALL"


# tokens and windows


@query(f"WITH {CHUNKS} SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, CAST(k AS BIGINT) AS n_chunks FROM sized")
def tokenize_stats(spark, sf_dir):
    n = F.size(T.tokens(F.col("text")))
    return corpus(spark, sf_dir).select("doc_id", n.cast("long").alias("n_tokens"), T.window_count(n).cast("long").alias("n_chunks"))


@query(f"WITH {CHUNKS} SELECT corpus_id, doc_id, chunk_idx, token_start, token_end, sha256(array_to_string(tokens, ' ')) AS text_sha FROM chunks")
def chunk_windows(spark, sf_dir):
    return chunks(spark, sf_dir).select(*I.KEY, "token_start", "token_end", F.sha2(I.chunk_text(), 256).alias("text_sha"))


@query(_sql["chunk_windows"])
def chunk_windows_sql(spark, sf_dir):
    """The same in the session's SQL."""
    N.register(spark)
    corpus(spark, sf_dir).createOrReplaceTempView("quernstone_corpus")
    return spark.sql("SELECT corpus_id, doc_id, chunk_idx, token_start, token_end, sha2(text, 256) AS text_sha FROM (SELECT corpus_id, doc_id, inline_outer(w) FROM (SELECT corpus_id, doc_id, windows_of(tokens_of(text)) AS w FROM quernstone_corpus)) WHERE chunk_idx IS NOT NULL")


@query(f"WITH {CHUNKS} SELECT corpus_id, count(*) AS n_chunks FROM chunks GROUP BY ALL")
def chunk_counts(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("corpus_id").agg(F.count("*").alias("n_chunks"))


WANTED = "(SELECT corpus_id, CAST(unnest([0, 3, 100000]) AS INT) AS chunk_id FROM (SELECT DISTINCT source AS corpus_id FROM documents))"


@query(f"WITH {CHUNKS}, ids AS (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY doc_id, chunk_idx) - 1 AS chunk_id FROM chunks) SELECT w.corpus_id, w.chunk_id, sha256(coalesce(array_to_string(i.tokens, ' '), '')) AS text_sha FROM {WANTED} w LEFT JOIN ids i ON i.corpus_id = w.corpus_id AND i.chunk_id = w.chunk_id")
def chunk_lookup(spark, sf_dir):
    wanted = corpus(spark, sf_dir).select("corpus_id").distinct().withColumn("chunk_id", F.explode(F.array(F.lit(0), F.lit(3), F.lit(100000))))
    return I.lookup(chunks(spark, sf_dir), wanted).select("corpus_id", "chunk_id", F.sha2("text", 256).alias("text_sha"))


# index


@query(f"WITH {CHUNKS}, {TF} SELECT corpus_id, doc_id, chunk_idx, term, tf FROM tf")
def term_freq(spark, sf_dir):
    return I.term_freq(chunks(spark, sf_dir))


@query(f"WITH {CHUNKS}, {TF} SELECT corpus_id, term, df FROM df")
def doc_freq(spark, sf_dir):
    return I.doc_freq(I.term_freq(chunks(spark, sf_dir)))


@query(f"WITH {CHUNKS}, {TF} SELECT corpus_id, n_chunks, round(avg_dl, 6) AS avg_dl FROM stats")
def corpus_stats(spark, sf_dir):
    return I.corpus_stats(chunks(spark, sf_dir)).withColumn("avg_dl", F.round("avg_dl", 6))


@query(f"WITH {CHUNKS}, {TF} SELECT corpus_id, term, df, round(ln((n_chunks - df + 0.5) / (df + 0.5) + 1.0), 6) AS idf FROM df JOIN stats USING (corpus_id)")
def idf_table(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return I.doc_freq(I.term_freq(c)).join(I.corpus_stats(c), "corpus_id").select("corpus_id", "term", "df", F.round(I.idf(F.col("df"), F.col("n_chunks")), 6).alias("idf"))


# retrieval


@query(f"WITH {FIELDS}, every AS (SELECT field, query FROM fields UNION ALL SELECT 'turn ' || conv_id || '/' || turn, text FROM conversations WHERE text IS NOT NULL), qt AS (SELECT field, term, count(*) AS qtf FROM (SELECT field, unnest(regexp_split_to_array(lower(query), '[ \t\n\x0B\f\r]+')) AS term FROM every) WHERE term <> '' GROUP BY ALL) SELECT field, term, qtf FROM qt")
def duplicate_query_terms(spark, sf_dir):
    """Terms of the catalog's queries, and of each turn of the conversations as one more."""
    talk = read(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    turns = talk.select(F.concat(F.lit("turn "), "conv_id", F.lit("/"), "turn").alias("field"), F.col("text").alias("query"))
    return Q.query_terms(asked(spark).select("field", "query").unionAll(turns))


@query(f"WITH {ALL} SELECT corpus_id, field, doc_id, chunk_idx, score FROM scores")
def bm25_scores(spark, sf_dir):
    return Q.bm25(chunks(spark, sf_dir), asked(spark))


@query(f"WITH {ALL} SELECT corpus_id, field, doc_id, chunk_idx, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 15")
def bm25_topk_by_source(spark, sf_dir):
    return Q.top_k(Q.bm25(chunks(spark, sf_dir), asked(spark)), 15)


@query(f"WITH {ALL.replace('source AS corpus_id', 'CAST(0 AS INT) AS corpus_id', 1)} SELECT field, doc_id, chunk_idx, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 50")
def bm25_topk(spark, sf_dir):
    """One index over all documents: the top-k report of search()."""
    one = I.chunk(corpus(spark, sf_dir).withColumn("corpus_id", F.lit(0)))
    return Q.search(one, asked(spark)).drop("corpus_id")


# the stored index: SQL knows nothing of it and ranks the texts


def folder(spark, name: str) -> str:
    return f"{scratch(spark)}/quernstone/{name}-{uuid.uuid4().hex}"


ONE = ALL.replace("source AS corpus_id", "CAST(0 AS INT) AS corpus_id", 1)


@query(f"WITH {ONE} SELECT field, doc_id, chunk_idx, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 50")
def stored_topk(spark, sf_dir):
    """One index over all documents, written and then searched without their texts."""
    index = StoredIndex(spark, folder(spark, "index"))
    index.add(corpus(spark, sf_dir).withColumn("corpus_id", F.lit(0)))
    return index.search(asked(spark)).drop("corpus_id")


@query(f"WITH {ONE} SELECT field, doc_id, chunk_idx, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 10")
def stored_topk_pruned(spark, sf_dir):
    """The same where only tiles that can hold one of the best ten are unpacked."""
    index = StoredIndex(spark, folder(spark, "index"), tile_bits=2)
    index.add(corpus(spark, sf_dir).withColumn("corpus_id", F.lit(0)))
    return index.search(asked(spark), 10, seeds=12, pruned_from=0).drop("corpus_id")


def grown(spark, sf_dir) -> StoredIndex:
    """Nine tenths of the documents, then the last tenth and some that are there, less every
    eleventh document, in segments that are merged; the segments add up to a rebuild."""
    docs, index = corpus(spark, sf_dir), StoredIndex(spark, folder(spark, "index"))
    index.add(docs.filter("doc_id % 10 != 0"))
    index.add(docs.filter("doc_id % 10 = 0 OR doc_id % 10 = 7"))
    index.remove(docs.filter("doc_id % 11 = 3"))
    index.compact(2)
    return index


LEFT = "FROM (SELECT * FROM documents WHERE doc_id % 11 <> 3)"


@query(f"WITH {ALL.replace('FROM documents', LEFT, 1)} SELECT corpus_id, field, doc_id, chunk_idx, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 15")
def stored_topk_grown(spark, sf_dir):
    return grown(spark, sf_dir).search(asked(spark), 15)


@query(f"WITH {CHUNKS.replace('FROM documents', LEFT, 1)}, {TF} SELECT corpus_id, term, df FROM df")
def stored_doc_freq_grown(spark, sf_dir):
    return grown(spark, sf_dir).doc_freq()


@query(f"WITH {CHUNKS.replace('FROM documents', LEFT, 1)}, {TF} SELECT corpus_id, n_chunks, round(avg_dl, 6) AS avg_dl FROM stats")
def stored_stats_grown(spark, sf_dir):
    return grown(spark, sf_dir).stats().withColumn("avg_dl", F.round("avg_dl", 6))


@query(f"WITH {ALL} SELECT corpus_id, field, doc_id, chunk_idx, score, CAST(rank AS INT) AS rank FROM short")
def min_score_gate(spark, sf_dir):
    return Q.shortlist(chunks(spark, sf_dir), asked(spark))


@query(f"WITH {ALL}, {NORMS} SELECT corpus_id, field, doc_id, chunk_idx, round(norm, 6) AS norm FROM norms")
def minmax_norm(spark, sf_dir):
    return Q.normalised(Q.shortlist(chunks(spark, sf_dir), asked(spark))).select("corpus_id", "field", "doc_id", "chunk_idx", F.round("norm", 6).alias("norm"))


def vectors(spark, sf_dir):
    """Vectors stand in for the embeddings of documents, by number."""
    return read(spark, sf_dir, "embeddings")


QUERIES = "(SELECT vec_id AS q, CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id % 20 = 0)"


@query(f"SELECT q, v AS vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, v) AS rank FROM (SELECT q, vec_id AS v, round(list_cosine_similarity(qe, CAST(embedding AS DOUBLE[])), 6) AS score FROM {QUERIES}, embeddings WHERE vec_id <> q)) WHERE rank <= 5")
def cosine_topk(spark, sf_dir):
    """Nearest five vectors of each query vector (ids divisible by 20): a stated query set, in
    blocks, against all rows."""
    e = D.spread(vectors(spark, sf_dir))
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("asked"))
    return Q.nearest(e.select(F.col("vec_id").alias("doc_id"), "embedding"), q, 5).select("q", F.col("doc_id").alias("vec_id"), "score", "rank")


SIMILAR = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(z.embedding AS DOUBLE[])), 6)"


@query(
    f"""WITH {ALL}, {NORMS}, sims AS (SELECT n.*, round(0.6 * norm + 0.4 * coalesce({SIMILAR}, 0.0), 6) AS blended
  FROM norms n JOIN fields f ON f.field = n.field LEFT JOIN embeddings e ON e.vec_id = n.doc_id LEFT JOIN embeddings z ON z.vec_id = f.ordinal),
  last AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, field ORDER BY blended DESC, rank) AS final_rank FROM sims)
  SELECT corpus_id, field, doc_id, chunk_idx, blended, CAST(final_rank AS INT) AS final_rank FROM last WHERE final_rank <= 5"""
)
def hybrid_rerank(spark, sf_dir):
    short = saved(Q.shortlist(chunks(spark, sf_dir), asked(spark)), "shortlist")
    e = vectors(spark, sf_dir)
    asked_e = asked(spark).join(e, F.col("ordinal") == F.col("vec_id")).select("field", F.col("embedding").alias("qe"))
    similar = short.join(e.withColumnRenamed("vec_id", "doc_id"), "doc_id").join(asked_e, "field").select("corpus_id", "field", "doc_id", "chunk_idx", F.round(Q.cosine(F.col("embedding"), F.col("qe")), 6).alias("similarity"))
    return Q.rerank(short, similar).select("corpus_id", "field", "doc_id", "chunk_idx", "blended", "final_rank")


# rules


def rule_query(name: str, control: str) -> None:
    own = [r for r in DOMAIN.rules if r.control == control]
    rows = [(i, t) for i, c, t in X.RULE_CASES if c == control]
    names = ", ".join(f"{R.sql_vote(r, 'text')} AS {r.name}" for r in own)
    everywhere = f"(SELECT case_id, text FROM {values(rows, 'case_id, text')} UNION ALL SELECT 1000 + doc_id, text FROM documents)"

    def run(spark, sf_dir):
        cases = spark.createDataFrame(rows, "case_id long, text string").unionAll(read(spark, sf_dir, "documents").select(F.col("doc_id") + 1000, "text"))
        return cases.select("case_id", *(R.vote(r, F.col("text")).alias(r.name) for r in own))

    run.__name__ = name
    query(f"SELECT CAST(case_id AS BIGINT) AS case_id, {names} FROM {everywhere}")(run)


for _c in DOMAIN.controls:
    rule_query(f"rule_votes_{_c.lower()}", _c)

RULE_BY = " ".join(f"WHEN '{c}' THEN {R.sql_score([R.sql_vote(r, 'text') for r in DOMAIN.rules if r.control == c])}" for c in DOMAIN.controls)


@query(f"SELECT CAST(case_id AS BIGINT) AS case_id, control, round(CASE control {RULE_BY} END, 6) AS rule_score FROM (SELECT case_id, control, text FROM {values(X.RULE_CASES, 'case_id, control, text')} UNION ALL SELECT 1000 + doc_id, 'PC' || (1 + doc_id % 3), text FROM documents)")
def rule_score(spark, sf_dir):
    cases = spark.createDataFrame(X.RULE_CASES, "case_id long, control string, text string")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id") + 1000, F.concat(F.lit("PC"), F.col("doc_id") % 3 + 1), "text")
    return O.rule_scores(cases.unionAll(docs), DOMAIN).select("case_id", "control", F.round("rule_score", 6).alias("rule_score"))


# votes

PARSED = "CASE WHEN answer IS NULL THEN NULL WHEN contains(upper(answer), 'NON_COMPLIANT') OR contains(upper(answer), 'NON COMPLIANT') OR contains(upper(answer), 'NONCOMPLIANT') THEN 0.0 WHEN contains(upper(answer), 'PARTIAL') THEN 0.5 WHEN contains(upper(answer), 'COMPLIANT') THEN 1.0 ELSE 0.0 END"
SAID = f"""said AS (SELECT field, text, model, answer FROM {values(X.VOTES, 'field, text, model, answer')} UNION ALL
  SELECT CASE WHEN conv_id % 2 = 0 THEN 'A' ELSE 'B' END, 'talk ' || conv_id || '/' || (turn // 3), 'm' || (1 + turn % 3), min(CASE length(text) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'COMPLIANT. ' || text WHEN 2 THEN 'partial: ' || text WHEN 3 THEN 'Non compliant ' || text ELSE text END) FROM conversations GROUP BY ALL)"""
VOTES = f"{SAID}, votes AS (SELECT field, text, model, CAST({PARSED} AS DOUBLE) AS vote FROM (SELECT DISTINCT field, text FROM said) CROSS JOIN (VALUES ('m1'), ('m2'), ('m3')) m(model) LEFT JOIN said USING (field, text, model))"
ENSEMBLE = "ens AS (SELECT field, text, count(*) AS n_votes, avg(vote) AS vote_mean, CASE WHEN count(*) >= 2 THEN round_even(1 - (max(vote) - min(vote)), 2) END AS confidence FROM votes WHERE vote IS NOT NULL GROUP BY ALL)"


def stored(spark, sf_dir) -> DataFrame:
    """Answers of three models: our own, and the turns of conversations, three to a text."""
    own = spark.createDataFrame(X.VOTES, "field string, text string, model string, answer string")
    say = F.when(F.length("text") % 5 == 1, F.concat(F.lit("COMPLIANT. "), "text")).when(F.length("text") % 5 == 2, F.concat(F.lit("partial: "), "text")).when(F.length("text") % 5 == 3, F.concat(F.lit("Non compliant "), "text")).when(F.length("text") % 5 == 4, F.col("text"))
    place = F.concat(F.lit("talk "), "conv_id", F.lit("/"), F.floor(F.col("turn") / 3))
    talk = read(spark, sf_dir, "conversations").select(F.when(F.col("conv_id") % 2 == 0, "A").otherwise("B").alias("field"), place.alias("text"), F.concat(F.lit("m"), F.col("turn") % 3 + 1).alias("model"), say.alias("answer"))
    return own.unionAll(talk.groupBy("field", "text", "model").agg(F.min("answer").alias("answer")))


def cast_votes(spark, sf_dir) -> DataFrame:
    texts = stored(spark, sf_dir).select("field", "text").distinct()
    return O.cast_votes(texts, O.StoredVotes(stored(spark, sf_dir), ["m1", "m2", "m3"]))


@query(f"WITH {VOTES} SELECT field, text, model, vote FROM votes")
def vote_parse(spark, sf_dir):
    return cast_votes(spark, sf_dir)


@query(f"WITH {VOTES}, {ENSEMBLE} SELECT field, text, n_votes, round(vote_mean, 6) AS vote_mean, confidence FROM ens")
def ensemble_confidence(spark, sf_dir):
    return O.ensemble(cast_votes(spark, sf_dir)).withColumn("vote_mean", F.round("vote_mean", 6))


@query(f"WITH {VOTES}, {ENSEMBLE} SELECT field, text, round(coalesce(vote_mean, 0.25), 6) AS chunk_score, vote_mean IS NOT NULL AS is_vote FROM (SELECT DISTINCT field, text FROM votes) LEFT JOIN ens USING (field, text)")
def chunk_score_fallback(spark, sf_dir):
    texts = stored(spark, sf_dir).select("field", "text").distinct().withColumn("rule_score", F.lit(0.25))
    both = texts.join(O.ensemble(cast_votes(spark, sf_dir)), ["field", "text"], "left")
    return both.select("field", "text", F.round(F.coalesce("vote_mean", "rule_score"), 6).alias("chunk_score"), F.col("vote_mean").isNotNull().alias("is_vote"))


@query(f"WITH {VOTES}, {ENSEMBLE} SELECT field, round_even(avg(CAST(vote_mean IS NOT NULL AS DOUBLE)), 2) AS llm_coverage, round_even(avg(confidence), 2) AS confidence, coalesce(round_even(avg(confidence), 2) < 0.5, FALSE) AS needs_review FROM (SELECT DISTINCT field, text FROM votes) LEFT JOIN ens USING (field, text) GROUP BY ALL")
def llm_coverage(spark, sf_dir):
    texts = stored(spark, sf_dir).select("field", "text").distinct()
    both = texts.join(O.ensemble(cast_votes(spark, sf_dir)), ["field", "text"], "left")
    evidence = both.select(F.lit("all").alias("corpus_id"), "field", F.lit(1).alias("final_rank"), "text", F.coalesce("vote_mean", F.lit(0.0)).alias("chunk_score"), F.col("vote_mean").isNotNull().alias("is_vote"), "confidence", F.lit(False).alias("suspicious"))
    fields = spark.createDataFrame([("A", "A", 0), ("B", "B", 1)], "field string, control string, ordinal int")
    return U.field_scores(evidence, fields, evidence).select("field", "llm_coverage", "confidence", "needs_review")


KEYS = "sha256('m' || CAST(doc_id % 3 AS VARCHAR) || ':f:' || coalesce(text, ''))"


def keyed(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"), F.lit("f").alias("field"), "text")


@query(f"SELECT doc_id, {KEYS} AS key FROM documents WHERE text IS NOT NULL")
def cache_key(spark, sf_dir):
    return keyed(spark, sf_dir).select("doc_id", S.cache_key(F.col("model"), F.col("field"), F.col("text")).alias("key"))


CACHE = f"cache AS (SELECT DISTINCT {KEYS} AS key, CAST(0.5 AS DOUBLE) AS vote FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND text IS NOT NULL)"


def small_cache(spark, sf_dir) -> DataFrame:
    good = keyed(spark, sf_dir).join(read(spark, sf_dir, "labels").filter("quality = 1"), "doc_id")
    return good.select(S.cache_key(F.col("model"), F.col("field"), F.col("text")).alias("key"), F.lit(0.5).alias("vote")).distinct()


@query(f"WITH {CACHE} SELECT doc_id FROM documents WHERE text IS NOT NULL AND {KEYS} NOT IN (SELECT key FROM cache)")
def vote_cache_misses(spark, sf_dir):
    return O.cached(keyed(spark, sf_dir), small_cache(spark, sf_dir))[1].select("doc_id")


@query(f"WITH {CACHE} SELECT doc_id, vote FROM (SELECT doc_id, {KEYS} AS key FROM documents WHERE text IS NOT NULL) JOIN cache USING (key)")
def vote_cache_hits(spark, sf_dir):
    return O.cached(keyed(spark, sf_dir), small_cache(spark, sf_dir))[0].select("doc_id", "vote")


@query(
    f"""WITH {CACHE}, new AS (SELECT {KEYS} AS key, CAST(doc_id % 2 AS DOUBLE) AS vote, doc_id AS seq FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0)
  SELECT key, vote FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM (SELECT key, vote, -1 AS seq FROM cache UNION ALL SELECT * FROM new)) WHERE n = 1"""
)
def vote_cache_upsert(spark, sf_dir):
    """Every fifth call is one that failed, with no vote."""
    vote = F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 2).cast("double"))
    new = keyed(spark, sf_dir).select(S.cache_key(F.col("model"), F.col("field"), F.col("text")).alias("key"), vote.alias("vote"), F.col("doc_id").alias("seq"))
    return O.upserted(small_cache(spark, sf_dir), new)


@query(_sql["vote_cache_upsert"])
def vote_store_upsert(spark, sf_dir):
    """The same in a stored cache, by three writes and a merge."""
    store = VoteStore(spark, folder(spark, "votes"))
    store.upsert(small_cache(spark, sf_dir).withColumn("seq", F.lit(0)))
    vote = F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 2).cast("double"))
    new = keyed(spark, sf_dir).select("doc_id", S.cache_key(F.col("model"), F.col("field"), F.col("text")).alias("key"), vote.alias("vote"), F.col("doc_id").alias("seq"))
    half = (read(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0) // 2
    store.upsert(new.filter(F.col("doc_id") <= half))
    store.compact(2)
    store.upsert(new.filter(F.col("doc_id") > half))
    return store.table()


@query(f"WITH {CACHE} SELECT doc_id, vote FROM (SELECT doc_id, {KEYS} AS key FROM documents WHERE text IS NOT NULL) JOIN cache USING (key)")
def vote_store_lookup(spark, sf_dir):
    store = VoteStore(spark, folder(spark, "votes"))
    store.upsert(small_cache(spark, sf_dir).withColumn("seq", F.lit(0)))
    asked = keyed(spark, sf_dir).withColumn("key", S.cache_key(F.col("model"), F.col("field"), F.col("text")))
    return store.lookup(asked).select("doc_id", "vote")


def judge(model: str, prompt: str) -> tuple[str, dict]:
    """Stands in for a remote model: it looks for a word in the excerpt, and one model fails."""
    said = prompt.split("<excerpt>\n")[1].split("\n</excerpt>")[0]
    if model == "m3" and len(said) % 3 == 0:
        raise TimeoutError("no answer")
    return ("COMPLIANT" if " the " in said else "PARTIAL" if model == "m2" else "NON_COMPLIANT"), {"chars": len(said)}


EXCERPTS = "excerpts AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS field, regexp_replace(text[1:150], '[^a-z ]', '', 'g') AS text FROM documents WHERE text IS NOT NULL)"
JUDGED = f"""{EXCERPTS}, votes AS (SELECT field, text, model, CASE WHEN model = 'm3' AND length(text) % 3 = 0 THEN NULL WHEN contains(text, ' the ') THEN 1.0 WHEN model = 'm2' THEN 0.5 ELSE 0.0 END AS vote
  FROM excerpts, (VALUES ('m1'), ('m2'), ('m3')) t(model))"""


def excerpts(spark, sf_dir) -> DataFrame:
    text = F.regexp_replace(F.substring("text", 1, 150), "[^a-z ]", "")
    return read(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("field"), text.alias("text")).distinct()


def ledger(spark) -> Ledger:
    return Ledger(spark, folder(spark, "ledger"), Calling(tries=2, base=0.0))


@query(f"WITH {JUDGED} SELECT field, text, count(vote) AS n_votes, round(avg(vote), 6) AS vote_mean, CASE WHEN count(vote) >= 2 THEN round_even(1 - (max(vote) - min(vote)), 2) END AS confidence FROM votes GROUP BY ALL")
def called_votes(spark, sf_dir):
    """Votes of called models, each asked once by way of the ledger."""
    votes = O.cast_votes(excerpts(spark, sf_dir), LedgerVotes(ledger(spark), ["m1", "m2", "m3"], judge))
    return O.ensemble(votes).withColumn("vote_mean", F.round("vote_mean", 6))


@query(f"WITH {JUDGED} SELECT model, CASE WHEN vote IS NULL THEN 'errors' ELSE 'calls' END AS stream, count(*) * CASE WHEN vote IS NULL THEN 2 ELSE 1 END AS n, count(DISTINCT sha256(model || ':' || field || ':' || text)) AS asked FROM votes GROUP BY model, vote IS NULL")
def call_ledger_log(spark, sf_dir):
    """A row for each try, in the streams of the call log."""
    own = ledger(spark)
    O.cast_votes(excerpts(spark, sf_dir), LedgerVotes(own, ["m1", "m2", "m3"], judge)).count()
    return sinks.call_log(own.log()).groupBy("model", "stream").agg(F.count("*").alias("n"), F.countDistinct("key").alias("asked"))


# scores


def scored(spark, sf_dir):
    return score_corpora(corpus(spark, sf_dir), X.DRIVER)


@query(f"WITH {ROLLUP} SELECT corpus_id, control, field, score, best_chunk <> '' AS has_evidence FROM by_field")
def field_scores(spark, sf_dir):
    return scored(spark, sf_dir).fields.select("corpus_id", "control", "field", "score", (F.col("best_chunk") != "").alias("has_evidence"))


@query(f"WITH {ROLLUP} SELECT corpus_id, control, score, has_evidence FROM by_control")
def control_scores(spark, sf_dir):
    return scored(spark, sf_dir).controls.select("corpus_id", "control", "score", "has_evidence")


@query(f"WITH {ROLLUP} {COMPANY}")
def company_scores(spark, sf_dir):
    return scored(spark, sf_dir).companies


@query(f"WITH {ROLLUP} SELECT corpus_id, control, {BUCKET.format('score')} AS maturity, CASE WHEN score >= 65 THEN 'COMPLIANT' WHEN score >= 35 THEN 'PARTIAL' ELSE 'NON_COMPLIANT' END AS label FROM by_control")
def maturity(spark, sf_dir):
    return scored(spark, sf_dir).controls.select("corpus_id", "control", "maturity", U.label(F.col("score")).alias("label"))


PER_DOC = ROLLUP.replace("source AS corpus_id, doc_id", "source || '/' || CAST(doc_id AS VARCHAR) AS corpus_id, doc_id", 1).replace("SELECT DISTINCT source AS corpus_id FROM documents", "SELECT DISTINCT source || '/' || CAST(doc_id AS VARCHAR) AS corpus_id FROM documents")


@query(f"WITH {PER_DOC} {COMPANY}")
def per_doc_breakdown(spark, sf_dir):
    return per_document(corpus(spark, sf_dir), X.DRIVER).companies


@query(f"WITH {PER_DOC} SELECT corpus_id, control, score, has_evidence FROM by_control")
def per_doc_controls(spark, sf_dir):
    return per_document(corpus(spark, sf_dir), X.DRIVER).controls.select("corpus_id", "control", "score", "has_evidence")


@query(f"WITH {ROLLUP} SELECT corpus_id, field, sha256(best_chunk) AS best_sha FROM by_field WHERE best_chunk <> ''")
def best_evidence(spark, sf_dir):
    return scored(spark, sf_dir).fields.filter("best_chunk != ''").select("corpus_id", "field", F.sha2("best_chunk", 256).alias("best_sha"))


BANDED = f"""banded AS (SELECT *, CASE WHEN score < 50 THEN 'weak' WHEN score < 65 THEN 'medium' ELSE 'strong' END AS band FROM by_field),
placed AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, control, band ORDER BY ordinal) AS place FROM banded),
shown AS (SELECT *, trim(best_chunk[1:200], {chars(T.SPACES)}) AS snippet FROM placed WHERE place <= CASE band WHEN 'weak' THEN 3 ELSE 2 END)"""


@query(f"WITH {ROLLUP}, {BANDED} SELECT corpus_id, control, field, band, CAST(place AS INT) AS place, snippet FROM shown")
def evidence_bands(spark, sf_dir):
    return V.picked(scored(spark, sf_dir).fields).select("corpus_id", "control", "field", "band", "place", "snippet")


@query(f"WITH {ROLLUP}, {BANDED} SELECT corpus_id, control, sha256(string_agg(chr(10) || CASE band WHEN 'weak' THEN 'Weak area' WHEN 'medium' THEN 'Partial area' ELSE 'Strong area' END || ' — ' || field || ':' || chr(10) || snippet || chr(10), '' ORDER BY CASE band WHEN 'weak' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, place)) AS evidence_sha FROM shown GROUP BY ALL")
def evidence_text(spark, sf_dir):
    return V.evidence_text(V.picked(scored(spark, sf_dir).fields)).select("corpus_id", "control", F.sha2("evidence", 256).alias("evidence_sha"))


WEAK = f"""weak AS (SELECT corpus_id, control, count(*) FILTER (band = 'weak') AS n, list('Close the gap in ' || field ORDER BY place) FILTER (band = 'weak') AS todo FROM shown GROUP BY ALL),
said AS (SELECT corpus_id, control, 'Control ' || control || ' scores ' || format('{{:.1f}}', score) || ' of 100, which is ' || {BUCKET.format("score")} || '. ' || n || ' of its fields lack evidence.' AS finding, coalesce(todo, []) AS remediation FROM by_control JOIN weak USING (corpus_id, control))"""


@query(f"WITH {ROLLUP}, {BANDED}, {WEAK} SELECT corpus_id, control, finding, array_to_string(remediation, chr(10)) AS remediation FROM said")
def findings(spark, sf_dir):
    s = scored(spark, sf_dir)
    return V.findings(s.controls, s.fields).select("corpus_id", "control", "finding", F.array_join("remediation", "\n").alias("remediation"))


def sql_string(text: str) -> str:
    """A JSON string with escapes for all that is not ASCII."""
    code = "unicode(c)"
    high = f"printf('\\u%04x\\u%04x', 55296 + ({code} - 65536) // 1024, 56320 + ({code} - 65536) % 1024)"
    return f"list_reduce(list_prepend('', list_transform(string_split(CAST(to_json({text}) AS VARCHAR), ''), lambda c: CASE WHEN {code} < 128 THEN c WHEN {code} < 65536 THEN printf('\\u%04x', {code}) ELSE {high} END)), lambda a, b: a || b)"


def sql_object(entries: dict[str, str]) -> str:
    """JSON of SQL expressions that are JSON; a null one is left out. Keys in their order."""
    parts = ", ".join(f"'\"{k}\":' || {v}" for k, v in entries.items())
    return f"'{{{{' || concat_ws(',', {parts}) || '}}}}'".replace("{{", "{").replace("}}", "}")


def sql_nested(string, order) -> str:
    """fields_json, controls_json and whole: a company's JSON. string: how text becomes JSON;
    order: of the keys."""
    f = {"score": "CAST(score AS VARCHAR)", "best_chunk": string("best_chunk"), "llm_coverage": "CAST(llm_coverage AS VARCHAR)", "needs_review": "CAST(suspicious AS VARCHAR)", "injection_suspected": "CAST(suspicious AS VARCHAR)"}
    c = {"score": "CAST(score AS VARCHAR)", "maturity": f"'\"' || {BUCKET.format('score')} || '\"'", "has_evidence": "CAST(has_evidence AS VARCHAR)", "needs_review": "CAST(suspicious AS VARCHAR)", "injection_suspected": "CAST(suspicious AS VARCHAR)", "fields": "fields"}
    return f"""fields_json AS (SELECT corpus_id, control, '{{' || string_agg('"' || field || '":' || {sql_object(order(f))}, ',' ORDER BY field) || '}}' AS fields FROM by_field GROUP BY ALL),
whole AS (SELECT corpus_id, '{{' || string_agg('"' || control || '":' || {sql_object(order(c))}, ',' ORDER BY control) || '}}' AS controls FROM by_control JOIN fields_json USING (corpus_id, control) GROUP BY ALL)"""


@query(f"WITH {ROLLUP}, {sql_nested(lambda t: f'CAST(to_json({t}) AS VARCHAR)', lambda x: x)} SELECT corpus_id, company_score, controls FROM whole JOIN ({COMPANY}) USING (corpus_id)")
def nested_result(spark, sf_dir):
    s = scored(spark, sf_dir)
    return U.nested(s.companies, s.controls, s.fields).select("corpus_id", "company_score", F.to_json("controls").alias("controls"))


@query(f"WITH {ROLLUP} SELECT corpus_id, control, CAST(NULL AS DOUBLE) AS confidence, suspicious AS needs_review, suspicious AS injection_suspected FROM by_control")
def control_flags(spark, sf_dir):
    return scored(spark, sf_dir).controls.select("corpus_id", "control", "confidence", "needs_review", "injection_suspected")


REVIEWED = f"""j AS (SELECT *, {SUSPICIOUS} AS suspicious FROM (SELECT field, control, text, CAST(chunk_score AS DOUBLE) AS chunk_score, CAST(confidence AS DOUBLE) AS confidence FROM {values(X.JUDGED, 'field, control, text, chunk_score, confidence')} UNION ALL
  SELECT 'f' || (doc_id % 7), 'c' || (doc_id % 7 // 3), text, (length(text) % 5) / 4.0, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 5) / 4.0 END FROM documents WHERE text IS NOT NULL))"""


@query(
    f"""WITH {REVIEWED}, f AS (SELECT control, field, round_even(avg(chunk_score) * 100, 2) AS score, round_even(avg(confidence), 2) AS confidence, bool_or(suspicious) AS suspicious FROM j GROUP BY ALL)
  SELECT control, round_even(avg(score), 2) AS score, TRUE AS has_evidence, round_even(avg(confidence), 2) AS confidence, bool_or(suspicious OR coalesce(confidence < 0.5, FALSE)) AS needs_review, bool_or(suspicious) AS injection_suspected FROM f GROUP BY ALL"""
)
def control_review(spark, sf_dir):
    """Confidence, review and injection of controls, from judged windows of our own and from
    documents with figures in place of votes."""
    own = spark.createDataFrame(X.JUDGED, "field string, control string, text string, chunk_score double, confidence double")
    d = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.concat(F.lit("f"), d % 7), F.concat(F.lit("c"), F.floor(d % 7 / 3)), "text", (F.length("text") % 5) / 4, F.when(d % 3 > 0, (d % 5) / 4))
    rows = own.unionAll(docs)
    evidence = rows.withColumn("corpus_id", F.lit("c")).withColumn("final_rank", F.lit(1)).withColumn("is_vote", F.col("confidence").isNotNull()).withColumn("suspicious", S.suspicious(F.col("text")))
    fields = rows.select("field", "control").distinct().withColumn("ordinal", F.lit(0))
    return U.control_scores(U.field_scores(evidence, fields, evidence)).select("control", "score", "has_evidence", "confidence", "needs_review", "injection_suspected")


@query(f"WITH {ROLLUP} SELECT corpus_id, control, CASE WHEN has_evidence THEN format('{{:.1f}}', score) ELSE '—' END AS score, CASE WHEN has_evidence THEN {BUCKET.format('score')} ELSE '—' END AS maturity, suspicious AS needs_review FROM by_control")
def report_view(spark, sf_dir):
    return sinks.report_view(scored(spark, sf_dir).controls)


@query(
    f"""SELECT CAST(id AS INT) AS id, trim(CASE WHEN regexp_matches(answer, '(?is)FINDING:\\s*.+') THEN regexp_extract(regexp_replace(answer, '(?is)REMEDIATION:.*$', ''), '(?is)FINDING:\\s*(.+)', 1) ELSE answer END, chr(32) || chr(9) || chr(10) || chr(13)) AS finding,
  array_to_string(list_filter(list_transform(string_split(regexp_extract(answer, '(?is)REMEDIATION:\\s*(.+)', 1), chr(10)), lambda x: trim(regexp_replace(trim(x), '^[-•*]+', ''))), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^\\(?(none|no remediation|not needed)')), '|') AS remediation
  FROM (SELECT id, answer FROM {values(X.ANSWERS, 'id, answer')} UNION ALL SELECT 100 + conv_id * 1000 + turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN 'FINDING: ' || text || chr(10) || 'REMEDIATION:' || chr(10) || '- ' || replace(text, '. ', '.' || chr(10) || '- ') ELSE 'REMEDIATION: ' || text END FROM conversations WHERE text IS NOT NULL)"""
)
def finding_parse(spark, sf_dir):
    """Answers of our own, and the turns of conversations with headings put before them."""
    talk, t = read(spark, sf_dir, "conversations").filter("text IS NOT NULL"), F.col("text")
    both = F.concat(F.lit("FINDING: "), t, F.lit("\nREMEDIATION:\n- "), F.replace(t, F.lit(". "), F.lit(".\n- ")))
    said = F.when(F.col("turn") % 3 == 0, t).when(F.col("turn") % 3 == 1, both).otherwise(F.concat(F.lit("REMEDIATION: "), t))
    own = spark.createDataFrame(X.ANSWERS, "id int, answer string").unionAll(talk.select((100 + F.col("conv_id") * 1000 + F.col("turn")).cast("int"), said))
    a = own.withColumn("f", V.parsed_finding(F.col("answer")))
    return a.select("id", "f.finding", F.array_join("f.remediation", "|").alias("remediation"))


# security

TEXTS = f"(SELECT CAST(id AS BIGINT) AS id, text FROM {values(X.UNTRUSTED, 'id, text')} UNION ALL SELECT 1000 + conv_id * 1000 + turn, text FROM conversations WHERE text IS NOT NULL)"


def untrusted(spark, sf_dir) -> DataFrame:
    own = spark.createDataFrame(X.UNTRUSTED, "id long, text string")
    talk = read(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    return own.unionAll(talk.select(F.col("conv_id") * 1000 + F.col("turn") + 1000, "text"))


HITS = ", ".join(f"regexp_extract(text, {lit('(?i)(' + p + ')')}, 1)" for p in INJECTION)


@query(f"SELECT id, array_to_string(hits, '|') AS hits, len(hits) > 0 AS suspicious FROM (SELECT id, list_filter([{HITS}], lambda x: x <> '') AS hits FROM {TEXTS})")
def injection_scan(spark, sf_dir):
    t = F.col("text")
    return untrusted(spark, sf_dir).select("id", F.array_join(S.injections(t), "|").alias("hits"), S.suspicious(t).alias("suspicious"))


def sql_redacted(source: str, key: str) -> str:
    """A step for each pattern: what is left after the ones before, and its count."""
    steps, last, names = [f"r0 AS (SELECT {key}, text FROM {source})"], "r0", []
    for k, (name, pattern, exact) in enumerate(REDACTIONS, 1):
        p = lit(pattern if exact else "(?i)" + pattern)
        steps.append(f"r{k} AS (SELECT * REPLACE (regexp_replace(text, {p}, '[REDACTED_{name.upper()}]', 'g') AS text), len(regexp_extract_all(text, {p})) AS {name} FROM {last})")
        last = f"r{k}"
        names.append(f"CAST({name} AS INT) AS {name}")
    return f"WITH {', '.join(steps)} SELECT {key}, sha256(text) AS text_sha, {', '.join(names)} FROM {last}"


def redaction_of(texts: DataFrame, key: str) -> DataFrame:
    out = texts.withColumn("r", S.redacted(F.col("text")))
    counts = [F.coalesce(F.col("r.counts")[name], F.lit(0)).alias(name) for name, _, _ in REDACTIONS]
    return out.select(key, F.sha2("r.text", 256).alias("text_sha"), *counts)


@query(sql_redacted(TEXTS, "id"))
def redact_text(spark, sf_dir):
    return redaction_of(untrusted(spark, sf_dir), "id")


@query(sql_redacted("(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)", "doc_id"))
def redact_documents(spark, sf_dir):
    return redaction_of(D.spread(read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text")), "doc_id")


def sql_hmac(message: str) -> str:
    key = KEY.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


PAYLOAD = f"""'{{"_generated_at":"{AT}","doc_id":' || doc_id || ',"lang":"' || lang || '"}}'"""


@query(f"SELECT doc_id, {sql_hmac(PAYLOAD)} AS hmac, '{S.ALGORITHM}' AS algorithm, TRUE AS valid, FALSE AS tampered_valid FROM documents")
def sign_verify(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    entries = {"doc_id": F.col("doc_id").cast("string"), "lang": S.quoted(F.col("lang"))}
    out = d.withColumn("i", S.signed(KEY, entries, F.lit(AT)))
    changed = entries | {"doc_id": (F.col("doc_id") + 1).cast("string")}
    return out.select("doc_id", "i.hmac", "i.algorithm", S.verified(KEY, entries, F.col("i")).alias("valid"), S.verified(KEY, changed, F.col("i")).alias("tampered_valid"))


def by_key(entries: dict[str, str]) -> dict[str, str]:
    return dict(sorted(entries.items()))


CANONICAL = f"""{sql_nested(sql_string, by_key)},
found_json AS (SELECT corpus_id, '{{' || string_agg('"' || control || '":{{"finding":' || {sql_string("finding")} || ',"remediation":' || replace(CAST(to_json(remediation) AS VARCHAR), '", "', '","') || '}}', ',' ORDER BY control) || '}}' AS findings FROM said GROUP BY ALL),
payload AS (SELECT corpus_id, '"findings":' || findings || ',"scores":{{"company_score":' || CAST(company_score AS VARCHAR) || ',"controls":' || controls || '}}}}' AS body FROM whole JOIN found_json USING (corpus_id) JOIN ({COMPANY}) USING (corpus_id))"""
SIGNED = f"""'{{"_generated_at":"{AT}",' || body"""


@query(f"WITH {ROLLUP}, {BANDED}, {WEAK}, {CANONICAL} SELECT corpus_id, sha256('{{' || body) AS report_sha, {sql_hmac(SIGNED)} AS hmac, TRUE AS valid, FALSE AS changed_valid FROM payload")
def signed_report(spark, sf_dir):
    """A signed report per corpus, verified as it stands and with one byte changed."""
    s = scored(spark, sf_dir)
    made = P.reports(s, KEY, AT)
    changed = made.withColumn("report", F.regexp_replace("report", '"company_score":', '"company_score":1'))
    a = P.verify(made, KEY).select("corpus_id", F.sha2("report", 256).alias("report_sha"), "hmac", "valid")
    return a.join(P.verify(changed, KEY).select("corpus_id", F.col("valid").alias("changed_valid")), "corpus_id")


DOCUMENTED = f"""{PER_DOC}, doc_company AS ({COMPANY}), doc_controls AS (SELECT corpus_id, '{{' || string_agg('"' || control || '":' || CAST(score AS VARCHAR), ',' ORDER BY control) || '}}' AS controls FROM by_control GROUP BY ALL),
per_doc AS (SELECT d.source AS corpus_id, '{{' || string_agg('"' || d.doc_id || '":{{"company_score":' || CAST(company_score AS VARCHAR) || ',"controls":' || controls || '}}', ',' ORDER BY CAST(d.doc_id AS VARCHAR)) || '}}' AS per_document
  FROM documents d JOIN doc_company c ON c.corpus_id = d.source || '/' || d.doc_id JOIN doc_controls k ON k.corpus_id = c.corpus_id GROUP BY ALL)"""


@query(f"WITH per AS (WITH {DOCUMENTED} SELECT * FROM per_doc), body AS (WITH {ROLLUP}, {BANDED}, {WEAK}, {CANONICAL} SELECT * FROM payload), answer AS (SELECT corpus_id, replace(body, ',\"scores\":{{\"company_score\"', ',\"per_document\":' || per_document || ',\"scores\":{{\"company_score\"') AS body FROM body JOIN per USING (corpus_id)) SELECT corpus_id, sha256('{{' || body) AS answer_sha, {sql_hmac(SIGNED)} AS hmac FROM answer")
def request_answer(spark, sf_dir):
    """All that a request is answered with, as one signed document for each corpus."""
    return A.answers(corpus(spark, sf_dir), KEY, AT, X.DRIVER).select("corpus_id", F.sha2("answer", 256).alias("answer_sha"), "hmac")


@query(f"""SELECT 'read' AS stage, unnest(['rows', 'null_text', 'short', 'suspicious']) AS counter, unnest([count(*), count(*) FILTER (text IS NULL), count(*) FILTER (len({TOKENS.replace('text', "coalesce(text, '')")}) < 50), count(*) FILTER (coalesce({SUSPICIOUS}, FALSE))]) AS n FROM documents
  UNION ALL SELECT 'windows', unnest(['rows', 'whole']), unnest([count(*), count(*) FILTER (token_end - token_start = 512)]) FROM (WITH {CHUNKS} SELECT * FROM chunks)
  UNION ALL SELECT 'cache', unnest(['rows', 'hits']), unnest([count(*), count(hit)]) FROM (WITH {CACHE} SELECT c.key AS hit FROM (SELECT {KEYS} AS key FROM documents WHERE text IS NOT NULL) d LEFT JOIN cache c USING (key))""")
def flow_counters(spark, sf_dir):
    """Rejects, windows and cache hits counted while the windows are cut and the cache is asked."""
    flow, t = G.Flow(), F.col("text")
    short = F.coalesce(F.size(T.tokens(t)), F.lit(0)) < 50
    docs = flow.watch(corpus(spark, sf_dir), "read", null_text=t.isNull(), short=F.when(t.isNull(), True).otherwise(short), suspicious=F.coalesce(S.suspicious(t), F.lit(False)))
    flow.watch(I.chunk(docs), "windows", whole=F.col("token_end") - F.col("token_start") == 512).write.format("noop").mode("overwrite").save()
    asked = keyed(spark, sf_dir).select(S.cache_key(F.col("model"), F.col("field"), F.col("text")).alias("key"))
    flow.watch(asked.join(small_cache(spark, sf_dir), "key", "left"), "cache", hits=F.col("vote").isNotNull()).write.format("noop").mode("overwrite").save()
    return flow.table(spark)


# sources


SQL_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]"


def sql_lines(most: int) -> str:
    return f"""WITH l AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '({SQL_END})\\z', ''), '{SQL_END}') AS ls FROM documents WHERE text IS NOT NULL),
  s AS (SELECT doc_id, ls, list_transform(ls, lambda x: trim(x, {chars(T.SPACES)})) AS bare FROM l),
  k AS (SELECT doc_id, ls, bare, list_filter(range(1, len(ls) + 1), lambda i: len(list_filter(bare, lambda b: b = bare[i])) <= {most}) AS keep FROM s)
  SELECT doc_id, sha256(array_to_string(list_transform(keep, lambda i: ls[i]), chr(10))) AS text_sha FROM k"""


def without_repeats(spark, sf_dir, most):
    docs = D.spread(read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text"))
    return D.drop_repeated_lines(docs, ["doc_id"], most).select("doc_id", F.sha2("text", 256).alias("text_sha"))


@query(sql_lines(5))
def repeated_lines(spark, sf_dir):
    return without_repeats(spark, sf_dir, 5)


@query(sql_lines(1))
def repeated_lines_once(spark, sf_dir):
    return without_repeats(spark, sf_dir, 1)


@query(f"SELECT doc_id, len({TOKENS}) >= 50 AS enough FROM documents WHERE text IS NOT NULL")
def min_words_gate(spark, sf_dir):
    good, bad = D.enough_words(read(spark, sf_dir, "documents").filter("text IS NOT NULL"))
    return good.select("doc_id", F.lit(True).alias("enough")).unionAll(bad.select("doc_id", F.lit(False)))


def sql_plain(col: str) -> str:
    col = f"regexp_replace({col}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in (*T.HIDDEN, *T.ASIDE):
        col = f"regexp_replace({col}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}\\s*>', ' ', 'g')"
    col = f"regexp_replace({col}, '(?s)<[^>]*>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        col = f"replace({col}, {lit(a)}, {lit(b)})"
    return rf"trim(regexp_replace({col}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


PLAIN = f"(SELECT page_id, url, {sql_plain('html')} AS text FROM pages)"


@query(f"SELECT page_id, url, sha256(text) AS text_sha FROM {PLAIN} WHERE text <> ''")
def html_text(spark, sf_dir):
    return D.from_pages(read(spark, sf_dir, "pages")).select("page_id", "url", F.sha2("text", 256).alias("text_sha"))


def sql_main() -> str:
    """blocks (page_id, url, i, text, words, linked, heading, row, aside, content) of pages."""
    cut = "coalesce(html, '')"
    for pattern, mark in M.steps("(?:[^>\"']|\"[^\"]*\"|'[^']*')*"):
        cut = f"regexp_replace({cut}, {lit(pattern)}, {lit(mark)}, 'g')"
    names = "MAP {" + ", ".join(f"{lit(k)}: chr({v})" for k, v in sorted(name2codepoint.items())) + "}"
    name = "regexp_extract(p, '^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);', 1)"
    code = "CASE WHEN e[1:2] IN ('#x', '#X') THEN CAST('0x' || e[3:] AS INT) WHEN e[1] = '#' THEN CAST(e[2:] AS INT) END"
    char = f"CASE WHEN n >= 32 AND n <= 1114111 AND NOT n BETWEEN 55296 AND 57343 THEN chr(n) ELSE {names}[e] END"
    words = lambda x: f"len(list_filter(regexp_split_to_array({x}, '{M.WHITE}'), lambda w: w <> ''))"
    share = lambda w: f"coalesce(linked {w} / nullif(words {w}, 0), 0)" if w else "coalesce(linked / nullif(words, 0), 0)"
    return f"""cut AS (SELECT page_id, url, string_split({cut}, chr(7)) AS parts FROM pages),
lines AS (SELECT page_id, url, flatten(list_transform(parts, lambda p: list_transform(string_split(p, chr(10)), lambda x: {{'aside': starts_with(p, chr(5)), 'line': x}}))) AS lines FROM cut),
line AS (SELECT page_id, url, unnest(lines, recursive := true), unnest(range(len(lines))) AS k FROM lines),
bare AS (SELECT *, CASE WHEN contains(line, chr(3)) THEN array_to_string(list_filter(list_transform(string_split(line, chr(3)), lambda c: trim(regexp_replace(c, '[{M.MARKS}]', '', 'g'))), lambda c: c <> ''), ' | ') ELSE regexp_replace(line, '[{M.MARKS}]', '', 'g') END AS bare
  FROM line WHERE regexp_matches(line, '[^{M.MARKS} \\t\\x0B\\f\\r]')),
part AS (SELECT page_id, k, unnest(string_split(bare, '&')) AS p, unnest(range(len(string_split(bare, '&')))) AS j FROM bare),
named AS (SELECT *, CASE WHEN j > 0 THEN {name} ELSE '' END AS e FROM part),
coded AS (SELECT *, {code} AS n FROM named),
read AS (SELECT page_id, k, string_agg(CASE WHEN j = 0 THEN p WHEN e = '' THEN '&' || p ELSE coalesce({char}, '&' || e || ';') || p[len(e) + 2 :] END, '' ORDER BY j) AS text FROM coded GROUP BY ALL),
told AS (SELECT page_id, url, k, trim(regexp_replace(text, '{M.WHITE}', ' ', 'g')) AS text, {words(f"regexp_replace(line, '[{M.MARKS}]', ' ', 'g')")} AS words, {words("array_to_string(regexp_extract_all(line, chr(1) || '([^' || chr(1) || chr(2) || ']*)', 1), ' ')")} AS linked,
  starts_with(line, chr(4)) AS heading, contains(line, chr(3)) AS row, aside FROM bare JOIN read USING (page_id, k)),
near AS (SELECT *, {share("")} AS share, coalesce(lag({share("")}) OVER w, 0) AS share_before, coalesce(lag(words) OVER w, 0) AS words_before, coalesce(lead(words) OVER w, 0) AS words_after FROM told WHERE text <> '' WINDOW w AS (PARTITION BY page_id ORDER BY k)),
flagged AS (SELECT *, NOT aside AND share <= 1 / 3 AND (row OR CASE WHEN share_before <= 5 / 9 THEN words > 16 OR words_after > 15 OR words_before > 4 ELSE words > 40 OR words_after > 17 END) AS flag FROM near),
blocks AS (SELECT *, flag OR (heading AND NOT aside AND coalesce(lead(flag) OVER (PARTITION BY page_id ORDER BY k), FALSE)) AS content FROM flagged)"""


MAIN_SQL = sql_main()


@query(f"WITH {MAIN_SQL}, main AS (SELECT page_id, string_agg(text, chr(10) ORDER BY k) AS text FROM blocks WHERE content GROUP BY ALL) SELECT page_id, url, sha256(text) AS text_sha, CASE WHEN text IS NULL THEN 'no content found' END AS error FROM pages LEFT JOIN main USING (page_id)")
def page_main_text(spark, sf_dir):
    return M.main_text(read(spark, sf_dir, "pages")).select("page_id", "url", F.sha2("text", 256).alias("text_sha"), "error")


@query(f"WITH {MAIN_SQL} SELECT page_id, count(*) AS n, CAST(sum(words) AS BIGINT) AS words, CAST(sum(linked) AS BIGINT) AS linked, count(*) FILTER (content) AS kept, count(*) FILTER (aside) AS asides, count(*) FILTER (row) AS n_rows, count(*) FILTER (heading) AS headings FROM blocks GROUP BY ALL")
def page_blocks(spark, sf_dir):
    each = M.blocks(read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.explode_outer("blocks").alias("b")).filter("b IS NOT NULL")
    n = lambda c: F.count_if(F.col(f"b.{c}"))
    return each.groupBy("page_id").agg(F.count("*").alias("n"), F.sum("b.words").alias("words"), F.sum("b.linked").alias("linked"), n("content").alias("kept"), n("aside").alias("asides"), n("row").alias("n_rows"), n("heading").alias("headings"))


@query(f"SELECT page_id, CASE WHEN text = '' THEN 'no text found' END AS error, length(nullif(text, '')) AS n FROM {PLAIN}")
def page_errors(spark, sf_dir):
    return D.read_pages(read(spark, sf_dir, "pages")).select("page_id", "error", F.length("text").cast("long").alias("n"))


@query(f"SELECT path, CASE WHEN regexp_matches(path, '^https?://') THEN 'url' WHEN regexp_matches(lower(path), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(path), '\\.docx$') THEN 'docx' WHEN regexp_matches(lower(path), '\\.(txt|text)$') THEN 'txt' END AS kind FROM (SELECT path FROM {values([(p,) for p in X.PATHS], 'path')} UNION ALL SELECT url FROM pages UNION ALL SELECT regexp_replace(url, '^https?://', '') || CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.Txt' WHEN 3 THEN '.text' ELSE '' END FROM pages)")
def source_routing(spark, sf_dir):
    """Paths of our own, the pages' addresses, and those as names of files."""
    pages = read(spark, sf_dir, "pages")
    end = F.element_at(F.array(*map(F.lit, (".PDF", ".docx", ".Txt", ".text", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    files = pages.select(F.concat(F.regexp_replace("url", "^https?://", ""), end).alias("path"))
    paths = spark.createDataFrame([(p,) for p in X.PATHS], "path string").unionAll(pages.select("url")).unionAll(files)
    return paths.select("path", T.routed(F.col("path")).alias("kind"))


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS log_date, CASE WHEN event_type = 'error' THEN 'errors' ELSE 'calls' END AS stream, count(*) AS n FROM events GROUP BY ALL")
def call_log(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    calls = e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    return sinks.call_log(calls).groupBy("log_date", "stream").agg(F.count("*").alias("n"))


# evaluation

LABELLED = """pairs AS (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'COMPLIANT' WHEN quality = 1 THEN 'PARTIAL' ELSE 'NON_COMPLIANT' END AS expected,
  CASE WHEN n_chars % 100 >= 65 THEN 'COMPLIANT' WHEN n_chars % 100 >= 35 THEN 'PARTIAL' ELSE 'NON_COMPLIANT' END AS predicted FROM labels JOIN documents USING (doc_id)),
l AS (SELECT unnest(['COMPLIANT', 'PARTIAL', 'NON_COMPLIANT']) AS x),
m AS (SELECT a.x AS expected, b.x AS predicted, (SELECT count(*) FROM pairs p WHERE p.expected = a.x AND p.predicted = b.x) AS n FROM l a, l b),
s AS (SELECT x AS label, (SELECT sum(n) FROM m WHERE expected = x AND predicted = x) AS tp, (SELECT sum(n) FROM m WHERE predicted = x) AS said, (SELECT sum(n) FROM m WHERE expected = x) AS support FROM l),
prf AS (SELECT label, coalesce(tp / nullif(said, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall, CAST(support AS BIGINT) AS support FROM s),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM prf)"""
NAMES = ["COMPLIANT", "PARTIAL", "NON_COMPLIANT"]


def pairs(spark, sf_dir) -> DataFrame:
    both = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    expected = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), NAMES[0]).when(F.col("quality") == 1, NAMES[1]).otherwise(NAMES[2])
    return both.select(expected.alias("expected"), U.label(F.col("n_chars") % 100).alias("predicted"))


@query(f"WITH {LABELLED} SELECT expected, predicted, CAST(n AS BIGINT) AS n FROM m")
def confusion_matrix(spark, sf_dir):
    return E.confusion(pairs(spark, sf_dir), NAMES)


@query(f"WITH {LABELLED} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def prf_metrics(spark, sf_dir):
    s = E.scores(E.confusion(pairs(spark, sf_dir), NAMES))
    return s.select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"WITH {LABELLED} SELECT (SELECT count(*) FROM pairs) AS n, (SELECT round(avg(CAST(expected = predicted AS DOUBLE)), 4) FROM pairs) AS accuracy, (SELECT round(avg(f1), 4) FROM f) AS macro_f1")
def accuracy_summary(spark, sf_dir):
    return E.summary(pairs(spark, sf_dir), NAMES)


@query("SELECT corpus_id, copy, count(*) AS n FROM (SELECT source AS corpus_id, unnest([0, 1, 2]) AS copy FROM documents) GROUP BY ALL")
def corpus_scaler(spark, sf_dir):
    return E.repeated(corpus(spark, sf_dir), 3).groupBy("corpus_id", "copy").agg(F.count("*").alias("n"))


# rate limit: events of a user are minutes to hours apart, so the window is six hours


def requests(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


LIMITED = """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_id) AS nth FROM events),
step AS (SELECT key, id, nth, TRUE AS accepted, [t] AS recent FROM e WHERE nth = 1
  UNION ALL SELECT key, id, nth, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, t) ELSE kept END FROM
    (SELECT e.key, e.id, e.nth, e.t, list_filter(s.recent, lambda x: e.t - x < 21600.0) AS kept FROM step s JOIN e ON e.key IS NOT DISTINCT FROM s.key AND e.nth = s.nth + 1))
SELECT key, id, accepted FROM step"""


@query(LIMITED)
def rate_limit(spark, sf_dir):
    return ratelimit.limit(requests(spark, sf_dir), 21600.0, 3).select("key", "id", "accepted")


@query("SELECT user_id AS key, event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS load FROM events")
def offered_load(spark, sf_dir):
    return ratelimit.offered(requests(spark, sf_dir), 21600.0).select("key", "id", "load")
