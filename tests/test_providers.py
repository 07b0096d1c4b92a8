"""Providers, embedders, rules of any form, pages and pdf files."""

import sys
import types

import pytest
from pyspark.sql import functions as F

from quernstone.catalog import Catalog, Field, Rule
from quernstone.functions import rules as R
from quernstone.functions import text as T
from quernstone.operators import embed as E
from quernstone.operators import evidence as V
from quernstone.operators import index as I
from quernstone.operators import retrieve as Q
from quernstone.operators import voting as O
from quernstone.plans.scoring import per_document, score_corpora
from quernstone.sources import documents as D
from quernstone.sources import sinks


def test_calls_are_tried_again_with_longer_waits():
    waits, left = [], [2]

    def call(x):
        if left[0]:
            left[0] -= 1
            raise OSError
        return x + "!"

    assert O.persistent(call, sleep=waits.append)("a") == "a!"
    assert len(waits) == 2 and 0.75 <= waits[0] < 1.25 and 1.5 <= waits[1] < 2.5
    left[0] = 99
    assert O.persistent(call, tries=4, base=0, sleep=waits.append)("a") is None and len(waits) == 5


def no_network():
    """A call that fails; made here, as workers cannot import this module."""
    return lambda *_: 1 / 0


def test_votes_fall_back_along_the_chain_then_on_rules(spark):
    failing = no_network()
    docs = spark.createDataFrame([("c", 0, "SOC security operations run 24x7"), ("d", 0, "SOC SOC in use, security operations planned")], "corpus_id string, doc_id long, text string")
    stored = spark.createDataFrame([("PC3_soc", "SOC security operations run 24x7", "m1", "PARTIAL")], "field string, text string, model string, answer string")
    chain = O.VoteChain(O.CalledVotes(["m1", "m2"], failing, tries=1), O.StoredVotes(stored, ["m1", "m2"]))
    got = {r.corpus_id: r for r in score_corpora(docs, provider=chain).fields.filter("field = 'PC3_soc'").collect()}
    assert (got["c"].score, got["c"].llm_coverage, got["c"].confidence) == (50.0, 1.0, None)
    assert (got["d"].score, got["d"].llm_coverage) == (50.0, 0.0)
    told = O.CalledVotes(["m"], lambda model, prompt: "COMPLIANT" if "SOC" in prompt else "NON_COMPLIANT", tries=1)
    assert score_corpora(docs, provider=told).fields.filter("corpus_id = 'c' AND field = 'PC3_soc'").first().score == 100.0


def test_findings_fall_back_along_the_chain(spark):
    docs = spark.createDataFrame([("c", 0, "SOC security operations run 24x7")], "corpus_id string, doc_id long, text string")
    s, failing = score_corpora(docs), no_network()
    local = V.CalledFindings(lambda prompt: "FINDING: from a model\nREMEDIATION:\n- act" if "control PC1" in prompt else failing(), tries=1)
    got = {r.control: r for r in V.findings(s.controls, s.fields, V.FindingChain(V.CalledFindings(failing, tries=1), local, V.TemplateFindings())).collect()}
    assert (got["PC1"].finding, list(got["PC1"].remediation)) == ("from a model", ["act"])
    assert got["PC3"].finding.startswith("Control PC3 scores") and len(got["PC2"].finding) >= 50
    none = V.findings(s.controls, s.fields, V.CalledFindings(failing, tries=1)).collect()
    assert all(r.finding == "" and list(r.remediation) == [] for r in none) and len(none) == 3


def test_an_embedder_reranks_and_its_absence_does_not(spark):
    docs = spark.createDataFrame([("c", i, t) for i, t in enumerate(["alpha beta alpha", "alpha gamma", "alpha beta", "delta"])], "corpus_id string, doc_id long, text string")
    fields = Q.fields_frame(spark, (Field("f", "F", "alpha beta"),))
    chunks = I.chunk(docs)
    short = Q.shortlist(chunks, fields, least=0.0)
    sim = {r.doc_id: r.similarity for r in E.similarities(short, chunks, fields, E.HashingEmbedder()).collect()}
    assert sim[2] == 1.0 and sim[2] > sim[0] > sim[1]
    order = [r.doc_id for r in Q.rerank(short, E.similarities(short, chunks, fields, E.HashingEmbedder())).orderBy("final_rank").collect()]
    assert order == [2, 0, 1] or order[0] in (0, 2)

    class Missing:
        def load(self):
            raise ImportError

    plain = [r.doc_id for r in Q.rerank(short, None).orderBy("final_rank").collect()]
    assert [r.doc_id for r in Q.rerank(short, E.similarities(short, chunks, fields, Missing())).orderBy("final_rank").collect()] == plain
    catalog = Catalog((Field("f", "F", "alpha beta"),), (), {"F": 1.0})
    assert score_corpora(docs, catalog, embedder=E.HashingEmbedder(), least=0.0).evidence.count() == 3


def test_a_rule_of_any_form(spark):
    rule = Rule("long_words", "F", "own", (), build=lambda t: F.when(F.exists(T.tokens(t), lambda x: F.length(x) > 9), 1.0))
    docs = spark.createDataFrame([("c", 0, "alpha beta extraordinary alpha")], "corpus_id string, doc_id long, text string")
    assert docs.select(R.vote(rule, F.col("text"))).first()[0] == 1.0
    catalog = Catalog((Field("f", "F", "alpha beta"),), (rule,), {"F": 1.0})
    assert score_corpora(docs, catalog).companies.first().company_score == 100.0
    two = docs.unionAll(docs.withColumn("doc_id", F.lit(1).cast("long")).withColumn("text", F.lit("")))
    assert {r.corpus_id: r.company_score for r in per_document(two, catalog).companies.collect()} == {"c/0": 100.0, "c/1": 0.0}


def test_pages_without_text_have_an_error(spark):
    pages = spark.createDataFrame([(1, "u", "<nav>x</nav><table><tr><td>a &amp; b</td></tr></table><FOOTER>y</FOOTER>"), (2, "v", "<script>x</script>"), (3, "w", None)], "page_id long, url string, html string")
    assert [(r.text, r.error) for r in D.read_pages(pages).orderBy("page_id").collect()] == [("a & b", None), (None, "no text found"), (None, "no text found")]
    files = spark.createDataFrame([], "path string, kind string, text string, error string")
    assert D.ingest(files, D.read_pages(pages)).count() == 3
    with pytest.raises(ValueError):
        D.ingest(files, None)


def test_lines_and_white_space_of_unicode(spark):
    text = "a b\x85c\x0bd\r\ne\x1cf\n"
    got = spark.createDataFrame([(text,), ("  x ",), ("",)], "t string").select(T.lines(F.col("t")).alias("l"), T.stripped(F.col("t")).alias("s")).collect()
    assert got[0].l == text.splitlines() and got[1].s == "x" and got[2].l == [""]


def stub(pages, monkeypatch):
    class Pdf:
        def __init__(self, raw):
            self.pages = [types.SimpleNamespace(extract_text=lambda t=t: t) for t in pages]

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

    monkeypatch.setitem(sys.modules, "pdfplumber", types.SimpleNamespace(open=lambda f: Pdf(f.read())))


def test_pdf_text_layer_and_its_second_reading(monkeypatch):
    long = "w" * 70
    stub([long, None, long], monkeypatch)
    assert D.pdf_text(b"") == f"{long}\n{long}\n"
    assert D.pdf_text(b"", lambda data: "seen") == f"{long}\n{long}\n"
    stub(["few", None], monkeypatch)
    assert D.pdf_text(b"", lambda data: "seen") == "seen"
    assert D.pdf_text(b"", lambda data: None) == "few\n" and D.pdf_text(b"") == "few\n"
    assert D.pdf_text(b"", no_network()) == "few\n"


def test_a_report_written_is_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("c", 1.5)], "corpus_id string, company_score double")
    sinks.write_json(rows, str(tmp_path / "r"))
    assert D.read_report(spark, str(tmp_path / "r"), "corpus_id string, company_score double").collect() == rows.collect()


def test_windows_are_built_once(spark):
    """No window and no text is shuffled on the way to a ranking: the text is read by one pass,
    which counts, and all else reads the counts it wrote."""
    docs = spark.createDataFrame([("c", 0, "the of")], "corpus_id string, doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    counted = plan(I.term_counts(I.chunk(docs), ["of", "the"]))
    assert counted.count("split(text") == 1 and "Generate explode(tokens" not in counted
    ranked = plan(Q.bm25(I.chunk(docs), Q.fields_frame(spark, (Field("f", "F", "the of"),))))
    assert "split(text" not in ranked and "Generate explode(tokens" not in ranked
