from collections import Counter

import pyarrow.parquet as pq
import public_tokenizers
from test_decontaminate import brute as contaminated
from test_jaccard import brute as near
from test_linedup import brute as lines
from tokenizers import Tokenizer

import corpus_pipeline
from quernstone.llm import linedup, toxicity
from quernstone.llm.common import written

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF), name)
        seen[name] = (before, docs)
        assert name == "packing" or docs.columns == columns
    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    a, b = seen["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(a, labels, labels.toxic)
    bad = {r.doc_id for r in toxicity.toxicity(a, model).filter("toxic").collect()}
    assert sorted(rows(b)) == sorted(r for r in rows(a) if r[0] not in bad)
    known = {d for d, t in zip(*pq.read_table(f"{SF}/labels.parquet", columns=["doc_id", "toxic"]).to_pydict().values()) if not t}
    assert not bad & known

    a, b = seen["line_dedup"]
    want = {d: (n, k, h) for d, n, k, h in lines(rows(a), linedup.MIN_DOCS, long_docs=linedup.LONG_DOCS)}
    import hashlib

    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in rows(b)} == {d: h for d, (_, _, h) in want.items()}
    assert all(r.n_chars == len(r.text) for r in b.collect())

    a, b = seen["near_dedup"]
    assert sorted(rows(b), key=str) == near(rows(a))

    a, b = seen["decontamination"]
    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    dirty = {d for d, *_, x in contaminated(rows(a), list(zip(bench["item_id"], bench["text"]))) if x}
    assert sorted(rows(b)) == sorted(r for r in rows(a) if r[0] not in dirty)

    a, b = seen["packing"]
    t = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    n = {d: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for d, x in rows(a)}
    got = Counter()
    for r in b.collect():
        got[r.doc_id] += r.length
        assert r.doc_tokens == n[r.doc_id]
    assert got == Counter(n)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_an_empty_table_runs_through(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
