import math
import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.catalog import Field
from quernstone.functions import text as T
from quernstone.operators import index as I
from quernstone.operators import neighbours
from quernstone.operators import retrieve as Q


def docs(spark, texts, corpus="c"):
    return spark.createDataFrame([(corpus, i, t) for i, t in enumerate(texts)], "corpus_id string, doc_id long, text string")


def test_window_sizes(spark):
    sizes = {0: 0, 1: 1, 511: 1, 512: 1, 513: 2, 896: 2, 897: 3, 1500: 4}
    n = {r.doc_id: r["n"] for r in I.chunk(docs(spark, ["w " * k for k in sizes])).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert [n.get(i, 0) for i in range(len(sizes))] == list(sizes.values())


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=5), st.integers(4, 9), st.integers(1, 4))
def test_windows_cover_all_tokens(spark, sizes, window, stride):
    got = I.chunk(docs(spark, [" ".join(f"t{k}" for k in range(n)) for n in sizes]), window, stride).collect()
    for i, n in enumerate(sizes):
        own = sorted((r.chunk_idx, r.token_start, r.token_end, r.tokens) for r in got if r.doc_id == i)
        assert {k for _, s, e, _ in own for k in range(s, e)} == set(range(n))
        assert all(s == c * stride and t == [f"t{k}" for k in range(s, e)] for c, s, e, t in own)
        assert sum(e == n for _, _, e, _ in own) == (1 if n else 0)


def test_tokens_split_on_ascii_white_space_only(spark):
    r = docs(spark, ["a\tb\x0bc d  \r\ne", "", None]).select(T.tokens(F.col("text")).alias("t")).collect()
    assert [x.t for x in r] == [["a", "b", "c d", "e"], [], None]


def test_bm25_against_the_formula(spark):
    texts = ["No map no Matrix", "map map the matrix of a map", "nothing here", ""]
    fields = Q.fields_frame(spark, (Field("f", "F", "no map no unknown"),))
    got = {r.doc_id: r.score for r in Q.bm25(I.chunk(docs(spark, texts)), fields).collect()}
    bags = [t.lower().split() for t in texts[:3]]
    avg = sum(map(len, bags)) / 3
    want = {}
    for i, bag in enumerate(bags):
        s = 0.0
        for term, qtf in (("no", 2), ("map", 1), ("unknown", 1)):
            df = sum(term in b for b in bags)
            if tf := bag.count(term):
                s += qtf * math.log((3 - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(bag) / avg)) + 1)
        if s:
            want[i] = round(s, 6)
    assert got == want


def test_single_window_scores(spark):
    fields = Q.fields_frame(spark, (Field("f", "F", "soc audit"), Field("g", "F", "no x no y")))
    got = {(r.corpus_id, r.field): r.score for r in Q.bm25(I.chunk(docs(spark, ["soc audit no other"])), fields).collect()}
    one = math.log(4 / 3) * 2
    assert got == {("c", "f"): round(2 * one, 6), ("c", "g"): round(2 * one, 6)}


def test_rerank_keeps_order_without_vectors_and_breaks_ties_by_rank(spark):
    ranked = spark.createDataFrame([("c", "f", d, 0, s, r) for d, s, r in ((1, 5.0, 1), (2, 4.0, 2), (3, 4.0, 3), (4, 1.0, 4))], "corpus_id string, field string, doc_id long, chunk_idx int, score double, rank int")
    assert [r.doc_id for r in Q.rerank(ranked, None, k=3).orderBy("final_rank").collect()] == [1, 2, 3]
    sim = spark.createDataFrame([("c", "f", 4, 0, 1.0)], "corpus_id string, field string, doc_id long, chunk_idx int, similarity double")
    got = Q.rerank(ranked, sim, k=4).orderBy("final_rank").collect()
    assert [r.doc_id for r in got] == [1, 2, 3, 4] and got[3].blended == 0.4
    flat = ranked.withColumn("score", F.lit(2.0))
    assert all(r.norm == 0 for r in Q.normalised(flat).collect())


def test_cosine_of_nothing_is_zero(spark):
    r = spark.sql("SELECT array(0.0, 0.0) a, array(1.0, 0.0) b").select(Q.cosine(F.col("a"), F.col("b")), Q.cosine(F.col("b"), F.col("b"))).first()
    assert tuple(r) == (0.0, 1.0)


def test_nearest_is_the_same_in_cells(spark):
    rows = spark.createDataFrame([(i, [float(x) for x in (i % 7, i % 5, i % 3, 1)]) for i in range(60)] + [(None, [1.0] * 4), (60, None), (61, [0.0] * 4), (61, [0.0] * 4)], "doc_id long, embedding array<float>")
    asked = rows.filter("doc_id % 4 = 0").selectExpr("doc_id AS q", "embedding AS asked")
    whole = Q.nearest(rows, asked, 3)
    cells = Q.nearest(rows, asked, 3, query_bytes=100, tile=9)
    assert "BroadcastNestedLoopJoin" in whole._jdf.queryExecution().toString() and "NestedLoop" not in cells._jdf.queryExecution().toString()
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cells.collect()))
    assert len(cells.collect()) == 16 * 3 and Q.nearest(rows, asked.limit(0), 3).count() == 0


def test_nearest_in_blocks_is_as_pair_by_pair(spark):
    rng = random.Random(5)
    vector = lambda: [rng.choice((-1.0, 0.0, 0.5, 1.0, 2.0)) for _ in range(4)]
    rows = [(i, vector()) for i in range(300)] + [(400 + i, [1.0, 2.0, 0.5, 0.0]) for i in range(60)] + [(500, [0.1] * 4)] * 9
    rows += [(600 + i, v) for i, v in enumerate((None, [0.0] * 4, [0.0] * 4, [math.nan, 1.0, 0.0, 0.0], [math.inf, 1.0, 0.0, 1.0], [1.0, 2.0], [0.0], [], [None, 1.0, 1.0, 1.0], [1e-30] * 4, [1e30, 0.0, 0.0, 1e30]))]
    rows = spark.createDataFrame([*rows, (None, [1.0] * 4)], "doc_id int, embedding array<float>").repartition(3)
    asked = rows.filter("doc_id % 5 = 0 OR doc_id >= 600").selectExpr("doc_id AS q", "embedding AS asked").distinct()
    pairs = rows.join(asked, F.col("doc_id") != F.col("q")).select("q", "doc_id", F.lit(0).alias("chunk_idx"), F.round(Q.cosine(F.col("asked"), F.col("embedding")), 6).alias("score"))
    want = sorted(map(str, Q.top_k(pairs, 5, ("q",)).collect()))
    for found in (Q.nearest(rows, asked, 5), Q.nearest(rows, asked, 5, query_bytes=900, tile=70)):
        assert found.schema["q"].dataType == asked.schema["q"].dataType and sorted(map(str, found.collect())) == want


def test_nearest_takes_blocks_not_pairs(spark):
    """8,000,000 pairs, too many to be taken one by one in that time."""
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: F.sin(x * F.col("id")).cast("float")).alias("embedding"))
    asked = rows.filter("doc_id % 50 = 0").selectExpr("doc_id AS q", "embedding AS asked")
    at = time.monotonic()
    assert Q.nearest(rows, asked, 5).count() == 400 * 5 and time.monotonic() - at < 30


def test_rounding_is_as_sparks(spark):
    x = [0.1234565, -0.1234565, 0.12345649999999999, 1.5e-6, 2.5e-6, -2.5e-6, 0.9999995, 1.0000000000000002, -0.0, 3e-7]
    want = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6).alias("y")).collect()]
    assert [v / 1e6 for v in neighbours.rounded(np.array(x)).tolist()] == want
