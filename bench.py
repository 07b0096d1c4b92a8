"""Times the headline queries and prints one JSON line.

The published figures are ratios of a native index over a plain one, for 15 queries with k = 5
over one window per document, repeated. "twin" times the same quantities: the engine against a
plain Python version of our own, over that many windows; "stored" is the index that is written
once and searched without the texts.

Each query runs into a sink that drops its rows, once to warm up and then REPEATS times; the
median counts. BENCH_SF_DIR names the tables, BENCH_CPUS the cores.
"""

from __future__ import annotations

import heapq
import json
import math
import os
import random
import time
import uuid
from collections import Counter, defaultdict
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quernstone import suite
from quernstone.catalog import B, DELTA, DOMAIN, K1, STRIDE, WINDOW
from quernstone.operators import index as I
from quernstone.operators import retrieve as Q
from quernstone.plans.scoring import score_corpora
from quernstone.sources.snapshots import scratch
from quernstone.sources.stored_index import StoredIndex

REPEATS = 3
#: Phases that published figures name, then other queries of weight.
NAMED = ["tokenize_stats", "chunk_windows", "term_freq", "bm25_topk_by_source", "hybrid_rerank", "company_scores", "per_doc_breakdown", "redact_documents", "repeated_lines", "rate_limit"]


def phases(spark, sf_dir):
    docs = suite.corpus(spark, sf_dir)
    fields = Q.fields_frame(spark, DOMAIN.fields)
    one = I.chunk(docs.withColumn("corpus_id", F.lit("all")))
    return {
        "tokenise_chunk": lambda: I.chunk(docs),
        "index_statistics": lambda: I.doc_freq(I.term_freq(I.chunk(docs))),
        "queries_15_top_15": lambda: Q.top_k(Q.bm25(one, fields), 15),
        "full_score_rules": lambda: score_corpora(docs).companies,
    } | {n: lambda n=n: suite.queries()[n](spark, sf_dir) for n in NAMED}


#: Windows of the published figures.
SCALES = (1800, 7200)


class Plain:
    """Windows, an inverted index and BM25+ in plain Python, one thread."""

    def __init__(self, texts: list[str]):
        self.sizes: list[int] = []
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for text in texts:
            tokens = text.split()
            for s in range(0, max(1, len(tokens) - WINDOW + STRIDE), STRIDE):
                own = tokens[s : s + WINDOW]
                for term, tf in Counter(map(str.lower, own)).items():
                    self.postings[term].append((len(self.sizes), tf))
                self.sizes.append(len(own))

    def top(self, query: str, k: int) -> list[tuple[float, int]]:
        n, found = len(self.sizes), Counter()
        average = sum(self.sizes) / n
        for term in query.lower().split():
            held = self.postings.get(term, [])
            idf = math.log((n - len(held) + 0.5) / (len(held) + 0.5) + 1)
            for c, tf in held:
                found[c] += idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.sizes[c] / average)) + DELTA)
        return heapq.nlargest(k, ((s, -c) for c, s in found.items()))


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def twin(spark, windows: int) -> dict[str, float]:
    """Seconds of both for windows of about 210 tokens that hold words of the queries."""
    rng = random.Random(1)
    words = sorted({w for f in DOMAIN.fields for w in f.query.split()})
    filler = [f"word{k}" for k in range(3000)]
    base = [" ".join(rng.choice(words) if rng.random() < 0.15 else rng.choice(filler) for _ in range(210)) for _ in range(9)]
    texts = [base[k % 9] for k in range(windows)]
    docs = spark.createDataFrame([(0, k, t) for k, t in enumerate(texts)], "corpus_id int, doc_id int, text string").repartition(spark.sparkContext.defaultParallelism).cache()
    docs.count()
    fields = Q.fields_frame(spark, DOMAIN.fields)
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    build = lambda: sink(I.corpus_index(I.term_counts(I.chunk(docs), sorted({w.lower() for w in words}))))
    ask = lambda: sink(Q.top_k(Q.bm25(I.chunk(docs), fields), 5))
    out = {}
    for name, f in (("index", build), ("all", ask)):
        out[name] = median(timed(f) for _ in range(1 + REPEATS))
    index = StoredIndex(spark, f"{scratch(spark)}/bench-{uuid.uuid4().hex}", buckets=4)
    out["stored_build"] = timed(lambda: index.add(docs))
    out["stored_queries"] = median(timed(lambda: sink(index.search(DOMAIN.fields, 5))) for _ in range(1 + REPEATS))
    docs.unpersist()
    began = time.perf_counter()
    plain = Plain(texts)
    out["plain_index"] = time.perf_counter() - began
    out["plain_queries"] = timed(lambda: [plain.top(f.query, 5) for f in DOMAIN.fields])
    out["plain_all"] = out["plain_index"] + out["plain_queries"]
    return {k: round(v, 3) for k, v in out.items()}


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, make in phases(spark, sf_dir).items():
        runs = []
        for _ in range(1 + REPEATS):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(median(runs[1:]), 3)
    twins = {str(n): twin(spark, n) for n in SCALES}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "twin": twins}))
    spark.stop()


if __name__ == "__main__":
    main()
