"""Results hang neither on the cores that are alive nor on when they change: a plan is built
with some number of cores and read with another, which deals small files out anew."""

import contextlib

import pytest
from pyspark.sql import functions as F

from quernstone.llm import columndedup, decontaminate, fmdedup, jaccard, linedup, simhash
from quernstone.llm.common import with_uid

DOCS, BENCHMARK = (f"/root/testdata/sf0.001/{t}.parquet" for t in ("documents", "benchmark"))
PARALLEL = "spark.sql.leafNodeDefaultParallelism"
WAYS = {
    "lines": lambda d, b: linedup.line_report(d, long_docs=2),
    "dedup_lines": lambda d, b: linedup.dedup_lines(d, long_docs=2).select("doc_id", F.md5("text")),
    "op9": lambda d, b: columndedup.dedup(d).drop("kept"),
    "op10": lambda d, b: fmdedup.dedup(d).drop("kept"),
    "simhash": lambda d, b: simhash.representatives(d).select("doc_id"),
    "jaccard": lambda d, b: jaccard.representatives(d).select("doc_id"),
    "benchmark": lambda d, b: decontaminate.contamination(d, b, block_bytes=500),
}


@contextlib.contextmanager
def cores(spark, n):
    spark.conf.set(PARALLEL, n)
    spark.conf.set("spark.sql.files.openCostInBytes", 1024)
    try:
        yield
    finally:
        spark.conf.unset(PARALLEL)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(spark, way, built, read):
    with cores(spark, built):
        df = WAYS[way](spark.read.parquet(DOCS), spark.read.parquet(BENCHMARK))
    with cores(spark, read):
        # a plan is made when it is first run: of a frame of its own, as a lost executor makes it
        return sorted(map(str, df.select("*").collect()))


@pytest.mark.parametrize("way", WAYS)
def test_cores_may_change(spark, way):
    assert rows(spark, way, 4, 4) == rows(spark, way, 4, 9)


def test_uid_is_a_rows_own(spark, tmp_path):
    spark.range(1000).withColumn("x", F.col("id") % 7).repartition(5).write.parquet(str(tmp_path / "a b%20c"))
    df = spark.read.parquet(str(tmp_path / "a b%20c"))
    with cores(spark, 2):
        one = {r.id: r.uid for r in with_uid(df, "id", "x").collect()}
    with cores(spark, 7):
        two = {r.id: r.uid for r in with_uid(df.filter("x > 2").select("id"), "id").collect()}
    assert len(set(one.values())) == 1000 and two == {k: v for k, v in one.items() if k % 7 > 2}


def test_frames_that_are_no_files_are_numbered_once(spark):
    df = spark.read.parquet(DOCS)
    for frame in (df.union(df), df.withColumn("e", F.explode(F.sequence(F.lit(1), F.lit(2)))), df.join(df.select("doc_id"), "doc_id"), df.withColumn("_metadata", F.lit(1))):
        out = with_uid(frame, "doc_id")
        assert out.count() == frame.count() == out.select("uid").distinct().count()
        assert sorted(out.collect()) == sorted(out.collect())
