"""The vote cache as a stored table: hash buckets, parts that are only ever added, and versions.

An upsert writes a part and adds it to the list of the version before; where two writers meet,
the second one adds its part to the first one's list, so neither loses a vote. Of a key that
several parts hold, the last part's vote counts. Each file has a Bloom filter of its keys, which
the reader asks before it opens a row group.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.sources.snapshots import Conflict, Snapshots

BUCKETS = 64
#: Parts that are merged into one.
PARTS = 16


class VoteStore:
    """key, vote in a folder. Keys are those of cache_key(); failures (null votes) are never kept."""

    def __init__(self, spark: SparkSession, at: str, buckets: int = BUCKETS):
        self.spark, self.at, self.buckets = spark, at.rstrip("/"), buckets
        self.snapshots = Snapshots(spark, at)

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, votes: DataFrame) -> str:
        name = uuid.uuid4().hex
        dealt = votes.select("key", "vote", self._bucket(F.col("key")).alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "key")
        options = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        dealt.write.options(**options).partitionBy("bucket").parquet(f"{self.at}/{name}")
        return name

    def _parts(self) -> list[str]:
        return self.snapshots.current()[1].get("parts", [])

    def upsert(self, new: DataFrame) -> None:
        """new: key, vote, seq. Of votes on one key the one with the greatest seq counts."""
        last = F.row_number().over(W.partitionBy("key").orderBy(F.col("seq").desc()))
        name = self._write(new.filter("vote IS NOT NULL").withColumn("n", last).filter("n = 1"))
        self.snapshots.update(lambda content: {"buckets": self.buckets, "parts": [*content.get("parts", []), name]})

    def _read(self, parts: list[str]) -> DataFrame:
        """key, vote, bucket, part (its place in the list)."""
        out = self.spark.createDataFrame([], "key string, vote double, bucket int, part int")
        for k, name in enumerate(parts):
            df = self.spark.read.schema("key string, vote double, bucket int").parquet(f"{self.at}/{name}")
            out = out.unionByName(df.withColumn("part", F.lit(k)))
        return out

    def _last(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.max_by("vote", "part").alias("vote"))

    def table(self) -> DataFrame:
        """key, vote of all keys."""
        return self._last(self._read(self._parts()))

    def get(self, keys: list[str]) -> DataFrame:
        """key, vote of a few keys: their buckets' files alone are opened, and of these only row
        groups whose filters may hold one."""
        if not keys:
            return self._last(self._read([]))
        row = self.spark.createDataFrame([(k,) for k in keys], "key string").select(F.collect_set(self._bucket(F.col("key"))).alias("b")).first()
        return self._last(self._read(self._parts()).filter(F.col("bucket").isin(*row.b) & F.col("key").isin(*keys)))

    def lookup(self, asked: DataFrame) -> DataFrame:
        """asked: key and others, which stay. A row of it for each with a vote, and vote. Both
        sides meet by bucket and key, and only found rows are told apart by part."""
        keys = asked.select("key").distinct().withColumn("bucket", self._bucket(F.col("key")))
        found = self._read(self._parts()).join(keys, ["bucket", "key"], "left_semi")
        return asked.join(self._last(found), "key")

    def compact(self, least: int = PARTS) -> None:
        """Merges all parts into one if there are so many. Parts that others add meanwhile stay
        behind it; if others merged, nothing is done."""
        parts = self._parts()
        if len(parts) < max(2, least):
            return
        name = self._write(self._last(self._read(parts)))
        while True:
            version, content = self.snapshots.current()
            now = content.get("parts", [])
            if now[: len(parts)] != parts:
                return
            try:
                self.snapshots.commit(version + 1, {**content, "parts": [name, *now[len(parts) :]]})
                return
            except Conflict:
                continue
