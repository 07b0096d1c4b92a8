"""Counters on the flow: what a plan rejects, finds or misses, counted while it runs, without a
pass of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Flow:
    """Counters of one run by stage. watch() puts them on a frame; values() has them when an
    action on it, or on anything made of it, has run. A frame that is read twice is counted once,
    by its first run; rows that a limit leaves unread are not counted."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, stage: str, **counters: Column) -> DataFrame:
        """counters: conditions whose true rows are counted; `rows` counts all."""
        if stage in self._seen:
            raise ValueError(f"{stage} is watched already")
        self._seen[stage] = Observation(stage)
        counts = [F.count_if(c).alias(n) for n, c in counters.items()]
        return df.observe(self._seen[stage], F.count(F.lit(1)).alias("rows"), *counts)

    def values(self) -> dict[str, dict[str, int]]:
        return {stage: dict(seen.get) for stage, seen in self._seen.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """stage, counter, n."""
        rows = [(s, c, int(n)) for s, counts in self.values().items() for c, n in counts.items()]
        return spark.createDataFrame(rows, "stage string, counter string, n long")
