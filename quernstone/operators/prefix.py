"""Sums of what stands before each row of a group, for groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.sources.snapshots import saved


def before(rows: DataFrame, group: list[str], order: list[str], value: Column) -> DataFrame:
    """rows with before: the sum of value over the rows of the group that come before in an
    order. Rows are dealt out by ranges of it and written so; each range is summed up by itself,
    and starts with what the ranges before it add up to, of which there are as many as ranges
    and groups. So no task holds more of a group than a range."""
    ranged = rows.withColumn("value", value.cast("long")).repartitionByRange(*group, *order).withColumn("part", F.spark_partition_id())
    ranged = saved(ranged, "ranges")
    earlier = lambda by, order: W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy(*group, "part").agg(F.sum("value").alias("total"))
    starts = totals.select(*(F.col(g).alias(f"of_{g}") for g in group), F.col("part").alias("of_part"), F.coalesce(F.sum("total").over(earlier(group, ["part"])), F.lit(0)).alias("start"))
    own = F.coalesce(F.sum("value").over(earlier([*group, "part"], order)), F.lit(0))
    same = reduce(lambda a, g: a & F.col(g).eqNullSafe(F.col(f"of_{g}")), group, F.col("part") == F.col("of_part"))
    return ranged.withColumn("own", own).join(starts, same).select(*rows.columns, (F.col("start") + F.col("own")).alias("before"))
