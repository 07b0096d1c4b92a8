"""How predictions agree with labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """pairs: expected, predicted. expected, predicted, n: every pair of labels, zeros too."""
    spark = pairs.sparkSession
    every = spark.createDataFrame([(a, b) for a in labels for b in labels], "expected string, predicted string")
    n = pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    return every.join(n, ["expected", "predicted"], "left").fillna(0, ["n"])


def scores(confusion: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support; 0 where a share has nothing to be of."""
    hit = F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0)
    by_row = confusion.groupBy(F.col("expected").alias("label")).agg(F.sum(hit).alias("tp"), F.sum("n").alias("support"))
    by_col = confusion.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = share(F.col("tp"), F.col("said")), share(F.col("tp"), F.col("support"))
    out = by_row.join(by_col, "label").select("label", p.alias("precision"), r.alias("recall"), "support")
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """n, accuracy and macro_f1 (the plain mean over labels), to four places."""
    macro = scores(confusion(pairs, labels)).agg(F.round(F.avg("f1"), 4).alias("macro_f1"))
    right = F.avg((F.col("expected") == F.col("predicted")).cast("double"))
    return pairs.agg(F.count("*").alias("n"), F.round(right, 4).alias("accuracy")).crossJoin(F.broadcast(macro))


def repeated(corpus: DataFrame, times: int) -> DataFrame:
    """A corpus scaled up by copies; copy tells them apart."""
    return corpus.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
