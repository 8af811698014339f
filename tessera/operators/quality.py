"""Agreement of a clustering with known classes, from the contingency table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(rows: DataFrame) -> DataFrame:
    """truth, cluster_id, n; noise is left out."""
    return rows.where("cluster_id <> -1").groupBy("truth", "cluster_id").agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(rows: DataFrame) -> DataFrame:
    """One row, ari: 0 where nothing is scored, 1 where both sides are one class."""
    table = contingency(rows)
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = table.agg(pairs("n").alias("ij"), F.sum("n").alias("n"))
    a = table.groupBy("truth").agg(F.sum("n").alias("n")).agg(pairs("n").alias("a"))
    b = table.groupBy("cluster_id").agg(F.sum("n").alias("n")).agg(pairs("n").alias("b"))
    expected = F.try_divide(F.col("a") * F.col("b"), F.col("n") * (F.col("n") - 1) / 2)
    top = (F.col("a") + F.col("b")) / 2
    found = both.crossJoin(a).crossJoin(b)  # one row each
    ari = F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).when(top == expected, 1.0).otherwise(F.try_divide(F.col("ij") - expected, top - expected))
    return found.select(F.coalesce(ari, F.lit(0.0)).alias("ari"))


def normalised_information(rows: DataFrame) -> DataFrame:
    """One row, nmi: mutual information over the mean of both entropies; 0 where nothing is scored."""
    table = contingency(rows)
    total = table.agg(F.sum("n").alias("t"))
    a = table.groupBy("truth").agg(F.sum("n").alias("na"))
    b = table.groupBy("cluster_id").agg(F.sum("n").alias("nb"))
    joined = table.join(a, "truth").join(b, "cluster_id").crossJoin(total)
    p = F.col("n") / F.col("t")
    info = joined.agg(F.sum(p * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    entropy = lambda d, c, name: d.crossJoin(total).agg(F.sum(-F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t"))).alias(name))
    found = info.crossJoin(entropy(a, "na", "ha")).crossJoin(entropy(b, "nb", "hb"))
    return found.select(F.coalesce(F.try_divide("mi", (F.col("ha") + F.col("hb")) / 2), F.when(F.col("mi").isNull(), 0.0).otherwise(1.0)).alias("nmi"))
