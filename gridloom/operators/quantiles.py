"""Values by exact rank, of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def values_at_ranks(df: DataFrame, group: str, value: str, ranks: dict[str, Column], bins: int = 4096, levels: int = 2) -> DataFrame:
    """group and one column for each of ranks: the value at the 0-based ascending rank, an expression of n (the
    group's count); null for a rank outside the group.

    A histogram between the group's extremes, made once for all ranks, finds the bins that hold them, a second one
    within those bins finer ones; only the distinct values of the last bins are put in order. Rows are never sorted or
    gathered by group: what moves are counts per bin, combined before the shuffle. Nulls and NaN don't count."""
    rows = df.select(F.col(group), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    ends = rows.groupBy(group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    place = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(place, F.lit(bins - 1))).otherwise(0)
    at = F.explode(F.array(*[F.struct(F.lit(name).alias("which"), rank.cast("long").alias("at")) for name, rank in ranks.items()])).alias("r")
    counts = rows.join(ends, group).groupBy(group, bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"), F.min("n").alias("n"))
    below = F.coalesce(F.sum("c").over(W.partitionBy(group).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    asked = counts.withColumn("below", below).select("*", at).select(group, "r.which", "low", "high", "c", (F.col("r.at") - F.col("below")).alias("at"))
    within = asked.where("at >= 0 and at < c").select(group, "which", F.col("low").alias("lo"), F.col("high").alias("hi"), "at")
    for _ in range(levels - 1):
        counts = rows.join(within, group).where("v between lo and hi").groupBy(group, "which", bin_.alias("bin"))
        counts = counts.agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"), F.min("at").alias("at"))
        below = F.coalesce(F.sum("c").over(W.partitionBy(group, "which").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        within = counts.withColumn("at", F.col("at") - below).where("at >= 0 and at < c").select(group, "which", F.col("low").alias("lo"), F.col("high").alias("hi"), "at")
    near = rows.join(within, group).where("v between lo and hi").groupBy(group, "which", "v").agg(F.count("*").alias("c"), F.min("at").alias("at"))
    upto = near.withColumn("upto", F.sum("c").over(W.partitionBy(group, "which").orderBy("v"))).where("upto > at")
    return upto.groupBy(group).agg(*[F.min(F.when(F.col("which") == name, F.col("v"))).alias(name) for name in ranks])


def value_at_rank(df: DataFrame, group: str, value: str, rank: Column, bins: int = 4096, levels: int = 2) -> DataFrame:
    """(group, value): values_at_ranks for one rank; a rank outside the group gives no row."""
    return values_at_ranks(df, group, value, {value: rank}, bins, levels)
