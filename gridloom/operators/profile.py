"""Profiles of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

STATS = ("null_ratio", "mean_norm", "std_norm", "min_norm", "max_norm")


def column_profile(df: DataFrame) -> DataFrame:
    """(col_idx, name, dtype, is_numeric, null_ratio, mean_norm, std_norm, min_norm, max_norm), one row per column,
    from one pass over the table. Numbers are placed between the column's extremes (0 to 1; a constant one over a
    range of 1); all are 0 for other types and for columns of nulls. An empty table has null ratios."""
    aggregates, kinds = [F.count("*").alias("n")], []
    for i, f in enumerate(df.schema.fields):
        numeric = isinstance(f.dataType, (NumericType, BooleanType))
        kinds.append(numeric)
        aggregates.append(F.count(F.col(f"`{f.name}`")).alias(f"c{i}"))
        if numeric:
            v = F.col(f"`{f.name}`").cast("int").cast("double") if isinstance(f.dataType, BooleanType) else F.col(f"`{f.name}`").cast("double")
            aggregates += [g(v).alias(f"{a}{i}") for a, g in (("lo", F.min), ("hi", F.max), ("mean", F.avg), ("std", F.stddev_samp))]
    rows = []
    for i, (f, numeric) in enumerate(zip(df.schema.fields, kinds)):
        stats = [F.lit(0.0)] * 4
        if numeric:
            lo, hi, mean, std = (F.col(f"{a}{i}") for a in ("lo", "hi", "mean", "std"))
            span = F.when(hi > lo, hi - lo).otherwise(1.0)
            some = F.col(f"c{i}") > 0
            stats = [F.when(some, x).otherwise(0.0) for x in ((mean - lo) / span, F.coalesce(std, F.lit(0.0)) / span, F.lit(0.0), F.lit(1.0))]
        null_ratio = F.when(F.col("n") > 0, 1 - F.col(f"c{i}") / F.col("n"))
        kind = F.lit(f.dataType.simpleString()).alias("dtype")
        rows.append(F.struct(F.lit(i).alias("col_idx"), F.lit(f.name).alias("name"), kind, F.lit(numeric).alias("is_numeric"), *[x.alias(s) for s, x in zip(STATS, [null_ratio, *stats])]))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))
