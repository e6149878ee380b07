"""Session helpers: reading tables, cutting lineage, and exact detection of heavy keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A key is heavy if it holds more than this share of all rows. By counting, at most 1 / HEAVY_SHARE keys can
#: be heavy, whatever the size of the data; that is the proven bound behind every broadcast of heavy keys.
HEAVY_SHARE = 0.001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the shared folder that the cluster names; sets one of its own only where none is named (tests)."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="gridloom-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there, so that a lost executor costs nothing
    upstream and several consumers share one computation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{folder}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def heavy_keys(df: DataFrame, key: str, weight: Column | None = None, share: float = HEAVY_SHARE) -> DataFrame:
    """The keys that hold more than `share` of the total weight (rows by default); at most 1 / share of them.
    Counts are combined before the shuffle, so that a heavy key costs one row per task."""
    counts = df.groupBy(key).agg(F.sum(weight if weight is not None else F.lit(1)).alias("__n"))
    total = counts.agg((F.sum("__n") * F.lit(share)).alias("__t"))
    return counts.where(F.col("__n") > total.scalar()).select(key)


def salt(column: str | Column, salts: int) -> Column:
    """A number below `salts` that depends on the column only."""
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: float = HEAVY_SHARE) -> DataFrame:
    """left joined with right (one row per key at most) on key. Keys that are heavy in left get their rows of right
    by broadcast (at most 1 / share rows), the others by a shuffle join."""
    heavy = heavy_keys(left, key, share=share)
    hot = left.join(F.broadcast(right.join(F.broadcast(heavy), key, "left_semi")), key, "inner")
    if how == "left":
        with_hot = right.join(F.broadcast(heavy), key, "left_semi").withColumn("__there", F.lit(True))
        marked = left.join(F.broadcast(heavy.withColumn("__heavy", F.lit(True))), key, "left")
        hot = marked.where("__heavy").drop("__heavy").join(F.broadcast(with_hot), key, "left").drop("__there")
        return hot.unionByName(marked.where("__heavy is null").drop("__heavy").join(right, key, "left"))
    cold = left.join(F.broadcast(heavy), key, "left_anti")
    return hot.unionByName(cold.join(right, key, how))


def merged(edges: DataFrame, node: str, key: str) -> DataFrame:
    """(node, label): the smallest node that each node reaches through shared keys, for the nodes whose label isn't
    their own. edges: distinct (node, key). Only keys with several nodes link; rounds end when no label changes."""
    shared = edges.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(key)
    state = cut(edges.join(shared, key).select(node, key, F.col(node).alias("label")))
    while True:
        by_key = state.groupBy(key).agg(F.min("label").alias("__k"))
        moved = state.join(by_key, key)
        by_node = moved.groupBy(node).agg(F.min("__k").alias("__m"))
        new = cut(moved.drop("__k").join(by_node, node).select(node, key, F.col("__m").alias("label"), (F.col("__m") < F.col("label")).alias("__changed")))
        state = new.drop("__changed")
        if new.where("__changed").isEmpty():
            return state.where(F.col("label") != F.col(node)).select(node, "label").distinct()


def ranked(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with position: the rank of each row in the order, from 0. Rows are sorted in ranges, and a row's rank is its
    place in its range plus the counts of the ranges before it, so no task and no driver holds them all."""
    placed = cut(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.withColumns({"__range": F.shiftright("__id", 33), "__place": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    before = F.sum("count").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    starts = placed.groupBy("__range").count().select("__range", F.coalesce(before, F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__range").withColumn("position", F.col("__start") + F.col("__place")).drop("__id", "__range", "__place", "__start")
