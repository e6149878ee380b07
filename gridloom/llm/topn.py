"""The N best items of every group.

A histogram of each group's scores gives a threshold that at least N distinct items of the group reach; items below
it are dropped - each has N better ones - and the survivors are made distinct (the highest score counts) and ranked
exactly, ties by the given columns. Every group that surely holds N items has a threshold.

Histograms are made of raw rows, before items are made distinct, and stay safe however often an item is repeated:
a bin holds, instead of a count, a bitmap of the hashes of its items. The number of bits that a bin and those above
it set together is never more than the number of their distinct items. The bins are taken from the logarithm of the
score, so they are monotone in it, need no pass for the range, and their number per group is bounded by the
floating-point range.

Lists are moved packed, as they come. Groups with more than `share` of all items (at most 1 / share of them) are
never moved as a whole: their histograms are combined before the shuffle, their thresholds meet the rows by
broadcast, and what is left is spread by group and item; the final ranking keeps N rows per group and task before it
moves anything. The lists of all other groups are moved once, by group; histogram, threshold, distinct items and
ranks then need no further shuffle. A group of any size, even one of ties only, is never gathered in one task.

Null groups, null items and scores that are null or NaN don't count. Infinite scores do. Empty input gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.text import id_order, strip
from gridloom.runtime import HEAVY_SHARE, cut, heavy_keys

#: Bins of a histogram per doubling of the score.
BINS_PER_DOUBLING = 64
#: Bits of a bitmap for each of the N items; more make two items less likely to share one.
BITS_PER_ITEM = 8
_ZERO = 1100 * BINS_PER_DOUBLING

Ties = Callable[[Column], list[Column]]


def score_bin(score: Column) -> Column:
    """A whole number that never falls as the score rises."""
    magnitude = F.floor(F.log2(F.abs(score)) * BINS_PER_DOUBLING) + _ZERO
    top = F.lit(2 * _ZERO)
    return (
        F.when(score == float("inf"), top)
        .when(score == float("-inf"), -top)
        .when(score > 0, magnitude)
        .when(score < 0, -magnitude)
        .otherwise(0)
        .cast("int")
    )


def thresholds(items: DataFrame, n: int) -> DataFrame:
    """(grp, least_bin): the highest bin such that it and the bins above surely hold n distinct items. Groups that
    surely hold no n items have none. items: (grp, item, score, bin), items may repeat."""
    words = -(-n * BITS_PER_ITEM // 64)
    placed = items.select("grp", "bin", F.pmod(F.xxhash64("item"), F.lit(64 * words)).cast("int").alias("at"))
    bit = F.expr("shiftleft(1L, at % 64)")
    maps = placed.groupBy("grp", "bin").agg(*[F.bit_or(F.when(F.col("at").between(64 * w, 64 * w + 63), bit).otherwise(0)).alias(f"bits{w}") for w in range(words)])
    down = W.partitionBy("grp").orderBy(F.desc("bin"))
    held = reduce(add, [F.bit_count(F.bit_or(f"bits{w}").over(down)) for w in range(words)])
    return maps.select("grp", "bin", held.alias("held")).where(F.col("held") >= n).groupBy("grp").agg(F.max("bin").alias("least_bin"))


def _best(items: DataFrame, least: DataFrame, n: int, ties: Ties) -> DataFrame:
    above = items.join(least, "grp", "left").where("least_bin is null or bin >= least_bin")
    distinct = above.groupBy("grp", "item").agg(F.max("score").alias("score"))
    order = W.partitionBy("grp").orderBy(F.desc("score"), *ties(F.col("item")))
    return distinct.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= n)


def top_n_of_lists(lists: DataFrame, group: str, items: str, n: int, ties: Ties, share: float = HEAVY_SHARE) -> DataFrame:
    """(grp, item, score, rank_no): the n best distinct items of each group, rank 1 first; equal scores in the order
    of `ties`, which must tell any two items apart. A group may have any number of rows; `items` is an array of
    structs of item and score (double)."""
    known = lists.where(F.col(group).isNotNull()).select(F.col(group).alias("grp"), F.col(items).alias("list"))
    heavy = cut(heavy_keys(known, "grp", F.greatest(F.size("list"), F.lit(0)), share))
    counted = lambda x: x["item"].isNotNull() & x["score"].isNotNull() & ~F.isnan(x["score"])

    def flat(part: DataFrame) -> DataFrame:
        return part.select("grp", F.inline("list")).withColumn("bin", score_bin(F.col("score")))

    usable = known.withColumn("list", F.filter("list", counted)).where("size(list) > 0")
    hot = flat(usable.join(F.broadcast(heavy), "grp", "left_semi"))
    cold = flat(usable.join(F.broadcast(heavy), "grp", "left_anti").repartition("grp"))
    return _best(hot, F.broadcast(thresholds(hot, n)), n, ties).unionByName(_best(cold, thresholds(cold, n), n, ties))


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int, ties: Ties, share: float = HEAVY_SHARE) -> DataFrame:
    """top_n_of_lists for items that come one in a row, as (group, rank_no, item, score)."""
    one = F.array(F.struct(F.col(item).alias("item"), F.col(score).cast("double").alias("score")))
    best = top_n_of_lists(rows.select(F.col(group).alias("g"), one.alias("list")), "g", "list", n, ties, share)
    return best.select(F.col("grp").alias(group), "rank_no", F.col("item").alias(item), "score")


def rag_candidates(rag: DataFrame) -> DataFrame:
    """(query_index, list) of each row, without the failed ones: its positions with an id, as structs of item and
    score. Position i has score i; a shorter list of scores leaves the rest without one."""
    pairs = F.transform("candidate_sheet_ids", lambda x, i: F.struct(strip(x).alias("item"), F.get("candidate_scores", i).alias("score")))
    return rag.where("status is null or status <> 'failed'").select("query_index", F.filter(pairs, lambda x: x["item"] != "").alias("list"))


def best_sheets(rag: DataFrame, n: int = 5, share: float = HEAVY_SHARE) -> DataFrame:
    """(query_index, rank_no, sheet_id): the n best sheets of each query."""
    best = top_n_of_lists(rag_candidates(rag), "query_index", "list", n, id_order, share)
    return best.select(F.col("grp").alias("query_index"), "rank_no", F.col("item").alias("sheet_id"))
