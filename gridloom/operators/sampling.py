"""Splits, samples and training sets, all in an order that depends on a seed and the keys only."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.quantiles import value_at_rank
from gridloom.runtime import cut, ranked, skew_join


#: Positions that one sequence may have.
MOST_ON_DRIVER = 5_000_000


def lot(seed: int, *keys: str | Column) -> Column:
    """The drawing order: a digest of seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *keys))


def lot_number(seed: int, *keys: str | Column) -> Column:
    """The lot as a number from 0 to 1 (its first 48 bits)."""
    return F.conv(F.substring(lot(seed, *keys), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def python_split(spark: SparkSession, n: int, seed: int, eval_ratio: float, validation_ratio: float = 0.0) -> DataFrame:
    """(position, split) as drawn by Python's own shuffle: evaluation is the last part of the shuffled positions,
    validation the last part of the rest. The shuffle is one sequence, so it runs on the driver, for up to
    MOST_ON_DRIVER positions (the evaluated queries, not the corpus); `exact_split` splits tables of any size."""
    if n > MOST_ON_DRIVER:
        raise ValueError(f"{n} positions are too many for one sequence; use exact_split")
    if not 0 < eval_ratio < 1:
        raise ValueError("eval_ratio must lie between 0 and 1")
    order = list(range(n))
    random.Random(seed).shuffle(order)
    held = max(1, int(eval_ratio * n)) if n else 0
    rest = order[: n - held]
    valid = max(1, int(validation_ratio * len(rest))) if validation_ratio and rest else 0
    names = [(p, "core") for p in rest[: len(rest) - valid]] + [(p, "validation") for p in rest[len(rest) - valid :]] + [(p, "eval") for p in order[n - held :]]
    return spark.createDataFrame(names, "position long, split string")


def exact_split(df: DataFrame, key: str, seed: int, parts: dict[str, float]) -> DataFrame:
    """df with split: the parts' shares of the rows, to the row, in drawing order. The last part takes what is left.
    The cuts are found by exact rank, without putting all rows in one order. Keys must be distinct."""
    drawn = df.withColumn("__lot", lot_number(seed, key))
    one = drawn.select((F.col("__lot") >= 0).alias("g"), "__lot")  # one group, by an expression that joins can use
    names, upto, which = list(parts), 0.0, F.when(F.lit(False), "")
    for name in names[:-1]:
        upto += parts[name]
        bound = value_at_rank(one, "g", "__lot", F.floor(F.col("n") * upto + 1e-9)).select("__lot").scalar()
        which = which.when(F.col("__lot") < bound, name)
    return drawn.withColumn("split", which.otherwise(names[-1])).drop("__lot")


def sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """The first n rows in drawing order."""
    return df.orderBy(lot(seed, key), key).limit(n)


def stratified(df: DataFrame, key: str, label: str, seed: int, target: int) -> DataFrame:
    """target rows with labels as even as they allow: going up the labels, each gets the quota of what is left over
    the labels that are left (at least 1); then rows of any label fill up. Labels are few; their counts go to the
    driver, and each label's quota is drawn in a window that keeps `target` rows per task."""
    counts = {r[label]: r["count"] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    quotas, left = {}, target
    for i, name in enumerate(sorted(counts)):
        quotas[name] = min(counts[name], max(1, left // (len(counts) - i)), max(left, 0))
        left -= quotas[name]
    order = W.partitionBy(label).orderBy("__lot", key)
    ranked = df.where(F.col(label).isNotNull()).withColumn("__lot", lot(seed, key)).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= target)
    quota = reduce(lambda w, x: w.when(F.col(label) == x[0], x[1]), quotas.items(), F.when(F.lit(False), 0)).otherwise(0)
    first = ranked.where(F.col("__n") <= quota)
    more = ranked.where(F.col("__n") > quota).orderBy("__lot", key).limit(max(left, 0))
    return first.unionByName(more).drop("__lot", "__n")


def _with_others(asked: DataFrame, pool: DataFrame, seed: int, taken: Column, n: int) -> DataFrame:
    """asked with others: n or more ids that aren't taken, if there are as many. All ids of the pool are ranked in
    drawing order; each query reads on from its own drawn place in it, by a join on the rank."""
    drawn = ranked(pool.select("sheet_id").distinct().withColumn("l", lot(seed, "sheet_id")), "l", "sheet_id").select("position", "sheet_id")
    total = F.greatest(drawn.agg(F.count("*")).scalar(), F.lit(1))
    place = F.conv(F.substring(lot(seed, F.col("query_index").cast("string")), 1, 8), 16, 10).cast("long")
    placed = asked.select("query_index", F.sequence(F.lit(0), F.size(taken) + n - 1).alias("slots"), F.pmod(place, total).alias("place"), total.alias("total"))
    slots = placed.select("query_index", "place", "total", F.explode("slots").alias("slot")).select("query_index", "slot", F.pmod(F.col("place") + F.col("slot"), F.col("total")).alias("position"))
    found = slots.join(drawn, "position").groupBy("query_index").agg(F.array_sort(F.collect_list(F.struct("slot", "sheet_id"))).alias("found"))
    ids = F.coalesce(F.transform("found", lambda x: x["sheet_id"]), F.array().cast("array<string>"))
    return asked.join(found, "query_index", "left").withColumn("others", F.array_distinct(F.array_except(ids, taken))).drop("found")


def _shuffled(items: Column, seed: int) -> Column:
    """The array, or array of structs with x, in the query's own drawing order."""
    key = lambda x: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("query_index").cast("string"), x["x"]))
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(key(x).alias("l"), x.alias("x")))), lambda s: s["x"])


def _marked(ids: Column, label: int) -> Column:
    return F.transform(ids, lambda x: F.struct(x.alias("x"), F.lit(label).alias("y")))


def workspaces(asked: DataFrame, pool: DataFrame, seed: int, size: int = 10, distractors: int = 4) -> DataFrame:
    """(query_index, workspace, relevant): each query's relevant sheets and up to `distractors` others, at most `size`
    in all, in drawing order. asked: (query_index, relevant)."""
    room = F.greatest(F.least(F.lit(distractors), size - F.size("relevant")), F.lit(0))
    step = _with_others(asked, pool, seed, F.col("relevant"), distractors)
    both = F.concat(_marked(F.col("relevant"), 1), _marked(F.slice("others", 1, room), 0))
    return step.select("query_index", F.transform(_shuffled(both, seed), lambda s: s["x"]).alias("workspace"), "relevant")


def training_workspaces(asked: DataFrame, pool: DataFrame, seed: int, size: int = 10, negative_ratio: float = 0.5, least_negatives: int = 1) -> DataFrame:
    """(query_index, workspace, labels): positives up to what the negatives leave, then explicit negatives in their
    order, then drawn others, shuffled together with their labels. asked: (query_index, positives, negatives)."""
    most_positives = max(1, size - min(size - 1, max(least_negatives, round(size * negative_ratio))))
    drawn = F.transform(_shuffled(_marked(F.col("positives"), 1), seed), lambda s: s["x"])
    taken = F.when(F.size("positives") <= most_positives, F.col("positives")).otherwise(F.slice(drawn, 1, most_positives))
    step = _with_others(asked, pool, seed, F.concat("positives", "negatives"), size).withColumn("taken", taken)
    against = F.slice(F.concat(F.array_except("negatives", "taken"), "others"), 1, size - F.size("taken"))
    both = _shuffled(F.concat(_marked(F.col("taken"), 1), _marked(against, 0)), seed)
    return step.select("query_index", both.alias("b")).select("query_index", F.transform("b", lambda s: s["x"]).alias("workspace"), F.transform("b", lambda s: s["y"]).alias("labels"))


def easy_negatives(ids: DataFrame, key: str, known: DataFrame, seed: int, n: int, attempts: int = 10) -> DataFrame:
    """(a, b) up to n drawn unordered pairs of ids that aren't among the known pairs (a, b), each once. Of
    n * attempts draws the first n that pass are taken, so a rejected or repeated draw is replaced by a later one and
    an id may be in several pairs. All ids are ranked in drawing order; a draw is a pair of places in it."""
    drawn = cut(ranked(ids.select(F.col(key).alias("x")).distinct().withColumn("l", lot(seed, "x")), "l", "x").select("position", "x"))
    total = drawn.count()
    if total < 2:
        return drawn.where("false").select(F.col("x").alias("a"), F.col("x").alias("b"))
    number = lambda side: F.conv(F.substring(lot(seed, F.col("id").cast("string"), F.lit(side)), 1, 8), 16, 10).cast("long")
    tries = ids.sparkSession.range(n * attempts).withColumn("p", number("a") % total).withColumn("q", (F.col("p") + 1 + number("b") % (total - 1)) % total)
    left, right = (drawn.select(F.col("position").alias(c), F.col("x").alias(f"x{c}")) for c in "pq")
    pairs = tries.join(left, "p").join(right, "q").select("id", F.least("xp", "xq").alias("a"), F.greatest("xp", "xq").alias("b")).groupBy("a", "b").agg(F.min("id").alias("id"))
    new = pairs.join(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    return new.orderBy("id").limit(n).select("a", "b")


def nway_id(position: Column) -> Column:
    """The id of the sample at a position of its file, like nway_000012."""
    return F.format_string("nway_%06d", position)


def group_members(df: DataFrame, group: str, member: str) -> DataFrame:
    """(group, representative, member): the other members of each group with its smallest one. All pairs of a group
    follow from these rows, of which there are no more than members."""
    first = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(member).alias("representative"), F.max(member).alias("__last")).where("representative < __last").drop("__last")
    members = df.select(group, F.col(member).alias("member")).distinct()
    return skew_join(members, first, group).where("member <> representative").select(group, "representative", "member")
