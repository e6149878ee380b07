"""Ranking metrics, losses and summaries of runs.

Ranked lists are rows (query, rank_no, item) with ranks from 1; relevant items are rows (query, item). Metrics are
taken per query, over the queries with relevant items, and then averaged; a query without a list counts as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def per_query(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, n_relevant, hits, gain, first_hit) over the first k ranks. Repeated items count at their best rank.
    Where relevant is (query_id, n_relevant), the ranked items hold their label, and no list of relevant items is
    needed."""
    if "n_relevant" in relevant.columns:
        hits = ranked.where((F.col("rank_no") <= k) & (F.col("label") == 1)).groupBy("query_id", "item_id").agg(F.min("rank_no").alias("rank_no"))
        return _with_ranks(relevant.select("query_id", "n_relevant"), hits)
    truth = relevant.select("query_id", "item_id").distinct()
    hits = ranked.where(F.col("rank_no") <= k).groupBy("query_id", "item_id").agg(F.min("rank_no").alias("rank_no")).join(truth, ["query_id", "item_id"], "left_semi")
    return _with_ranks(truth.groupBy("query_id").agg(F.count("*").alias("n_relevant")), hits)


def _with_ranks(owners: DataFrame, hits: DataFrame) -> DataFrame:
    totals = hits.groupBy("query_id").agg(F.collect_list("rank_no").alias("hit_ranks"))
    return owners.join(totals, "query_id", "left").withColumn("hit_ranks", F.coalesce("hit_ranks", F.array().cast("array<int>")))


def _at(k: Column) -> dict[str, Column]:
    ranks = F.filter("hit_ranks", lambda r: r <= k)
    hits = F.size(ranks).cast("double")
    gain = F.aggregate(ranks, F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), k).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    return {
        "precision": hits / k,
        "recall": hits / F.col("n_relevant"),
        "hit_rate": (hits > 0).cast("double"),
        "ndcg": gain / ideal,
        "mrr": F.coalesce(1 / F.array_min(ranks), F.lit(0.0)),
    }


def at_cutoffs(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(k, num_queries, precision, recall, hit_rate, ndcg, mrr) for each cutoff, all in one pass."""
    each = per_query(ranked, relevant, max(ks)).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return each.groupBy("k").agg(F.count("*").alias("num_queries"), *[F.round(F.avg(c), 6).alias(n) for n, c in _at(F.col("k")).items()])


def with_hard_negatives(ranked: DataFrame, relevant: DataFrame, negatives: DataFrame, k: int = 5) -> DataFrame:
    """One row: the metrics at k, and hn_fpr: how often the first rank is a hard negative, over the queries that have
    any (0 if none has)."""
    each = per_query(ranked, relevant, k).select("query_id", *[c.alias(n) for n, c in _at(F.lit(k)).items()])
    owners = negatives.select("query_id").distinct()
    first = ranked.where("rank_no = 1").join(negatives.select("query_id", "item_id").distinct(), ["query_id", "item_id"], "left_semi").select("query_id").distinct().withColumn("wrong", F.lit(1.0))
    fpr = owners.join(first, "query_id", "left").select("query_id", F.coalesce("wrong", F.lit(0.0)).alias("wrong"))
    joined = each.join(fpr, "query_id", "left")
    return joined.agg(
        *[F.round(F.avg(n), 6).alias(f"{n}_at_{k}") for n in ("precision", "recall", "hit_rate", "ndcg", "mrr")],
        F.round(F.coalesce(F.avg("wrong"), F.lit(0.0)), 6).alias("hn_fpr"),
        F.count("*").alias("num_queries"),
        F.count("wrong").alias("num_with_negatives"),
    )


def ceiling(candidates: DataFrame, relevant: DataFrame, k: int, final_k: int = 5) -> DataFrame:
    """One row: what a perfect ranking of the first k candidates could reach."""
    each = per_query(candidates, relevant, k).withColumn("captured", F.size("hit_ranks"))
    return each.agg(
        F.round(F.avg(F.col("captured") / F.col("n_relevant")), 6).alias("candidate_recall"),
        F.round(F.avg((F.col("captured") > 0).cast("double")), 6).alias("candidate_hit"),
        F.round(F.avg((F.col("captured") == F.col("n_relevant")).cast("double")), 6).alias("all_relevant"),
        F.round(F.avg(F.least("captured", F.lit(final_k)) / F.col("n_relevant")), 6).alias("oracle_recall"),
        F.count("*").alias("num_queries"),
    )


def agreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """One row: in how many queries the first k items of two rankings are the same, in the same order."""
    def lists(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(F.col("rank_no") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank_no", "item_id"))).alias("l"))
        return rows.select("query_id", F.transform("l", lambda x: x["item_id"]).alias(name))

    both = lists(a, "a").join(lists(b, "b"), "query_id")
    return both.agg(F.count("*").alias("num_queries"), F.count_if(F.col("a") == F.col("b")).alias("same_lists"), F.count_if(F.get("a", F.lit(0)) == F.get("b", F.lit(0))).alias("same_first"))


def softmax_features(scored: DataFrame) -> DataFrame:
    """scored with z (score against its query's mean and population deviation), share (softmax) and rank_feature
    (1 at the first rank, 0 at the last)."""
    group = W.partitionBy("query_id")
    top = F.exp(F.col("score") - F.max("score").over(group))
    k = F.count("*").over(group)
    return (
        scored.withColumn("z", (F.col("score") - F.avg("score").over(group)) / F.greatest(F.stddev_pop("score").over(group), F.lit(1e-6)))
        .withColumn("top", top)
        .withColumn("share", F.col("top") / F.sum("top").over(group))
        .withColumn("rank_feature", F.when(k == 1, 1.0).otherwise(1 - (F.col("rank_no") - 1) / (k - 1)))
        .drop("top")
    )


def listwise_loss(scored: DataFrame, margin: float = 0.2, weights: tuple[float, float, float] = (1.0, 0.5, 0.2), most: float = 20.0) -> DataFrame:
    """(query_id, listwise, bce, hinge, loss) of candidates (query_id, score, label): log-sum-exp over all minus over
    the positives; weighted binary cross-entropy; hinge of the hardest pair. Queries need both labels."""
    pos, neg = F.col("label") == 1, F.col("label") == 0
    s = F.col("score")
    shifted = scored.withColumn("m", F.max("score").over(W.partitionBy("query_id")))
    ratio = F.least(F.greatest(F.count_if(neg) / F.greatest(F.count_if(pos), F.lit(1)), F.lit(1.0)), F.lit(most))
    softplus = F.log1p(F.exp(-F.abs(s))) + F.greatest(s, F.lit(0.0))  # ln(1 + e^s)
    sums = shifted.groupBy("query_id").agg(
        (F.ln(F.sum(F.exp(s - F.col("m")))) - F.ln(F.sum(F.when(pos, F.exp(s - F.col("m")))))).alias("listwise"),
        ((F.sum(F.when(pos, softplus - s)) * ratio + F.sum(F.when(neg, softplus))) / F.count("*")).alias("bce"),
        F.greatest(F.lit(0.0), F.max(F.when(neg, s)) - F.min(F.when(pos, s)) + margin).alias("hinge"),
    )
    total = sum(F.col(c) * w for c, w in zip(("listwise", "bce", "hinge"), weights))
    return sums.where("listwise is not null and hinge is not null").withColumn("loss", total)


def info_nce(scored: DataFrame, temperature: float = 0.07) -> DataFrame:
    """(query_id, loss): minus the log-share of the positives among all candidates, at a temperature."""
    t = F.col("score") / temperature
    rows = scored.withColumn("m", F.max(t).over(W.partitionBy("query_id")))
    sums = rows.groupBy("query_id").agg(F.sum(F.exp(t - F.col("m"))).alias("a"), F.sum(F.when(F.col("label") == 1, F.exp(t - F.col("m")))).alias("p"))
    return sums.where("p is not null").select("query_id", (F.ln("a") - F.ln("p")).alias("loss"))


def set_loss(scored: DataFrame, temperature: float = 0.07, weights: tuple[float, float] = (0.1, 0.2), positive_weight: float = 2.0) -> DataFrame:
    """(query_id, nce, align, node, loss, node_accuracy): the contrastive loss (null without positives); how far the
    positives' mean score is below 1 and the others' above 0; the weighted cross-entropy of the scores as logits; their
    weighted sum; and how often the sign of the logit is the label."""
    s, pos = F.col("score"), F.col("label") == 1
    softplus = F.log1p(F.exp(-F.abs(s))) + F.greatest(s, F.lit(0.0))
    parts = scored.groupBy("query_id").agg(
        F.avg(F.when(pos, (softplus - s) * positive_weight).otherwise(softplus)).alias("node"),
        F.avg(((1 / (1 + F.exp(-s)) > 0.5).cast("int") == F.col("label")).cast("double")).alias("node_accuracy"),
    )
    means = label_means(scored).select("query_id", (1 - F.col("positive_mean") + F.greatest(F.lit(0.0), F.col("negative_mean"))).alias("align"))
    nce = info_nce(scored, temperature).withColumnRenamed("loss", "nce")
    both = parts.join(means, "query_id").join(nce, "query_id", "left")
    return both.withColumn("loss", F.col("nce") + weights[0] * F.col("align") + weights[1] * F.col("node"))


def label_means(scored: DataFrame) -> DataFrame:
    """(query_id, positive_mean, negative_mean) of the scores; 0 where there is none."""
    def mean(label: int) -> Column:
        hit = F.col("label") == label
        return F.coalesce(F.sum(F.when(hit, F.col("score"))), F.lit(0.0)) / F.greatest(F.count_if(hit), F.lit(1))

    return scored.groupBy("query_id").agg(mean(1).alias("positive_mean"), mean(0).alias("negative_mean"))


def accuracy(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: how often the label is whether the probability of the score reaches the threshold."""
    p = 1 / (1 + F.exp(-F.col("score")))
    return scored.agg(F.round(F.avg(((p >= threshold).cast("int") == F.col("label")).cast("double")), 6).alias("accuracy"), F.count("*").alias("pairs"))


def first_accuracy(scored: DataFrame) -> DataFrame:
    """One row: how often the first rank has label 1, over the queries with candidates."""
    return scored.where("rank_no = 1").agg(F.round(F.avg((F.col("label") == 1).cast("double")), 6).alias("accuracy"), F.count("*").alias("num_queries"))


def missing_runs(rows: DataFrame, groups: list[str], seed: str, expected: range) -> DataFrame:
    """groups and missing: the expected seeds, in order, that a group has no rows of; groups that lack none are left
    out."""
    held = rows.groupBy(*groups).agg(F.collect_set(F.when(F.col(seed).isin(list(expected)), F.col(seed))).alias("held"))
    wanted = F.array(*[F.lit(x).cast(dict(rows.dtypes)[seed]) for x in expected])
    return held.select(*groups, F.array_except(wanted, F.col("held")).alias("missing")).where("size(missing) > 0")


def mean_and_deviation(rows: DataFrame, groups: list[str], seed: str, value: str) -> DataFrame:
    """groups, runs, mean, std: mean and sample deviation over the seeds' means; 0 for one seed."""
    seeds = rows.groupBy(*groups, seed).agg(F.avg(value).alias("v"))
    return seeds.groupBy(*groups).agg(F.count("*").alias("runs"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 6).alias("std"))


def best_first(rows: DataFrame, groups: list[str], step: str, value: str) -> DataFrame:
    """The row with the highest value of each group; of equal ones the first step."""
    best = F.max_by(F.struct(step, value), F.struct(value, -F.col(step).cast("long"))).alias("b")
    return rows.groupBy(*groups).agg(best).select(*groups, F.col(f"b.{step}").alias(step), F.col(f"b.{value}").alias(value))
