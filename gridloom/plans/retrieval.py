"""Queries on retrieval, ranking metrics and losses.

Queries are the embeddings whose id is divisible by 50, the corpus is every embedding. An item is relevant to a query,
wherever it is, if it has the query's label, and a hard negative if it has another label and the query's remainder by
7. Candidates are labelled by comparing the two labels; how many relevant items a query has follows from counts per
label, so no table of pairs is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.text import clean_ids
from gridloom.operators import metrics, mining, quantiles, vector
from gridloom.plans.registry import Registry
from gridloom.plans.texts import ids_sql
from gridloom.runtime import table

queries = Registry()
K = 10
#: New hard negatives for each existing pair.
RATIO = 0.3


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "embeddings")
    return rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


def candidates(spark: SparkSession, sf: str, k: int = K, cosine: bool = False) -> DataFrame:
    return vector.top_k(*_sides(spark, sf), k, cosine)


def labelled(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    """Candidates with label (1 if relevant, else 0) and hard (a hard negative or not)."""
    rows = table(spark, sf, "embeddings")
    own, its = rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), rows.select(F.col("vec_id").alias("item_id"), F.col("label").alias("its"))
    both = candidates(spark, sf, k).join(own, "query_id").join(its, "item_id")
    hard = F.expr("coalesce(own <> its and query_id % 7 = item_id % 7, false)")
    return both.withColumn("label", F.coalesce((F.col("own") == F.col("its")).cast("int"), F.lit(0))).withColumn("hard", hard).drop("own", "its")


def _counted(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, n_relevant, n_hard): how many items have the query's label, itself apart, and how many another one
    and its remainder, from counts per label and remainder."""
    rows = table(spark, sf, "embeddings").where("label is not null").select("vec_id", "label", (F.col("vec_id") % 7).alias("rest"))
    cells = rows.groupBy("label", "rest").count()
    labels, rests = cells.groupBy("label").agg(F.sum("count").alias("alike")), cells.groupBy("rest").agg(F.sum("count").alias("near"))
    mine = rows.where("vec_id % 50 = 0").join(labels, "label").join(rests, "rest").join(cells, ["label", "rest"])
    return mine.select(F.col("vec_id").alias("query_id"), (F.col("alike") - 1).alias("n_relevant"), (F.col("near") - F.col("count")).alias("n_hard"))


def relevant(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, n_relevant) of the queries with relevant items."""
    return _counted(spark, sf).where("n_relevant > 0")


_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, list_dot_product(a.e, b.e) AS score, list_cosine_similarity(a.e, b.e) AS cos,
        a.label = b.label AS rel,
        a.label <> b.label AND a.vec_id % 7 = b.vec_id % 7 AS hn
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank_no,
        CAST(row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, item_id) AS INTEGER) AS cos_rank FROM s),
c AS (SELECT query_id, item_id, score, rank_no, CAST(rel AS INTEGER) AS label FROM r WHERE rank_no <= 10)
"""


@queries.add("topk_dot", _SQL + "SELECT query_id, item_id, round(score, 6) AS score, rank_no FROM c")
def topk_dot(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).select("query_id", "item_id", F.round("score", 6).alias("score"), "rank_no")


@queries.add("topk_cosine", _SQL + "SELECT query_id, item_id, round(cos, 6) AS score, cos_rank AS rank_no FROM r WHERE cos_rank <= 10")
def topk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf, cosine=True).select("query_id", "item_id", F.round("score", 6).alias("score"), "rank_no")


@queries.add("candidate_labels", _SQL + "SELECT query_id, item_id, rank_no, label FROM c")
def candidate_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).select("query_id", "item_id", "rank_no", "label")


@queries.add(
    "topk_workspace_then_final",
    _SQL
    + """, b AS (SELECT *, 0.7 / (1 + exp(-5 * score)) + 0.3 * greatest(0, score) AS final FROM c),
    f AS (SELECT query_id, item_id, round(final, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final DESC, rank_no) AS INTEGER) AS rank_no FROM b)
    SELECT * FROM f WHERE rank_no <= 5""",
)
def topk_workspace_then_final(spark: SparkSession, sf: str) -> DataFrame:
    final = 0.7 / (1 + F.exp(-5 * F.col("score"))) + 0.3 * F.greatest(F.lit(0.0), F.col("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("final"), "before")
    again = candidates(spark, sf).withColumnRenamed("rank_no", "before").withColumn("final", final).withColumn("rank_no", F.row_number().over(best))
    return again.where("rank_no <= 5").select("query_id", "item_id", F.round("final", 6).alias("score"), "rank_no")


@queries.add(
    "topk_workspace_by_name",
    _SQL
    + """, b AS (SELECT c.*, v.label AS name, 0.7 / (1 + exp(-5 * score)) + 0.3 * greatest(0, score) AS final FROM c JOIN v ON v.vec_id = c.item_id),
    d AS (SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY final DESC, rank_no) AS i FROM b),
    f AS (SELECT query_id, item_id, name, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final DESC, rank_no) AS INTEGER) AS rank_no FROM d WHERE i = 1) SELECT * FROM f WHERE rank_no <= 5""",
)
def topk_workspace_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """The five best of the workspace after scoring again, the best of each name only; the label serves as the name."""
    final = 0.7 / (1 + F.exp(-5 * F.col("score"))) + 0.3 * F.greatest(F.lit(0.0), F.col("score"))
    names = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("name"))
    again = candidates(spark, sf).join(names, "item_id").withColumn("final", final)
    first = again.withColumn("i", F.row_number().over(W.partitionBy("query_id", "name").orderBy(F.desc("final"), "rank_no"))).where("i = 1")
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("final"), "rank_no"))).where("rank <= 5")
    return ranked.select("query_id", "item_id", "name", F.col("rank").alias("rank_no"))


@queries.add(
    "activations",
    _SQL
    + """, p AS (SELECT *, 1 / (1 + exp(-score)) AS p, least(greatest(1 / (1 + exp(-score)), 1e-6), 1 - 1e-6) AS q FROM c)
    SELECT query_id, item_id, round(p, 6) AS sigmoid, round(greatest(0, score), 6) AS relu, round(CASE WHEN score > 0 THEN score ELSE 0.2 * score END, 6) AS leaky,
    round(score / 2 * (1 + tanh(sqrt(2 / pi()) * (score + 0.044715 * score * score * score))), 6) AS gelu, round(-(q * ln(q) + (1 - q) * ln(1 - q)), 6) AS entropy FROM p""",
)
def activations(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).select("query_id", "item_id", *[F.round(c, 6).alias(n) for n, c in vector.activations(F.col("score")).items()])


@queries.add(
    "rerank_blend",
    _SQL
    + """SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY label + 0.5 * score DESC, rank_no) AS INTEGER) AS rank_no,
    round(label + 0.5 * score, 6) AS blended FROM c""",
)
def rerank_blend(spark: SparkSession, sf: str) -> DataFrame:
    blended = labelled(spark, sf).withColumn("blended", F.col("label") + 0.5 * F.col("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("blended"), "rank_no")
    return blended.select("query_id", "item_id", F.row_number().over(order).alias("rank_no"), F.round("blended", 6).alias("blended"))


@queries.add("first_nonpositive", _SQL + "SELECT query_id, arg_min(item_id, rank_no) AS item_id, min(rank_no) AS rank_no FROM c WHERE label = 0 GROUP BY query_id")
def first_nonpositive(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).where("label = 0").groupBy("query_id").agg(F.min_by("item_id", "rank_no").alias("item_id"), F.min("rank_no").alias("rank_no"))


@queries.add(
    "pos2_neg8_pairs",
    _SQL + """, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank_no) AS i FROM c)
    SELECT query_id, item_id, label FROM n WHERE i <= CASE label WHEN 1 THEN 2 ELSE 8 END""",
)
def pos2_neg8_pairs(spark: SparkSession, sf: str) -> DataFrame:
    numbered = labelled(spark, sf).withColumn("i", F.row_number().over(W.partitionBy("query_id", "label").orderBy("rank_no")))
    return numbered.where("i <= case label when 1 then 2 else 8 end").select("query_id", "item_id", "label")


@queries.add(
    "score_features",
    _SQL
    + """SELECT query_id, item_id, round((score - avg(score) OVER g) / greatest(stddev_pop(score) OVER g, 1e-6), 6) AS z,
    round(exp(score - max(score) OVER g) / sum(exp(score)) OVER g * exp(max(score) OVER g), 6) AS share, round(1 - (rank_no - 1) / 9.0, 6) AS rank_feature
    FROM c WINDOW g AS (PARTITION BY query_id)""",
)
def score_features(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.softmax_features(candidates(spark, sf)).select("query_id", "item_id", *[F.round(c, 6).alias(c) for c in ("z", "share", "rank_feature")])


_METRICS = _SQL + """,
rel AS (SELECT query_id, count(*) AS n FROM s WHERE rel GROUP BY query_id),
ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
ideal AS (SELECT query_id, n, k, (SELECT sum(1 / log2(i + 1)) FROM unnest(range(1, least(n, k)::BIGINT + 1)) t(i)) AS best FROM rel, ks),
q AS (SELECT i.query_id, i.k, i.n, i.best, count(c.item_id) AS hits, coalesce(sum(1 / log2(c.rank_no + 1)), 0) AS gain, min(c.rank_no) AS first
      FROM ideal i LEFT JOIN c ON c.query_id = i.query_id AND c.label = 1 AND c.rank_no <= i.k GROUP BY ALL)
"""
_MEANS = "round(avg(hits / k), 6) AS precision{0}, round(avg(hits / n), 6) AS recall{0}, round(avg(CAST(hits > 0 AS INTEGER)), 6) AS hit_rate{0}, round(avg(gain / best), 6) AS ndcg{0}, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr{0}"


@queries.add("metrics_at_ks", _METRICS + f"SELECT k, count(*) AS num_queries, {_MEANS.format('')} FROM q GROUP BY k")
def metrics_at_ks(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.at_cutoffs(labelled(spark, sf), relevant(spark, sf))


@queries.add(
    "metrics_hn_fpr",
    _METRICS
    + f"""SELECT {_MEANS.format('_at_5')}, round(coalesce(avg(w.wrong), 0), 6) AS hn_fpr, count(*) AS num_queries, count(w.wrong) AS num_with_negatives
    FROM q LEFT JOIN (SELECT query_id, max(CAST(hn AND rank_no = 1 AS DOUBLE)) AS wrong FROM r GROUP BY query_id HAVING bool_or(hn)) w USING (query_id) WHERE k = 5""",
)
def metrics_hn_fpr(spark: SparkSession, sf: str) -> DataFrame:
    found, counted = labelled(spark, sf), _counted(spark, sf)
    owners = counted.where("n_hard > 0").select("query_id", F.lit(None).cast("long").alias("item_id"))
    return metrics.with_hard_negatives(found, counted.where("n_relevant > 0"), owners.unionByName(found.where("hard").select("query_id", "item_id")))


@queries.add(
    "candidate_ceiling",
    _METRICS
    + """SELECT round(avg(hits / n), 6) AS candidate_recall, round(avg(CAST(hits > 0 AS DOUBLE)), 6) AS candidate_hit, round(avg(CAST(hits = n AS DOUBLE)), 6) AS all_relevant,
    round(avg(least(hits, 5) / n), 6) AS oracle_recall, count(*) AS num_queries FROM q WHERE k = 10""",
)
def candidate_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ceiling(labelled(spark, sf), relevant(spark, sf), K)


@queries.add(
    "exact_topk_agreement",
    _SQL
    + """, l AS (SELECT query_id, list(item_id ORDER BY rank_no) FILTER (WHERE rank_no <= 5) AS a, list(item_id ORDER BY cos_rank) FILTER (WHERE cos_rank <= 5) AS b FROM r GROUP BY query_id)
    SELECT count(*) AS num_queries, count_if(a = b)::BIGINT AS same_lists, count_if(a[1] = b[1])::BIGINT AS same_first FROM l""",
)
def exact_topk_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.agreement(candidates(spark, sf), candidates(spark, sf, cosine=True), 5)


@queries.add(
    "masked_pos_neg_means",
    _SQL + """SELECT query_id, round(coalesce(avg(score) FILTER (WHERE label = 1), 0), 6) AS positive_mean, round(coalesce(avg(score) FILTER (WHERE label = 0), 0), 6) AS negative_mean FROM c GROUP BY query_id""",
)
def masked_pos_neg_means(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.label_means(labelled(spark, sf)).select("query_id", F.round("positive_mean", 6).alias("positive_mean"), F.round("negative_mean", 6).alias("negative_mean"))


@queries.add("threshold_accuracy", _SQL + "SELECT round(avg(CAST(CAST(1 / (1 + exp(-score)) >= 0.5 AS INTEGER) = label AS DOUBLE)), 6) AS accuracy, count(*) AS pairs FROM c")
def threshold_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.accuracy(labelled(spark, sf))


@queries.add(
    "listwise_loss",
    _SQL
    + """, t AS (SELECT query_id, ln(sum(exp(score))) - ln(sum(exp(score)) FILTER (WHERE label = 1)) AS listwise,
      (sum(ln(1 + exp(score)) - score) FILTER (WHERE label = 1) * least(greatest(count(*) FILTER (WHERE label = 0) / greatest(count(*) FILTER (WHERE label = 1), 1), 1.0), 20.0) + sum(ln(1 + exp(score))) FILTER (WHERE label = 0)) / count(*) AS bce,
      greatest(0, max(score) FILTER (WHERE label = 0) - min(score) FILTER (WHERE label = 1) + 0.2) AS hinge, bool_or(label = 1) AND bool_or(label = 0) AS ok FROM c GROUP BY query_id)
    SELECT query_id, round(listwise, 6) AS listwise, round(bce, 6) AS bce, round(hinge, 6) AS hinge, round(listwise + 0.5 * bce + 0.2 * hinge, 6) AS loss FROM t WHERE ok""",
)
def listwise_loss(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.listwise_loss(labelled(spark, sf)).select("query_id", *[F.round(c, 6).alias(c) for c in ("listwise", "bce", "hinge", "loss")])


@queries.add("infonce_loss", _SQL + "SELECT query_id, round(ln(sum(exp(score / 0.07))) - ln(sum(exp(score / 0.07)) FILTER (WHERE label = 1)), 6) AS loss FROM c GROUP BY query_id HAVING bool_or(label = 1)")
def infonce_loss(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.info_nce(labelled(spark, sf)).select("query_id", F.round("loss", 6).alias("loss"))


_PAIRS = f"""WITH q AS (SELECT DISTINCT query_index, {ids_sql('coalesce(positive_sheet_ids, sheet_ids, [])')} AS p, {ids_sql('coalesce(hard_negative_sheet_ids, [])')} AS n FROM queries), e AS (SELECT p, n, unnest(p) AS a FROM q),
pairs AS (SELECT DISTINCT a, b, 1 AS label FROM (SELECT a, unnest(p) AS b FROM e) WHERE a < b UNION ALL SELECT DISTINCT a, b, 0 FROM (SELECT a, unnest(n) AS b FROM e) WHERE a <> b),
d AS (SELECT sheet_id AS id, min(doc_id) AS doc_id FROM documents WHERE sheet_id IS NOT NULL GROUP BY sheet_id),
v AS (SELECT id, source, CAST(embedding AS DOUBLE[]) AS e FROM d JOIN documents USING (doc_id) JOIN embeddings ON vec_id = doc_id WHERE embedding IS NOT NULL)
"""


def sheet_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(a, b, label) of every existing pair: two positive sheets of a query with label 1, a positive and a hard
    negative one with 0."""
    ids = lambda *c: F.array_distinct(clean_ids(F.coalesce(*c, F.array().cast("array<string>"))))
    each = table(spark, sf, "queries").select(ids("positive_sheet_ids", "sheet_ids").alias("p"), ids("hard_negative_sheet_ids").alias("n")).select("p", "n", F.explode("p").alias("a"))
    alike = each.select("a", F.explode("p").alias("b"), F.lit(1).alias("label")).where("a < b").distinct()
    return alike.unionByName(each.select("a", F.explode("n").alias("b"), F.lit(0).alias("label")).where("a <> b").distinct())


def sheet_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(id, source, vector) of each sheet whose first document has an embedding."""
    first = table(spark, sf, "documents").where("sheet_id is not null").groupBy(F.col("sheet_id").alias("id")).agg(F.min_by("source", "doc_id").alias("source"), F.min("doc_id").alias("vec_id"))
    return first.join(table(spark, sf, "embeddings"), "vec_id").where("embedding is not null").select("id", "source", F.col("embedding").alias("vector"))


@queries.add(
    "set_loss",
    _SQL
    + """, t AS (SELECT query_id, CASE WHEN bool_or(label = 1) THEN ln(sum(exp(score / 0.07))) - ln(sum(exp(score / 0.07)) FILTER (WHERE label = 1)) END AS nce,
      1 - coalesce(avg(score) FILTER (WHERE label = 1), 0) + greatest(0, coalesce(avg(score) FILTER (WHERE label = 0), 0)) AS align,
      avg(CASE label WHEN 1 THEN 2 * (ln(1 + exp(score)) - score) ELSE ln(1 + exp(score)) END) AS node, avg(CAST(CAST(1 / (1 + exp(-score)) > 0.5 AS INTEGER) = label AS DOUBLE)) AS node_accuracy FROM c GROUP BY query_id)
    SELECT query_id, round(nce, 6) AS nce, round(align, 6) AS align, round(node, 6) AS node, round(nce + 0.1 * align + 0.2 * node, 6) AS loss, round(node_accuracy, 6) AS node_accuracy FROM t""",
)
def set_loss(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.set_loss(labelled(spark, sf)).select("query_id", *[F.round(c, 6).alias(c) for c in ("nce", "align", "node", "loss", "node_accuracy")])


@queries.add("argmax_accuracy", _SQL + "SELECT round(avg(CAST(label = 1 AS DOUBLE)), 6) AS accuracy, count(*) AS num_queries FROM c WHERE rank_no = 1")
def argmax_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """How often the best candidate is relevant."""
    return metrics.first_accuracy(labelled(spark, sf))


@queries.add(
    "band_pairs_same_source",
    _PAIRS
    + """, m AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.e, y.e) AS s FROM v x JOIN v y ON x.source = y.source AND x.id < y.id WHERE list_cosine_similarity(x.e, y.e) BETWEEN 0.3 AND 0.6),
    n AS (SELECT *, row_number() OVER (ORDER BY a, b) AS i FROM m ANTI JOIN (SELECT least(a, b) AS a, greatest(a, b) AS b FROM pairs) k USING (a, b))
    SELECT a, b, round(s, 6) AS similarity FROM n WHERE i <= floor((SELECT count(*) FROM pairs) * RATIO)""".replace("RATIO", str(RATIO)),
)
def band_pairs_same_source(spark: SparkSession, sf: str) -> DataFrame:
    """New pairs of sheets of the same source whose similarity lies in the band, up to RATIO times the existing pairs."""
    return mining.hard_negatives(sheet_vectors(spark, sf), sheet_pairs(spark, sf), RATIO).select("a", "b", F.round("similarity", 6).alias("similarity"))


@queries.add("label_audit", _PAIRS + "SELECT a, b, label, round(list_cosine_similarity(x.e, y.e), 6) AS similarity, 1 AS new_label FROM pairs JOIN v x ON x.id = a JOIN v y ON y.id = b WHERE label = 0 AND list_cosine_similarity(x.e, y.e) > 0.7")
def label_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Every existing pair with label 0 that is more alike than the limit."""
    return mining.label_audit(sheet_pairs(spark, sf), sheet_vectors(spark, sf)).select("a", "b", "label", F.round("similarity", 6).alias("similarity"), "new_label")


_RUNS = "WITH e AS (SELECT event_type, user_id % 3 AS seed, CAST(ts AS DATE) AS epoch, value FROM events WHERE value IS NOT NULL)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("value is not null").select("event_type", (F.col("user_id") % 3).alias("seed"), F.to_date("ts").alias("epoch"), "value")


@queries.add("seed_mean_std", _RUNS + ", s AS (SELECT event_type, seed, avg(value) AS v FROM e GROUP BY ALL) SELECT event_type, count(*) AS runs, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std FROM s GROUP BY ALL")
def seed_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.mean_and_deviation(_runs(spark, sf), ["event_type"], "seed", "value")


@queries.add(
    "seed_missing",
    _RUNS + ", t AS (SELECT DISTINCT event_type FROM e), w AS (SELECT event_type, unnest(range(5)) AS seed FROM t) SELECT event_type, list(seed ORDER BY seed) AS missing FROM w ANTI JOIN e USING (event_type, seed) GROUP BY event_type",
)
def seed_missing(spark: SparkSession, sf: str) -> DataFrame:
    """The seeds from 0 to 4 that a method has no run of."""
    return metrics.missing_runs(_runs(spark, sf), ["event_type"], "seed", range(5))


@queries.add("epoch_band", _RUNS + ", s AS (SELECT event_type, epoch, seed, avg(value) AS v FROM e GROUP BY ALL) SELECT event_type, epoch, count(*) AS runs, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std FROM s GROUP BY ALL")
def epoch_band(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.mean_and_deviation(_runs(spark, sf), ["event_type", "epoch"], "seed", "value")


@queries.add(
    "best_epoch_first_wins",
    _RUNS
    + """, s AS (SELECT event_type, seed, date_diff('day', DATE '1970-01-01', epoch) AS epoch, round(avg(value), 2) AS metric FROM e GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY event_type, seed ORDER BY metric DESC, epoch) AS i FROM s) SELECT event_type, seed, epoch, metric FROM n WHERE i = 1""",
)
def best_epoch_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    days = _runs(spark, sf).withColumn("epoch", F.datediff("epoch", F.lit("1970-01-01").cast("date")).cast("long")).groupBy("event_type", "seed", "epoch").agg(F.round(F.avg("value"), 2).alias("metric"))
    return metrics.best_first(days, ["event_type", "seed"], "epoch", "metric")


_LATENCY = """WITH l AS (SELECT coalesce(status, 'unknown') AS status, latency_seconds * 1000 AS ms FROM rag WHERE latency_seconds IS NOT NULL),
  o AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY status) AS n FROM l),
  p AS (SELECT status, count(*) AS samples, round(avg(ms), 3) AS mean_ms, round((min(ms) FILTER (WHERE i = (n - 1) // 2) + min(ms) FILTER (WHERE i = n // 2)) / 2, 3) AS median_ms,
    round(min(ms) FILTER (WHERE i = CAST(round_even((n - 1) * 0.95::DOUBLE, 0) AS BIGINT)), 3) AS p95_ms, round(stddev_pop(ms), 3) AS std_ms FROM o GROUP BY status) """


def _latency(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "rag").where("latency_seconds is not null").select(F.coalesce("status", F.lit("unknown")).alias("status"), (F.col("latency_seconds") * 1000).alias("ms"))
    n = F.col("n")
    at = {"lower": F.floor((n - 1) / 2), "upper": F.floor(n / 2), "p95": F.bround((n - 1) * 0.95)}
    out = rows.groupBy("status").agg(F.count("*").alias("samples"), F.round(F.avg("ms"), 3).alias("mean_ms"), F.round(F.stddev_pop("ms"), 3).alias("std_ms"))
    out = out.join(quantiles.values_at_ranks(rows, "status", "ms", at), "status")
    return out.select("status", "samples", "mean_ms", F.round((F.col("lower") + F.col("upper")) / 2, 3).alias("median_ms"), F.round("p95", 3).alias("p95_ms"), "std_ms")


@queries.add("latency_summary", _LATENCY + "SELECT * FROM p")
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _latency(spark, sf)


@queries.add(
    "latency_derived",
    """WITH m AS (SELECT shard_no AS stage, avg(latency_seconds * 1000) AS ms FROM rag WHERE latency_seconds IS NOT NULL AND shard_no IS NOT NULL GROUP BY shard_no)
    SELECT stage, round(CASE WHEN stage = 0 THEN ms ELSE ms + (SELECT ms FROM m WHERE stage = 0) END, 3) AS end_to_end_ms FROM m""",
)
def latency_derived(spark: SparkSession, sf: str) -> DataFrame:
    """The first shard stands for the first stage: what it takes alone, and with each later stage behind it."""
    rows = table(spark, sf, "rag").where("latency_seconds is not null and shard_no is not null")
    means = rows.groupBy(F.col("shard_no").alias("stage")).agg(F.avg(F.col("latency_seconds") * 1000).alias("ms"))
    first = means.where("stage = 0").agg(F.max("ms")).scalar()
    return means.select("stage", F.round(F.when(F.col("stage") == 0, F.col("ms")).otherwise(F.col("ms") + first), 3).alias("end_to_end_ms"))


@queries.add(
    "token_usage",
    """SELECT count(*) AS rows, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
    count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed, round(avg(coalesce(latency_seconds, 0)), 6) AS mean_latency FROM rag""",
)
def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "rag").agg(
        F.count("*").alias("rows"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "output_tokens")],
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(F.avg(F.coalesce("latency_seconds", F.lit(0.0))), 6).alias("mean_latency"),
    )
