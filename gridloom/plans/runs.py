"""Queries on scans, caches of candidates and summaries of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.text import clean_ids
from gridloom.operators import metrics, sampling, vector
from gridloom.plans import retrieval
from gridloom.plans.registry import Registry
from gridloom.plans.texts import ids_sql, trim_sql
from gridloom.runtime import scratch, table
from gridloom.sources import keyed, scans, sinks

queries = Registry()

_EVAL = f"""WITH known AS (SELECT DISTINCT {trim_sql('sheet_id')} AS sheet_id FROM sheets),
b AS (SELECT query_index, any_value({trim_sql('query')}) AS query, any_value({ids_sql('coalesce(positive_sheet_ids, sheet_ids)')}) AS p, any_value({ids_sql('coalesce(hard_negative_sheet_ids, sheet_ids_negative, negative_sheet_ids)')}) AS n
  FROM queries WHERE {trim_sql('query')} <> '' GROUP BY query_index),
i AS (SELECT query_index, 'p' AS role, unnest(p) AS sheet_id, unnest(range(len(p))) AS pos FROM b UNION ALL SELECT query_index, 'n', unnest(n), unnest(range(len(n))) FROM b),
g AS (SELECT query_index, list(sheet_id ORDER BY pos) FILTER (WHERE role = 'p') AS positives, list(sheet_id ORDER BY pos) FILTER (WHERE role = 'n') AS negatives FROM i SEMI JOIN known USING (sheet_id) GROUP BY query_index),
f AS (SELECT query_index, query, positives, coalesce(negatives, []) AS negatives FROM b JOIN g USING (query_index))
"""


@queries.add("evaluation_queries", _EVAL + "SELECT query_index, query, positives, negatives FROM f WHERE len(positives) > 0")
def evaluation_queries(spark: SparkSession, sf: str) -> DataFrame:
    return scans.evaluation_queries(table(spark, sf, "queries"), table(spark, sf, "sheets"))


@queries.add("evaluation_queries_first", _EVAL + "SELECT query_index, query, positives, negatives FROM f WHERE len(positives) > 0 ORDER BY query_index LIMIT 100")
def evaluation_queries_first(spark: SparkSession, sf: str) -> DataFrame:
    return scans.evaluation_queries(table(spark, sf, "queries"), table(spark, sf, "sheets"), most=100)


@queries.add(
    "evaluation_queries_hard",
    _EVAL.replace("coalesce(hard_negative_sheet_ids, sheet_ids_negative, negative_sheet_ids)", "hard_negative_sheet_ids") + "SELECT query_index, query, positives, negatives FROM f WHERE len(positives) > 0",
)
def evaluation_queries_hard(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives only count as negatives."""
    return scans.evaluation_queries(table(spark, sf, "queries"), table(spark, sf, "sheets"), negatives=("hard_negative_sheet_ids",))


@queries.add(
    "workspace_labels",
    f"""WITH known AS (SELECT DISTINCT {trim_sql('sheet_id')} AS sheet_id FROM sheets),
    w AS (SELECT DISTINCT query_index, coalesce(positive_sheet_ids, []) AS p, coalesce(hard_negative_sheet_ids, []) AS n FROM queries),
    u AS (SELECT query_index, p, n, unnest(list_concat(p, n)) AS id, unnest(range(len(p) + len(n))) AS pos FROM w),
    k AS (SELECT query_index, p, n, {trim_sql('id')} AS sheet_id, pos, pos < len(p) AS positive FROM u),
    g AS (SELECT query_index, p, n, list(sheet_id ORDER BY pos) FILTER (WHERE positive) AS positives, list(sheet_id ORDER BY pos) FILTER (WHERE NOT positive) AS negatives FROM k SEMI JOIN known USING (sheet_id) GROUP BY ALL)
    SELECT query_index, coalesce(positives, []) AS positives, coalesce(negatives, []) AS negatives FROM g""",
)
def workspace_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Workspaces of positives and hard negatives with their labels, read back without the unknown ids."""
    none = F.array().cast("array<string>")
    rows = table(spark, sf, "queries").select("query_index", F.coalesce("positive_sheet_ids", none).alias("p"), F.coalesce("hard_negative_sheet_ids", none).alias("n")).distinct()
    labels = F.concat(F.transform("p", lambda x: F.lit(1)), F.transform("n", lambda x: F.lit(0)))
    found = scans.from_workspace(rows.select("query_index", F.concat("p", "n").alias("workspace_sheet_ids"), labels.alias("labels")), table(spark, sf, "sheets"))
    return found.where("positives is not null").select("query_index", "positives", "negatives")


@queries.add(
    "pair_encodings",
    "WITH e AS (SELECT DISTINCT edge_batch_id, trim(p[1]) AS a, trim(p[2]) AS b FROM (SELECT edge_batch_id, unnest(edges) AS p FROM dependency_edges) WHERE len(p) = 2) SELECT a AS id_1, b AS id_2, CAST(edge_batch_id % 2 AS INTEGER) AS label, count(*) AS pairs FROM e GROUP BY ALL",
)
def pair_encodings(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs written in three ways, by batch, and read back from whichever is there."""
    edges = table(spark, sf, "dependency_edges").select("edge_batch_id", F.explode("edges").alias("p")).where("size(p) = 2")
    e = edges.select("edge_batch_id", F.trim(F.get("p", F.lit(0))).alias("a"), F.trim(F.get("p", F.lit(1))).alias("b")).distinct()
    way = lambda k, c: F.when(F.col("edge_batch_id") % 3 == k, F.col(c))
    forms = {"table1": F.struct(way(0, "a").alias("sheet_id")), "table2": F.struct(way(0, "b").alias("sheet_id")), "sheet_a": way(1, "a"), "sheet_b": way(1, "b"), "sheet_id_1": way(2, "a"), "sheet_id_2": way(2, "b")}
    written = e.select(*[c.alias(n) for n, c in forms.items()], (F.col("edge_batch_id") % 2).cast("int").alias("label"))
    return scans.pair_ids(written).groupBy("id_1", "id_2", "label").agg(F.count("*").alias("pairs"))


@queries.add(
    "enriched_headers",
    "SELECT sheet_id, loaded_at, unnest(range(len(columns))) AS col_idx, coalesce(unnest(columns).name, '') AS text, 'unknown' AS dtype, false AS is_numeric, 0.0::DOUBLE AS null_ratio FROM sheets",
)
def enriched_headers(spark: SparkSession, sf: str) -> DataFrame:
    each = scans.enriched_headers(table(spark, sf, "sheets")).select("sheet_id", "loaded_at", F.explode("headers").alias("h"))
    return each.select("sheet_id", "loaded_at", F.col("h.col_idx").cast("long").alias("col_idx"), "h.text", "h.dtype", "h.value_stats.is_numeric", "h.value_stats.null_ratio")


def _cached(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ranked = retrieval.candidates(spark, sf).select(F.col("query_id").alias("query_index"), "rank_no", F.col("item_id").alias("sheet_id"), "score")
    asked = table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_index"), F.concat(F.lit("query "), "vec_id").alias("query"))
    return ranked, asked


@queries.add("cache_export", retrieval._SQL + "SELECT query_id AS query_index, 'query ' || query_id AS query, list(item_id ORDER BY rank_no) AS candidate_sheet_ids, list(round(score, 8) ORDER BY rank_no) AS candidate_scores FROM c GROUP BY query_id")
def cache_export(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.export_lists(*_cached(spark, sf))


@queries.add("cache_import", retrieval._SQL + "SELECT query_id AS query_index, list(item_id ORDER BY rank_no)[1:5] AS candidate_sheet_ids, list(round(score, 8) ORDER BY rank_no)[1:5] AS candidate_scores FROM c GROUP BY query_id")
def cache_import(spark: SparkSession, sf: str) -> DataFrame:
    ranked, asked = _cached(spark, sf)
    return sinks.import_lists(sinks.export_lists(ranked, asked), asked, 5)


@queries.add(
    "agreement_by_text",
    """WITH a AS (SELECT DISTINCT query_index, query, coalesce(positive_sheet_ids, sheet_ids, []) AS ids FROM queries WHERE trim(query) <> ''),
    last AS (SELECT query, max(query_index) AS query_index FROM a GROUP BY query), b AS (SELECT a.query, a.ids FROM a JOIN last USING (query, query_index))
    SELECT count(*) AS rows, count(*) FILTER (WHERE a.ids = b.ids) AS same_lists, count(*) FILTER (WHERE coalesce(a.ids[1], '') = coalesce(b.ids[1], '')) AS same_first FROM a JOIN b ON a.query = b.query""",
)
def agreement_by_text(spark: SparkSession, sf: str) -> DataFrame:
    """Each record's positives against those of the last record with the same text."""
    rows = table(spark, sf, "queries").where("trim(query) <> ''").select("query_index", "query", F.coalesce("positive_sheet_ids", "sheet_ids", F.array().cast("array<string>")).alias("ids")).distinct()
    last = rows.groupBy("query").agg(F.max_by("ids", "query_index").alias("other"))
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    return rows.join(last, "query").agg(F.count("*").alias("rows"), F.count_if(F.col("ids") == F.col("other")).alias("same_lists"), F.count_if(first("ids") == first("other")).alias("same_first"))


@queries.add(
    "epoch_positive",
    f"""WITH p AS (SELECT DISTINCT query_index, unnest({ids_sql('coalesce(positive_sheet_ids, sheet_ids)')}) AS sheet_id FROM queries), e AS (SELECT unnest([0, 1, 2]) AS epoch),
    r AS (SELECT query_index, epoch, sheet_id, row_number() OVER (PARTITION BY query_index, epoch ORDER BY md5('42:' || epoch || ':' || query_index || ':' || sheet_id), encode(sheet_id)) AS n FROM p, e)
    SELECT query_index, epoch, sheet_id FROM r WHERE n = 1""",
)
def epoch_positive(spark: SparkSession, sf: str) -> DataFrame:
    """The positive that each of three epochs trains a query with."""
    ids = F.array_distinct(clean_ids(F.coalesce("positive_sheet_ids", "sheet_ids")))
    rows = table(spark, sf, "queries").select("query_index", F.explode(ids).alias("sheet_id")).distinct().withColumn("epoch", F.explode(F.array(*map(F.lit, range(3)))))
    lot = sampling.lot(42, F.col("epoch").cast("string"), F.col("query_index").cast("string"), "sheet_id")
    return rows.groupBy("query_index", "epoch").agg(F.min_by("sheet_id", F.struct(lot, "sheet_id")).alias("sheet_id"))


@queries.add(
    "entropy_summary",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c),
    u AS (SELECT user_id, -sum(p * ln(p + 1e-10)) / ln(5) AS h FROM p GROUP BY user_id) SELECT count(*) AS users, round(avg(h), 6) AS mean_entropy, round(max(h), 6) AS max_entropy FROM u""",
)
def entropy_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised entropy of the event types of each user (five types)."""
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("user_id")))
    h = p.groupBy("user_id").agg((-F.sum(F.col("p") * F.log(F.col("p") + 1e-10)) / F.log(F.lit(5.0))).alias("h"))
    return h.agg(F.count("*").alias("users"), F.round(F.avg("h"), 6).alias("mean_entropy"), F.round(F.max("h"), 6).alias("max_entropy"))


@queries.add(
    "sweep_summary",
    retrieval._METRICS.replace("unnest([1, 3, 5, 10])", "unnest([2, 4, 6, 8, 10])")
    + ", m AS (SELECT k AS setting, round(avg(hits / n), 6) AS recall, round(avg(gain / best), 6) AS ndcg FROM q GROUP BY k) SELECT *, ndcg = (SELECT max(ndcg) FROM m) AS best, (SELECT min(least(recall, ndcg)) FROM m) AS axis_from FROM m",
)
def sweep_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics of each setting of the candidate count, which is best, and where a figure's axis would begin."""
    m = metrics.at_cutoffs(retrieval.labelled(spark, sf), retrieval.relevant(spark, sf), (2, 4, 6, 8, 10)).select(F.col("k").alias("setting"), "recall", "ndcg")
    top, least = m.agg(F.max("ndcg")).scalar(), m.agg(F.min(F.least("recall", "ndcg"))).scalar()
    return m.select("setting", "recall", "ndcg", (F.col("ndcg") == top).alias("best"), least.alias("axis_from"))


@queries.add(
    "pooled_vectors",
    """WITH v AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, 65)) AS dim FROM embeddings) SELECT label, dim, round(avg(x), 6) AS mean, round(max(x), 6) AS most FROM v GROUP BY ALL""",
)
def pooled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and maximum of the vectors of each label, by dimension."""
    v = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("at", "x")).select("label", (F.col("at") + 1).cast("long").alias("dim"), F.col("x").cast("double").alias("x"))
    return v.groupBy("label", "dim").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.max("x"), 6).alias("most"))


@queries.add(
    "pooled_tokens",
    """WITH v AS (SELECT label, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings)
    SELECT label, dim, round(arg_min(x, vec_id), 6) AS cls, round(avg(x) FILTER (WHERE vec_id % 3 <> 0), 6) AS mean, round(max(x) FILTER (WHERE vec_id % 3 <> 0), 6) AS most FROM v GROUP BY ALL""",
)
def pooled_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as the tokens of a text per label, in the order of their ids; those divisible by 3 are padding."""
    pooled = vector.pooled_tokens(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", F.col("vec_id") % 3 != 0)
    return pooled.select("label", "dim", *[F.round(c, 6).alias(c) for c in ("cls", "mean", "most")])


_SPLIT = "coalesce(nullif(regexp_replace(lower(split), '[^a-z]', '', 'g'), ''), 'none')"


@queries.add("split_files", f"SELECT {_SPLIT} AS split, count(*) AS rows, count(DISTINCT query_index) AS records FROM queries GROUP BY 1")
def split_files(spark: SparkSession, sf: str) -> DataFrame:
    """Records written to one folder per split, and counted as read back."""
    split = F.coalesce(F.nullif(F.regexp_replace(F.lower("split"), "[^a-z]", ""), F.lit("")), F.lit("none"))
    at = scratch(spark, "split-files")
    sinks.write_splits(table(spark, sf, "queries").select("query_index", "query", split.alias("split")), at)
    return spark.read.schema("query_index long, query string, split string").json(at).groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("query_index").alias("records"))


@queries.add("report_round_trip", f"SELECT {_SPLIT} AS split, count(*) AS rows FROM queries GROUP BY 1")
def report_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A report of the rows per split, written as one file and read back by its keys. Splits are few by nature."""
    split = F.coalesce(F.nullif(F.regexp_replace(F.lower("split"), "[^a-z]", ""), F.lit("")), F.lit("none"))
    counts = table(spark, sf, "queries").groupBy(split.alias("split")).count().collect()
    at = f"{scratch(spark, 'report')}/report.json"
    sinks.write_json(at, {r.split: {"rows": r["count"]} for r in counts})
    return keyed.records(spark, at).select(F.col("key").alias("split"), F.expr("try_variant_get(record, '$.rows', 'bigint')").alias("rows"))


@queries.add(
    "usage_by_query",
    """SELECT query_index, count(*) AS attempts, count(*) FILTER (WHERE status = 'succeeded') AS succeeded, CAST(coalesce(sum(coalesce(prompt_tokens, 0) + coalesce(output_tokens, 0)), 0) AS BIGINT) AS tokens,
    bool_or(coalesce(status = 'succeeded', false)) AS answered FROM rag GROUP BY query_index""",
)
def usage_by_query(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts and tokens of each query; failed rows count as attempts without an answer."""
    ok = F.col("status") == "succeeded"
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return table(spark, sf, "rag").groupBy("query_index").agg(F.count("*").alias("attempts"), F.count_if(ok).alias("succeeded"), F.sum(tokens).alias("tokens"), F.bool_or(F.coalesce(ok, F.lit(False))).alias("answered"))
