"""The queries of the problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import canonical, lookalike, overlap, packing, reading, tokens, topn
from gridloom.plans.registry import Registry
from gridloom.runtime import table

queries = Registry()

_BLANKS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_P1 = f"""
WITH c AS (
  SELECT query_index, regexp_replace(candidate_sheet_ids[i], '^{_BLANKS}+|{_BLANKS}+$', '', 'g') AS sheet_id, candidate_scores[i] AS score
  FROM (SELECT *, unnest(range(1, len(candidate_sheet_ids) + 1)) AS i FROM rag WHERE status IS NULL OR status <> 'failed')),
d AS (
  SELECT query_index, sheet_id, max(score) AS score FROM c
  WHERE query_index IS NOT NULL AND sheet_id <> '' AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_index ORDER BY score DESC,
    CASE WHEN regexp_full_match(sheet_id, '[0-9]+') THEN 0 ELSE 1 END,
    CASE WHEN regexp_full_match(sheet_id, '[0-9]+') THEN CAST(sheet_id AS HUGEINT) END, encode(sheet_id)) AS rank_no FROM d)
SELECT query_index, CAST(rank_no AS INTEGER) AS rank_no, sheet_id FROM r WHERE rank_no <= 5
"""


@queries.add("p1_found", _P1)
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return topn.best_sheets(table(spark, sf, "rag"))


@queries.add("p2_found")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = overlap.overlaps(overlap.classed(table(spark, sf, "queries")))
    ends = F.least("train_index", "other_index"), F.greatest("train_index", "other_index")
    return pairs.select(ends[0].alias("query_index_a"), ends[1].alias("query_index_b")).distinct()


@queries.add("p2_classes")
def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.classed(table(spark, sf, "queries")).members.select("query_index", "split", "source", F.hex("class_id").alias("class_id")).distinct()


@queries.add("p2_report")
def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.report(overlap.classed(table(spark, sf, "queries")))


_LINES = r"\r\n\x0b\x{85}\x{2028}\x{2029}"
_P3 = rf"""
WITH q AS (SELECT DISTINCT query_index, nfc_normalize(query) AS t FROM queries WHERE query_index IS NOT NULL),
p AS (
  SELECT query_index, regexp_replace(lower(t), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g') AS flat,
    regexp_split_to_array(replace(t, '|', ';'), '[{_LINES}]+') AS lines FROM q),
m AS (
  SELECT query_index, flat, list_reduce(lines, lambda a, x: a || CASE WHEN regexp_matches(x, '^[^;]*[:=]') THEN ';' ELSE ' ' END || x) AS joined FROM p WHERE flat <> ''),
s AS (
  SELECT query_index, flat, list_filter(string_split(joined, ';'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}\p{{M}}]')) AS pieces FROM m),
k AS (
  SELECT query_index, flat, CASE WHEN len(pieces) >= 2 AND len(list_filter(pieces, lambda x: NOT regexp_matches(x, '(?s)^[^:=]*[\p{{L}}\p{{N}}][^:=]*[:=].*[\p{{L}}\p{{N}}]'))) = 0
    THEN list_aggregate(list_sort(list_transform(pieces, lambda x: regexp_replace(lower(x), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g'))), 'string_agg', '|') END AS parted FROM s),
t AS (SELECT flat, min(parted) AS of_flat FROM k WHERE parted IS NOT NULL GROUP BY flat),
g AS (SELECT k.query_index, coalesce(k.parted, t.of_flat, k.flat) AS key FROM k LEFT JOIN t ON k.parted IS NULL AND k.flat = t.flat),
n AS (SELECT key, min(query_index) AS keep, count(DISTINCT query_index) AS copies FROM g GROUP BY key)
"""


@queries.add("p3_found", _P3 + "SELECT DISTINCT keep AS keep_query_index, query_index AS copy_query_index FROM g JOIN n USING (key) WHERE query_index > keep")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = canonical.copies(table(spark, sf, "queries"), "query_index", "query")
    return pairs.select(F.col("keep").alias("keep_query_index"), F.col("copy").alias("copy_query_index"))


@queries.add("p3_collapsed", _P3 + "SELECT keep AS query_index, copies FROM n")
def p3_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.collapsed(table(spark, sf, "queries"), "query_index", "query")


@queries.add("p5_found")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.odd_names(lookalike.sheet_names(table(spark, sf, "sheets"))).select("sheet_id", "col_pos").distinct()


@queries.add("p5_plain")
def p5_plain(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.plain_names(lookalike.sheet_names(table(spark, sf, "sheets")))


@queries.add("p7_ids")
def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encoded(table(spark, sf, "documents"))


@queries.add("p7_round_trip", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p7_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.decoded(tokens.encoded(table(spark, sf, "documents")))


@queries.add("p8_containers")
def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf, "documents"))


@queries.add("p8_summary")
def p8_summary(spark: SparkSession, sf: str) -> DataFrame:
    return packing.summary(packing.packed_documents(table(spark, sf, "documents")))


@queries.add("p8_costs")
def p8_costs(spark: SparkSession, sf: str) -> DataFrame:
    """What each set of permitted lengths would cost, and which is taken."""
    return packing.costs(tokens.counted(table(spark, sf, "documents")), "n_tokens")


@queries.add("p9_found")
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return reading.demanding(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


@queries.add("p9_levels")
def p9_levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading.levels(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


@queries.add("p9_rounds")
def p9_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """How the alternating optimisation went: the likelihood and the move of the difficulties in each round."""
    history = reading.fit(table(spark, sf, "documents"), table(spark, sf, "reading_labels")).history
    return spark.createDataFrame(history, "round int, log_likelihood double, moved double")


@queries.add("p9_profile")
def p9_profile(spark: SparkSession, sf: str) -> DataFrame:
    return reading.profile(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))
