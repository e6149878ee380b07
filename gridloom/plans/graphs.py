"""Queries on relations within workspaces.

The workspace of a query is the first ten of its labelled candidates (positives and hard negatives that exist) in id
order; its base score falls from 1 to 0 with the position. Vectors come from the retrieval queries instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import serialize
from gridloom.operators import graph, vector
from gridloom.plans import retrieval
from gridloom.plans.registry import Registry
from gridloom.plans.texts import _SCOPE, _labels_sql, latest_sheets, scoped
from gridloom.runtime import cut, table

queries = Registry()

_MEMBERS = f"""WITH {_SCOPE},
k AS (SELECT query_index AS q, any_value(ids)[1:10] AS ids FROM c GROUP BY query_index),
u AS (SELECT q, unnest(ids) AS item, unnest(range(len(ids))) AS pos, len(ids) AS of FROM k),
m AS (SELECT q, item, CASE WHEN of = 1 THEN 1.0::DOUBLE ELSE 1 - pos / (of - 1) END AS score, coalesce(num_rows, 0) AS rows, coalesce(num_cols, 0) AS cols,
  list_distinct(list_transform({_labels_sql()}, lambda x: lower(x))) AS headers FROM u JOIN s ON s.sheet_id = item),
p AS (SELECT a.q, a.item AS i, b.item AS j, a.rows AS ri, b.rows AS rj, a.cols AS ci, b.cols AS cj, a.headers AS hi, b.headers AS hj FROM m a JOIN m b USING (q)),
schema AS (SELECT q, i, j, CASE WHEN i = j THEN 0.0::DOUBLE ELSE len(list_intersect(hi, hj)) / greatest(1, len(hi) + len(hj) - len(list_intersect(hi, hj))) END AS w FROM p),
shape AS (SELECT q, i, j, CASE WHEN i = j THEN 0.0::DOUBLE ELSE (1 / (1 + abs(ri - rj)) + 1 / (1 + abs(ci - cj))) / 2 END AS w FROM p),
t AS (SELECT DISTINCT trim(string_split(k, ',')[1]) AS a, trim(substr(k, strpos(k, ',') + 1)) AS b, ty AS type FROM (SELECT k, unnest(edge_all_types[k]) AS ty FROM (SELECT edge_all_types, unnest(map_keys(edge_all_types)) AS k FROM dependency_edges))),
e AS (SELECT a AS i, b AS j, type FROM t WHERE a <> b UNION SELECT b, a, type FROM t WHERE a <> b),
dep AS (SELECT p.q, e.type, p.i, p.j, 1.0::DOUBLE AS w FROM p JOIN e USING (i, j)),
norm AS (SELECT q, i, j, w / greatest(sum(w) OVER (PARTITION BY q, i), 1e-9) AS w FROM schema WHERE i <> j),
mix AS (SELECT q, i, j, sum(w) AS w FROM (SELECT q, i, j, w * exp(0.2) / (exp(0.2) + exp(0.5)) AS w FROM schema UNION ALL SELECT q, i, j, w * exp(0.5) / (exp(0.2) + exp(0.5)) FROM shape) GROUP BY ALL),
feat AS (SELECT q, item, 'rows' AS dim, ln(1 + greatest(0, rows)) AS x FROM m UNION ALL SELECT q, item, 'cols', ln(1 + greatest(0, cols)) FROM m)
"""


def members(spark: SparkSession, sf: str) -> DataFrame:
    """(q, item, score, rows, cols, headers)."""
    ids = scoped(spark, sf).dropDuplicates(["query_index"]).select(F.col("query_index").alias("q"), F.slice("ids", 1, 10).alias("ids"))
    at = ids.select("q", F.size("ids").alias("n"), F.posexplode("ids").alias("p", "item"))
    score = F.when(F.col("n") == 1, 1.0).otherwise(1 - F.col("p") / (F.col("n") - 1))
    sheets = latest_sheets(spark, sf).select(F.col("sheet_id").alias("item"), F.coalesce("num_rows", F.lit(0)).alias("rows"), F.coalesce("num_cols", F.lit(0)).alias("cols"), serialize.header_set(F.col("columns")).alias("headers"))
    return at.select("q", "item", score.alias("score")).join(sheets, "item")


def features(m: DataFrame) -> DataFrame:
    """(q, item, dim, x): logarithms of the numbers of rows and columns (negative ones as 0)."""
    both = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.log(1.0 + F.greatest(F.col(d), F.lit(0))).alias("x")) for d in ("rows", "cols")])).alias("f")
    return m.select("q", "item", both).select("q", "item", "f.dim", "f.x")


def typed_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(a, b, type) of the batches' typed edges."""
    rows = table(spark, sf, "dependency_edges").select(F.explode("edge_all_types").alias("k", "types")).select("k", F.explode("types").alias("type"))
    ends = F.split("k", ",", 2)
    return rows.select(F.trim(F.get(ends, F.lit(0))).alias("a"), F.trim(F.get(ends, F.lit(1))).alias("b"), "type").distinct()


def rounded(df: DataFrame, column: str, digits: int = 12) -> DataFrame:
    """df with a rounded column: to twelve digits where each value is computed on its own or many sums end in a five behind
    the ninth, to nine where it is another sum."""
    return df.withColumn(column, F.round(column, digits))


@queries.add("channel_schema", _MEMBERS + "SELECT q, i, j, round(w, 12) AS w FROM schema")
def channel_schema(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.schema(members(spark, sf)), "w")


@queries.add("channel_schema_serve", _MEMBERS + "SELECT q, i, j, round(CASE WHEN i = j THEN CAST(len(hi) > 0 AS DOUBLE) ELSE len(list_intersect(hi, hj)) / greatest(1, len(hi) + len(hj) - len(list_intersect(hi, hj))) END, 12) AS w FROM p")
def channel_schema_serve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.schema(members(spark, sf), serving=True), "w")


@queries.add("channel_shape_train", _MEMBERS + "SELECT q, i, j, round(w, 12) AS w FROM shape")
def channel_shape_train(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.shape(members(spark, sf)), "w")


@queries.add(
    "channel_shape_serve",
    _MEMBERS + """SELECT q, i, j, round(CASE WHEN i = j THEN 1.0::DOUBLE ELSE greatest(0, (1 - abs(ri - rj) / greatest(1, max(ri) OVER (PARTITION BY q)) + 1 - abs(ci - cj) / greatest(1, max(ci) OVER (PARTITION BY q))) / 2) END, 12) AS w FROM p""",
)
def channel_shape_serve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.shape(members(spark, sf), serving=True), "w")


@queries.add("channel_dependency", _MEMBERS + "SELECT q, type, i, j, w FROM dep")
def channel_dependency(spark: SparkSession, sf: str) -> DataFrame:
    return graph.dependency(members(spark, sf), typed_edges(spark, sf))


@queries.add("channel_dependency_types", _MEMBERS + "SELECT type, count(*) AS edges, count(DISTINCT q) AS workspaces FROM dep WHERE type IN ('join_key', 'aggregation') GROUP BY type")
def channel_dependency_types(spark: SparkSession, sf: str) -> DataFrame:
    chosen = graph.dependency(members(spark, sf), typed_edges(spark, sf), ["join_key", "aggregation"])
    return chosen.groupBy("type").agg(F.count("*").alias("edges"), F.count_distinct("q").alias("workspaces"))


@queries.add("row_normalize", _MEMBERS + "SELECT q, i, j, round(w, 9) AS w FROM norm")
def row_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.row_normalised(graph.schema(members(spark, sf))), "w", 9)


@queries.add("row_normalize_self_loop", _MEMBERS + "SELECT q, i, j, round((w + CAST(i = j AS INTEGER)) / sum(w + CAST(i = j AS INTEGER)) OVER (PARTITION BY q, i), 9) AS w FROM schema")
def row_normalize_self_loop(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.row_normalised(graph.schema(members(spark, sf)), self_loops=True), "w", 9)


def _mix(m: DataFrame) -> DataFrame:
    return graph.mixed({"schema": graph.schema(m), "shape": graph.shape(m)}, {"schema": 0.2, "shape": 0.5})


@queries.add("channel_mix", _MEMBERS + "SELECT q, i, j, round(w, 12) AS w FROM mix")
def channel_mix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_mix(cut(members(spark, sf))), "w")


@queries.add("adjacency_compose", _MEMBERS + "SELECT a.q, a.i, b.j, round(sum(a.w * b.w), 12) AS w FROM norm a JOIN norm b ON a.q = b.q AND a.j = b.i GROUP BY ALL")
def adjacency_compose(spark: SparkSession, sf: str) -> DataFrame:
    a = cut(graph.row_normalised(graph.schema(members(spark, sf))))
    return rounded(graph.composed(a, a), "w")


@queries.add(
    "adjacency_compose_relu",
    _MEMBERS + "SELECT a.q, a.i, b.j, round(sum(greatest(0, a.w - 0.1) * b.w), 12) AS w FROM norm a JOIN norm b ON a.q = b.q AND a.j = b.i GROUP BY ALL",
)
def adjacency_compose_relu(spark: SparkSession, sf: str) -> DataFrame:
    """Two steps along a relation, weak edges of the first dropped to 0."""
    a = cut(graph.row_normalised(graph.schema(members(spark, sf))))
    return rounded(graph.composed(graph.rectified(a, -0.1), a), "w")


@queries.add(
    "gcn_layer",
    _MEMBERS
    + """, pr AS (SELECT n.q, n.i, sum(n.w * x.x) FILTER (WHERE dim = 'rows') AS r, sum(n.w * x.x) FILTER (WHERE dim = 'cols') AS c FROM norm n JOIN feat x ON x.q = n.q AND x.item = n.j GROUP BY ALL),
    h AS (SELECT m.q, m.item AS i, ln(1 + greatest(0, rows)) + greatest(0, coalesce(0.5 * r - 0.2 * c, 0)) AS r, ln(1 + greatest(0, cols)) + greatest(0, coalesce(0.1 * r + 0.3 * c, 0)) AS c FROM m LEFT JOIN pr ON pr.q = m.q AND pr.i = m.item)
    SELECT q, i, 'rows' AS dim, round(r / greatest(sqrt(r * r + c * c), 1e-12), 6) AS x FROM h UNION ALL SELECT q, i, 'cols', round(c / greatest(sqrt(r * r + c * c), 1e-12), 6) FROM h""",
)
def gcn_layer(spark: SparkSession, sf: str) -> DataFrame:
    m = cut(members(spark, sf))
    weights = {"rows": {"rows": 0.5, "cols": 0.1}, "cols": {"rows": -0.2, "cols": 0.3}}
    return rounded(graph.gcn_layer(graph.row_normalised(graph.schema(m)), features(m), weights), "x", 6)


@queries.add("propagate_features", _MEMBERS + "SELECT n.q, n.i, x.dim, round(sum(n.w * x.x), 6) AS x FROM norm n JOIN feat x ON x.q = n.q AND x.item = n.j GROUP BY ALL")
def propagate_features(spark: SparkSession, sf: str) -> DataFrame:
    m = cut(members(spark, sf))
    return rounded(graph.propagated(graph.row_normalised(graph.schema(m)), features(m)), "x", 6)


@queries.add(
    "score_message",
    _MEMBERS
    + """, z AS (SELECT q, item AS j, (score - avg(score) OVER g) / greatest(stddev_pop(score) OVER g, 1e-6) AS z FROM m WINDOW g AS (PARTITION BY q)),
    v AS (SELECT n.q, n.i, sum(n.w * z.z) AS message FROM norm n JOIN z USING (q, j) GROUP BY ALL)
    SELECT m.q, m.item AS i, round(coalesce(message, 0), 9) + 0.0 AS message FROM m LEFT JOIN v ON v.q = m.q AND v.i = m.item""",
)
def score_message(spark: SparkSession, sf: str) -> DataFrame:
    m = cut(members(spark, sf))
    return rounded(graph.score_message(graph.schema(m), m), "message", 9).withColumn("message", F.col("message") + 0.0)


@queries.add(
    "edge_softmax",
    _MEMBERS
    + """, y AS (SELECT a.q, a.i, a.j, x.score + z.score AS e FROM norm a JOIN m x ON x.q = a.q AND x.item = a.i JOIN m z ON z.q = a.q AND z.item = a.j WHERE a.w > 0),
    lr AS (SELECT q, i, j, exp(CASE WHEN e > 0 THEN e ELSE 0.2 * e END) AS e FROM y) SELECT q, i, j, round(e / sum(e) OVER (PARTITION BY q, i), 9) AS w FROM lr""",
)
def edge_softmax(spark: SparkSession, sf: str) -> DataFrame:
    m = cut(members(spark, sf))
    return rounded(graph.edge_softmax(graph.row_normalised(graph.schema(m)), m), "w", 9)


@queries.add("set_pool", _MEMBERS + ", w AS (SELECT q, item, exp(score) / sum(exp(score)) OVER (PARTITION BY q) AS w FROM m) SELECT x.q, x.dim, round(sum(w.w * x.x), 6) AS x FROM feat x JOIN w USING (q, item) GROUP BY ALL")
def set_pool(spark: SparkSession, sf: str) -> DataFrame:
    m = cut(members(spark, sf))
    return rounded(graph.set_pool(features(m), m), "x", 6)


@queries.add(
    "gated_relations",
    _MEMBERS
    + """, h AS (SELECT q, i, j, w / greatest(sum(w) OVER (PARTITION BY q, i), 1e-9) AS w FROM shape WHERE i <> j),
    g AS (SELECT n.q, n.i, x.dim, 'schema' AS c, 0.5 AS l, sum(n.w * x.x) AS v FROM norm n JOIN feat x ON x.q = n.q AND x.item = n.j GROUP BY ALL
          UNION ALL SELECT n.q, n.i, x.dim, 'shape', 0.3, sum(n.w * x.x) FROM h n JOIN feat x ON x.q = n.q AND x.item = n.j GROUP BY ALL),
    sz AS (SELECT q, i, c, exp(l * sqrt(sum(v * v))) AS e FROM g GROUP BY q, i, c, l), tot AS (SELECT q, i, sum(e) AS t FROM sz GROUP BY ALL),
    msg AS (SELECT g.q, g.i, g.dim, sum(g.v * sz.e / tot.t) AS m FROM g JOIN sz USING (q, i, c) JOIN tot USING (q, i) GROUP BY ALL),
    own AS (SELECT q, item AS i, dim, x, sqrt(sum(x * x) OVER (PARTITION BY q, item)) AS n FROM feat)
    SELECT own.q, own.i, own.dim, round(own.x + coalesce(msg.m, 0) / (1 + exp(-(0.1 * n - 0.5))), 6) AS x FROM own LEFT JOIN msg USING (q, i, dim)""",
)
def gated_relations(spark: SparkSession, sf: str) -> DataFrame:
    m = cut(members(spark, sf))
    return rounded(graph.gated_relations({"schema": graph.schema(m), "shape": graph.shape(m)}, features(m), {"schema": 0.5, "shape": 0.3}, 0.1, -0.5), "x", 6)


_VECTORS = retrieval._SQL + ", m AS (SELECT c.*, v.e FROM c JOIN v ON v.vec_id = c.item_id)"


def vector_members(spark: SparkSession, sf: str) -> DataFrame:
    """(q, item, score, rank_no, vector) of the retrieved candidates."""
    items = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    return retrieval.candidates(spark, sf).select(F.col("query_id").alias("q"), F.col("item_id").alias("item"), "score", "rank_no").join(items, "item")


@queries.add("channel_semantic", _VECTORS + "SELECT a.query_id AS q, a.item_id AS i, b.item_id AS j, round((list_cosine_similarity(a.e, b.e) + 1) / 2, 12) AS w FROM m a JOIN m b USING (query_id)")
def channel_semantic(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.semantic(vector_members(spark, sf)), "w")


@queries.add("channel_query", _VECTORS + "SELECT a.query_id AS q, a.item_id AS i, b.item_id AS j, round((a.score * b.score + 1) / 2, 12) AS w FROM m a JOIN m b USING (query_id)")
def channel_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.by_query(vector_members(spark, sf)), "w")


@queries.add(
    "pair_vectors",
    _VECTORS + "SELECT m.query_id AS q, m.item_id AS item, list_transform(list_concat(list_concat(m.e, z.e), list_transform(m.e, lambda x, i: abs(x - z.e[i]))), lambda x: round(x, 6)) AS features FROM m JOIN v z ON z.vec_id = m.query_id",
)
def pair_vectors(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "embeddings").select(F.col("vec_id").alias("q"), F.col("embedding").alias("asked"))
    both = vector_members(spark, sf).join(asked, "q")
    return both.select("q", "item", F.transform(vector.pair_vector(F.col("vector"), F.col("asked")), lambda x: F.round(x, 6)).alias("features"))


@queries.add(
    "base_scorer",
    _VECTORS
    + """SELECT m.query_id AS q, m.item_id AS item, round(2.0 * score + 0.01 * list_sum(m.e) - 0.01 * list_sum(z.e) - 0.02 * list_sum(list_transform(m.e, lambda x, i: abs(x - z.e[i])))
    + 0.05 * list_dot_product(m.e, z.e) + 0.03 * (1 - (rank_no - 1) / 9.0), 6) AS score FROM m JOIN v z ON z.vec_id = m.query_id""",
)
def base_scorer(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "embeddings").select(F.col("vec_id").alias("q"), F.col("embedding").alias("asked"))
    rank = 1 - (F.col("rank_no") - 1) / (retrieval.K - 1)
    weights = {"item": 0.01, "query": -0.01, "difference": -0.02, "product": 0.05, "rank": 0.03}
    scored = vector_members(spark, sf).join(asked, "q").withColumn("score", graph.base_score(F.col("vector"), F.col("asked"), F.col("score"), rank, 2.0, weights))
    return scored.select("q", "item", F.round("score", 6).alias("score"))
