"""Relations among the members of small workspaces, as rows (q, i, j, w) of sparse matrices.

A workspace holds few members (ten by default), so its pairs are few; every operator joins and groups by workspace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.vector import cosine, unit


def pairs(members: DataFrame, keep: list[str], loops: bool = True) -> DataFrame:
    """(q, i, j) of all ordered pairs of members (q, item) of a workspace, with keep of both as x_i and x_j."""
    a, b = (members.select("q", F.col("item").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in keep]) for x in "ij")
    both = a.join(b, "q")
    return both if loops else both.where("i <> j")


def semantic(members: DataFrame) -> DataFrame:
    """(cos + 1) / 2 of the members' vectors."""
    return pairs(members, ["vector"]).select("q", "i", "j", unit(cosine(F.col("vector_i"), F.col("vector_j"))).alias("w"))


def by_query(members: DataFrame) -> DataFrame:
    """(s_i s_j + 1) / 2 of the members' scores."""
    return pairs(members, ["score"]).select("q", "i", "j", unit(F.col("score_i") * F.col("score_j")).alias("w"))


def schema(members: DataFrame, serving: bool = False) -> DataFrame:
    """Jaccard similarity of the members' header sets; the diagonal is 0, in serving 1 where there are headers."""
    both = F.size(F.array_intersect("headers_i", "headers_j"))
    w = both / F.greatest(F.lit(1), F.size("headers_i") + F.size("headers_j") - both)
    loop = (F.size("headers_i") > 0).cast("double") if serving else F.lit(0.0)
    return pairs(members, ["headers"]).select("q", "i", "j", F.when(F.col("i") == F.col("j"), loop).otherwise(w).alias("w"))


def shape(members: DataFrame, serving: bool = False) -> DataFrame:
    """Closeness of the members' numbers of rows and columns. In training the mean of 1 / (1 + difference), diagonal
    0; in serving 1 less the mean of difference over the workspace's maximum, diagonal 1."""
    dr, dc = F.abs(F.col("rows_i") - F.col("rows_j")), F.abs(F.col("cols_i") - F.col("cols_j"))
    if serving:
        whole = W.partitionBy("q")
        most = lambda c: F.greatest(F.lit(1), F.max(c).over(whole))
        w = F.greatest(F.lit(0.0), (1 - dr / most(F.col("rows_i")) + 1 - dc / most(F.col("cols_i"))) / 2)
    else:
        w = (1 / (1 + dr) + 1 / (1 + dc)) / 2
    return pairs(members, ["rows", "cols"]).select("q", "i", "j", F.when(F.col("i") == F.col("j"), 1.0 if serving else 0.0).otherwise(w).alias("w"))


def dependency(members: DataFrame, edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(q, type, i, j, w = 1) of the edges (a, b, type) between members, in both directions; loops are left out."""
    chosen = edges.where(F.col("type").isin(types)) if types else edges
    both = chosen.select(F.col("a").alias("i"), F.col("b").alias("j"), "type").unionByName(chosen.select(F.col("b").alias("i"), F.col("a").alias("j"), "type")).where("i <> j").distinct()
    return pairs(members, [], loops=False).join(both, ["i", "j"]).select("q", "type", "i", "j", F.lit(1.0).alias("w"))


def row_normalised(a: DataFrame, self_loops: bool = False) -> DataFrame:
    """Each row over its sum, negatives as 0. Without the diagonal, or with 1 added to it."""
    w = F.greatest(F.col("w"), F.lit(0.0))
    if self_loops:
        ones = a.select("q", F.col("i"), F.col("i").alias("j")).distinct().withColumn("w", F.lit(1.0))
        rows = a.withColumn("w", w).unionByName(ones).groupBy("q", "i", "j").agg(F.sum("w").alias("w"))
    else:
        rows = a.where("i <> j").withColumn("w", w)
    return rows.withColumn("w", F.col("w") / F.greatest(F.sum("w").over(W.partitionBy("q", "i")), F.lit(1e-9)))


def mixed(channels: dict[str, DataFrame], logits: dict[str, float]) -> DataFrame:
    """The channels' sum, weighted by the softmax of their logits."""
    total = sum(2.718281828459045**x for x in logits.values())
    parts = [a.select("q", "i", "j", (F.col("w") * (2.718281828459045 ** logits[n] / total)).alias("w")) for n, a in channels.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("q", "i", "j").agg(F.sum("w").alias("w"))


def composed(a: DataFrame, b: DataFrame) -> DataFrame:
    """The matrix product of two relations of each workspace."""
    right = b.select("q", F.col("i").alias("j"), F.col("j").alias("k"), F.col("w").alias("v"))
    return a.join(right, ["q", "j"]).groupBy("q", "i", "k").agg(F.sum(F.col("w") * F.col("v")).alias("w")).withColumnRenamed("k", "j")


def propagated(a: DataFrame, x: DataFrame) -> DataFrame:
    """(q, i, dim, x): the matrix product of a relation and features (q, item, dim, x)."""
    right = x.select("q", F.col("item").alias("j"), "dim", "x")
    return a.join(right, ["q", "j"]).groupBy("q", "i", "dim").agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def rectified(a: DataFrame, bias: float = 0.0) -> DataFrame:
    """The weights plus the bias, negatives as 0."""
    return a.withColumn("w", F.greatest(F.lit(0.0), F.col("w") + bias))


def gcn_layer(a: DataFrame, x: DataFrame, weights: dict[str, dict[str, float]]) -> DataFrame:
    """(q, i, dim, x): features plus the rectified product of relation, features and weights[from][to], at length 1 for
    each node. Weights are given; nodes without neighbours keep their features."""
    parts = [F.struct(F.lit(d).alias("dim"), F.lit(e).alias("to"), F.lit(float(w)).alias("v")) for d, row in weights.items() for e, w in row.items()]
    moved = propagated(a, x).withColumn("p", F.explode(F.array(*parts))).where("dim = p.dim")
    messages = moved.groupBy("q", "i", F.col("p.to").alias("dim")).agg(F.sum(F.col("x") * F.col("p.v")).alias("m"))
    own = x.withColumnRenamed("item", "i").join(messages, ["q", "i", "dim"], "left")
    summed = own.withColumn("x", F.col("x") + F.greatest(F.coalesce("m", F.lit(0.0)), F.lit(0.0)))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("q", "i")))
    return summed.select("q", "i", "dim", (F.col("x") / F.greatest(length, F.lit(1e-12))).alias("x"))


def standardised(members: DataFrame) -> DataFrame:
    """members with z: score less its workspace's mean, over the population deviation."""
    g = W.partitionBy("q")
    return members.withColumn("z", (F.col("score") - F.avg("score").over(g)) / F.greatest(F.stddev_pop("score").over(g), F.lit(1e-6)))


def score_message(a: DataFrame, members: DataFrame) -> DataFrame:
    """(q, i, message): the neighbours' standardised scores, averaged by the row-normalised relation; 0 without
    neighbours."""
    z = standardised(members).select("q", F.col("item").alias("j"), "z")
    sums = row_normalised(a).join(z, ["q", "j"]).groupBy("q", "i").agg(F.sum(F.col("w") * F.col("z")).alias("message"))
    return members.select("q", F.col("item").alias("i")).join(sums, ["q", "i"], "left").select("q", "i", F.coalesce("message", F.lit(0.0)).alias("message"))


def edge_softmax(a: DataFrame, members: DataFrame, slope: float = 0.2) -> DataFrame:
    """(q, i, j, w): attention of i over its edges (w > 0), a softmax of leaky-rectified sums of scores."""
    s = members.select("q", "item", "score")
    e = a.where("w > 0").join(s.select("q", F.col("item").alias("i"), F.col("score").alias("si")), ["q", "i"]).join(s.select("q", F.col("item").alias("j"), F.col("score").alias("sj")), ["q", "j"])
    energy = F.col("si") + F.col("sj")
    g = W.partitionBy("q", "i")
    e = e.withColumn("e", F.when(energy > 0, energy).otherwise(energy * slope))
    e = e.withColumn("e", F.exp(F.col("e") - F.max("e").over(g)))
    return e.select("q", "i", "j", (F.col("e") / F.sum("e").over(g)).alias("w"))


def set_pool(x: DataFrame, members: DataFrame) -> DataFrame:
    """(q, dim, x): the members' features, averaged by the softmax of their scores."""
    g = W.partitionBy("q")
    top = members.select("q", "item", F.exp(F.col("score") - F.max("score").over(g)).alias("t"))
    weights = top.select("q", "item", (F.col("t") / F.sum("t").over(g)).alias("w"))
    return x.join(weights, ["q", "item"]).groupBy("q", "dim").agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def gated_relations(channels: dict[str, DataFrame], x: DataFrame, logits: dict[str, float], slope: float, bias: float) -> DataFrame:
    """(q, i, dim, x): features plus gate times their neighbours' over several relations. Each node weighs the
    channels by a softmax of logit times the size of its message, and its gate is the logistic of slope times its own
    size plus bias. Weights are given, not learned."""
    messages = None
    for name, a in channels.items():
        m = propagated(row_normalised(a), x).withColumn("channel", F.lit(name)).withColumn("logit", F.lit(float(logits[name])))
        messages = m if messages is None else messages.unionByName(m)
    node = W.partitionBy("q", "i")
    size = messages.withColumn("size", F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("q", "i", "channel"))))
    lifted = size.withColumn("e", F.exp(F.col("logit") * F.col("size") - F.max(F.col("logit") * F.col("size")).over(node)))
    total = lifted.groupBy("q", "i").agg((F.sum("e") / F.count_distinct("dim")).alias("total"))
    summed = lifted.join(total, ["q", "i"]).groupBy("q", "i", "dim").agg(F.sum(F.col("x") * F.col("e") / F.col("total")).alias("m"))
    own = x.withColumnRenamed("item", "i").withColumn("n", F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("q", "i"))))
    gate = 1 / (1 + F.exp(-(slope * F.col("n") + bias)))
    return own.join(summed, ["q", "i", "dim"], "left").select("q", "i", "dim", (F.col("x") + gate * F.coalesce("m", F.lit(0.0))).alias("x"))


def base_score(item: Column, query: Column, raw: Column, rank: Column, scale: float, weights: dict[str, float]) -> Column:
    """scale * raw and a linear part in sum(item), sum(query), sum|item - query|, sum(item * query), raw and rank, each
    with its weight; with weights of 0 the order is that of raw."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    parts = {
        "item": total(wide(item)),
        "query": total(wide(query)),
        "difference": total(F.zip_with(item, query, lambda a, b: F.abs(a.cast("double") - b.cast("double")))),
        "product": total(F.zip_with(item, query, lambda a, b: a.cast("double") * b.cast("double"))),
        "raw": raw,
        "rank": rank,
    }
    return scale * raw + sum((parts[n] * w for n, w in weights.items()), F.lit(0.0))
