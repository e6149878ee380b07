"""Exact vector search in blocks, and expressions on vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a block of queries and of a chunk of the corpus; a task holds one of each and their product in memory.
QUERY_BLOCK, CORPUS_CHUNK = 1024, 65536
#: The most numbers, over all vectors, of queries that are broadcast (32 MB).
BROADCAST = 4_000_000


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """The vector at length 1; a vector of zeros stays."""
    length = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def unit(similarity: Column) -> Column:
    """A similarity from -1 to 1 on the scale from 0 to 1."""
    return (similarity + 1) / 2


def pair_vector(u: Column, v: Column) -> Column:
    """u, v and the sizes of their differences, one behind the other."""
    return F.concat(as_doubles(u), as_doubles(v), F.zip_with(u, v, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def activations(x: Column, slope: float = 0.2, clip: float = 1e-6) -> dict[str, Column]:
    """The usual activations of a logit, and the entropy of its probability, clipped away from 0 and 1. gelu is the
    form with tanh."""
    p = 1 / (1 + F.exp(-x))
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return {
        "sigmoid": p,
        "relu": F.greatest(F.lit(0.0), x),
        "leaky": F.when(x > 0, x).otherwise(x * slope),
        "gelu": x / 2 * (1 + F.tanh(F.lit((2 / np.pi) ** 0.5) * (x + 0.044715 * x * x * x))),
        "entropy": -(q * F.ln(q) + (1 - q) * F.ln(1 - q)),
    }


def pooled_tokens(tokens: DataFrame, text: str, position: str, vector: str, there: Column) -> DataFrame:
    """text, dim, cls, mean, most: for each text and dimension (from 1) the value at the first position, and the mean and
    the maximum over the tokens that are there (null where none is). Sums are combined before the shuffle."""
    rows = tokens.select(text, F.col(position).alias("__at"), there.alias("__there"), F.posexplode(vector).alias("__i", "__x"))
    x = F.col("__x").cast("double")
    return rows.groupBy(text, (F.col("__i") + 1).cast("long").alias("dim")).agg(F.min_by(x, "__at").alias("cls"), F.avg(F.when(F.col("__there"), x)).alias("mean"), F.max(F.when(F.col("__there"), x)).alias("most"))


def top_k(queries: DataFrame, corpus: DataFrame, k: int, cosine: bool = False, band: tuple[float, float] | None = None, by_id: bool = False) -> DataFrame:
    """(query_id, item_id, score, rank_no): the k best items of each query by dot product (or cosine), ties by
    item_id; a query never finds its own id. With `band` only scores within it count; with by_id the first k by
    item_id come instead of the best.

    queries: (query_id, vector, ...), corpus: (item_id, vector). Queries of up to BROADCAST numbers go to every task,
    which reads its part of the corpus once, where it lies, and keeps k rows per query. More queries are cut into
    blocks and the corpus into chunks; each pair is one task's matrix product, which keeps k rows per query, so
    neither side is broadcast. Null vectors find nothing and aren't found."""
    queries = queries.where("vector is not null").select("query_id", "vector")
    corpus = corpus.where("vector is not null").select("item_id", "vector")
    kinds = dict(queries.dtypes)["query_id"], dict(corpus.dtypes)["item_id"]
    schema = f"query_id {kinds[0]}, item_id {kinds[1]}, score double"
    size = queries.agg(F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))).first()[0]
    if size <= BROADCAST:
        found = _against_all(queries, corpus, k, cosine, band, by_id, schema)
    else:
        found = _in_blocks(queries, corpus, k, cosine, band, by_id, schema)
    order = [F.col("item_id")] if by_id else [F.desc("score"), F.col("item_id")]
    return found.withColumn("rank_no", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank_no") <= k)


def _matrix(vectors: pd.Series, cosine: bool) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if cosine else x


def _firsts(score: np.ndarray, ids: np.ndarray, ok: np.ndarray, k: int, by_id: bool) -> np.ndarray:
    """The places of the k first items that are ok; ids ascend."""
    at = np.flatnonzero(ok)
    if not by_id:
        if len(at) > 4 * k:  # all that could be among the k best, ties included
            at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
        at = at[np.argsort(-score[at], kind="stable")]
    return at[:k]


def _against_all(queries: DataFrame, corpus: DataFrame, k: int, cosine: bool, band: tuple[float, float] | None, by_id: bool, schema: str) -> DataFrame:
    asked = queries.toPandas()
    shared = queries.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(), _matrix(asked["vector"], cosine) if len(asked) else np.empty((0, 0))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qs, a = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(qs)
        for c in batches:
            if c.empty or not len(qs):
                continue
            c = c.sort_values("item_id", kind="stable")
            ids, b = c["item_id"].to_numpy(), _matrix(c["vector"], cosine)
            for start in range(0, len(a), 128):
                for i, row in enumerate(a[start : start + 128] @ b.T, start):
                    ok = ids != qs[i]
                    if band:
                        ok &= (row >= band[0]) & (row <= band[1])
                    at = _firsts(row, ids, ok, k, by_id)
                    score, item = np.concatenate([best[i][0], row[at]]), np.concatenate([best[i][1], ids[at]])
                    order = (np.argsort(item, kind="stable") if by_id else np.lexsort((item, -score)))[:k]
                    best[i] = score[order], item[order]
        if len(qs):
            n = [len(x) for x, _ in best]
            yield pd.DataFrame({"query_id": np.repeat(qs, n), "item_id": np.concatenate([x for _, x in best]), "score": np.concatenate([x for x, _ in best])})

    return corpus.mapInPandas(run, schema)


def _in_blocks(queries: DataFrame, corpus: DataFrame, k: int, cosine: bool, band: tuple[float, float] | None, by_id: bool, schema: str) -> DataFrame:
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    chunks = max(1, -(-corpus.count() // CORPUS_CHUNK))
    left = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = corpus.withColumn("chunk", F.pmod(F.xxhash64("item_id"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        c = c.sort_values("item_id", kind="stable")
        a, b = _matrix(q["vector"], cosine), _matrix(c["vector"], cosine)
        qs, ids, out = q["query_id"].to_numpy(), c["item_id"].to_numpy(), []
        for start in range(0, len(a), 128):
            for i, row in enumerate(a[start : start + 128] @ b.T, start):
                ok = ids != qs[i]
                if band:
                    ok &= (row >= band[0]) & (row <= band[1])
                at = _firsts(row, ids, ok, k, by_id)
                out.append(pd.DataFrame({"query_id": qs[i], "item_id": ids[at], "score": row[at]}))
        return pd.concat(out, ignore_index=True)

    return left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInPandas(best, schema)
