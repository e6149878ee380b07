"""Hard negatives among vectors, and the audit of labelled pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import vector
from gridloom.runtime import ranked

#: Rows of a block; a task holds two of them and their product.
BLOCK = 1024


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})


def hard_negatives(vectors: DataFrame, existing: DataFrame, ratio: float, band: tuple[float, float] = (0.3, 0.6)) -> DataFrame:
    """(a, b, similarity): the pairs, a < b, of the same source with a cosine similarity in the closed band that aren't
    among the existing pairs (a, b) in either order; in the order of a and b, as many as ratio times the existing
    pairs. vectors: (id, source, vector), ids distinct. Each source is cut into blocks by its size, and each pair of
    blocks is one task's product, so a hot source is spread over many."""
    rows = vectors.where("vector is not null and source is not null")
    sizes = rows.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(sizes, "source").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")})

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        v = np.stack([np.asarray(x, np.float64) for x in pdf["vector"]])
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        scores, block = v @ v.T, pdf["block"].to_numpy()
        wanted = (scores >= band[0]) & (scores <= band[1])
        if pdf["low"][0] != pdf["high"][0]:
            wanted &= block[:, None] != block[None, :]
        i, j = np.nonzero(np.triu(wanted, 1))
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"a": ids[i], "b": ids[j], "similarity": scores[i, j]})

    kind = dict(vectors.dtypes)["id"]
    found = met.select("source", "low", "high", "block", "id", "vector").groupBy("source", "low", "high").applyInPandas(pairs, f"a {kind}, b {kind}, similarity double")
    new = found.join(_unordered(existing.select("a", "b")).distinct(), ["a", "b"], "left_anti")
    return ranked(new, "a", "b").where(F.col("position") < int(existing.count() * ratio)).drop("position")


def label_audit(pairs: DataFrame, vectors: DataFrame, limit: float = 0.7) -> DataFrame:
    """pairs (a, b, label, ...) with similarity and new_label 1: those with label 0 (or none) whose vectors are more
    alike than the limit, one row for each row of pairs. vectors: (id, vector), ids distinct."""
    x = vectors.select(F.col("id").alias("a"), F.col("vector").alias("x"))
    y = vectors.select(F.col("id").alias("b"), F.col("vector").alias("y"))
    scored = pairs.where(F.coalesce("label", F.lit(0)) == 0).join(x, "a").join(y, "b").withColumn("similarity", vector.cosine(F.col("x"), F.col("y")))
    return scored.where(F.col("similarity") > limit).drop("x", "y").withColumn("new_label", F.lit(1))
