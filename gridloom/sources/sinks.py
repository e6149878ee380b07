"""Sinks: small reports written whole or not at all, and tables split by a column."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(path: str, payload: Any) -> None:
    """A small report as a JSON file on any file system that Spark reaches. It is written under a name of its own and
    then takes the place of an older report in one step, so readers see either the old or the new one."""
    jvm, conf = SparkSession.active()._jvm, SparkSession.active()._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fresh = hadoop.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    text = json.dumps(payload, ensure_ascii=False, indent=2)
    fs = hadoop.FileSystem.newInstance(target.toUri(), conf)
    fs.setWriteChecksum(False)
    try:
        out = fs.create(fresh)
        out.write(bytearray(text.encode()))
        out.close()
        overwrite = SparkSession.active()._sc._gateway.new_array(hadoop.Options.Rename, 1)
        overwrite[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(fresh), fs.makeQualified(target), overwrite)
    finally:
        fs.delete(fresh, False)
        fs.close()


def write_splits(rows: DataFrame, path: str, by: str = "split") -> None:
    """JSON lines in one folder per value."""
    rows.write.mode("overwrite").partitionBy(by).json(path)


def export_lists(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_index, query, candidate_sheet_ids, candidate_scores): ranked candidates as lists, scores to 8 places."""
    lists = candidates.groupBy("query_index").agg(F.array_sort(F.collect_list(F.struct("rank_no", "sheet_id", "score"))).alias("l"))
    return queries.select("query_index", "query").join(lists, "query_index").select(
        "query_index", "query", F.transform("l", lambda x: x["sheet_id"]).alias("candidate_sheet_ids"), F.transform("l", lambda x: F.round(x["score"], 8)).alias("candidate_scores")
    )


def import_lists(cache: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The first k candidates of each query from exported lists; a query without a list is an error."""
    joined = queries.select("query_index").join(cache, "query_index", "left")
    ids = F.when(F.col("candidate_sheet_ids").isNull(), F.raise_error(F.concat(F.lit("no candidates for query "), F.col("query_index").cast("string"))).cast("array<string>")).otherwise(F.col("candidate_sheet_ids"))
    return joined.select("query_index", F.slice(ids, 1, k).alias("candidate_sheet_ids"), F.slice("candidate_scores", 1, k).alias("candidate_scores"))
