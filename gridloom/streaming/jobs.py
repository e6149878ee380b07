"""Jobs as a stream of events: queued, running, succeeded or failed; time to live; resumable sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RANK = {"queued": 0, "running": 1, "failed": 2, "succeeded": 3}
TIME_TO_LIVE = "interval 24 hours"


def status_of(event_type: Column) -> Column:
    """The status that an event of a session puts its job in."""
    return F.when(event_type == "purchase", "succeeded").when(event_type == "error", "failed").when(event_type == "click", "running").otherwise("queued")


def latest(events: DataFrame) -> DataFrame:
    """(job_id, status, created_at, updated_at, expires_at) of each job from its events (job_id, at, event_id,
    status): the status of its last event. Aggregated, so a job of any number of events costs one row per task."""
    last = F.max_by("status", F.struct("at", "event_id")).alias("status")
    jobs = events.groupBy("job_id").agg(last, F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
    return jobs.withColumn("expires_at", F.col("created_at") + F.expr(TIME_TO_LIVE))


def expired(jobs: DataFrame, now: Column) -> DataFrame:
    """The jobs past their time; expired ones stay in the table."""
    return jobs.where(F.col("expires_at") < now)


def partial_failures(events: DataFrame) -> DataFrame:
    """(job_id, results, errors, status): a job with any result has succeeded, whatever else failed."""
    counts = events.groupBy("job_id").agg(F.count_if(F.col("status") != "failed").alias("results"), F.count_if(F.col("status") == "failed").alias("errors"))
    return counts.withColumn("status", F.when(F.col("results") > 0, "succeeded").otherwise("failed"))


def updates(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """A stream of (job_id, status, events, updated_at), one row for each job that a micro-batch changed. State is the
    job's last status and event; events that arrive late but in the watermark count, older ones don't."""

    def step(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, n, at, last = state.get if state.exists else ("queued", 0, 0, -1)
        for pdf in batches:
            n += len(pdf)
            newest = pdf.iloc[np.lexsort((pdf["event_id"], pdf["at"]))[-1]]
            if (newest["at"].value, newest["event_id"]) >= (at, last):
                status, at, last = newest["status"], newest["at"].value, int(newest["event_id"])
        state.update((status, n, at, last))
        state.setTimeoutTimestamp(max(at // 1_000_000 + 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "events": [n], "updated_at": [pd.Timestamp(at)]})

    return (
        events.withWatermark("at", watermark)
        .groupBy("job_id")
        .applyInPandasWithState(step, "job_id long, status string, events long, updated_at timestamp", "status string, n long, at long, last long", "update", GroupStateTimeout.EventTimeTimeout)
    )


def upsert_into(path: str, key: str, newest: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch that keeps, under path, one table version per batch with the newest row of each key.
    A batch that is tried again writes the same version again."""

    def write(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/v={version - 1}"
        rows = batch.unionByName(spark.read.parquet(before)) if version > 0 and _exists(spark, before) else batch
        best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), newest).alias("r")).select("r.*")
        best.write.mode("overwrite").parquet(f"{path}/v={version}")

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
