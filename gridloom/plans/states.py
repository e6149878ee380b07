"""Queries on jobs: the events of a user are those of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import times
from gridloom.plans.registry import Registry
from gridloom.runtime import scratch, table
from gridloom.streaming import jobs

queries = Registry()

_JOBS = """WITH e AS (SELECT user_id AS job_id, ts AS moment, event_id, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'queued' END AS status FROM events),
j AS (SELECT job_id, arg_max(status, row(moment, event_id)) AS status, min(moment) AS created_at, max(moment) AS updated_at, min(moment) + INTERVAL 24 HOUR AS expires_at FROM e GROUP BY job_id) """


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), "event_id", jobs.status_of(F.col("event_type")).alias("status"))


@queries.add("job_status_latest", _JOBS + "SELECT * FROM j")
def job_status_latest(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.latest(job_events(spark, sf))


@queries.add(
    "job_pages",
    _JOBS + "SELECT job_id, 'job_' || md5(CAST(job_id AS VARCHAR)) AS name, '/api/v1/retrieval/jobs/job_' || md5(CAST(job_id AS VARCHAR)) AS page, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created, strftime(expires_at, '%Y-%m-%dT%H:%M:%SZ') AS expires FROM j",
)
def job_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The name and page of each job, and its times as text."""
    name = times.job_id(F.col("job_id"))
    found = jobs.latest(job_events(spark, sf))
    return found.select("job_id", name.alias("name"), times.poll_url("", name).alias("page"), times.iso_z(F.col("created_at")).alias("created"), times.iso_z(times.expiry(F.col("created_at"))).alias("expires"))


@queries.add("job_ttl_expired", _JOBS + "SELECT job_id, status, expires_at FROM j WHERE expires_at < (SELECT max(moment) FROM e)")
def job_ttl_expired(spark: SparkSession, sf: str) -> DataFrame:
    events = job_events(spark, sf)
    return jobs.expired(jobs.latest(events), events.agg(F.max("at")).scalar()).select("job_id", "status", "expires_at")


@queries.add("partial_failure_report", _JOBS + ", c AS (SELECT job_id, count(*) FILTER (WHERE status <> 'failed') AS results, count(*) FILTER (WHERE status = 'failed') AS errors FROM e GROUP BY job_id) SELECT *, CASE WHEN results > 0 THEN 'succeeded' ELSE 'failed' END AS status FROM c")
def partial_failure_report(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.partial_failures(job_events(spark, sf))


@queries.add("stream_job_updates", _JOBS + "SELECT job_id, arg_max(status, row(moment, event_id)) AS status, count(*) AS events, max(moment) AS updated_at FROM e GROUP BY job_id")
def stream_job_updates(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream, folded into one row per job; the sink keeps the newest row of each."""
    at = scratch(spark, "job-updates")
    source = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    events = stream.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), "event_id", jobs.status_of(F.col("event_type")).alias("status"))
    run = jobs.updates(events, "3650 days").writeStream.outputMode("update").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).foreachBatch(jobs.upsert_into(f"{at}/jobs", "job_id", "events")).start()
    run.awaitTermination()
    last = max((p["batchId"] for p in run.recentProgress), default=0)
    return spark.read.parquet(f"{at}/jobs/v={last}").withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
