import datetime as dt

from pyspark.sql import functions as F

from gridloom.streaming import jobs

SCHEMA = "job_id long, at timestamp, event_id long, status string"


def at(hour):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


EVENTS = [
    [(1, at(0), 1, "queued"), (1, at(2), 3, "succeeded"), (2, at(1), 2, "running")],
    [(1, at(1), 4, "running"), (2, at(3), 5, "failed"), (3, at(3), 6, "queued")],
    [(3, at(3), 7, "running"), (2, at(4), 8, "succeeded")],
]


def test_a_stream_in_several_batches_ends_like_one_table(spark, tmp_path):
    for i, rows in enumerate(EVENTS):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = jobs.upsert_into(str(tmp_path / "jobs"), "job_id", "events")
    run = jobs.updates(stream, "30 days").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).foreachBatch(sink).start()
    run.awaitTermination()
    versions = sorted(int(p.name[2:]) for p in (tmp_path / "jobs").iterdir())
    got = {r.job_id: (r.status, r.events, r.updated_at) for r in spark.read.parquet(str(tmp_path / f"jobs/v={versions[-1]}")).collect()}
    assert got == {1: ("succeeded", 3, at(2)), 2: ("succeeded", 3, at(4)), 3: ("running", 2, at(3))}
    table = jobs.latest(spark.createDataFrame([r for rows in EVENTS for r in rows], SCHEMA))
    assert {r.job_id: r.status for r in table.collect()} == {k: v[0] for k, v in got.items()}


def test_a_batch_written_twice_changes_nothing(spark, tmp_path):
    sink = jobs.upsert_into(str(tmp_path), "k", "n")
    first, second = spark.createDataFrame([(1, 1), (2, 5)], "k long, n long"), spark.createDataFrame([(1, 3), (2, 4)], "k long, n long")
    sink(first, 0)
    for _ in range(2):
        sink(second, 1)
        assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "v=1")).collect()} == {(1, 3), (2, 5)}


def test_time_to_live_and_partial_failures(spark):
    events = spark.createDataFrame([r for rows in EVENTS for r in rows] + [(9, at(5), 9, "failed")], SCHEMA)
    table = jobs.latest(events)
    assert {r.job_id for r in jobs.expired(table, F.lit(at(24.5))).collect()} == {1}
    report = {r.job_id: (r.results, r.errors, r.status) for r in jobs.partial_failures(events).collect()}
    assert report[2] == (2, 1, "succeeded") and report[9] == (0, 1, "failed")
    assert jobs.latest(events.where("false")).count() == 0
