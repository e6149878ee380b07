import datetime as dt
import json

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import selection, times
from gridloom.operators import metrics, models


def test_encoder(spark):
    df = spark.createDataFrame([(1, "ab", 9), (2, None, 9), (3, "b", 9)], "id long, text string, vector int")
    got = {r.id: r.vector for r in models.encoded(df, "text", lambda: lambda ts: np.array([[t.count("a"), t.count("b")] for t in ts]), ["id"]).collect()}
    assert np.allclose(got[1], [0.5**0.5] * 2) and got[2] is None and got[3] == [0.0, 1.0]


def test_a_fake_selector_end_to_end(spark):
    def load():
        def ask(prompt, attempt):
            if "never" in prompt or attempt == 1:
                raise RuntimeError("busy")
            return {"answer": json.dumps({"sheet_ids": ["bytesheet_2"]}), "prompt_tokens": 100, "output_tokens": 5, "cached_tokens": 80}

        return ask

    asked = spark.createDataFrame([(0, "find B", ["1", "2"], ["2"]), (1, "never", ["1", "2"], ["1"])], "query_id long, prompt string, valid array<string>, relevant array<string>")
    rows = models.answered(asked, "prompt", load, ["query_id", "valid", "relevant"], attempts=2)
    by_id = {r.query_id: r for r in rows.collect()}
    assert (by_id[0].status, by_id[0].attempts, by_id[0].cached_tokens) == ("succeeded", 2, 80)
    assert (by_id[1].status, by_id[1].error, by_id[1].answer) == ("failed", "RuntimeError: busy", None)
    chosen = rows.select("query_id", F.posexplode(selection.repaired(selection.parsed_selection(F.col("answer")), F.col("valid"), 1)).alias("p", "item_id"))
    relevant = rows.select("query_id", F.explode("relevant").alias("item_id"))
    report = metrics.at_cutoffs(chosen.select("query_id", (F.col("p") + 1).alias("rank_no"), "item_id"), relevant, (1,)).first()
    assert (report.num_queries, report.recall) == (2, 0.5)


def test_requests(spark):
    rows = spark.createDataFrame([("q", ["https://a.example/x.xlsx"]), (" ", []), ("q", ["http://a", None]), (None, None)], "query string, urls array<string>")
    assert [r.errors for r in models.request_errors(rows).collect()] == [[], ["blank query", "no addresses"], ["no https address: http://a", "no https address: null"], ["blank query", "no addresses"]]


def test_times(spark):
    t = F.lit(dt.datetime(2024, 2, 28, 23, 5, 9))
    row = spark.range(1).select(times.iso_z(t).alias("a"), times.iso_z(times.expiry(t)).alias("b"), times.job_id().alias("c"), times.job_id(F.lit(7)).alias("d"), times.poll_url("https://x/", F.lit("job_1")).alias("e")).first()
    assert (row.a, row.b, row.e) == ("2024-02-28T23:05:09Z", "2024-02-29T23:05:09Z", "https://x/api/v1/retrieval/jobs/job_1")
    assert len(row.c) == len(row.d) == 36 and row.c != row.d
