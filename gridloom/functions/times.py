"""Times and names of jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_z(t: Column) -> Column:
    """A UTC time to the second, like 2024-01-31T09:05:00Z."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def expiry(created: Column, hours: int = 24) -> Column:
    return created + F.make_interval(hours=F.lit(hours))


def job_id(seed: Column | None = None) -> Column:
    """`job_` and 32 hexadecimal digits: random, or always the same for a seed."""
    return F.concat(F.lit("job_"), F.md5(seed.cast("string")) if seed is not None else F.replace(F.uuid(), F.lit("-"), F.lit("")))


def poll_url(base: str, job: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/api/v1/retrieval/jobs/"), job)
