"""Scans of metadata files: JSON objects keyed by id or JSON arrays, and duplicates by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.text import strip

SHEET = "struct<sheet_id:string,name:string,num_rows:bigint,num_cols:bigint,columns:array<variant>,source:string>"


def last_wins(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order. Only one row per key and task is moved."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def _get(v: Column, path: str, kind: str) -> Column:
    return F.call_function("try_variant_get", v, F.lit(path), F.lit(kind))


def records(spark: SparkSession, path: str, others: bool = False) -> DataFrame:
    """(key, record): the entries of JSON files that hold one object keyed by id, or one array (keyed by position).
    Entries that are no objects are skipped, with others they are kept; a file of any other type is an error. A file
    is one JSON value and so one row, of 2 GB at most; larger metadata come as several files or as tables."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))
    listed = F.transform(_get(F.col("doc"), "$", "array<variant>"), lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value")))
    keyed = F.map_entries(_get(F.col("doc"), "$", "map<string,variant>"))
    either = F.coalesce(listed, keyed, F.raise_error(F.lit("a metadata file must hold an object or an array")).cast("array<struct<key:string,value:variant>>"))
    return doc.select(F.explode(either).alias("x")).select("x.key", F.col("x.value").alias("record")).where(F.lit(others) | F.schema_of_variant("record").startswith("OBJECT"))


def sheets(spark: SparkSession, path: str, duplicates: str = "error") -> DataFrame:
    """(sheet_id, name, num_rows, num_cols, columns, source) of a sheet file. The id is the record's own, else its
    key. Columns may be objects or plain names. duplicates: `error`, or `last` for the last of each id."""
    r = F.col("record")
    column = lambda c: F.struct(
        F.coalesce(_get(c, "$.name", "string"), F.when(F.schema_of_variant(c) == "STRING", _get(c, "$", "string"))).alias("name"), _get(c, "$.example", "string").alias("example")
    )
    out = records(spark, path).select(
        F.monotonically_increasing_id().alias("__at"),
        F.coalesce(_get(r, "$.sheet_id", "string"), "key").alias("sheet_id"),
        _get(r, "$.name", "string").alias("name"),
        _get(r, "$.num_rows", "bigint").alias("num_rows"),
        _get(r, "$.num_cols", "bigint").alias("num_cols"),
        F.transform(_get(r, "$.columns", "array<variant>"), column).alias("columns"),
        _get(r, "$.source", "string").alias("source"),
    )
    if duplicates == "last":
        return last_wins(out, "sheet_id", [F.desc("__at")]).drop("__at")
    repeated = out.groupBy("sheet_id").count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"sheet id {repeated[0].sheet_id!r} occurs {repeated[0]['count']} times")
    return out.drop("__at")


def sanitised(sheets_: DataFrame) -> DataFrame:
    """Only the known fields: trimmed texts, whole numbers (0 for none), and of the columns the trimmed names that
    aren't blank. Ids stay as they are."""
    text = lambda c: F.coalesce(strip(c), F.lit(""))
    names = F.transform(F.coalesce("columns", F.array().cast("array<struct<name:string,example:string>>")), lambda c: F.struct(text(c["name"]).alias("name")))
    return sheets_.select(
        "sheet_id",
        text(F.col("name")).alias("name"),
        F.coalesce("num_rows", F.lit(0)).cast("long").alias("num_rows"),
        F.coalesce("num_cols", F.lit(0)).cast("long").alias("num_cols"),
        F.filter(names, lambda c: c["name"] != "").alias("columns"),
        text(F.col("source")).alias("source"),
    )
