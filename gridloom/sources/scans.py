"""Scans of query and pair tables in their several forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import clean_ids, strip

NEGATIVES = ("hard_negative_sheet_ids", "sheet_ids_negative", "negative_sheet_ids")


def evaluation_queries(queries: DataFrame, known: DataFrame, most: int = 0, negatives: tuple[str, ...] = NEGATIVES) -> DataFrame:
    """(query_index, query, positives, negatives) of the queries with text and known positives. Positives come from
    positive_sheet_ids, else sheet_ids; negatives from the first column that isn't null; both keep the order of their
    first occurrence. `most` takes the first so many by query_index (0: all)."""
    columns = {"positives": F.coalesce("positive_sheet_ids", "sheet_ids"), "negatives": F.coalesce(*negatives)}
    base = queries.where(F.coalesce(strip(F.col("query")), F.lit("")) != "").select("query_index", strip(F.col("query")).alias("query"), *[F.array_distinct(clean_ids(c)).alias(n) for n, c in columns.items()]).dropDuplicates(["query_index"])
    there = known.select(strip(F.col("sheet_id")).alias("sheet_id")).distinct()

    def kept(name: str) -> DataFrame:
        ids = base.select("query_index", F.posexplode(name).alias("at", "sheet_id")).join(there, "sheet_id", "left_semi")
        return ids.groupBy("query_index").agg(F.array_sort(F.collect_list(F.struct("at", "sheet_id"))).alias("l")).select("query_index", F.transform("l", lambda x: x["sheet_id"]).alias(name))

    out = base.select("query_index", "query").join(kept("positives"), "query_index").join(kept("negatives"), "query_index", "left")
    out = out.withColumn("negatives", F.coalesce("negatives", F.array().cast("array<string>")))
    return out.orderBy("query_index").limit(most) if most else out


def from_workspace(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with positives and negatives from a workspace and its labels. Labels stay with their ids when unknown ids
    are dropped; ids are looked up by join, once for each distinct workspace."""
    keyed = rows.withColumn("__key", F.md5(F.to_json(F.struct("workspace_sheet_ids", "labels"))))
    one = keyed.dropDuplicates(["__key"])
    at = one.select("__key", F.posexplode(F.arrays_zip(F.transform("workspace_sheet_ids", strip).alias("id"), F.col("labels").alias("y"))).alias("at", "z")).select("__key", "at", F.col("z.id").alias("sheet_id"), F.col("z.y").alias("y"))
    there = at.join(known.select(strip(F.col("sheet_id")).alias("sheet_id")).distinct(), "sheet_id", "left_semi")
    lists = there.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("at", "sheet_id", "y"))).alias("l"))
    ids = lambda y: F.transform(F.filter("l", lambda x: x["y"] == y), lambda x: x["sheet_id"])
    return keyed.join(lists, "__key", "left").withColumn("positives", ids(1)).withColumn("negatives", ids(0)).drop("__key", "l")


def pair_ids(pairs: DataFrame) -> DataFrame:
    """(id_1, id_2, label) of training pairs in any of the id encodings whose columns are there."""
    there = set(pairs.columns)

    def first(*names: str):
        found = [F.col(n) for n in names if n.split(".")[0] in there]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return pairs.select(first("table1.sheet_id", "sheet_a", "sheet_id_1").alias("id_1"), first("table2.sheet_id", "sheet_b", "sheet_id_2").alias("id_2"), F.coalesce("label", F.lit(0)).alias("label"))


def enriched_headers(sheets: DataFrame) -> DataFrame:
    """sheets with headers: every column with its position, and statistics of zero where it has none."""
    zero = F.struct(F.lit(False).alias("is_numeric"), *[F.lit(0.0).alias(s) for s in ("null_ratio", "mean_norm", "std_norm", "min_norm", "max_norm")])
    return sheets.withColumn("headers", F.transform(F.coalesce("columns", F.array().cast("array<struct<name:string,example:string>>")), lambda c, i: F.struct(F.coalesce(c["name"], F.lit("")).alias("text"), i.alias("col_idx"), F.lit("unknown").alias("dtype"), zero.alias("value_stats"))))
