"""Checks of metadata that return rows of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import clean_ids, strip

# The fields of metadata records.
SHEET_FIELDS = ("sheet_id", "name", "num_rows", "num_cols", "columns", "source")
COLUMN_FIELDS = ("name",)
QUERY_FIELDS = (
    "query", "query_type", "dependency_type", "positive_sheet_ids", "negative_sheet_ids", "is_dependency_heavy", "hard_negative_sheet_ids",
    "hard_negative_types", "dependency_sheet_ids", "dependency_positive_sheet_ids", "dependency_edge_sheet_ids", "dependency_edges", "split",
)
ID_FIELDS = (
    "positive_sheet_ids", "negative_sheet_ids", "hard_negative_sheet_ids", "dependency_sheet_ids", "dependency_positive_sheet_ids", "dependency_edge_sheet_ids", "sheet_ids", "sheet_ids_negative",
)


def extra_fields(payloads: DataFrame, payload: str, allowed: tuple[str, ...], keep: list[str]) -> DataFrame:
    """keep and extra of each JSON object with fields that aren't allowed; extra: their sorted names."""
    names = F.array_sort(F.array_except(F.json_object_keys(F.when(F.try_parse_json(payload).isNotNull(), F.col(payload))), F.array(*map(F.lit, allowed))))
    return payloads.withColumn("extra", names).where("size(extra) > 0").select(*keep, "extra")


def sheet_errors(records: DataFrame) -> DataFrame:
    """(key, place, error) of sheet records (key, record as variant): records and columns that are no objects, fields
    that aren't allowed, columns without a name. place: empty, or the column like `columns[3]`."""
    get = lambda v, kind, path="$": F.call_function("try_variant_get", v, F.lit(path), F.lit(kind))

    def checked(v: Column, allowed: tuple[str, ...], place: Column) -> list[Column]:
        names = F.array_sort(F.array_except(F.map_keys(get(v, "map<string,variant>")), F.array(*map(F.lit, allowed))))
        whole = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
        text = F.when(~whole, "not an object").when(F.size(names) > 0, F.concat(F.lit("disallowed fields: "), F.array_join(names, ", ")))
        return [F.when(text.isNotNull(), F.struct(place.alias("place"), text.alias("error")))]

    def column(c: Column, i: Column) -> Column:
        place = F.concat(F.lit("columns["), i.cast("string"), F.lit("]"))
        blank = F.schema_of_variant(c).startswith("OBJECT") & (F.coalesce(strip(get(c, "string", "$.name")), F.lit("")) == "")
        return F.array(*checked(c, COLUMN_FIELDS, place), F.when(blank, F.struct(place.alias("place"), F.lit("empty column name").alias("error"))))

    columns = F.coalesce(get(F.col("record"), "array<variant>", "$.columns"), F.array().cast("array<variant>"))
    found = F.concat(F.array(*checked(F.col("record"), SHEET_FIELDS, F.lit(""))), F.flatten(F.transform(columns, column)))
    return records.select("key", F.explode(F.array_compact(found)).alias("e")).select("key", "e.place", "e.error")


def query_errors(queries: DataFrame, sheets: DataFrame, fields: tuple[str, ...] = ID_FIELDS) -> DataFrame:
    """(query_index, field, error): blank texts, and ids in any of the id fields that no sheet has."""
    blank = queries.where(F.coalesce(strip(F.col("query")), F.lit("")) == "").select("query_index", F.lit("query").alias("field"), F.lit("blank text").alias("error"))
    used = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), clean_ids(F.col(f)).alias("ids")) for f in fields])).alias("x")
    ids = queries.select("query_index", used).select("query_index", "x.field", F.explode("x.ids").alias("sheet_id")).distinct()
    unknown = ids.join(sheets.select(strip(F.col("sheet_id")).alias("sheet_id")).distinct(), "sheet_id", "left_anti")
    return blank.unionByName(unknown.select("query_index", "field", F.concat(F.lit("unknown id "), "sheet_id").alias("error"))).distinct()


def edge_errors(batches: DataFrame, sheets: DataFrame) -> DataFrame:
    """(edge_batch_id, position, error): edges without exactly two ends, and ends that are blank or unknown."""
    edges = batches.select("edge_batch_id", F.posexplode("edges").alias("position", "edge"))
    arity = edges.where("edge is null or size(edge) <> 2").select("edge_batch_id", "position", F.concat(F.lit("ends: "), F.coalesce(F.size("edge"), F.lit(0)).cast("string")).alias("error"))
    ends = edges.select("edge_batch_id", "position", F.explode("edge").alias("end")).select("edge_batch_id", "position", F.coalesce(strip(F.col("end")), F.lit("")).alias("sheet_id"))
    unknown = ends.join(sheets.select(strip(F.col("sheet_id")).alias("sheet_id")).distinct(), "sheet_id", "left_anti")
    return arity.unionByName(unknown.select("edge_batch_id", "position", F.concat(F.lit("unknown end "), "sheet_id").alias("error"))).distinct()


def resume(todo: DataFrame, done: DataFrame, key: str, succeeded: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of todo whose key has no succeeded row in done, and the succeeded rows to keep."""
    kept = done.where(succeeded)
    return todo.join(kept.select(key).distinct(), key, "left_anti"), kept


def same_settings(a: dict, b: dict, keys: tuple[str, ...]) -> None:
    """An error if two runs differ in any of the settings that results depend on."""
    differ = [k for k in keys if a.get(k) != b.get(k)]
    if differ:
        raise ValueError(f"the earlier run had other settings: {', '.join(differ)}")
