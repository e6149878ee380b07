"""References to records that do not exist: missing, not yet there, or already deleted.

References are counted per key and period (month) before anything is joined, and these cells are judged: a cell
whose key has no record is missing, one in a month before the first loading is late, one in a month after the first
deletion is deleted. Only in the month of the loading or the deletion itself does the exact time matter. Keys that
hold more than HEAVY_SHARE of all references (at most 1 / HEAVY_SHARE keys, so the broadcast of their cells is
bounded) are looked up by broadcast, all others by a shuffle anti-join and join of the cells; both are united.
`orphans` then meets the references with the judged cells only, `orphan_counts` sums the cells themselves.

Null or blank keys are no references; a null creation time allows only the reason `missing`; empty tables give
no rows; repeated references of a record count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import clean_ids, strip
from gridloom.runtime import cut, heavy_keys

COLUMNS = ["ref_table", "ref_id", "ref_field", "sheet_id", "created_at"]


def references(df: DataFrame, name: str, ref_id: str, ids: dict[str, Column], created_at: str = "created_at", repeats: bool = False) -> DataFrame:
    """(ref_table, ref_id, ref_field, sheet_id, created_at), one row for each distinct id of a field; with repeats, of
    each delivery of a record, which saves a shuffle where the caller makes its results distinct."""
    fields = F.array(*[F.struct(F.lit(f).alias("f"), F.array_distinct(clean_ids(c)).alias("v")) for f, c in ids.items()])
    found = df.select(F.lit(name).alias("ref_table"), F.col(ref_id).alias("ref_id"), F.col(created_at).alias("created_at"), F.explode(fields).alias("x")).select(
        "ref_table", "ref_id", F.col("x.f").alias("ref_field"), F.explode("x.v").alias("sheet_id"), "created_at"
    )
    return found if repeats else found.distinct()


def lifetimes(sheets: DataFrame) -> DataFrame:
    """(sheet_id, first_loaded, first_deleted) of each trimmed key."""
    return (
        sheets.select(strip(F.col("sheet_id")).alias("sheet_id"), "loaded_at", "deleted_at")
        .where("sheet_id is not null and sheet_id <> ''")
        .groupBy("sheet_id")
        .agg(F.min("loaded_at").alias("first_loaded"), F.min("deleted_at").alias("first_deleted"))
    )


def _month(t: Column) -> Column:
    """The months since year 0; -1 for null."""
    return F.coalesce(F.year(t) * 12 + F.month(t) - 1, F.lit(-1))


def _by_month() -> Column:
    """The reason that holds for a whole month; `exact` where the time within the month decides."""
    loaded, deleted = _month(F.col("first_loaded")), _month(F.col("first_deleted"))
    there = F.col("month") >= 0
    return (
        F.when(there & F.col("first_loaded").isNotNull() & (F.col("month") < loaded), "late")
        .when(there & ((F.col("month") == loaded) | (F.col("month") == deleted)), "exact")
        .when(there & F.col("first_deleted").isNotNull() & (F.col("month") > deleted), "deleted")
    )


def _by_time() -> Column:
    exact = F.when(F.col("created_at") < F.col("first_loaded"), "late").when(F.col("created_at") >= F.col("first_deleted"), "deleted")
    return F.when(F.col("reason") == "exact", exact).otherwise(F.col("reason"))


def _judged(cells: DataFrame, heavy: DataFrame, sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells of heavy keys, and those of all others, with reason, first_loaded and first_deleted; only cells that
    are orphans or may hold some. cells: (sheet_id, month, ...)."""
    lives = lifetimes(sheets)
    at_heavy = F.broadcast(heavy.join(lives.withColumn("known", F.lit(True)), "sheet_id", "left"))
    hot = cells.join(at_heavy, "sheet_id").withColumn("reason", F.when(F.col("known").isNull(), "missing").otherwise(_by_month())).drop("known")
    cold = cells.join(F.broadcast(heavy), "sheet_id", "left_anti")
    missing = cold.join(lives, "sheet_id", "left_anti").withColumns({c: F.lit(None).cast(t) for c, t in lives.dtypes if c != "sheet_id"}).withColumn("reason", F.lit("missing"))
    timed = cold.join(lives, "sheet_id").withColumn("reason", _by_month())
    return hot.where("reason is not null"), missing.unionByName(timed).where("reason is not null")


def orphans(refs: DataFrame, sheets: DataFrame) -> DataFrame:
    """COLUMNS and reason of each reference without a record at its time. `late`: created before the first
    loading; `deleted`: created at or after the first deletion; `late` wins where both hold. Repeated rows of refs
    are repeated."""
    placed = refs.select(*COLUMNS, _month(F.col("created_at")).alias("month"))
    cells = cut(placed.groupBy("sheet_id", "month").agg(F.count("*").alias("n")))
    heavy = cut(heavy_keys(cells, "sheet_id", F.col("n")))
    hot, cold = _judged(cells.drop("n"), heavy, sheets)
    found = placed.join(F.broadcast(hot), ["sheet_id", "month"]).unionByName(placed.join(F.broadcast(heavy), "sheet_id", "left_anti").join(cold, ["sheet_id", "month"]))
    return found.withColumn("reason", _by_time()).where("reason is not null").select(*COLUMNS, "reason")


def orphan_counts(refs: DataFrame, sheets: DataFrame) -> DataFrame:
    """(ref_table, period, reason, refs, keys): orphan references per table and month of creation (null where
    unknown). The cells' own counts are added up; only the references of cells that the time within the month decides
    are looked at one by one."""
    placed = refs.select(*COLUMNS, _month(F.col("created_at")).alias("month")).distinct()
    cells = cut(placed.groupBy("ref_table", "sheet_id", "month").agg(F.count("*").alias("n")))
    hot, cold = _judged(cells, cut(heavy_keys(cells, "sheet_id", F.col("n"))), sheets)
    judged = cut(hot.unionByName(cold))
    key = ["ref_table", "sheet_id", "month"]
    exact = placed.join(judged.where("reason = 'exact'").drop("n"), key).withColumn("reason", _by_time()).where("reason is not null")
    per_key = judged.where("reason <> 'exact'").select(*key, "reason", "n").unionByName(exact.groupBy(*key, "reason").agg(F.count("*").alias("n")))
    period = F.when(F.col("month") >= 0, F.make_date(F.floor(F.col("month") / 12).cast("int"), F.col("month") % 12 + 1, F.lit(1)))
    return per_key.groupBy("ref_table", period.alias("period"), "reason").agg(F.sum("n").alias("refs"), F.count_distinct("sheet_id").alias("keys"))


def sheet_references(queries: DataFrame, edges: DataFrame, repeats: bool = False) -> DataFrame:
    """The references to sheets of queries and dependency batches."""
    own = references(queries, "queries", "query_index", {f: F.col(f) for f in ("positive_sheet_ids", "hard_negative_sheet_ids")}, repeats=repeats)
    ends = {"edges": F.flatten(F.filter("edges", lambda e: e.isNotNull()))}
    return own.unionByName(references(edges, "dependency_edges", "edge_batch_id", ends, repeats=repeats))
