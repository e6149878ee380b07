"""Texts of sheets, as columns of a DataFrame with name, num_rows, num_cols, columns (array of name and example),
source and sheet_id. Blank parts are left out unless a function says otherwise; null columns count as none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.text import strip

#: Columns of a sheet that its text names; blank ones among them are dropped, not replaced by later ones.
MOST_COLUMNS = 12


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_columns(columns: Column, most: int = MOST_COLUMNS) -> Column:
    return F.slice(F.coalesce(columns, F.array().cast("array<struct<name:string,example:string>>")), 1, most)


def column_labels(columns: Column, most: int = MOST_COLUMNS, examples: bool = False) -> Column:
    """The trimmed names (`name: example` where an example is there) of the first columns, without blank ones."""

    def label(c: Column) -> Column:
        name, example = _or_empty(strip(c["name"])), _or_empty(strip(c["example"]))
        if not examples:
            return name
        return F.when((name != "") & (example != ""), F.concat(name, F.lit(": "), example)).otherwise(F.when(name != "", name).otherwise(example))

    return F.filter(F.transform(first_columns(columns, most), label), lambda x: x != "")


def _segments(*parts: Column) -> Column:
    return F.concat_ws(" ; ", *parts)


def _shape(rows: Column, cols: Column, between: str) -> Column:
    number = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat(F.lit("shape: "), number(rows), F.lit(between), number(cols))


def _listed(prefix: str, labels: Column) -> Column:
    return F.when(F.size(labels) > 0, F.concat(F.lit(prefix), F.array_join(labels, " | ")))


def canonical(examples: bool = False, most: int = MOST_COLUMNS) -> Column:
    """`name: N ; shape: R x C ; columns: a | b`."""
    name = strip(F.col("name"))
    return _segments(F.when(name != "", F.concat(F.lit("name: "), name)), _shape(F.col("num_rows"), F.col("num_cols"), " x "), _listed("columns: ", column_labels(F.col("columns"), most, examples)))


def stage_two(shape: bool = True) -> Column:
    """As canonical, but the name isn't trimmed, the shape may be left out, and a sheet without any part is named by
    its id."""
    parts = [F.when(F.col("name") != "", F.concat(F.lit("name: "), F.col("name")))]
    parts += [_shape(F.col("num_rows"), F.col("num_cols"), " x ")] if shape else []
    text = _segments(*parts, _listed("columns: ", column_labels(F.col("columns"))))
    return F.when(text != "", text).otherwise(F.concat(F.lit("sheet_id: "), F.col("sheet_id")))


def stage_one(examples: bool = False) -> Column:
    """`name: N ; shape: RxC ; headers: a | b`."""
    name = strip(F.col("name"))
    return _segments(F.when(name != "", F.concat(F.lit("name: "), name)), _shape(F.col("num_rows"), F.col("num_cols"), "x"), _listed("headers: ", column_labels(F.col("columns"), examples=examples)))


def compact(most: int = 3) -> Column:
    """`name=N; columns=a | b`, name always there."""
    labels = column_labels(F.col("columns"), most)
    return F.concat(F.lit("name="), _or_empty(strip(F.col("name"))), F.coalesce(_listed("; columns=", labels), F.lit("")))


def miner(most: int = 20) -> Column:
    """`[source] a | b`, blank columns kept."""
    names = F.transform(first_columns(F.col("columns"), most), lambda c: _or_empty(c["name"]))
    return F.concat(F.lit("["), _or_empty(F.col("source")), F.lit("] "), F.array_join(names, " | "))


def runtime() -> Column:
    """`name: N ; shape: R x C ; columns: a | b`, name always there."""
    return _segments(F.concat(F.lit("name: "), _or_empty(F.col("name"))), _shape(F.col("num_rows"), F.col("num_cols"), " x "), _listed("columns: ", column_labels(F.col("columns"))))


def header_set(columns: Column, most: int = MOST_COLUMNS) -> Column:
    """The distinct lower-case names of the first columns, in order."""
    return F.array_distinct(F.transform(column_labels(columns, most), F.lower))


def catalog_line() -> Column:
    """`[id] text`."""
    return F.concat(F.lit("["), F.col("sheet_id"), F.lit("] "), canonical())
