"""Column expressions on strings and arrays of ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_ids(ids: Column) -> Column:
    """The trimmed ids of an array without null and blank ones, in order; null stays null."""
    return F.filter(F.transform(ids, strip), lambda x: x.isNotNull() & (x != ""))


def id_order(c: Column) -> list[Column]:
    """Sort columns: ids of digits only first and by number, then the others by code point. Numbers may have any
    length: they compare by their digits without leading zeros, first by count, then as strings."""
    digits = F.regexp_replace(c, "^0+(?=.)", "")
    numeric = c.rlike("^[0-9]+$")
    return [
        F.when(numeric, 0).otherwise(1),
        F.when(numeric, F.length(digits)).otherwise(0),
        F.when(numeric, digits).otherwise(F.lit("")),
        c,
    ]
