"""Records that differ only in formatting: one record each, with the number of its copies.

Two texts are equal if they have the same letters and digits in the same order. In texts made of two or more
`field: value` (or `field = value`) pieces the order of the pieces doesn't matter either: their key is the sorted
list of the pieces' keys. A text without such pieces that has the letters and digits of one with pieces takes that
text's key. Lists whose pieces have the same letters and digits in the same order, but other borders, are equal too:
all keys of pieces that are linked through such texts make one class.

Keys that hold more than a share of all records are found exactly, from counts combined before the shuffle; there
are at most 1 / share of them. Their records are aggregated in two levels, by key and salt and then by key, and get
their representative by broadcast; all other keys are aggregated by one shuffle and joined by another.

Null, blank and letterless texts have no key: such a record is its own representative and copy of nothing. Records
delivered twice count once. Accents are compared as they are stored, except that an accent stored apart is joined
with its letter where one character exists for both.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gridloom.runtime import HEAVY_SHARE, cut, heavy_keys, merged, salt, skew_join

_DROPPED = r"[^\p{L}\p{N}\p{M}]+"
_PIECE = r"(?s)^[^:=]*[\p{L}\p{N}][^:=]*[:=].*[\p{L}\p{N}]"


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def letters(text: Column) -> Column:
    """Lower-case letters and digits (and accents) only."""
    return F.regexp_replace(F.lower(text), _DROPPED, "")


def _pieces(text: Column) -> Column:
    """The parts between ; | and line ends; a line without a field of its own belongs to the part before it."""
    joined = F.regexp_replace(text, r"[\r\n\u000b\u0085\u2028\u2029]+(?=[^:=;|\r\n]*(?:\z|[;|\r\n]))", " ")
    return F.filter(F.split(joined, r"[;|\r\n\u000b\u0085\u2028\u2029]+"), lambda p: letters(p) != "")


def with_keys(df: DataFrame, text: str) -> DataFrame:
    """df with flat (digest of the letters) and parted (digest of the sorted pieces, null without pieces); both
    null for a text without letters."""
    plain = df.where(~F.coalesce(F.col(text).rlike(r"\p{M}"), F.lit(False)))
    marked = df.where(F.col(text).rlike(r"\p{M}")).withColumn(text, _composed(text))

    def keyed(part: DataFrame) -> DataFrame:
        pieces = _pieces(F.col(text))
        listed = (F.size(pieces) >= 2) & F.forall(pieces, lambda p: p.rlike(_PIECE))
        flat = letters(F.col(text))
        return part.withColumn("flat", F.when(flat != "", F.unhex(F.md5(flat)))).withColumn(
            "parted", F.when((flat != "") & listed, F.unhex(F.md5(F.array_join(F.array_sort(F.transform(pieces, letters)), "|"))))
        )

    return keyed(plain).unionByName(keyed(marked))


def keyed_records(df: DataFrame, record: str, text: str) -> DataFrame:
    """(record, key) of each distinct record with letters in its text; cut from its lineage, as several steps use it."""
    keys = cut(with_keys(df.select(record, text), text).where(F.col("flat").isNotNull() & F.col(record).isNotNull()).groupBy(record, "flat").agg(F.min("parted").alias("parted")))
    classes = cut(keys.where("parted is not null").select("parted", "flat").distinct())
    labels = merged(classes, "parted", "flat")
    of_parted = classes.join(labels, "parted", "left").select("parted", "flat", F.coalesce("label", "parted").alias("class"))
    parted = skew_join(keys.where("parted is not null").select(record, "parted"), of_parted.select("parted", "class").distinct(), "parted")
    taken = of_parted.groupBy("flat").agg(F.min("class").alias("of_flat"))
    loose = skew_join(keys.where("parted is null").drop("parted"), taken, "flat", "left").select(record, F.coalesce("of_flat", "flat").alias("key"))
    return parted.select(record, F.col("class").alias("key")).unionByName(loose)


def representatives(keyed: DataFrame, record: str, share: float = HEAVY_SHARE, salts: int = 32) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The heavy keys; (key, keep, copies) of the heavy keys; the same of all others."""
    heavy = heavy_keys(keyed, "key", share=share)
    hot = keyed.join(F.broadcast(heavy), "key", "left_semi")
    cold = keyed.join(F.broadcast(heavy), "key", "left_anti")
    salted = hot.groupBy("key", salt(record, salts).alias("salt")).agg(F.min(record).alias("keep"), F.count("*").alias("copies"))
    return (
        heavy,
        salted.groupBy("key").agg(F.min("keep").alias("keep"), F.sum("copies").alias("copies")),
        cold.groupBy("key").agg(F.min(record).alias("keep"), F.count("*").alias("copies")),
    )


def copies(df: DataFrame, record: str, text: str, share: float = HEAVY_SHARE) -> DataFrame:
    """(keep, copy): each record whose text equals that of one with a smaller identifier, and the smallest of its
    group."""
    keyed = cut(keyed_records(df, record, text))
    heavy, hot, cold = representatives(keyed, record, share)
    pairs = (
        keyed.join(F.broadcast(hot.select("key", "keep")), "key")
        .unionByName(keyed.join(F.broadcast(heavy), "key", "left_anti").join(cold.where("copies > 1").select("key", "keep"), "key"))
        .where(F.col(record) > F.col("keep"))
    )
    return pairs.select("keep", F.col(record).alias("copy"))


def collapsed(df: DataFrame, record: str, text: str, share: float = HEAVY_SHARE) -> DataFrame:
    """(record, copies): one record for each group of equal texts, the one with the smallest identifier, and the
    number of records in its group, itself included."""
    _, hot, cold = representatives(cut(keyed_records(df, record, text)), record, share)
    return hot.unionByName(cold).select(F.col("keep").alias(record), "copies")
