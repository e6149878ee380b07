"""Schemas that drift between files: tagged-union inference over JSON lines.

Every readable line gives, for each path, a type tag; the schemas of all lines are fused per path while alternatives
are kept side by side. `changes` fuses the top-level fields per file (a set of tags per field and file) and compares
each file with the one before it in its feed. `alternatives` fuses all paths, down to the innermost, per feed and
lists where each alternative type appears first. `unified` makes one table: each canonical field has a column of one
type, converted from any alternative, and a column of typed branches that holds the value as it was delivered, so
that a value which can't be converted isn't lost.

A line that is no JSON is unreadable: it has no fields, and `unified` keeps it with readable = false. A null
payload is unreadable too. A JSON value that is no object is readable and has no fields. Nulls and empty arrays
have no type. Lines delivered twice count once. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.text import strip
from gridloom.runtime import cut

#: Fields that are one field under two names.
PAIRS = {"sheet_ids": "positive_sheet_ids", "sheet_ids_negative": "negative_sheet_ids", "query": "question"}


def _tag(schema: Column) -> Column:
    """The type's name for a schema as text; null for nulls and empty arrays."""

    def scalar(s: Column) -> Column:
        return (
            F.when(s == "STRING", "string")
            .when(s == "BOOLEAN", "boolean")
            .when(s.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), "number")
            .when(s.startswith("OBJECT"), "object")
        )

    inner = F.regexp_extract(schema, "^ARRAY<(.*)>$", 1)
    of = F.coalesce(scalar(inner), F.when(inner.startswith("ARRAY"), "array").when(inner == "VARIANT", "mixed"))
    return F.when(schema.startswith("ARRAY"), F.when(of.isNotNull(), F.concat(F.lit("array<"), of, F.lit(">")))).otherwise(scalar(schema))


LINE = ["feed", "file_name", "file_seq", "line_no"]


def parsed(raw: DataFrame) -> DataFrame:
    """The lines with doc (variant, null if unreadable) and fields (map of the top-level fields). Lines delivered
    twice are there twice."""
    return (
        raw.select(*LINE, "loaded_at", "payload").withColumn("doc", F.try_parse_json("payload")).withColumn("fields", F.expr("try_variant_get(doc, '$', 'map<string,variant>')"))
    )


def _once(raw: DataFrame) -> DataFrame:
    """Each line once, with its first loading."""
    return raw.groupBy(*LINE, F.md5("payload").alias("digest")).agg(F.min("loaded_at").alias("loaded_at"), F.first("payload").alias("payload")).drop("digest")


def field_tags(lines: DataFrame) -> DataFrame:
    """(feed, file_name, file_seq, field, tags): the fused alternatives of each field of each file. Tags are
    gathered as sets before the shuffle, so a huge file costs a few rows per task."""
    return (
        lines.select("feed", "file_name", "file_seq", F.explode("fields").alias("field", "value"))
        .select("feed", "file_name", "file_seq", "field", _tag(F.schema_of_variant("value")).alias("tag"))
        .groupBy("feed", "file_name", "file_seq", "field")
        .agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    )


def changes(raw: DataFrame, pairs: dict[str, str] = PAIRS) -> DataFrame:
    """(file_name, change_kind, old_field, new_field): what is new in a file against the file before it in its
    feed. A feed's first file has no changes. A renamed field may also have another type; both are reported."""
    files = raw.select("feed", "file_name", "file_seq").distinct()
    order = W.partitionBy("feed").orderBy("file_seq", "file_name")
    chain = files.select("file_name", F.lag("file_name").over(order).alias("before")).where("before is not null")
    tags = cut(field_tags(parsed(raw)).select("file_name", "field", "tags"))
    now = tags.join(chain.select("file_name"), "file_name", "left_semi")
    was = tags.withColumnRenamed("file_name", "before").join(chain, "before").select("file_name", "field", F.col("tags").alias("old_tags"), F.lit(True).alias("was"))
    both = now.withColumn("is", F.lit(True)).join(was, ["file_name", "field"], "full_outer")

    other = F.create_map(*[F.lit(x) for a, b in pairs.items() for x in (a, b, b, a)])
    gone = both.where("is is null").select("file_name", F.col("field").alias("old_field"), "old_tags", other[F.col("field")].alias("new_field"))
    new = both.where("was is null").select("file_name", F.col("field").alias("new_field"), "tags", F.lit(True).alias("new"))
    moved = gone.join(new, ["file_name", "new_field"], "full_outer")
    kind = F.when(F.col("new").isNull(), "removed").when(F.col("old_field").isNull(), "added").otherwise("renamed")
    named = moved.select(
        "file_name",
        kind.alias("change_kind"),
        F.coalesce("old_field", F.lit("")).alias("old_field"),
        F.when(F.col("new"), F.col("new_field")).otherwise("").alias("new_field"),
        F.col("old_tags").alias("a"),
        F.col("tags").alias("b"),
    )
    kept = both.where("is and was").select("file_name", F.lit("kept").alias("change_kind"), F.col("field").alias("old_field"), F.col("field").alias("new_field"), F.col("old_tags").alias("a"), F.col("tags").alias("b"))
    retyped = F.when((F.size("a") > 0) & (F.size("b") > 0) & (F.col("a") != F.col("b")), "type_changed")
    kinds = F.explode(F.array_compact(F.array(F.when(F.col("change_kind") != "kept", F.col("change_kind")), F.when(F.col("change_kind").isin("kept", "renamed"), retyped))))
    return named.unionByName(kept).select("file_name", kinds.alias("change_kind"), "old_field", "new_field")


def _kind(schema: Column) -> Column:
    """The tag of a value on its own; an array's elements have tags of their own, without any it has none."""
    return F.when(schema.startswith("ARRAY"), F.when(schema != "ARRAY<VOID>", "array")).otherwise(_tag(schema))


def typed_paths(lines: DataFrame) -> DataFrame:
    """(LINE, path, alternative) of every value of every line that has a type: `.x` leads to the field x of an object,
    `[]` to the elements of an array. Goes down level by level until no value holds others."""
    level = lines.select(*LINE, F.explode("fields").alias("path", "value"))
    found = None
    inner = F.coalesce(
        F.transform(F.map_entries(F.expr("try_variant_get(value, '$', 'map<string,variant>')")), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("step"), e["value"].alias("value"))),
        F.transform(F.expr("try_variant_get(value, '$', 'array<variant>')"), lambda x: F.struct(F.lit("[]").alias("step"), x.alias("value"))),
    )
    while True:
        here = level.select(*LINE, "path", _kind(F.schema_of_variant("value")).alias("alternative"))
        found = here if found is None else found.unionByName(here)
        level = level.select(*LINE, "path", F.explode(inner).alias("x")).select(*LINE, F.concat("path", "x.step").alias("path"), F.col("x.value").alias("value"))
        if level.isEmpty():
            return found.where("alternative is not null")


def alternatives(raw: DataFrame) -> DataFrame:
    """(feed, path, alternative, first_file_seq, first_file_name, lines): each type that a path takes in a feed, where
    it appears first, and in how many lines."""
    per_line = typed_paths(parsed(raw)).distinct()
    return (
        per_line.groupBy("feed", "path", "alternative")
        .agg(F.min(F.struct("file_seq", "file_name")).alias("at"), F.count("*").alias("lines"))
        .select("feed", "path", "alternative", F.col("at.file_seq").alias("first_file_seq"), F.col("at.file_name").alias("first_file_name"), "lines")
    )


def _as_ids(v: Column) -> Column:
    """Array of ids from any of the branches: strings, numbers, objects with sheet_id, or one comma-parted string."""
    items = F.call_function("try_variant_get", v, F.lit("$"), F.lit("array<variant>"))

    def get(x: Column, path: str) -> Column:
        return F.call_function("try_variant_get", x, F.lit(path), F.lit("string"))

    def one(x: Column) -> Column:
        return F.coalesce(get(x, "$.sheet_id"), F.when(~F.schema_of_variant(x).startswith("OBJECT"), get(x, "$")))

    text = get(v, "$")
    ids = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.transform(items, one)).when(F.schema_of_variant(v) != "VOID", F.split(text, ","))
    return F.filter(F.transform(ids, strip), lambda x: x.isNotNull() & (x != ""))


#: Canonical fields of the one consistent table: aliases in order of preference, and canonical type.
CANONICAL = {
    "query": (("query", "question"), "string"),
    "split": (("split",), "string"),
    "query_type": (("query_type",), "string"),
    "dependency_type": (("dependency_type",), "string"),
    "positive_sheet_ids": (("positive_sheet_ids", "sheet_ids"), "ids"),
    "negative_sheet_ids": (("negative_sheet_ids", "sheet_ids_negative"), "ids"),
    "hard_negative_sheet_ids": (("hard_negative_sheet_ids",), "ids"),
    "is_dependency_heavy": (("is_dependency_heavy",), "boolean"),
    "weight": (("weight",), "double"),
}


#: The parts of a typed branch, after the name it was delivered under.
BRANCH = ("tag", "string", "number", "boolean", "json")


def _converted(v: Column, kind: str) -> Column:
    """The value in the canonical type, null where it can't be converted."""
    if kind == "ids":
        return _as_ids(v)
    text = F.call_function("try_variant_get", v, F.lit("$"), F.lit("string"))
    if kind == "boolean":
        low = F.lower(strip(text))
        return F.when(low.isin("true", "1", "yes", "y", "t"), True).when(low.isin("false", "0", "no", "n", "f"), False)
    return text.try_cast("double") if kind == "double" else text


def _branches(v: Column) -> Column:
    """The value as delivered: its tag, its text, number or boolean, and its JSON text."""
    tag = _tag(F.schema_of_variant(v))
    typed = [F.when(tag == t, F.call_function("try_variant_get", v, F.lit("$"), F.lit(k))).alias(t) for t, k in (("string", "string"), ("number", "double"), ("boolean", "boolean"))]
    return F.struct(tag.alias("tag"), *typed, F.to_json(v).alias("json"))


def unified(raw: DataFrame, canonical: dict = CANONICAL) -> DataFrame:
    """One row per distinct line: the canonical fields; for each a column `<field>_as` with its typed branches (null
    where the line has no value for it); tags (field as delivered -> type tag); rest (the fields that fill none of
    these, as JSON text); raw (a payload that is no object). Of two names of a field the first with a value counts,
    the other is in rest. Booleans also come from 0/1 and yes/no texts; what can't be converted is null and stays in
    its branch."""
    out, chosen = parsed(_once(raw)), []
    known = [a for aliases, _ in canonical.values() for a in aliases]
    for name, (aliases, kind) in canonical.items():
        held = [(a, F.try_element_at("fields", F.lit(a))) for a in aliases]
        there = [(a, F.when(F.schema_of_variant(v) != "VOID", v)) for a, v in held]
        origin = F.coalesce(*[F.when(v.isNotNull(), a) for a, v in there])
        both = F.transform(F.array(F.coalesce(*[v for _, v in there])), lambda v: F.struct(_converted(v, kind).alias("value"), _branches(v).alias("branch")))  # noqa: B023
        chosen.append(F.col(f"__{name}_from"))
        out = out.withColumns({f"__{name}_from": origin, f"__{name}": F.get(both, F.lit(0))})
    used = F.array_compact(F.array(*chosen))
    left = F.map_filter("fields", lambda k, v: ~F.array_contains(used, k) & ~(k.isin(known) & (F.schema_of_variant(v) == "VOID")))
    return out.select(
        *LINE,
        "loaded_at",
        F.col("doc").isNotNull().alias("readable"),
        *[F.col(f"__{n}.value").alias(n) for n in canonical],
        *[F.when(F.col(f"__{n}_from").isNotNull(), F.struct(F.col(f"__{n}_from").alias("delivered"), *[F.col(f"__{n}.branch.{c}").alias(c) for c in BRANCH])).alias(f"{n}_as") for n in canonical],
        F.transform_values("fields", lambda k, v: _tag(F.schema_of_variant(v))).alias("tags"),
        F.transform_values(left, lambda k, v: F.to_json(v)).alias("rest"),
        F.when(F.col("fields").isNull(), F.col("payload")).alias("raw"),
    )


def values(raw: DataFrame, canonical: dict = CANONICAL) -> DataFrame:
    """(LINE, field, delivered, tag, string, number, boolean, json): the typed branches of unified, one value a row."""
    each = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"{n}_as").alias("b")) for n in canonical])
    return unified(raw, canonical).select(*LINE, F.explode(each).alias("x")).select(*LINE, "x.field", "x.b.*").where("delivered is not null")
