"""Queries on texts of sheets, ids, prompts and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import selection, serialize
from gridloom.functions.text import clean_ids, id_order, strip
from gridloom.plans.registry import Registry
from gridloom.runtime import cut, ranked, skew_join, table
from gridloom.sources.keyed import last_wins

queries = Registry()

BLANKS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"


def ids_sql(c: str) -> str:
    """The trimmed ids of an array without null and blank ones, the first of each, in order."""
    cleaned = f"list_filter(list_transform({c}, lambda x: {trim_sql('x')}), lambda x: x IS NOT NULL AND x <> '')"
    return f"list_filter({cleaned}, lambda x, i: list_position({cleaned}, x) = i)"


def _columns_sql(most: int = 12) -> str:
    return f"coalesce(columns, [])[1:{most}]"


def _labels_sql(most: int = 12, examples: bool = False) -> str:
    name, ex = f"coalesce({trim_sql('c.name')}, '')", f"coalesce({trim_sql('c.example')}, '')"
    label = name if not examples else f"CASE WHEN {name} <> '' AND {ex} <> '' THEN {name} || ': ' || {ex} WHEN {name} <> '' THEN {name} ELSE {ex} END"
    return f"list_filter(list_transform({_columns_sql(most)}, lambda c: {label}), lambda x: x <> '')"


def _join_sql(labels: str, by: str = " | ") -> str:
    return f"coalesce(array_to_string({labels}, '{by}'), '')"


def _text_sql(between: str, prefix: str, labels: str, name: str) -> str:
    shape = f"'shape: ' || coalesce(CAST(num_rows AS VARCHAR), '?') || '{between}' || coalesce(CAST(num_cols AS VARCHAR), '?')"
    return f"concat_ws(' ; ', {name}, {shape}, CASE WHEN len({labels}) > 0 THEN '{prefix}' || {_join_sql(labels)} END)"


_NAME = f"CASE WHEN {trim_sql('name')} <> '' THEN 'name: ' || {trim_sql('name')} END"


def _add_text(name: str, column, sql: str) -> None:
    @queries.add(name, f"SELECT sheet_id, loaded_at, deleted_at, {sql} AS text FROM sheets")
    def plan(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, "sheets").select("sheet_id", "loaded_at", "deleted_at", column().alias("text"))


_add_text("serialize_canonical", serialize.canonical, _text_sql(" x ", "columns: ", _labels_sql(), _NAME))
_add_text("serialize_with_examples", lambda: serialize.canonical(True), _text_sql(" x ", "columns: ", _labels_sql(12, True), _NAME))
_add_text("serialize_stage1", serialize.stage_one, _text_sql("x", "headers: ", _labels_sql(), _NAME))
_add_text("serialize_stage1_examples", lambda: serialize.stage_one(True), _text_sql("x", "headers: ", _labels_sql(12, True), _NAME))
_add_text("serialize_stage2", serialize.stage_two, _text_sql(" x ", "columns: ", _labels_sql(), "CASE WHEN name <> '' THEN 'name: ' || name END"))
_add_text("serialize_runtime", serialize.runtime, _text_sql(" x ", "columns: ", _labels_sql(), "'name: ' || coalesce(name, '')"))
_add_text("serialize_compact", serialize.compact, f"'name=' || coalesce({trim_sql('name')}, '') || CASE WHEN len({_labels_sql(3)}) > 0 THEN '; columns=' || {_join_sql(_labels_sql(3))} ELSE '' END")
_add_text("serialize_miner", serialize.miner, f"'[' || coalesce(source, '') || '] ' || {_join_sql('list_transform(' + _columns_sql(20) + ', lambda c: coalesce(c.name, chr(0)))')}".replace("coalesce(c.name, chr(0))", "coalesce(c.name, '')"))


@queries.add("header_sets", f"WITH h AS (SELECT sheet_id, loaded_at, list_transform({_labels_sql()}, lambda x: lower(x)) AS l FROM sheets) SELECT sheet_id, loaded_at, list_filter(l, lambda x, i: list_position(l, x) = i) AS headers FROM h")
def header_sets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sheets").select("sheet_id", "loaded_at", serialize.header_set(F.col("columns")).alias("headers"))


_LATEST = f"s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY loaded_at DESC, deleted_at DESC NULLS LAST, name, num_rows) AS n FROM (SELECT * REPLACE ({trim_sql('sheet_id')} AS sheet_id) FROM sheets)) WHERE n = 1)"


def latest_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """One row per sheet: the last delivery wins."""
    rows = table(spark, sf, "sheets").withColumn("sheet_id", strip(F.col("sheet_id")))
    return last_wins(rows, "sheet_id", [F.desc("loaded_at"), F.desc_nulls_last("deleted_at"), F.asc_nulls_last("name"), F.asc_nulls_last("num_rows")])


_ID_ORDER = "CASE WHEN regexp_full_match({0}, '[0-9]+') THEN 0 ELSE 1 END, CASE WHEN regexp_full_match({0}, '[0-9]+') THEN CAST({0} AS HUGEINT) END, encode({0})"

_SCOPE = f"""{_LATEST},
q AS (SELECT DISTINCT query_index, query, {ids_sql("list_concat(coalesce(positive_sheet_ids, sheet_ids, []), coalesce(hard_negative_sheet_ids, []))")} AS ids FROM queries WHERE trim(query) <> ''),
x AS (SELECT query_index, query, unnest(ids) AS sheet_id FROM q),
l AS (SELECT x.query_index, x.query, x.sheet_id, '[' || x.sheet_id || '] ' || {_text_sql(" x ", "columns: ", _labels_sql(), _NAME)} AS line FROM x JOIN s ON x.sheet_id = s.sheet_id),
c AS (SELECT query_index, query, list(sheet_id ORDER BY {_ID_ORDER.format("sheet_id")}) AS ids, list(line ORDER BY {_ID_ORDER.format("sheet_id")}) AS lines FROM l GROUP BY query_index, query)
"""


def scoped(spark: SparkSession, sf: str) -> DataFrame:
    """(query_index, query, ids, lines): the labelled candidates of each query, positives and hard negatives that
    exist, in id order, with a catalog line each. Lists are as long as a query's own labels."""
    q = table(spark, sf, "queries").where("trim(query) <> ''")
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("positive_sheet_ids", "sheet_ids", none), F.coalesce("hard_negative_sheet_ids", none))
    asked = q.select("query_index", "query", F.explode(F.array_distinct(clean_ids(both))).alias("sheet_id")).distinct()
    lines = asked.join(latest_sheets(spark, sf), "sheet_id").select("query_index", "query", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(id_order(F.col("sheet_id")))], "sheet_id", serialize.catalog_line().alias("line")).alias("x"))
    grouped = lines.groupBy("query_index", "query").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return grouped.select("query_index", "query", F.transform("x", lambda x: x["sheet_id"]).alias("ids"), F.transform("x", lambda x: x["line"]).alias("lines"))


@queries.add("catalog_text", f"WITH {_SCOPE} SELECT query_index, query, array_to_string(lines, chr(10)) AS catalog FROM c")
def catalog_text(spark: SparkSession, sf: str) -> DataFrame:
    return scoped(spark, sf).select("query_index", "query", F.array_join("lines", "\n").alias("catalog"))


def _prompt_sql(*head: str) -> str:
    return " || chr(10) || ".join([*(f"'{h}'" for h in head), "array_to_string(lines, chr(10))", "'Query: ' || query"])


@queries.add(
    "prompts",
    f"WITH {_SCOPE} SELECT query_index, {_prompt_sql('Name up to 5 sheets that answer the query, the best first, by the numbers in brackets only.', selection.GUARD, 'Catalog:')} AS prompt FROM c",
)
def prompts(spark: SparkSession, sf: str) -> DataFrame:
    return scoped(spark, sf).select("query_index", selection.prompt(F.col("query"), F.col("lines"), 5).alias("prompt"))


@queries.add(
    "prompts_exact",
    f"""WITH {_SCOPE} SELECT query_index, {_prompt_sql('Choose exactly 5 different sheets for the query, the best first, as a JSON array of their ids.', selection.GUARD, 'Source: labelled candidates', 'Catalog:')} AS prompt FROM c""",
)
def prompts_exact(spark: SparkSession, sf: str) -> DataFrame:
    return scoped(spark, sf).select("query_index", selection.exact_prompt(F.col("query"), F.col("lines"), 5, "labelled candidates").alias("prompt"))


@queries.add("catalog_all", f"""WITH {_LATEST} SELECT row_number() OVER (ORDER BY {_ID_ORDER.format('sheet_id')}) AS position, '[' || sheet_id || '] ' || {_text_sql(" x ", "columns: ", _labels_sql(), _NAME)} AS line FROM s""")
def catalog_all(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog of all sheets, one line a row with its position, so that no task holds the whole text."""
    rows = latest_sheets(spark, sf)
    return ranked(rows, *id_order(F.col("sheet_id"))).select((F.col("position") + 1).alias("position"), serialize.catalog_line().alias("line"))


@queries.add("prompt_sizes", f"WITH {_SCOPE}, n AS (SELECT length(array_to_string(lines, chr(10))) AS n FROM c) SELECT count(*) AS prompts, round(avg(n), 6) AS mean_chars, max(n) AS max_chars, CAST(sum(n) AS BIGINT) AS all_chars, CAST(sum(n // 4) AS BIGINT) AS about_tokens FROM n")
def prompt_sizes(spark: SparkSession, sf: str) -> DataFrame:
    n = scoped(spark, sf).select(F.length(F.array_join("lines", "\n")).cast("long").alias("n"))
    return n.agg(F.count("*").alias("prompts"), F.round(F.avg("n"), 6).alias("mean_chars"), F.max("n").alias("max_chars"), F.sum("n").alias("all_chars"), F.sum(F.floor(F.col("n") / 4)).alias("about_tokens"))


@queries.add(
    "selection_schema",
    f"""WITH {_SCOPE} SELECT query_index, '{{"type": "array", "items": {{"type": "string", "enum": ' || CAST(to_json(ids) AS VARCHAR) || '}}, "minItems": 5, "maxItems": 5, "uniqueItems": true}}' AS schema FROM c""",
)
def selection_schema(spark: SparkSession, sf: str) -> DataFrame:
    return scoped(spark, sf).select("query_index", selection.selection_schema(F.col("ids"), 5).alias("schema"))


_ANSWER = """a AS (SELECT query_index, ids, list_transform(ids, lambda x, i: CASE i % 4 WHEN 0 THEN 'sheet ' || x WHEN 1 THEN x WHEN 2 THEN x ELSE 'none' END) AS said,
  list_transform(ids, lambda x, i: CASE i % 3 WHEN 0 THEN '[sheet_id: ' || x || ']' WHEN 1 THEN x ELSE ' SHEET_ID ' || x END) AS strict FROM c)"""


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers as a model might give them: ids with words before them, in brackets, or unknown."""
    c = scoped(spark, sf)
    said = F.transform("ids", lambda x, i: F.when((i + 1) % 4 == 0, F.concat(F.lit("sheet "), x)).when((i + 1) % 4 == 3, "none").otherwise(x))
    strict = F.transform("ids", lambda x, i: F.when((i + 1) % 3 == 0, F.concat(F.lit("[sheet_id: "), x, F.lit("]"))).when((i + 1) % 3 == 1, x).otherwise(F.concat(F.lit(" SHEET_ID "), x)))
    return c.select("query_index", "ids", said.alias("said"), strict.alias("strict"))


@queries.add(
    "id_repair_lenient",
    f"""WITH {_SCOPE}, {_ANSWER},
    r AS (SELECT query_index, list_filter(list_transform(said, lambda x: CASE WHEN list_contains(ids, x) THEN x WHEN list_contains(ids, regexp_extract(x, '(\\d+)$', 1)) THEN regexp_extract(x, '(\\d+)$', 1) END), lambda x: x IS NOT NULL) AS l FROM a)
    SELECT query_index, list_filter(l, lambda x, i: list_position(l, x) = i)[1:5] AS selected FROM r""",
)
def id_repair_lenient(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("query_index", selection.repaired(F.col("said"), F.col("ids"), 5).alias("selected"))


@queries.add("id_repair_strict_fill", f"""WITH {_SCOPE}, {_ANSWER},
    r AS (SELECT query_index, ids, list_transform(list_transform(strict[1:3], lambda x: trim(x)), lambda x: CASE WHEN list_contains(ids, x) THEN x
      WHEN regexp_full_match(lower(x), '(\\[sheet_id: |sheet_id )?[0-9]+\\]?') THEN regexp_extract(x, '[0-9]+') END) AS l FROM a),
    v AS (SELECT query_index, ids, list_filter(l, lambda x, i: x IS NOT NULL AND list_contains(ids, x) AND list_position(l, x) = i) AS found FROM r)
    SELECT query_index, CASE WHEN len(ids) >= 5 THEN list_concat(found, list_filter(ids, lambda x: NOT list_contains(found, x)))[1:5] END AS selected FROM v""")
def id_repair_strict_fill(spark: SparkSession, sf: str) -> DataFrame:
    """The first three answers repaired strictly and filled up to five from the candidates."""
    return _answers(spark, sf).select("query_index", selection.strictly_repaired(F.slice("strict", 1, 3), F.col("ids"), 5, fill=True).alias("selected"))


@queries.add("parse_selection_json", f"WITH {_SCOPE} SELECT query_index, CASE WHEN query_index % 5 = 4 THEN [] ELSE ids END AS parsed FROM c")
def parse_selection_json(spark: SparkSession, sf: str) -> DataFrame:
    """Five ways of writing the same answer as JSON, the last of them ambiguous, read back."""
    ids = F.col("ids")
    objects = F.transform(ids, lambda x: F.struct(x.alias("sheet_id")))
    form = (
        F.when(F.col("query_index") % 5 == 0, F.to_json(ids))
        .when(F.col("query_index") % 5 == 1, F.to_json(F.struct(ids.alias("sheet_ids"), F.array(F.lit("why")).alias("notes"))))
        .when(F.col("query_index") % 5 == 2, F.to_json(F.struct(objects.alias("selections"))))
        .when(F.col("query_index") % 5 == 3, F.to_json(F.struct(F.lit("ok").alias("status"), ids.alias("answer"))))
        .otherwise(F.to_json(F.struct(ids.alias("a"), ids.alias("b"))))
    )
    return scoped(spark, sf).select("query_index", selection.parsed_selection(form).alias("parsed"))


@queries.add("dedupe_in_order", f"SELECT DISTINCT query_index, {ids_sql('positive_sheet_ids')} AS ids FROM queries WHERE positive_sheet_ids IS NOT NULL")
def dedupe_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "queries").where("positive_sheet_ids is not null").select("query_index", F.array_distinct(clean_ids(F.col("positive_sheet_ids"))).alias("ids")).distinct()


@queries.add("id_order", f"WITH {_LATEST} SELECT source, sheet_id, row_number() OVER (PARTITION BY source ORDER BY {_ID_ORDER.format('sheet_id')}) AS position FROM s")
def id_order_query(spark: SparkSession, sf: str) -> DataFrame:
    """Every sheet with its position in the id order of its source; a hot source is ranked in ranges."""
    whole = cut(ranked(latest_sheets(spark, sf).select("source", "sheet_id"), "source", *id_order(F.col("sheet_id"))).withColumn("of", F.coalesce("source", F.lit("\0"))))
    first = whole.groupBy("of").agg(F.min("position").alias("first"))
    return skew_join(whole, first, "of").select("source", "sheet_id", (F.col("position") - F.col("first") + 1).alias("position"))


@queries.add("query_prefix", f"SELECT query_index, '{selection.QUERY_PREFIX}' || query AS text FROM queries WHERE trim(query) <> ''")
def query_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "queries").where("trim(query) <> ''").select("query_index", F.concat(F.lit(selection.QUERY_PREFIX), "query").alias("text"))


@queries.add("cutoff_lists", "SELECT DISTINCT source, list_sort(list_distinct(list_filter([source_no, 10, 3, 3, 1, source_no - 5], lambda x: x > 0))) AS ks FROM source_registry")
def cutoff_lists(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat_ws(",", "source_no", F.lit("10,3, 3,1,x"), F.col("source_no") - 5)
    return table(spark, sf, "source_registry").select("source", selection.cutoff_list(text).alias("ks")).distinct()


@queries.add("pair_keys", "SELECT DISTINCT least(e[1], e[2]) AS a, greatest(e[1], e[2]) AS b FROM (SELECT list_transform(unnest(edges), lambda x: trim(x)) AS e FROM dependency_edges) WHERE len(e) = 2 AND e[1] <> '' AND e[2] <> ''")
def pair_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct unordered pairs of edges with two ends."""
    ends = table(spark, sf, "dependency_edges").select(F.explode("edges").alias("e")).where("size(e) = 2").select(F.trim(F.col("e")[0]).alias("x"), F.trim(F.col("e")[1]).alias("y"))
    return ends.where("x <> '' and y <> ''").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


@queries.add("nested_path", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def nested_path(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
