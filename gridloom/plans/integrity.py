"""Queries on references and schema drift (problems 4 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import drift
from gridloom.operators import references as refs
from gridloom.plans.registry import Registry
from gridloom.runtime import table

queries = Registry()

# Spark's (?U)\s and DuckDB's \s differ, so the SQL names the blanks.
_BLANKS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')"


_ORPHANS = f"""
refs AS (
  SELECT DISTINCT ref_table, ref_id, ref_field, sheet_id, created_at FROM (
    SELECT 'queries' ref_table, query_index ref_id, 'positive_sheet_ids' ref_field, {_trim("unnest(positive_sheet_ids)")} sheet_id, created_at FROM queries
    UNION ALL
    SELECT 'queries', query_index, 'hard_negative_sheet_ids', {_trim("unnest(hard_negative_sheet_ids)")}, created_at FROM queries
    UNION ALL
    SELECT 'dependency_edges', edge_batch_id, 'edges', {_trim("unnest(flatten(edges))")}, created_at FROM dependency_edges)
  WHERE sheet_id IS NOT NULL AND sheet_id <> ''),
lives AS (
  SELECT {_trim("sheet_id")} sheet_id, min(loaded_at) first_loaded, min(deleted_at) first_deleted
  FROM sheets WHERE sheet_id IS NOT NULL GROUP BY 1),
found AS (
  SELECT r.*, CASE WHEN l.sheet_id IS NULL THEN 'missing' WHEN r.created_at < l.first_loaded THEN 'late'
                   WHEN r.created_at >= l.first_deleted THEN 'deleted' END reason
  FROM refs r LEFT JOIN lives l USING (sheet_id))
"""


def _refs(spark: SparkSession, sf: str, repeats: bool = True) -> DataFrame:
    return refs.sheet_references(table(spark, sf, "queries"), table(spark, sf, "dependency_edges"), repeats)


@queries.add("p4_found", f"WITH {_ORPHANS} SELECT DISTINCT ref_table, ref_id, ref_field, sheet_id, reason FROM found WHERE reason IS NOT NULL")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return refs.orphans(_refs(spark, sf), table(spark, sf, "sheets")).drop("created_at").distinct()


@queries.add(
    "p4_report",
    f"""WITH {_ORPHANS} SELECT ref_table, CAST(date_trunc('month', created_at) AS DATE) AS period, reason,
        count(*) AS refs, count(DISTINCT sheet_id) AS keys FROM found WHERE reason IS NOT NULL GROUP BY ALL""",
)
def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return refs.orphan_counts(_refs(spark, sf), table(spark, sf, "sheets"))


_TAGS = """
tags AS (
  SELECT feed, file_name, file_seq, k field,
    list_sort(list_distinct(list(CASE json_type(v)
      WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object'
      WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number'
      WHEN 'ARRAY' THEN CASE json_type(v, '$[0]') WHEN 'VARCHAR' THEN 'array<string>' WHEN 'OBJECT' THEN 'array<object>'
        WHEN 'BOOLEAN' THEN 'array<boolean>' WHEN 'UBIGINT' THEN 'array<number>' WHEN 'BIGINT' THEN 'array<number>' WHEN 'DOUBLE' THEN 'array<number>' END
      END) FILTER (WHERE json_type(v) <> 'NULL' AND (json_type(v) <> 'ARRAY' OR json_array_length(v) > 0)))) t
  FROM (SELECT feed, file_name, file_seq, k, json_extract(payload, concat('$."', k, '"')) v
        FROM (SELECT *, unnest(json_keys(payload)) k FROM query_raw WHERE json_valid(payload)))
  GROUP BY ALL),
chain AS (SELECT file_name, lag(file_name) OVER (PARTITION BY feed ORDER BY file_seq, file_name) was
          FROM (SELECT DISTINCT feed, file_name, file_seq FROM query_raw)),
pairs AS (SELECT * FROM (VALUES ('sheet_ids', 'positive_sheet_ids'), ('positive_sheet_ids', 'sheet_ids'),
          ('sheet_ids_negative', 'negative_sheet_ids'), ('negative_sheet_ids', 'sheet_ids_negative'),
          ('query', 'question'), ('question', 'query')) p(a, b)),
now AS (SELECT c.file_name, t.field, t.t FROM chain c JOIN tags t ON t.file_name = c.file_name WHERE c.was IS NOT NULL),
old AS (SELECT c.file_name, t.field, t.t FROM chain c JOIN tags t ON t.file_name = c.was),
gone AS (SELECT o.* FROM old o ANTI JOIN now n USING (file_name, field)),
new AS (SELECT n.* FROM now n ANTI JOIN old o USING (file_name, field)),
moved AS (SELECT g.file_name, g.field a, n.field b, g.t ta, n.t tb FROM gone g JOIN pairs p ON p.a = g.field JOIN new n ON n.file_name = g.file_name AND n.field = p.b),
kept AS (SELECT o.file_name, o.field a, o.field b, o.t ta, n.t tb FROM old o JOIN now n USING (file_name, field))
SELECT file_name, 'renamed' AS change_kind, a AS old_field, b AS new_field FROM moved
UNION ALL SELECT file_name, 'removed', field, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.file_name = g.file_name AND m.a = g.field)
UNION ALL SELECT file_name, 'added', '', field FROM new n WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.file_name = n.file_name AND m.b = n.field)
UNION ALL SELECT file_name, 'type_changed', a, b FROM (SELECT * FROM moved UNION ALL SELECT * FROM kept) WHERE len(ta) > 0 AND len(tb) > 0 AND ta <> tb
"""


@queries.add("p6_found", "WITH " + _TAGS.lstrip())
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.changes(table(spark, sf, "query_raw"))


@queries.add("p6_table")
def p6_table(spark: SparkSession, sf: str) -> DataFrame:
    return drift.unified(table(spark, sf, "query_raw"))


_NUMBERS = "('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT')"
_ONCE = """WITH l AS (SELECT feed, file_name, file_seq, line_no, payload, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN CAST(payload AS JSON) END AS doc
  FROM (SELECT DISTINCT feed, file_name, file_seq, line_no, payload FROM query_raw))"""


def _picked_sql(aliases: tuple[str, ...], of: str = "doc") -> str:
    """The value of the first alias that isn't null."""
    return "CASE " + " ".join(f"WHEN json_type({of}, '$.{a}') <> 'NULL' THEN json_extract({of}, '$.{a}')" for a in aliases) + " END"


def _values_sql() -> str:
    parts = []
    for name, (aliases, _) in drift.CANONICAL.items():
        delivered = "CASE " + " ".join(f"WHEN json_type(doc, '$.{a}') <> 'NULL' THEN '{a}'" for a in aliases) + " END"
        parts.append(f"SELECT file_name, line_no, '{name}' AS field, {delivered} AS delivered, {_picked_sql(aliases)} AS v FROM l")
    return f"""{_ONCE}, u AS ({' UNION ALL '.join(parts)})
    SELECT file_name, line_no, field, delivered, CASE WHEN json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') END AS string,
      CASE WHEN json_type(v) IN {_NUMBERS} THEN CAST(v AS DOUBLE) END AS number, CASE WHEN json_type(v) = 'BOOLEAN' THEN CAST(v AS BOOLEAN) END AS boolean,
      json_type(v) IN ('ARRAY', 'OBJECT') AS nested FROM u WHERE delivered IS NOT NULL"""


@queries.add("p6_values", _values_sql())
def p6_values(spark: SparkSession, sf: str) -> DataFrame:
    """Each value of a canonical field in its typed branch; `nested` stands for the JSON text of objects and arrays."""
    nested = F.substring("json", 1, 1).isin("[", "{")
    return drift.values(table(spark, sf, "query_raw")).select("file_name", "line_no", "field", "delivered", "string", "number", "boolean", nested.alias("nested"))


def _columns_sql() -> str:
    columns = []
    for name, (aliases, kind) in drift.CANONICAL.items():
        v = _picked_sql(aliases)
        text = f"json_extract_string({v}, '$')"
        if kind == "ids":
            one = "CASE json_type(x) WHEN 'OBJECT' THEN json_extract_string(x, '$.sheet_id') ELSE json_extract_string(x, '$') END"
            ids = f"CASE WHEN json_type({v}) = 'ARRAY' THEN list_transform(CAST({v} AS JSON[]), lambda x: {one}) WHEN {v} IS NOT NULL THEN string_split({text}, ',') END"
            columns.append(f"list_filter(list_transform({ids}, lambda x: {_trim('x')}), lambda x: x IS NOT NULL AND x <> '') AS {name}")
        elif kind == "boolean":
            columns.append(f"CASE WHEN lower({_trim(text)}) IN ('true', '1', 'yes', 'y', 't') THEN true WHEN lower({_trim(text)}) IN ('false', '0', 'no', 'n', 'f') THEN false END AS {name}")
        else:
            columns.append(f"TRY_CAST({text} AS DOUBLE) AS {name}" if kind == "double" else f"{text} AS {name}")
    return f"{_ONCE} SELECT file_name, line_no, json_valid(payload) IS TRUE AS readable, {', '.join(columns)} FROM l"


@queries.add("p6_columns", _columns_sql())
def p6_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The canonical columns of the one table."""
    return drift.unified(table(spark, sf, "query_raw")).select("file_name", "line_no", "readable", *drift.CANONICAL)


@queries.add(
    "p6_alternatives",
    """WITH t AS (SELECT DISTINCT feed, file_name, file_seq, line_no, substr(regexp_replace(fullkey, '\\[[0-9]+\\]', '[]', 'g'), 3) AS path,
      CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN CASE WHEN len(list_filter(CAST(value AS JSON[]), lambda x: json_type(x) <> 'NULL')) > 0 THEN 'array' END
        WHEN 'NULL' THEN NULL ELSE 'number' END AS alternative
      FROM (SELECT q.*, j.fullkey, j.type, j.value FROM query_raw q, json_tree(q.payload) j WHERE json_valid(q.payload) AND json_type(q.payload) = 'OBJECT') WHERE fullkey <> '$')
    SELECT feed, path, alternative, min(file_seq) AS first_file_seq, arg_min(file_name, file_seq) AS first_file_name, count(*) AS lines FROM t WHERE alternative IS NOT NULL GROUP BY ALL""",
)
def p6_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    return drift.alternatives(table(spark, sf, "query_raw"))


@queries.add(
    "p6_report",
    f"WITH c AS (WITH {_TAGS.lstrip()}) SELECT change_kind, old_field, new_field, count(*) AS files FROM c GROUP BY ALL",
)
def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return drift.changes(table(spark, sf, "query_raw")).groupBy("change_kind", "old_field", "new_field").agg(F.count("*").alias("files"))
