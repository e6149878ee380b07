"""Queries on validation, joins, profiles and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import serialize
from gridloom.functions.text import clean_ids, strip
from gridloom.operators import profile, sampling, validate
from gridloom.plans.registry import Registry
from gridloom.plans.texts import _LATEST, _NAME, _labels_sql, _text_sql, ids_sql, latest_sheets, trim_sql
from gridloom.runtime import table
from gridloom.sources import keyed

queries = Registry()
SEED = 42
_LOT = "md5(concat_ws(':', '42', {}))"


@queries.add(
    "sanitize_sheets",
    f"""SELECT sheet_id, coalesce({trim_sql('name')}, '') AS name, coalesce(num_rows, 0) AS num_rows, coalesce(num_cols, 0) AS num_cols,
    list_filter(list_transform(coalesce(columns, []), lambda c: {{'name': coalesce({trim_sql('c.name')}, '')}}), lambda c: c.name <> '') AS columns,
    coalesce({trim_sql('source')}, '') AS source FROM sheets""",
)
def sanitize_sheets(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.sanitised(table(spark, sf, "sheets"))


_BLANK = "coalesce({}, '') = ''"


@queries.add(
    "sheet_errors",
    f"""WITH c AS (SELECT sheet_id AS key, loaded_at, unnest(columns) AS c, unnest(range(len(columns))) AS i FROM sheets),
    e AS (SELECT key, 'columns[' || i || ']' AS place, unnest([CASE WHEN c IS NULL THEN 'not an object' END, CASE WHEN c.example IS NOT NULL THEN 'disallowed fields: example' END,
      CASE WHEN c IS NOT NULL AND {_BLANK.format(trim_sql('c.name'))} THEN 'empty column name' END]) AS error FROM c)
    SELECT sheet_id AS key, '' AS place, 'disallowed fields: ' || concat_ws(', ', CASE WHEN deleted_at IS NOT NULL THEN 'deleted_at' END, CASE WHEN loaded_at IS NOT NULL THEN 'loaded_at' END) AS error
    FROM sheets WHERE loaded_at IS NOT NULL OR deleted_at IS NOT NULL UNION ALL SELECT * FROM e WHERE error IS NOT NULL""",
)
def sheet_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The rows as JSON records; those of the tables have fields that metadata files may not have."""
    rows = table(spark, sf, "sheets")
    return validate.sheet_errors(rows.select(F.col("sheet_id").alias("key"), F.parse_json(F.to_json(F.struct(*rows.columns))).alias("record")))


@queries.add(
    "extra_fields",
    f"""SELECT file_name, line_no, list_sort(list_filter(json_keys(payload), lambda k: NOT list_contains({list(validate.QUERY_FIELDS)}, k))) AS extra FROM query_raw
    WHERE json_valid(payload) AND len(list_filter(json_keys(payload), lambda k: NOT list_contains({list(validate.QUERY_FIELDS)}, k))) > 0""",
)
def extra_fields(spark: SparkSession, sf: str) -> DataFrame:
    return validate.extra_fields(table(spark, sf, "query_raw"), "payload", validate.QUERY_FIELDS, ["file_name", "line_no"])


_KNOWN = f"known AS (SELECT DISTINCT {trim_sql('sheet_id')} AS sheet_id FROM sheets)"
_USED = " UNION ALL ".join(f"SELECT query_index, '{f}' AS field, unnest({ids_sql(f)}) AS sheet_id FROM queries" for f in validate.ID_FIELDS)


@queries.add(
    "query_errors",
    f"""WITH {_KNOWN}, used AS ({_USED}) SELECT DISTINCT query_index, 'query' AS field, 'blank text' AS error FROM queries WHERE {_BLANK.format(trim_sql('query'))}
    UNION SELECT query_index, field, 'unknown id ' || sheet_id FROM used ANTI JOIN known USING (sheet_id)""",
)
def query_errors(spark: SparkSession, sf: str) -> DataFrame:
    return validate.query_errors(table(spark, sf, "queries"), table(spark, sf, "sheets"))


@queries.add("unknown_ids_anti", f"WITH {_KNOWN}, used AS ({_USED}) SELECT sheet_id, count(*) AS uses FROM (SELECT DISTINCT * FROM used) ANTI JOIN known USING (sheet_id) GROUP BY sheet_id")
def unknown_ids_anti(spark: SparkSession, sf: str) -> DataFrame:
    errors = validate.query_errors(table(spark, sf, "queries"), table(spark, sf, "sheets")).where("field <> 'query'")
    return errors.groupBy(F.substring("error", 12, 1000000).alias("sheet_id")).agg(F.count("*").alias("uses"))


@queries.add("known_ids_semi", f"WITH {_KNOWN}, p AS (SELECT DISTINCT query_index, unnest({ids_sql('coalesce(positive_sheet_ids, sheet_ids)')}) AS sheet_id FROM queries) SELECT query_index, count(*) AS known_positives FROM p SEMI JOIN known USING (sheet_id) GROUP BY query_index")
def known_ids_semi(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "queries").select("query_index", F.explode(clean_ids(F.coalesce("positive_sheet_ids", "sheet_ids"))).alias("sheet_id")).distinct()
    known = table(spark, sf, "sheets").select(strip(F.col("sheet_id")).alias("sheet_id"))
    return used.join(known, "sheet_id", "left_semi").groupBy("query_index").agg(F.count("*").alias("known_positives"))


@queries.add(
    "edge_errors",
    f"""WITH {_KNOWN}, e AS (SELECT edge_batch_id, unnest(edges) AS edge, unnest(range(len(edges))) AS position FROM dependency_edges),
    ends AS (SELECT edge_batch_id, position, coalesce({trim_sql('unnest(edge)')}, '') AS sheet_id FROM e)
    SELECT DISTINCT edge_batch_id, CAST(position AS INTEGER) AS position, 'ends: ' || len(edge) AS error FROM e WHERE len(edge) <> 2
    UNION SELECT edge_batch_id, CAST(position AS INTEGER), 'unknown end ' || sheet_id FROM ends ANTI JOIN known USING (sheet_id)""",
)
def edge_errors(spark: SparkSession, sf: str) -> DataFrame:
    return validate.edge_errors(table(spark, sf, "dependency_edges"), table(spark, sf, "sheets"))


_EDGES = "e AS (SELECT DISTINCT trim(p[1]) AS a, trim(p[2]) AS b FROM (SELECT unnest(edges) AS p FROM dependency_edges) WHERE len(p) = 2 AND trim(p[1]) <> '' AND trim(p[2]) <> '')"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct edges (a, b) with two ends."""
    ends = table(spark, sf, "dependency_edges").select(F.explode("edges").alias("e")).where("size(e) = 2").select(F.trim(F.get("e", F.lit(0))).alias("a"), F.trim(F.get("e", F.lit(1))).alias("b"))
    return ends.where("a <> '' and b <> ''").distinct()


@queries.add(
    "pair_text_left_join",
    f"""WITH {_LATEST}, {_EDGES}, t AS (SELECT sheet_id, {_text_sql("x", "headers: ", _labels_sql(), _NAME)} AS text FROM s)
    SELECT a, b, coalesce(x.text, a) AS text_a, coalesce(y.text, b) AS text_b FROM e LEFT JOIN t x ON x.sheet_id = a LEFT JOIN t y ON y.sheet_id = b""",
)
def pair_text_left_join(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of both ends of each edge; an unknown end is its own text."""
    texts = latest_sheets(spark, sf).select("sheet_id", serialize.stage_one().alias("text"))
    a, b = (texts.select(F.col("sheet_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    joined = edges(spark, sf).join(a, "a", "left").join(b, "b", "left")
    return joined.select("a", "b", F.coalesce("text_a", "a").alias("text_a"), F.coalesce("text_b", "b").alias("text_b"))


@queries.add(
    "group_pairs",
    """WITH g AS (SELECT DISTINCT l_suppkey AS supplier, l_partkey AS part FROM lineitem), f AS (SELECT supplier, min(part) AS representative FROM g GROUP BY supplier HAVING count(*) > 1)
    SELECT supplier, representative, part AS member FROM g JOIN f USING (supplier) WHERE part <> representative""",
)
def group_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"))
    return sampling.group_members(rows, "supplier", "part")


@queries.add(
    "aug_pairs",
    f"""WITH g AS (SELECT DISTINCT lower({trim_sql('name')}) AS base, {trim_sql('sheet_id')} AS sheet_id FROM sheets WHERE {trim_sql('name')} <> ''), f AS (SELECT base, min(encode(sheet_id)) AS r FROM g GROUP BY base HAVING count(*) > 1)
    SELECT base, decode(r) AS representative, sheet_id AS member FROM g JOIN f USING (base) WHERE sheet_id <> decode(r)""",
)
def aug_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets of the same name, each with the first of them."""
    rows = table(spark, sf, "sheets").select(F.lower(strip(F.col("name"))).alias("base"), strip(F.col("sheet_id")).alias("sheet_id")).where("base <> ''")
    return sampling.group_members(rows, "base", "sheet_id")


@queries.add(
    "split_pairs",
    """WITH g AS (SELECT DISTINCT sheet_id AS parent, doc_id AS part FROM documents WHERE sheet_id IS NOT NULL), f AS (SELECT parent, min(part) AS representative FROM g GROUP BY parent HAVING count(*) > 1)
    SELECT parent, representative, part AS member FROM g JOIN f USING (parent) WHERE part <> representative""",
)
def split_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with the same parent, each with the first of them; parts without a parent belong to no group."""
    rows = table(spark, sf, "documents").where("sheet_id is not null").select(F.col("sheet_id").alias("parent"), F.col("doc_id").alias("part"))
    return sampling.group_members(rows, "parent", "part")


@queries.add(
    "base_pairs",
    f"""WITH n AS (SELECT DISTINCT {trim_sql('sheet_id')} AS sheet_id, CASE WHEN regexp_full_match({trim_sql('sheet_id')}, 'bytesheet_[0-9]+') THEN substr({trim_sql('sheet_id')}, 11) END AS base_sheet_id FROM sheets),
    g AS (SELECT coalesce(base_sheet_id, sheet_id) AS base, sheet_id FROM n), f AS (SELECT base, min(encode(sheet_id)) AS r FROM g GROUP BY base HAVING count(*) > 1)
    SELECT base, decode(r) AS representative, sheet_id AS member FROM g JOIN f USING (base) WHERE sheet_id <> decode(r)""",
)
def base_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets with the same base sheet; a sheet without one is its own base."""
    ids = table(spark, sf, "sheets").select(strip(F.col("sheet_id")).alias("sheet_id")).distinct()
    base = F.when(F.col("sheet_id").rlike("^bytesheet_[0-9]+$"), F.substring("sheet_id", 11, 1000))
    return sampling.group_members(ids.select(F.coalesce(base, "sheet_id").alias("base"), "sheet_id"), "base", "sheet_id")


@queries.add(
    "resume_anti_union",
    """WITH ok AS (SELECT query_index, count(*) AS rows FROM rag WHERE status = 'succeeded' GROUP BY query_index), q AS (SELECT DISTINCT query_index FROM queries)
    SELECT query_index, 'done' AS state, rows FROM ok UNION ALL SELECT query_index, 'todo', 0 FROM q ANTI JOIN ok USING (query_index)""",
)
def resume_anti_union(spark: SparkSession, sf: str) -> DataFrame:
    todo, kept = validate.resume(table(spark, sf, "queries").select("query_index").distinct(), table(spark, sf, "rag"), "query_index", F.col("status") == "succeeded")
    done = kept.where("query_index is not null").groupBy("query_index").agg(F.count("*").alias("rows")).select("query_index", F.lit("done").alias("state"), "rows")
    return done.unionByName(todo.select("query_index", F.lit("todo").alias("state"), F.lit(0).cast("long").alias("rows")))


_PROFILED = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string",
}


@queries.add(
    "column_profile",
    " UNION ALL ".join(
        f"""SELECT {i} AS col_idx, '{c}' AS name, '{t}' AS dtype, {t != 'string'} AS is_numeric, round(1.0::DOUBLE - count({c}) / count(*), 6) AS null_ratio, """
        + (
            f"round((avg({c}) - min({c})) / (max({c}) - min({c})), 6) AS mean_norm, round(stddev_samp({c}) / (max({c}) - min({c})), 6) AS std_norm, 0.0::DOUBLE AS min_norm, 1.0::DOUBLE AS max_norm FROM lineitem"
            if t != "string"
            else "0.0::DOUBLE AS mean_norm, 0.0::DOUBLE AS std_norm, 0.0::DOUBLE AS min_norm, 0.0::DOUBLE AS max_norm FROM lineitem"
        )
        for i, (c, t) in enumerate(_PROFILED.items())
    ),
)
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.column_profile(table(spark, sf, "lineitem").select(*_PROFILED)).select("col_idx", "name", "dtype", "is_numeric", *[F.round(s, 6).alias(s) for s in profile.STATS])


@queries.add(
    "easy_negatives",
    f"""WITH {_EDGES}, k AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM e), d AS (SELECT DISTINCT {trim_sql('sheet_id')} AS x FROM sheets),
    n AS (SELECT x, row_number() OVER (ORDER BY {_LOT.format('x')}, x) - 1 AS i, count(*) OVER () AS total FROM d), m AS (SELECT count(*) AS total FROM d),
    t AS (SELECT i, total, CAST('0x' || substr(md5('42:' || i || ':a'), 1, 8) AS BIGINT) % total AS p, CAST('0x' || substr(md5('42:' || i || ':b'), 1, 8) AS BIGINT) % (total - 1) AS step FROM m, range(2000) r(i)),
    p AS (SELECT least(l.x, r.x) AS a, greatest(l.x, r.x) AS b, min(t.i) AS i FROM t JOIN n l ON l.i = t.p JOIN n r ON r.i = (t.p + 1 + t.step) % t.total GROUP BY ALL)
    SELECT a, b FROM p ANTI JOIN k USING (a, b) ORDER BY i LIMIT 200""",
)
def easy_negatives(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "sheets").select(strip(F.col("sheet_id")).alias("sheet_id"))
    return sampling.easy_negatives(ids, "sheet_id", edges(spark, sf), SEED, 200)


_POOL = f"pool AS (SELECT list(sheet_id ORDER BY {_LOT.format('sheet_id')}, sheet_id) AS pool FROM known)"
_PLACE = f"CAST('0x' || substr({_LOT.format('query_index')}, 1, 8) AS BIGINT) % len(pool)"
_ASKED = f"asked AS (SELECT query_index, {ids_sql('any_value(coalesce(positive_sheet_ids, sheet_ids))')} AS p, {ids_sql('any_value(coalesce(hard_negative_sheet_ids, []))')} AS n FROM queries GROUP BY query_index HAVING len(p) > 0)"


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """(query_index, positives, negatives) of the queries with positives, one row each."""
    ids = lambda c: F.array_distinct(clean_ids(c))
    rows = table(spark, sf, "queries").select("query_index", ids(F.coalesce("positive_sheet_ids", "sheet_ids")).alias("positives"), ids(F.coalesce("hard_negative_sheet_ids", F.array().cast("array<string>"))).alias("negatives"))
    return rows.where("size(positives) > 0").dropDuplicates(["query_index"])


def _known(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sheets").select(strip(F.col("sheet_id")).alias("sheet_id"))


@queries.add(
    "nway_workspace",
    f"""WITH {_KNOWN}, {_POOL}, {_ASKED},
    o AS (SELECT query_index, p, list_filter(list_concat(pool, pool)[{_PLACE} + 1:{_PLACE} + len(p) + 4], lambda x: NOT list_contains(p, x)) AS others FROM asked, pool),
    w AS (SELECT query_index, unnest(list_concat(p, others[1:greatest(least(4, 10 - len(p)), 0)])) AS sheet_id FROM o)
    SELECT printf('nway_%06d', query_index) AS id, query_index, list(sheet_id ORDER BY md5('42:' || query_index || ':' || sheet_id)) AS workspace, any_value(a.p) AS relevant FROM w JOIN asked a USING (query_index) GROUP BY query_index""",
)
def nway_workspace(spark: SparkSession, sf: str) -> DataFrame:
    found = sampling.workspaces(_asked(spark, sf).select("query_index", F.col("positives").alias("relevant")), _known(spark, sf), SEED)
    return found.select(sampling.nway_id(F.col("query_index")).alias("id"), "*")


@queries.add(
    "training_workspace",
    f"""WITH {_KNOWN}, {_POOL}, {_ASKED},
    t AS (SELECT query_index, p, n, CASE WHEN len(p) <= 5 THEN p ELSE (SELECT list(x ORDER BY md5('42:' || query_index || ':' || x)) FROM unnest(p) u(x))[1:5] END AS taken FROM asked),
    f AS (SELECT query_index, list_filter(list_concat(pool, pool)[{_PLACE} + 1:{_PLACE} + len(p) + len(n) + 10], lambda x: NOT list_contains(p, x) AND NOT list_contains(n, x)) AS fill FROM asked, pool),
    g AS (SELECT query_index, taken, list_concat(list_filter(n, lambda x: NOT list_contains(taken, x)), fill)[1:10 - len(taken)] AS against FROM t JOIN f USING (query_index)),
    b AS (SELECT query_index, unnest(taken) AS x, 1 AS y FROM g UNION ALL SELECT query_index, unnest(against), 0 FROM g)
    SELECT query_index, list(x ORDER BY md5('42:' || query_index || ':' || x)) AS workspace, list(y ORDER BY md5('42:' || query_index || ':' || x)) AS labels FROM b GROUP BY query_index""",
)
def training_workspace(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.training_workspaces(_asked(spark, sf), _known(spark, sf), SEED)


@queries.add(
    "stratified_sample",
    f"""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_LOT.format('o_orderkey')}) AS i FROM orders),
    c AS (SELECT o_orderstatus, count(*) AS n, row_number() OVER (ORDER BY o_orderstatus) AS j, count(*) OVER () AS k FROM orders GROUP BY o_orderstatus),
    q AS (WITH RECURSIVE w AS (SELECT 0::BIGINT AS j, CAST(NULL AS VARCHAR) AS s, 0::BIGINT AS quota, 300::BIGINT AS rest UNION ALL
        SELECT c.j, c.o_orderstatus, least(c.n, greatest(1, w.rest // (c.k - c.j + 1))), w.rest - least(c.n, greatest(1, w.rest // (c.k - c.j + 1))) FROM w JOIN c ON c.j = w.j + 1) SELECT * FROM w),
    a AS (SELECT r.*, i <= quota AS first FROM r JOIN q ON q.s = o_orderstatus),
    m AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_LOT.format('o_orderkey')}) AS i FROM a WHERE NOT first)
    SELECT o_orderkey, o_orderstatus FROM a WHERE first OR o_orderkey IN (SELECT o_orderkey FROM m WHERE i <= (SELECT min(rest) FROM q))""",
)
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", SEED, 300)


@queries.add("simple_sample", f"SELECT o_orderkey FROM orders ORDER BY {_LOT.format('o_orderkey')}, o_orderkey LIMIT 500")
def simple_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", SEED, 500)


@queries.add(
    "hash_split",
    f"""WITH q AS (SELECT DISTINCT query_index FROM queries), r AS (SELECT query_index, row_number() OVER (ORDER BY substr({_LOT.format('query_index')}, 1, 12)) - 1 AS i, count(*) OVER () AS n FROM q)
    SELECT query_index, CASE WHEN i < floor(n * 0.8::DOUBLE + 1e-9) THEN 'train' WHEN i < floor(n * 0.9::DOUBLE + 1e-9) THEN 'validation' ELSE 'test' END AS split FROM r""",
)
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.exact_split(table(spark, sf, "queries").select("query_index").distinct(), "query_index", SEED, {"train": 0.8, "validation": 0.1, "test": 0.1})


@queries.add("python_split")
def python_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.python_split(spark, table(spark, sf, "queries").select("query_index").distinct().count(), SEED, 0.1, 0.1)


@queries.add("label_counts", f"SELECT coalesce(lower({trim_sql('split')}), 'none') AS split, CAST(sum(len(coalesce(positive_sheet_ids, sheet_ids, []))) AS BIGINT) AS positives, CAST(sum(len(coalesce(hard_negative_sheet_ids, []))) AS BIGINT) AS negatives FROM queries GROUP BY 1")
def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    size = lambda *c: F.sum(F.size(F.coalesce(*c, F.array().cast("array<string>")))).cast("long")
    return table(spark, sf, "queries").groupBy(F.coalesce(F.lower(strip(F.col("split"))), F.lit("none")).alias("split")).agg(size("positive_sheet_ids", "sheet_ids").alias("positives"), size("hard_negative_sheet_ids").alias("negatives"))
