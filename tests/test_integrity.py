import datetime as dt
import json
import random

from pyspark.sql import functions as F

from gridloom.operators import drift, references
from gridloom.runtime import heavy_keys, skew_join


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


SHEETS = "sheet_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
REFS = "ref_table string, ref_id long, ref_field string, sheet_id string, created_at timestamp_ntz"


def test_reasons(spark):
    sheets = spark.createDataFrame([(" a", day(5), None), ("a", day(3), None), ("b", day(0), day(10)), ("b", day(0), day(9)), (None, day(0), None), ("c", None, None)], SHEETS)
    refs = [("a", day(2)), ("a", day(3)), ("b", day(8)), ("b", day(9)), ("x", day(1)), ("x", None), ("a", None), ("c", day(0))]
    rows = spark.createDataFrame([("t", i, "f", s, at) for i, (s, at) in enumerate(refs)], REFS)
    found = {(r.ref_id, r.reason) for r in references.orphans(rows, sheets).collect()}
    assert found == {(0, "late"), (3, "deleted"), (4, "missing"), (5, "missing")}
    counts = {(r.period, r.reason): (r.refs, r["keys"]) for r in references.orphan_counts(rows, sheets).collect()}
    assert counts[(None, "missing")] == (1, 1) and counts[(dt.date(2024, 1, 1), "late")] == (1, 1)


def test_reasons_against_brute_force(spark):
    """Cells of whole months and the exact times within the months of loading and deletion, hot keys included."""
    rng = random.Random(4)
    moment = lambda: rng.choice([None, *[day(rng.randrange(120)) + dt.timedelta(hours=rng.randrange(24)) for _ in range(8)]])
    sheets = [(rng.choice(["hot", *map(str, range(20))]), moment(), rng.choice([None, moment()])) for _ in range(40)]
    refs = [(rng.choice("tu"), i % 500, rng.choice("fg"), rng.choice(["hot", "hot", *map(str, range(30))]), moment()) for i in range(900)]
    want = set()
    for t, i, f, s, at in refs:
        loads, ends = ([x[c] for x in sheets if x[0] == s and x[c] is not None] for c in (1, 2))
        if s not in {x[0] for x in sheets}:
            want.add((t, i, f, s, at, "missing"))
        elif at is not None and loads and at < min(loads):
            want.add((t, i, f, s, at, "late"))
        elif at is not None and ends and at >= min(ends):
            want.add((t, i, f, s, at, "deleted"))
    rows, known = spark.createDataFrame(refs, REFS), spark.createDataFrame(sheets, SHEETS)
    assert {tuple(r) for r in references.orphans(rows, known).collect()} == want and len({w[-1] for w in want}) == 3
    month = lambda at: at and at.date().replace(day=1)
    counts = {(r.ref_table, r.period, r.reason): (r.refs, r["keys"]) for r in references.orphan_counts(rows.unionByName(rows), known).collect()}
    cells = {(w[0], month(w[4]), w[5]) for w in want}
    assert counts == {c: (sum((w[0], month(w[4]), w[5]) == c for w in want), len({w[3] for w in want if (w[0], month(w[4]), w[5]) == c})) for c in cells}


def test_ids_are_trimmed_once_each_and_nulls_left_out(spark):
    df = spark.createDataFrame([(1, [" a ", "a", None, "", " "], day(0)), (1, ["a"], day(0)), (2, None, day(0))], "id long, ids array<string>, created_at timestamp_ntz")
    assert [(r.ref_id, r.sheet_id) for r in references.references(df, "t", "id", {"f": F.col("ids")}).collect()] == [(1, "a")]


def test_a_hot_key_goes_by_broadcast_and_changes_nothing(spark):
    rows = spark.range(3000).select(F.lit("t").alias("ref_table"), F.col("id").alias("ref_id"), F.lit("f").alias("ref_field"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("sheet_id"), F.lit(day(1)).alias("created_at"))
    assert "hot" in {r.sheet_id for r in heavy_keys(rows, "sheet_id", share=0.01).collect()}
    sheets = spark.createDataFrame([("k1", day(0), None)], SHEETS)
    found = references.orphans(rows, sheets)
    assert found.count() == 3000 - rows.where("sheet_id = 'k1'").count()


def test_empty_tables(spark):
    none = spark.createDataFrame([], REFS)
    sheets = spark.createDataFrame([], SHEETS)
    assert references.orphans(none, sheets).count() == 0 and references.orphan_counts(none, sheets).count() == 0
    raw = spark.createDataFrame([], RAW)
    assert drift.changes(raw).count() == 0 and drift.unified(raw).count() == 0 and drift.alternatives(raw).count() == 0


def test_skew_join_is_a_join(spark):
    left = spark.createDataFrame([(k, i) for i, k in enumerate("aaaaaaabbc")], "k string, i long")
    right = spark.createDataFrame([("a", 1), ("c", 3)], "k string, v long")
    for how in ("inner", "left"):
        assert sorted(map(str, skew_join(left, right, "k", how, share=0.5).select("k", "i", "v").collect())) == sorted(map(str, left.join(right, "k", how).select("k", "i", "v").collect()))


RAW = "feed string, file_name string, file_seq int, line_no int, loaded_at timestamp_ntz, payload string, doc string, fields string, tag string"


def raw(spark, files):
    rows = [("f", name, i, n, day(i), line, "x", "y", "z") for i, (name, lines) in enumerate(files) for n, line in enumerate(lines)]
    return spark.createDataFrame(rows, RAW)


def test_changes_against_brute_force_rules(spark):
    j = json.dumps
    files = [
        ("a", [j({"query": "q", "sheet_ids": ["1"], "w": 1, "n": None}), "{cut", None, j({"query": "q"})]),
        ("b", [j({"question": "q", "positive_sheet_ids": [1], "w": 0.5, "n": "now"}), j({"question": 3})]),
        ("c", [j({"question": "q", "positive_sheet_ids": [], "w": {"x": 1}, "new": [True]}), "[]", '"text"', "null"]),
        ("d", [j({"question": "q", "positive_sheet_ids": [{"sheet_id": "1"}], "w": None})] * 2),
    ]
    found = {tuple(r) for r in drift.changes(raw(spark, files)).collect()}
    assert found == {
        ("b", "renamed", "query", "question"),
        ("b", "type_changed", "query", "question"),
        ("b", "renamed", "sheet_ids", "positive_sheet_ids"),
        ("b", "type_changed", "sheet_ids", "positive_sheet_ids"),
        ("c", "type_changed", "question", "question"),
        ("c", "type_changed", "w", "w"),
        ("c", "removed", "n", ""),
        ("c", "added", "", "new"),
        ("d", "removed", "new", ""),
    }


def test_one_table_from_all_branches(spark):
    j = json.dumps
    lines = [j({"query": "q", "sheet_ids": "1, 2 ,"}), j({"question": "q", "positive_sheet_ids": [1, None, "2"]}), j({"query": None, "question": "q", "positive_sheet_ids": [{"sheet_id": "1"}, {"sheet_id": 2}], "is_dependency_heavy": "yes", "weight": "0.5", "note": [1]}), "{", None]
    rows = sorted(drift.unified(raw(spark, [("a", lines)])).collect(), key=lambda r: r.line_no)
    assert [r.readable for r in rows] == [True, True, True, False, False]
    assert all(r.query == "q" and r.positive_sheet_ids == ["1", "2"] for r in rows[:3])
    assert rows[2].is_dependency_heavy is True and rows[2].weight == 0.5 and rows[2].rest == {"note": "[1]"}
    assert rows[0].tags == {"query": "string", "sheet_ids": "string"} and rows[3].tags is None


def test_what_cannot_be_converted_stays(spark):
    """Values of the wrong type, of a second name and of whole lines are kept."""
    lines = ['{"weight":"high","is_dependency_heavy":"maybe","positive_sheet_ids":["1"],"sheet_ids":["2"]}', '{"weight":{"kg":1},"query":7,"question":"w","split":null}', "[1, 2]", "{cut"]
    rows = sorted(drift.unified(raw(spark, [("a", lines)])).collect(), key=lambda r: r.line_no)
    first, second, third, last = rows
    assert first.weight is None and first.weight_as.asDict() == {"delivered": "weight", "tag": "string", "string": "high", "number": None, "boolean": None, "json": '"high"'}
    assert first.is_dependency_heavy is None and first.is_dependency_heavy_as.string == "maybe"
    assert first.positive_sheet_ids == ["1"] and first.positive_sheet_ids_as.json == '["1"]' and first.rest == {"sheet_ids": '["2"]'}
    assert second.weight is None and (second.weight_as.tag, second.weight_as.json) == ("object", '{"kg":1}') and second.split_as is None
    assert second.query == "7" and second.query_as.number == 7.0 and second.rest == {"question": '"w"'}
    assert third.readable and third.raw == "[1, 2]" and third.tags is None and not last.readable and last.raw == "{cut" and first.raw is None


def test_alternatives_of_every_path(spark):
    files = [("a", ['{"x":{"y":[1,"s",{"z":[[true]]}]}}', '{"x":{"y":[]}}']), ("b", ['{"x":2,"n":null}', '{"x":2,"n":null}'])]
    found = {(r.path, r.alternative): (r.first_file_name, r.lines) for r in drift.alternatives(raw(spark, files)).collect()}
    assert found == {
        ("x", "object"): ("a", 2), ("x.y", "array"): ("a", 1), ("x.y[]", "number"): ("a", 1), ("x.y[]", "string"): ("a", 1), ("x.y[]", "object"): ("a", 1),
        ("x.y[].z", "array"): ("a", 1), ("x.y[].z[]", "array"): ("a", 1), ("x.y[].z[][]", "boolean"): ("a", 1), ("x", "number"): ("b", 2),
    }
