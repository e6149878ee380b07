import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import selection, serialize
from gridloom.functions.text import id_order, strip
from gridloom.operators import graph, metrics, mining, profile, quantiles, sampling, validate, vector
from gridloom.sources import keyed

SHEET = "sheet_id string, name string, num_rows long, num_cols long, columns array<struct<name:string,example:string>>, source string"


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([("1", "Sales", 10, 2, [("Region", "West"), ("Revenue", "100")], "s"), ("2", " ", None, None, None, None), ("3", None, 1, 1, [(None, None), (" A ", ""), ("", "x")], "s")], SHEET)


def texts(df, c):
    return [r[0] for r in df.orderBy("sheet_id").select(c).collect()]


def test_serialisers(sales):
    assert texts(sales, serialize.canonical())[:2] == ["name: Sales ; shape: 10 x 2 ; columns: Region | Revenue", "shape: ? x ?"]
    assert "Region: West" in texts(sales, serialize.canonical(examples=True))[0]
    assert texts(sales, serialize.canonical(examples=True))[2] == "shape: 1 x 1 ; columns: A | x"
    assert texts(sales, serialize.stage_one())[0] == "name: Sales ; shape: 10x2 ; headers: Region | Revenue"
    assert texts(sales, serialize.compact()) == ["name=Sales; columns=Region | Revenue", "name=", "name=; columns=A"]
    assert texts(sales, serialize.miner()) == ["[s] Region | Revenue", "[] ", "[s]  |  A  | "]
    assert texts(sales, serialize.stage_two(shape=False))[1:] == ["name:  ", "columns: A"]
    assert texts(sales, serialize.catalog_line())[0].startswith("[1] name: Sales")


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_selection(spark):
    valid = F.array(F.lit("1"), F.lit("2"))
    said = F.array(*map(F.lit, ["bytesheet_2", "missing", "2", "1"]))
    assert one(spark, selection.repaired(said, valid, 2)) == ["2", "1"]
    strict = F.array(F.lit("[Sheet_ID: 2]"))
    assert one(spark, selection.strictly_repaired(strict, valid, 2)) is None
    assert one(spark, selection.strictly_repaired(strict, valid, 2, fill=True)) == ["2", "1"]
    assert one(spark, selection.strictly_repaired(valid, valid, 1, fill=True)) is None
    for text, ids in (('["1", 2]', ["1", "2"]), ('{"ids": [{"id": "3"}]}', ["3"]), ('{"why": "", "x": ["1"]}', ["1"]), ('{"a": ["1"], "b": []}', []), ("nonsense", []), ('{"sheet_ids": [{"sheet_id": 4}]}', ["4"])):
        assert one(spark, selection.parsed_selection(F.lit(text))) == ids
    assert selection.cutoffs("10,1,3,3") == (1, 3, 10)
    for wrong in ("", "0,1", "a"):
        with pytest.raises(ValueError):
            selection.cutoffs(wrong)
    schema = json.loads(one(spark, selection.selection_schema(valid, 2)))
    assert schema == {"type": "array", "items": {"type": "string", "enum": ["1", "2"]}, "minItems": 2, "maxItems": 2, "uniqueItems": True}
    with pytest.raises(Exception, match="ids are needed"):
        one(spark, selection.strictly_repaired(strict, valid, 2, fail=True))
    asked = one(spark, selection.exact_prompt(F.lit("why"), F.array(F.lit("[1] a"), F.lit("[2] b")), 2, "all sheets"))
    assert selection.GUARD in asked and asked.endswith("[1] a\n[2] b\nQuery: why") and "exactly 2" in asked


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("12", "12"), ("[12]", "12"), ("[ 12 ]", "12"), ("sheet_id: 12", "12"), ("[Sheet-ID=12]", "12"), (" SHEET ID 12 ", "12"), ("sheetid12", "12"), ("[12", "12"), ("12]", "12"), ("sheet_id : 12", "12"),
        ("bytesheet_12", ""), ("12a", ""), ("sheet 12", ""), ("[[12]]", ""), ("id 12", ""), ("", ""), ("sheet_id", ""), ("sheet_id:=12", ""), ("1 2", ""),
    ],
)
def test_written_numbers(spark, text, number):
    assert one(spark, selection.written_number(F.lit(text))) == number


def test_strip_and_id_order(spark):
    assert one(spark, strip(F.lit("\t a b　\n"))) == "a b"
    ids = ["b", "10", "9", "a", "09", "99999999999999999999999999"]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").orderBy(*id_order(F.col("id"))).collect()
    assert [r.id for r in rows] == ["09", "9", "10", "99999999999999999999999999", "a", "b"]


def test_metrics_of_a_known_ranking(spark):
    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "query_id long, rank_no int, item_id string")
    relevant = spark.createDataFrame([(1, "a"), (1, "c"), (2, "a")], "query_id long, item_id string").where("query_id = 1")
    got = {r.k: r for r in metrics.at_cutoffs(ranked, relevant, (1, 3)).collect()}
    assert (got[1].precision, got[1].recall, got[3].precision, got[3].recall, got[3].mrr) == (1.0, 0.5, 0.666667, 1.0, 1.0)
    negatives = spark.createDataFrame([(1, "a")], "query_id long, item_id string")
    assert metrics.with_hard_negatives(ranked, relevant, negatives).first().hn_fpr == 1.0
    missing = metrics.at_cutoffs(ranked.where("false"), relevant, (1,)).first()
    assert missing.num_queries == 1 and missing.recall == 0.0


@pytest.mark.parametrize("broadcast", [0, 4_000_000])
def test_search_against_numpy(spark, monkeypatch, broadcast):
    monkeypatch.setattr(vector, "BROADCAST", broadcast)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, vector array<double>")
    items = rows.select(F.col("id").alias("item_id"), "vector")
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    got = {(r.query_id, r.rank_no): r.item_id for r in vector.top_k(asked, items, 5).collect()}
    for q in range(0, 300, 50):
        scores = x @ x[q]
        scores[q] = -np.inf
        assert [got[q, i + 1] for i in range(5)] == np.argsort(-scores, kind="stable")[:5].tolist()
    assert vector.top_k(asked.where("false"), items, 5).count() == 0


@pytest.mark.parametrize("broadcast", [0, 4_000_000])
def test_ties_go_to_the_smaller_id(spark, monkeypatch, broadcast):
    monkeypatch.setattr(vector, "BROADCAST", broadcast)
    rows = spark.createDataFrame([(i, [1.0]) for i in range(40)], "item_id long, vector array<double>")
    asked = rows.where("item_id = 7").withColumnRenamed("item_id", "query_id")
    assert [r.item_id for r in vector.top_k(asked, rows, 3).orderBy("rank_no").collect()] == [0, 1, 2]


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_value_at_rank(spark, bins):
    rng = random.Random(1)
    data = {g: [rng.choice([rng.random(), 0.5, -3.0]) for _ in range(n)] for g, n in (("a", 1), ("b", 500), ("c", 33))}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in [*vs, None]], "g string, v double")
    got = {r.g: r.v for r in quantiles.value_at_rank(df, "g", "v", F.bround((F.col("n") - 1) * 0.95), bins).collect()}
    assert got == {g: sorted(vs)[round((len(vs) - 1) * 0.95)] for g, vs in data.items()}


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", True, None), (3, None, False, None), (None, "b", True, None)], "x long, s string, b boolean, z double")
    got = {r.name: r for r in profile.column_profile(df).collect()}
    assert (got["x"].null_ratio, got["x"].mean_norm) == (pytest.approx(1 / 3), 0.5)
    assert got["b"].mean_norm == pytest.approx(2 / 3) and got["s"].max_norm == 0.0 and got["z"].max_norm == 0.0
    assert profile.column_profile(df.where("false")).first().null_ratio is None


def test_splits(spark):
    order = list(range(100))
    random.Random(42).shuffle(order)
    got = {r.position: r.split for r in sampling.python_split(spark, 100, 42, 0.2, 0.1).collect()}
    assert {p for p, s in got.items() if s == "eval"} == set(order[80:]) and {p for p, s in got.items() if s == "validation"} == set(order[72:80])
    sizes = {r.split: r["count"] for r in sampling.exact_split(spark.range(1003), "id", 1, {"train": 0.8, "validation": 0.1, "test": 0.1}).groupBy("split").count().collect()}
    assert sizes == {"train": 802, "validation": 100, "test": 101}


def test_stratified_quota_and_top_up(spark):
    df = spark.range(100).withColumn("y", F.when(F.col("id") < 3, 0).otherwise(1))
    got = sampling.stratified(df, "id", "y", 1, 20).collect()
    assert len(got) == 20 and sum(r.y == 0 for r in got) == 3
    assert sampling.stratified(df.where("false"), "id", "y", 1, 20).count() == 0


def test_workspaces(spark):
    pool = spark.range(50).select(F.col("id").cast("string").alias("sheet_id"))
    asked = spark.createDataFrame([(1, ["1", "2"], ["3"]), (2, [str(i) for i in range(9)], [])], "query_index long, positives array<string>, negatives array<string>")
    for r in sampling.training_workspaces(asked, pool, 5).collect():
        taken = [x for x, y in zip(r.workspace, r.labels) if y]
        assert len(r.workspace) == 10 == len(set(r.workspace)) and len(taken) == (2 if r.query_index == 1 else 5)
        assert r.query_index == 2 or "3" in r.workspace


def test_validation(spark, sales):
    lines = [("1", '{"sheet_id": "1", "columns": [{"name": "A"}]}'), ("2", '{"name": " ", "note": 1, "day": 2, "columns": [{"name": " ", "example": "x"}, "B", null, {}]}'), ("3", '"text"'), ("4", None)]
    records = spark.createDataFrame(lines, "key string, text string").select("key", F.parse_json("text").alias("record"))
    errors = {tuple(r) for r in validate.sheet_errors(records).collect()}
    assert errors == {
        ("2", "", "disallowed fields: day, note"), ("2", "columns[0]", "disallowed fields: example"), ("2", "columns[0]", "empty column name"),
        ("2", "columns[1]", "not an object"), ("2", "columns[2]", "not an object"), ("2", "columns[3]", "empty column name"), ("3", "", "not an object"), ("4", "", "not an object"),
    }
    edges = spark.createDataFrame([(1, [["1", "2"], ["1"], ["1", "9"], None])], "edge_batch_id long, edges array<array<string>>")
    assert {(r.position, r.error) for r in validate.edge_errors(edges, sales).collect()} == {(1, "ends: 1"), (2, "unknown end 9"), (3, "ends: 0")}
    todo, kept = validate.resume(spark.range(3).withColumnRenamed("id", "k"), spark.createDataFrame([(0, "ok"), (1, "bad")], "k long, s string"), "k", F.col("s") == "ok")
    assert {r.k for r in todo.collect()} == {1, 2} and kept.count() == 1
    with pytest.raises(ValueError):
        validate.same_settings({"k": 1}, {"k": 2}, ("k",))


def test_keyed_files(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text(json.dumps({"7": {"name": "A", "columns": ["x", {"name": "y", "example": "1"}]}, "8": "skipped", "9": {"sheet_id": 10}}))
    b.write_text(json.dumps([{"name": "B"}, {"sheet_id": "7"}]))
    rows = {r.sheet_id: r for r in keyed.sheets(spark, str(a)).collect()}
    assert set(rows) == {"7", "10"} and [(c.name, c.example) for c in rows["7"].columns] == [("x", None), ("y", "1")]
    assert {r.sheet_id for r in keyed.sheets(spark, str(b)).collect()} == {"0", "7"}
    (tmp_path / "c.json").write_text('[{"sheet_id": "1", "name": "old"}, {"sheet_id": "1", "name": "new"}]')
    with pytest.raises(ValueError):
        keyed.sheets(spark, str(tmp_path / "c.json"))
    assert [r.name for r in keyed.sheets(spark, str(tmp_path / "c.json"), "last").collect()] == ["new"]
    (tmp_path / "d.json").write_text('"text"')
    with pytest.raises(Exception, match="object or an array"):
        keyed.records(spark, str(tmp_path / "d.json")).collect()


def test_relations(spark):
    m = spark.createDataFrame([(1, "a", 1.0, 10, 2, ["x", "y"]), (1, "b", 0.0, 10, 3, ["y"]), (1, "c", 0.5, 0, 0, [])], "q long, item string, score double, rows long, cols long, headers array<string>")
    w = {(r.i, r.j): r.w for r in graph.schema(m).collect()}
    assert w["a", "b"] == 0.5 and w["a", "a"] == 0 and w["a", "c"] == 0
    rows = {(r.i, r.j): r.w for r in graph.row_normalised(graph.schema(m)).collect()}
    assert rows["a", "b"] == 1.0 and rows["c", "a"] == 0
    serve = {(r.i, r.j): r.w for r in graph.schema(m, serving=True).collect()}
    assert serve["a", "a"] == 1.0 and serve["c", "c"] == 0.0
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "a", "t"), ("a", "a", "t"), ("a", "z", "t")], "a string, b string, type string")
    assert {(r.i, r.j) for r in graph.dependency(m, edges).collect()} == {("a", "b"), ("b", "a")}
    weights = graph.edge_softmax(graph.row_normalised(graph.schema(m)), m)
    assert all(abs(r.s - 1) < 1e-9 for r in weights.groupBy("i").agg(F.sum("w").alias("s")).collect())


def test_workbooks(spark, tmp_path):
    from gridloom.sources import workbooks

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Head</t></si><si><r><t>Two </t></r><r><t>parts</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t> </t></is></c></row><row r="3"><c r="A3"><v>5</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1 locked")
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    rows = {r.path.rsplit("/", 1)[1]: r for r in workbooks.sheets(spark, str(tmp_path / "*.xlsx")).collect()}
    assert (rows["a.xlsx"].sheet_name, rows["a.xlsx"].num_rows, rows["a.xlsx"].num_cols, rows["a.xlsx"].headers) == ("One", 3, 4, ["Head", "Two parts"])
    assert rows["a.xlsx"].error is None and rows["b.xlsx"].error == "encrypted" and rows["c.xlsx"].error == "corrupt"


def test_sinks(spark, tmp_path):
    from gridloom.sources import sinks

    path = tmp_path / "r.json"
    sinks.write_json(str(path), {"a": 1})
    with pytest.raises(TypeError):
        sinks.write_json(str(path), {"a": object()})
    assert json.loads(path.read_text()) == {"a": 1} and [p.name for p in tmp_path.iterdir()] == ["r.json"]
    rows = spark.createDataFrame([(1, "train"), (2, "test")], "x long, split string")
    sinks.write_splits(rows, str(tmp_path / "s"))
    assert {r.split for r in spark.read.json(str(tmp_path / "s")).collect()} == {"train", "test"}


def test_query_scans(spark):
    from gridloom.sources import scans

    known = spark.createDataFrame([("1",), ("2",)], "sheet_id string")
    q = spark.createDataFrame(
        [(0, "find", [" 1", "1", "9"], None, None, ["2"]), (1, "x", None, ["2"], ["1"], None), (2, " ", ["1"], None, None, None), (3, "y", ["9"], None, None, None), (4, None, ["1"], None, None, None)],
        "query_index long, query string, positive_sheet_ids array<string>, sheet_ids array<string>, sheet_ids_negative array<string>, hard_negative_sheet_ids array<string>",
    ).withColumn("negative_sheet_ids", F.lit(None).cast("array<string>"))
    got = {r.query_index: (r.positives, r.negatives) for r in scans.evaluation_queries(q, known).collect()}
    assert got == {0: (["1"], ["2"]), 1: (["2"], ["1"])}
    assert [r.query_index for r in scans.evaluation_queries(q, known, most=1).collect()] == [0]
    w = spark.createDataFrame([("q", ["1", "9", "2"], [1, 1, 0])], "query string, workspace_sheet_ids array<string>, labels array<int>")
    r = scans.from_workspace(w, known).first()
    assert (r.positives, r.negatives) == (["1"], ["2"])
    pairs = spark.createDataFrame([("1", None, "2", None, 1)], "sheet_a string, sheet_id_1 string, sheet_b string, sheet_id_2 string, label int")
    assert scans.pair_ids(pairs).first()[:2] == ("1", "2")


def test_workspaces_draw_from_all_sheets(spark):
    pool = spark.range(20_000).selectExpr("cast(id as string) as sheet_id")
    asked = spark.range(2_000).selectExpr("id as query_index", "array(cast(id as string)) as relevant")
    rows = sampling.workspaces(asked, pool, 5).collect()
    assert all(len(set(r.workspace)) == 5 and set(r.relevant) <= set(r.workspace) for r in rows)
    assert len({x for r in rows for x in r.workspace if x not in r.relevant}) > 4096


def test_easy_negatives_replace_rejected_draws(spark):
    ids = spark.createDataFrame([(str(i),) for i in range(8)], "x string")
    known = spark.createDataFrame([("1", "0"), ("2", "3"), ("4", "5")], "a string, b string")
    got = [tuple(r) for r in sampling.easy_negatives(ids, "x", known, 5, 25, attempts=40).collect()]
    assert len(set(got)) == 25 == len(got) and not {("0", "1"), ("2", "3"), ("4", "5")} & set(got) and all(a < b for a, b in got)
    assert len(sampling.easy_negatives(ids, "x", known, 5, 3).collect()) == 3
    assert sampling.easy_negatives(ids.limit(1), "x", known, 5, 3).count() == 0
    with pytest.raises(ValueError):
        sampling.python_split(spark, sampling.MOST_ON_DRIVER + 1, 1, 0.5)


def test_several_ranks_at_once(spark):
    rng = random.Random(2)
    data = {g: [rng.choice([rng.random(), 0.5, 1e9]) for _ in range(n)] for g, n in (("a", 1), ("b", 700))}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    got = {r.g: r for r in quantiles.values_at_ranks(df, "g", "v", {"low": F.lit(0), "mid": F.floor(F.col("n") / 2), "none": F.lit(5000)}, 16).collect()}
    assert all((got[g].low, got[g].mid, got[g].none) == (min(vs), sorted(vs)[len(vs) // 2], None) for g, vs in data.items())


def test_mining_and_audit(spark):
    vectors = spark.createDataFrame([(1, "s", [1.0, 0.0]), (2, "s", [0.5, 0.75**0.5]), (3, "t", [0.5, 0.75**0.5]), (4, "s", [0.5, -(0.75**0.5)]), (9, "s", [0.9, 0.19**0.5])], "id long, source string, vector array<double>")
    none = spark.createDataFrame([(7, 8, 0)] * 9, "a long, b long, label int")
    known = none.unionByName(spark.createDataFrame([(4, 1, 0), (9, 1, 0), (9, 1, 1), (1, 3, 0)], "a long, b long, label int"))
    assert [(r.a, r.b) for r in mining.hard_negatives(vectors, none, 1.0).collect()] == [(1, 2), (1, 4)]
    assert [(r.a, r.b) for r in mining.hard_negatives(vectors, known, 1.0).collect()] == [(1, 2)]
    assert [(r.a, r.b) for r in mining.hard_negatives(vectors, none, 0.12).collect()] == [(1, 2)]
    assert [(r.a, r.b, r.label, r.new_label) for r in mining.label_audit(known, vectors).collect()] == [(9, 1, 0, 1)]
