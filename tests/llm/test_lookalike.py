import pytest

from gridloom.llm import lookalike as look

SCHEMA = "sheet_id string, name string, columns array<struct<name:string,example:string,n:int>>, n int, plain string, word string"

PLAIN = ["Plant", "Σύνολο", "Склад", "ТАХ", "Volume m³", "Größe", "Temp °C", "数量", "tab\tbed", "2019–2020", "Phase Ⅱ", "naïve", "", "  padded "]
ODD = {
    "Ｐｌａｎｔ （ｋｇ）": "Plant (kg)",
    "Gro\u0308sse": "Gr\u00f6sse",
    "Pl​ant﻿": "Plant",
    " Plant": " Plant",
    "a　b": "a b",
    "Q4 ‑ 2020": "Q4 - 2020",
    "Plаnt": "Plant",
    "Сurrenсy": "Currency",
    "Σύνoλo": "Σύνολο",
    "Цeнa": "Цена",
    "Pⅼɑnt": "Plant",
    "ѕреnԁ": "spend",
    "​": "",
}


@pytest.mark.parametrize("text", PLAIN)
def test_plain_stays(text):
    assert "".join(look.by_table(t) if w else look._between(t) for w, t in look._words(text)) == text


@pytest.mark.parametrize("text", ODD)
def test_odd_becomes_plain(text):
    assert "".join(look.by_table(t) if w else look._between(t) for w, t in look._words(text)) == ODD[text]


def test_the_automaton_walks_look_alikes_for_nothing():
    trie = look._trie(iter([("Plant", 5), ("Plane", 9), ("Planet", 2)]))
    assert look.reached(trie, "Рlа​nt") == [(0, "Plant", 5)]
    assert {(c, w) for c, w, _ in look.reached(trie, "Plant", 1)} == {(0, "Plant"), (1, "Plane"), (1, "Planet")}
    assert look.reached(trie, "xyz") == []


def test_the_most_frequent_spelling_in_the_words_script_wins():
    trie = look._trie(iter([("сор", 9), ("cop", 2), ("coр", 1)]))
    assert look.spelled(trie, "coр​") == "cop"
    assert look.spelled(look._trie(iter([])), "Рlant") == "Plant"


def plain_forms(spark, names):
    rows = [(f"s{i}", t, None, 1, "p", "w") for i, t in enumerate(names)]
    return {r.value: r.plain_form for r in look.odd_names(look.sheet_names(spark.createDataFrame(rows, SCHEMA))).collect()}


def test_the_vocabulary_decides(spark):
    """Look-alikes that the table leaves alone are odd only where the vocabulary has the word that they spell."""
    odd = {"\ufb01le sums": "file sums", "\u13aaccount": "Account", "Tʀee": "Tree", "sto\u24b8k": "stoCk", "\ua4d4otal": "Total"}
    assert plain_forms(spark, [*odd, "file sums", "Account", "Tree", "stoCk", "Total", "tree"]) == odd
    assert plain_forms(spark, odd) == {"Tʀee": "TRee"}
    assert plain_forms(spark, ["\u13aa\u13b3", "AW", "հօ", "ho"]) == {}  # words wholly in one script


def test_costs():
    trie = look._trie(iter([("Tree", 1), ("TRee", 1)]))
    assert sorted(look.reached(trie, "Tʀee", 0.5)) == [(0, "TRee", 1), (0.5, "Tree", 1)] and look.spelled(look._trie(iter([("Tree", 1)])), "Tʀee", 0) == "TRee"
    assert look.reached(look._trie(iter([("tree", 1)])), "Tree", 0.5) == []  # case counts unless the letter only looks like it
    assert look.reached(look._trie(iter([("file", 3)])), "\ufb01le") == [(0, "file", 3)]


def test_names(spark):
    rows = [(f"s{i}", t, [(t, None, 1), (None, "x", 1), ("Plant", None, 1)], 1, "p", "w") for i, t in enumerate([*PLAIN, *ODD, None])]
    rows += [rows[-2], ("none", None, None, 1, "p", "w"), ("long", "Plаnt " * 5000, [], 1, "p", "w")]
    sheets = spark.createDataFrame(rows, SCHEMA)
    names = look.sheet_names(sheets)
    found = {(r.sheet_id, r.col_pos): (r.value, r.plain_form) for r in look.odd_names(names).collect()}
    want = {(f"s{i}", p): (t, ODD[t]) for i, t in enumerate([*PLAIN, *ODD]) for p in (-1, 0) if t in ODD}
    assert found.pop(("long", -1))[1] == "Plant " * 5000
    assert found == want
    forms = look.plain_names(names)
    assert forms.count() == names.count() and forms.where("plain_form is null").count() == 0


def test_a_hot_value(spark):
    rows = [(f"s{i}", "Plаnt" if i % 3 == 0 else f"Name {i}", None, 1, "p", "w") for i in range(3000)]
    assert look.odd_names(look.sheet_names(spark.createDataFrame(rows, SCHEMA))).count() == 1000


def test_empty(spark):
    names = look.sheet_names(spark.createDataFrame([], SCHEMA))
    assert look.odd_names(names).count() == 0 and look.plain_names(names).count() == 0
