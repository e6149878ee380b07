import itertools
import random
import re

import pytest

from gridloom.llm import canonical

SCHEMA = "query_index long, query string, flat string, key string, salt int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "f", "k", 0) for i, t in rows], SCHEMA)


def pairs(spark, rows, **how):
    return {(r.keep, r.copy) for r in canonical.copies(frame(spark, rows), "query_index", "query", **how).collect()}


def test_what_is_equal(spark):
    long = "x" * 50_000
    rows = [
        (1, "Show the Rate, Q1"), (2, "show  THE rate q1"), (3, "show the rate q2"), (4, "“show the–rate” q1?\n"),
        (10, "a: x; b: y"), (11, "B = Y | A = X"), (12, "b:y\na:x"), (13, "a: x b: y"), (14, "b: y a: x"), (15, "a x b y"),
        (20, "caf\u00e9"), (21, "cafe\u0301"), (22, "cafe"),
        (30, None), (31, ""), (32, " \t"), (33, "?!"), (34, "..."),
        (40, long), (41, long.upper()), (40, long), (None, "show the rate q1"),
        (50, "a: long\nvalue; b: z"), (51, "b: z; a: long value"),
    ]
    assert pairs(spark, rows) == {(1, 2), (1, 4), (10, 11), (10, 12), (10, 13), (10, 14), (10, 15), (20, 21), (40, 41), (50, 51)}


@pytest.mark.parametrize("share", [0.001, 0.05, 0.9])
def test_against_brute_force(spark, share):
    rng = random.Random(5)
    words = ["Alpha", "beta", "GAMMA", "x1"]
    rows = [(i, rng.choice(["", "  ", None, "hot hot"] + [rng.choice([" ", ", ", "-"]).join(rng.choices(words, k=3))] * 4)) for i in range(300)]
    groups = {}
    for i, t in rows:
        key = re.sub(r"\W", "", (t or "").lower())
        if key:
            groups.setdefault(key, []).append(i)
    assert pairs(spark, rows, share=share) == {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    counted = {(r.query_index, r.copies) for r in canonical.collapsed(frame(spark, rows), "query_index", "query", share).collect()}
    assert counted == {(min(g), len(g)) for g in groups.values()}


def test_order_of_pieces(spark):
    parts = ["site: A", "period: Q1", "by = shift"]
    rows = [(i, rng) for i, rng in enumerate("; ".join(p) for p in itertools.permutations(parts))]
    assert pairs(spark, rows) == {(0, i) for i in range(1, 6)}


def test_other_borders_of_pieces(spark):
    rows = [(1, "A: 1; B: 2; C: 3"), (2, "A: 1, B: 2; C: 3"), (3, "C: 3; B: 2; A: 1"), (4, "a1b2c3"), (5, "C: 3; A: 1, B: 2"), (6, "A: 1; B: 2; C: 4")]
    assert pairs(spark, rows) == {(1, 2), (1, 3), (1, 4), (1, 5)}


def test_empty(spark):
    assert pairs(spark, []) == set()
    assert canonical.collapsed(frame(spark, []), "query_index", "query").count() == 0
