import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import packing

SCHEMA = "doc_id long, n_tokens long, size int, salt int, piece_no int"


def contents(plan):
    """container -> its items, from the segments; checks that ranks are used once."""
    held, ranks = {}, {}
    for size, rank, first, n, each, offset in plan.segments:
        for k in range(n * each):
            assert (size, rank + k) not in ranks
            ranks[size, rank + k] = True
            held.setdefault(first + k // each, []).append((offset + k % each * size, size))
    return held, Counter(s for s, _ in ranks)


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30), st.sampled_from([(64,), (8, 16, 64), (32, 64)]))
def test_a_plan_holds_every_item_once_and_fits(counts, lengths):
    plan = packing.plan(counts, lengths, 2)
    held, used = contents(plan)
    assert used == Counter(counts)
    spans = {c: length for first, n, length in plan.spans for c in range(first, first + n)}
    assert set(spans) == set(held)
    for c, items in held.items():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= spans[c] and all(x >= spans[c] or x < at for x in lengths)


def test_a_good_fill():
    rng = random.Random(2)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(5.5, 1)))) for _ in range(20_000))
    plan = packing.plan(counts)
    total = sum(s * c for s, c in counts.items())
    assert total / sum(n * length for _, n, length in plan.spans) > 0.995


def test_documents_of_all_sizes(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 0, 1, 7, 7, 7, 100, 2048, 2049, 5000, 30_000])) for i in range(600)] + [(None, 7), (3, 7), (3, 7)]
    found = packing.pack(spark.createDataFrame([(i, n, 1, 1, 1) for i, n in rows], SCHEMA), "doc_id", "n_tokens", salts=3).collect()
    assert Counter(r.doc_id for r in found if r.piece_no == 0) == Counter(i for i, _ in rows)
    assert sum(r.size for r in found) == sum(n or 0 for _, n in rows)
    assert all(r.first == r.piece_no * 2048 and (r.size == 2048 or r.first + 2048 > 0) for r in found)
    boxes = {}
    for r in found:
        boxes.setdefault((r.container_id, r.container_length), []).append((r.container_offset, r.size))
    assert len({c for c, _ in boxes}) == len(boxes)
    for (_, length), items in boxes.items():
        at = 0
        for offset, size in sorted(x for x in items if x[1]):
            assert offset == at
            at += size
        assert at <= length


@pytest.mark.parametrize("rows", [[], [(1, 0)], [(1, None), (2, 0)]])
def test_nothing_to_pack(spark, rows):
    found = packing.pack(spark.createDataFrame([(i, n, 1, 1, 1) for i, n in rows], SCHEMA), "doc_id", "n_tokens").collect()
    assert [(r.container_id, r.size) for r in found] == [(0, 0)] * len(rows)


def test_a_size_that_a_third_share_is_ranked_by_several_tasks(spark):
    rows = spark.range(9000).selectExpr("id as doc_id", "if(id % 3 = 0, 512, id % 400) as n_tokens")
    found = packing.pack(rows, "doc_id", "n_tokens")
    assert found.groupBy("container_id").sum("size").where("`sum(size)` > 2048").count() == 0 and found.count() == 9000
    s = packing.summary(found).collect()
    assert sum(r.tokens for r in s) == rows.groupBy().sum("n_tokens").first()[0]


def test_lengths_are_chosen_jointly(spark):
    """Several lengths together cost less than any of them alone, and the plan is the least of all sets."""
    rng = random.Random(7)
    counts = Counter(min(2047, max(1, int(rng.lognormvariate(5.7, 0.8)))) for _ in range(20_000))
    each = dict(packing.plans(counts, packing.LENGTHS, packing.CONTAINER_COST))
    chosen = packing.plan(counts)
    assert chosen.cost() == min(p.cost() for p in each.values()) < 0.97 * each[2048,].cost()
    assert len({length for _, _, length in chosen.spans}) > 1 and set(each) == {x for x in each if max(x) >= max(counts)}
    rows = spark.createDataFrame([(s, 1) for s in counts.elements()] + [(5000, 1), (None, 1)], "n_tokens long, cost int")
    found = packing.costs(rows, "n_tokens").collect()
    best = [r for r in found if r.chosen]
    assert len(best) == 1 and best[0].cost == min(r.cost for r in found) and best[0].tokens == sum(s * n for s, n in counts.items()) + 5000
    assert packing.costs(rows.where("false"), "n_tokens").where("chosen").first().cost == 0


def test_full_pieces_have_containers_of_their_own(spark):
    found = packing.pack(spark.createDataFrame([(i, n) for i, n in enumerate([2048] * 300 + [7000, 10, 20])], "item long, n_tokens long"), "item", "n_tokens").collect()
    full = [r.container_id for r in found if r.size == 2048]
    assert len(full) == 303 == len(set(full)) and not set(full) & {r.container_id for r in found if r.size < 2048}


def test_salts_follow_the_count(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_TASK", 50)
    rows = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 512, 1 + id % 40) as n_tokens")
    found = packing.pack(rows, "doc_id", "n_tokens", salts=1)
    assert found.groupBy("container_id").agg({"size": "sum"}).where("`sum(size)` > 2048").count() == 0 and found.select("doc_id").distinct().count() == 4000
    assert found.groupBy("container_id", "container_offset").count().where("count > 1").count() == 0
