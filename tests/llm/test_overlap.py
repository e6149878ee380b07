import random

import pytest

from gridloom.llm import overlap

SCHEMA = "query_index long, query string, split string, source string, positive_sheet_ids array<string>, sheet_ids array<string>, words string, class_id string, train string"
BASE = "Show the return rate Q1 2020 at Bavin Fenmafa per shift with formulas kept"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "src", p, old, "w", "c", "t") for i, t, s, p, old in rows], SCHEMA)


def found(spark, rows):
    return {(r.train_index, r.other_index) for r in overlap.overlaps(overlap.classed(frame(spark, rows))).collect()}


@pytest.mark.parametrize(
    ("text", "same"),
    [
        (BASE.upper(), True),
        ("per shift at Bavin Fenmafa: show the return rate, Q1 2020 (with formulas kept)", True),
        (BASE.replace("return", "retrun"), True),
        (BASE + " as soon as possible", True),
        (BASE.replace("Show", "Display"), True),
        (BASE.replace("Q1", "Q2"), False),
        (BASE.replace("2020", "2021"), False),
        (BASE.replace("Bavin Fenmafa", "Lokav Ubeba"), False),
        ("Something else entirely about other tables", False),
    ],
)
def test_same_request(text, same):
    assert overlap.same_request(overlap.words_of(BASE), overlap.words_of(text)) is same


def test_months_and_slips():
    assert overlap.month_of("jan") == 0 == overlap.month_of("enero") and overlap.month_of("août") == 7 and overlap.month_of("ma") is None
    assert not overlap.same_request("rate june 2020 at bavin".split(), "rate july 2020 at bavin".split())
    assert overlap.same_request("rate june 2020 at bavin".split(), "rate jun 2020 at bavin".split())
    assert overlap.slip("about", "abuot") and overlap.slip("table", "tabl") and not overlap.slip("table", "chair") and not overlap.slip("a", "b")


def test_who_takes_part(spark):
    rows = [
        (1, BASE, " Train", ["s", None, " "], None), (2, BASE, "test", [" s "], None), (3, BASE, None, ["s"], None), (4, None, "test", ["s"], None),
        (5, "?!", "test", ["s"], None), (6, BASE, "dev", None, ["s"]), (7, BASE, "dev", [], ["s"]), (8, BASE, "dev", ["other"], None), (1, BASE, " Train", ["s", None, " "], None),
    ]
    assert found(spark, rows) == {(1, 2), (1, 6)}
    report = {(r.split, r.source): (r.records, r.overlapping, r.pairs) for r in overlap.report(overlap.classed(frame(spark, rows))).collect()}
    assert report == {("test", "src"): (1, 1, 1), ("dev", "src"): (2, 1, 1)}


def test_against_brute_force(spark):
    rng = random.Random(11)
    places = ["Bavin Fenmafa", "Lokav Ubeba", "Tarud Teldawo", "Rudhu Bronolor"]
    extra = ["", " thank you", " as soon as possible", " please"]
    rows = []
    for i in range(400):
        text = f"{rng.choice(['Show', 'Find', 'List'])} the {rng.choice(['return rate', 'lead time', 'gross margin'])} Q{rng.randrange(1, 3)} 202{rng.randrange(2)} at {rng.choice(places)} per {rng.choice(['shift', 'batch'])} with formulas kept for the yearly review meeting"
        at = rng.randrange(len(text) - 1)
        if rng.random() < 0.2 and text[at].isalpha() and text[at + 1].isalpha():
            text = text[:at] + text[at + 1] + text[at] + text[at + 2 :]
        rows.append((i, text + rng.choice(extra), rng.choice(["train", "train", "test", "dev"]), [rng.choice(["hot", "hot", f"s{rng.randrange(9)}"])], None))
    words = {i: overlap.words_of(t) for i, t, *_ in rows}
    want = {(a[0], b[0]) for a in rows for b in rows if a[2] == "train" != b[2] and set(a[3]) & set(b[3]) and overlap.same_request(words[a[0]], words[b[0]])}
    got = found(spark, rows)
    assert got <= want and len(got) >= 0.97 * len(want)


def test_buckets_meet_similar_texts(spark):
    """Candidates against all pairs of texts across the split with a shared sheet and digits, by similarity alone."""
    rng = random.Random(5)
    parts = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lo", "mi", "ru", "ve")]
    rows = []
    for i in range(150):
        base = [rng.choice(parts) for _ in range(rng.randrange(12, 40))]
        for j in range(4):
            text = [w if rng.random() > j * 0.07 else rng.choice(parts) for w in base]
            rows.append((4 * i + j, " ".join(text), ("train", "test")[j % 2], ["hot"], None))
    words = {i: overlap.words_of(t) for i, t, *_ in rows}
    recs = overlap.classed(frame(spark, rows))
    of = {r.query_index: bytes(r.class_id) for r in recs.members.collect()}
    classes = {(bytes(r.class_a), bytes(r.class_b)) for r in overlap.candidates(recs).collect()}
    met = {(a[0], b[0]) for a in rows for b in rows if a[2] == "train" and b[2] == "test" and (of[a[0]], of[b[0]]) in classes}
    like = {(a[0], b[0]): overlap.jaccard(words[a[0]], words[b[0]]) for a in rows for b in rows if a[2] == "train" and b[2] == "test"}
    want = {p for p, s in like.items() if s >= overlap.LEAST_JACCARD}
    assert len(want) > 150 and len(want & met) >= 0.98 * len(want)
    assert sum(s < 0.2 for p, s in like.items() if p in met) < 0.05 * len(like)


def test_similarity_decides(spark):
    words = [[" ".join(overlap.words_of(t)) for t in both] for both in ((BASE, BASE + " please"), (BASE, "Show rate Q1 2020 at Bavin Fenmafa"))]
    pairs = spark.createDataFrame([(bytes([i]), b"x", a, b) for i, (a, b) in enumerate(words)], "class_a binary, class_b binary, words_a string, words_b string")
    assert [bytes(r.class_a) for r in overlap.verified(pairs).collect()] == [b"\0"]
    assert overlap.verified(pairs, least=0.99).count() == 0 and overlap.jaccard(["ab"], ["ab"]) == 1.0 and overlap.jaccard(["abcd"], ["abce"]) == 1 / 3


def test_huge_groups_of_copies_stay_linked(spark):
    rows = [(i, BASE if i % 2 else BASE.lower(), "train" if i < 60 else "test", ["s"], None) for i in range(100)]
    assert len(found(spark, rows)) == 60 * 40


def test_huge_groups_keep_their_near_pairs(spark):
    rows = [(0, BASE + " please", "train", ["s"], None)] + [(i, BASE, "test", ["s"], None) for i in range(1, 1202)]
    assert found(spark, rows) == {(0, i) for i in range(1, 1202)}
    rows += [(2000, BASE, "train", ["s", "r"], None), (2001, BASE, "test", ["r", "s"], None)]
    report = {(r.split, r.source): (r.records, r.overlapping, r.pairs) for r in overlap.report(overlap.classed(frame(spark, rows))).collect()}
    assert report == {("test", "src"): (1202, 1202, 2404)} and len(found(spark, rows)) == 2404


def test_formatting_around_digits_and_slips(spark):
    assert overlap.same_request("rate of 1 000 units in 2020 q3 please".split(), "rate of 1000 units in 2020q3".split())
    assert not overlap.same_request("rate of 1 000 units in room 12a".split(), "rate of 1000 units in room 12b".split())
    texts = [
        ("Limit 1,000 in 2020-Q3 at Bavin", "limit 1000 in2020q3 at Bavin"), ("Limit 1,000 in 2020-Q3 at Bavin", "limit 1000 in 2020Q3 at Bavin please"),
        ("monthly margin figures warehouse Bavin report", "montly margn figurs warehouse Bavin report"), ("Quarterly shipment delays carrier overview", "Quartrly shipmnt dlays carrier overview"),
    ]
    rows = [(10 * i + j, t, s, [f"s{i}"], None) for i, both in enumerate(texts) for j, (t, s) in enumerate(zip(both, ("train", "test")))]
    assert found(spark, rows) == {(10 * i, 10 * i + 1) for i in range(len(texts))}
    classes = {r.query_index: bytes(r.class_id) for r in overlap.classed(frame(spark, rows)).members.collect()}
    assert classes[0] == classes[1] and classes[20] != classes[21]


def test_empty_and_long(spark):
    assert found(spark, []) == set()
    long = " ".join(f"w{i}x" for i in range(20_000))
    assert found(spark, [(1, long, "train", ["s"], None), (2, long + " please", "test", ["s"], None)]) == {(1, 2)}
    assert found(spark, [(1, long, "train", ["s"], None), (2, long + " w7", "test", ["s"], None)]) == set()
    words = " ".join("abcdefghij"[i % 10] * (i % 7 + 1) for i in range(20_000))
    assert found(spark, [(1, words, "train", ["s"], None), (2, words + " please", "test", ["s"], None)]) == {(1, 2)}
