import random

from gridloom.llm import reading

DOCS = "doc_id long, text string, source string, lang string, items string, level string, n_chars string"
LABELS = "doc_id long, reading_level int, rater string, anchor string"
EASY = "the cat sat on a mat we see the dog run to a big red box my friend has one old cup".split()
HARD = "heterogeneous consolidation methodologies presuppose endogenous stratification whereas jurisdictional taxonomies circumscribe probabilistic imputation notwithstanding".split()


def text(rng, level, words=120):
    out = []
    while len(out) < words:
        n = 4 + 4 * level
        out += [rng.choice(HARD if rng.random() < (level - 1) / 4 else EASY) for _ in range(n)]
        out[-1] += "."
    return " ".join(out)


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    levels = [rng.randrange(1, 6) for _ in range(n)]
    return [text(rng, x) for x in levels], levels


def frames(spark, texts, labels):
    docs = spark.createDataFrame([(i, t, "s", "en", "x", "y", "z") for i, t in enumerate(texts)], DOCS)
    return docs, spark.createDataFrame([(i, x, "r", "a") for i, x in labels], LABELS)


def test_held_out_accuracy(spark):
    texts, levels = corpus()
    docs, labels = frames(spark, texts, [(i, x) for i, x in enumerate(levels) if i % 2] + [(1, None), (None, 3), (10_000, 5)])
    got = {r.doc_id: r.level for r in reading.levels(docs, labels).collect()}
    held = [i for i in range(len(texts)) if i % 2 == 0]
    assert sum((got[i] >= 3.5) == (levels[i] >= 4) for i in held) / len(held) > 0.93
    found = {r.doc_id for r in reading.demanding(docs, labels).collect()}
    assert found == {i for i, x in got.items() if x >= 3.5}
    profile = reading.profile(docs, labels).collect()
    assert sum(r.documents for r in profile) == len(texts)


def test_what_has_no_level(spark):
    texts, levels = corpus(80)
    table = "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 60
    data = "\n".join(f"Name{i},{i * 7919},{i}.5,net" for i in range(40))
    extra = [None, "", " \n", table, data, '{"a": [' + '"x", ' * 90 + '"y"]}', "no sentence here", "财务分析员更新每月合计。" * 40, "One. " * 40_000]
    docs, labels = frames(spark, texts + extra, list(enumerate(levels)) + [(80, 4)])
    got = {r.doc_id: r.level for r in reading.levels(docs, labels).collect()}
    assert set(got) - set(range(80)) == {87, 88}
    docs, none = frames(spark, texts[:5], [])
    assert {r.level for r in reading.levels(docs, none).collect()} == {None} and reading.demanding(docs, none).count() == 0
    docs, labels = frames(spark, [], [(1, 3)])
    assert reading.levels(docs, labels).count() == 0


def test_short_texts_are_left_out_and_copies_count_once(spark):
    texts, levels = corpus(120)
    rng = random.Random(9)
    hard, short = text(rng, 5), text(rng, 5, words=10)
    docs, labels = frames(spark, [*texts, hard, short], list(enumerate(levels)))
    docs = docs.unionByName(docs.where("doc_id = 120"))
    found = [r.doc_id for r in reading.demanding(docs, labels).collect()]
    assert found.count(120) == 1 and 121 not in found


def test_items():
    found, share, sentences = reading.items_of("One two.\n| 1 | 2 |\nTwo 三四五。")
    assert found["two"] == 2 and found["三四"] == 1 == found["四五"] and sentences == 2 and share < 0.9


def test_likelihood_and_steps():
    import numpy as np

    assert np.allclose(reading.at_mean(reading.passed(np.array([1.2, 2.0, 3.3, 4.9])).sum(axis=1)), [1.2, 2.0, 3.3, 4.9], atol=1e-3)
    sums = np.zeros((3, 6))
    sums[0] = [10, 10, 10, 5, 0, 62.5]  # an item that half of its answers place above the third step
    steps, a = reading._items(sums)
    here = reading.log_likelihood(sums, (steps, a))
    off = [reading.log_likelihood(sums, (steps + x, a)) for x in (-0.5, 0.5)]
    assert here > max(off) and a[1] == 0 and reading.log_likelihood(np.zeros((3, 6)), (steps, a)) == 0


def test_rounds_end_when_items_settle(spark):
    texts, levels = corpus(200, seed=3)
    docs, labels = frames(spark, texts, [(i, x) for i, x in enumerate(levels) if i % 4 == 0])
    history = reading.fit(docs, labels).history
    assert 2 <= len(history) <= reading.ROUNDS and (len(history) == reading.ROUNDS or history[-1][2] < reading.SETTLED)
    assert all(h[1] < 0 for h in history)
