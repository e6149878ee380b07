"""Reading level of documents.

A Rasch-style latent model with two kinds of parameters on the scale of the labels: the level theta of a document and
the difficulty beta of an item, where items are the words that occur in texts (pairs of characters in Chinese) and
the lengths of their sentences. Between the five levels lie four steps tau. An occurrence of item w in document d
answers for each step whether d lies above it, with the logistic chance P(w, k) = 1 / (1 + exp(-SLOPE (beta_w -
tau_k))); a labelled document's answers are the shares of its raters above each step, another document's are the
chances P(d, k) at its own level. The model maximises the likelihood

    sum over d, w, k of  a_w n_dw (P(d, k) log P(w, k) + (1 - P(d, k)) log(1 - P(w, k)))

by alternating steps, in which, as in Rasch's model, the mean number of steps passed is sufficient: given documents,
beta_w solves sum_k P(w, k) = the mean of its occurrences; given items, theta_d solves the same for the weighted mean of
its items. The discrimination a_w falls with the variance of the levels that w occurs at. Labelled documents are
anchors; the others join from the second round on, which gives difficulties to items that no labelled document holds.
Rounds end when the items' difficulties, weighted by occurrence, move by less than SETTLED on average, at the latest
after ROUNDS; each round's likelihood is reported.

Items are hashed to ITEMS numbers, so the whole model is arrays of that length, however large the corpus: each step
adds up partial arrays per task, and the driver sees ITEMS rows at most. Two items share a number with a chance of one in ITEMS for each pair; see the
README for the loss that was measured. Weighted means shrink towards the middle, so
a monotone curve, fitted on labelled documents scored by a model of the other half of them, maps them to the scale.

Only the prose of a text counts: lines of tables, listings, code and data are left out, and a text is running prose
if at least LEAST_PROSE of its characters and LEAST_SENTENCES sentences are left. Null, blank and other texts have
no level (null); without any labels all levels are null. Documents delivered twice are treated alike. Labels without
a level, or of unknown documents, don't count.
"""

from __future__ import annotations

import logging
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import cut

ITEMS = 1 << 18
#: The most rounds, and the mean move of difficulties that ends them earlier.
ROUNDS, SETTLED = 8, 0.01
#: The steps between the levels, and the slope of the response at a step: a document in the middle between two steps
#: passes the lower one with a chance of 0.95.
STEPS, SLOPE = (1.5, 2.5, 3.5, 4.5), 6.0
#: Weight of a labelled document against one without label, and of the overall mean against an item's own evidence.
ANCHOR, PRIOR = 10.0, 2.0
#: Variance that every item has besides its own.
NOISE = 0.15
LEAST_PROSE, LEAST_SENTENCES, LEAST_CHARACTERS = 0.4, 2, 300
DEMANDING = 3.5
BINS = 200

_LOG = logging.getLogger(__name__)

_WORDS = re.compile(r"[^\W\d_]+").findall
_DATA = re.compile(r'[\[\]{}|<>="\t\\]').findall
_DIGITS = re.compile(r"\d").findall
_LINES = re.compile(r"[\r\n\x0b\x0c\x85\u2028\u2029]+").split
_SENTENCES = re.compile(r"[.!?。！？…]+|\n").split
_HAN = re.compile(r"[\u3400-\u4dbf\u4e00-\u9fff]")


def prose_lines(text: str) -> list[str]:
    """The lines that aren't data: few brackets, bars, quotes and digits."""
    return [x for x in _LINES(text) if x and len(_DATA(x)) <= 0.015 * len(x) and len(_DIGITS(x)) <= 0.12 * len(x)]


def items_of(text: str) -> tuple[Counter, float, int]:
    """(how often each item occurs, the share of the text that is prose, its sentences). A sentence's length counts
    as an item by the square of its words, so that long sentences weigh as much as what they say."""
    lines = prose_lines(text)
    prose = "\n".join(lines).lower()
    found: Counter = Counter()
    lengths: Counter = Counter()
    sentences = 0
    han = _HAN.search(prose) is not None
    for sentence in _SENTENCES(prose):
        words = _WORDS(sentence)
        if not words:
            continue
        sentences += 1
        if han:
            long = [w for w in words if _HAN.match(w)]
            n = len(words) - len(long) + sum(map(len, long)) / 2
            words = [w for w in words if not _HAN.match(w)] + [w[i : i + 2] for w in long for i in range(len(w) - 1)]
        else:
            n = len(words)
        found.update(words)
        lengths[f"#{min(18, int(np.log2(max(1, n)) * 3))}"] += n * n / 5
    found.update(lengths)
    return found, len(prose) / max(1, len(text)), sentences


def features(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, prose, items, weights) of each document with text; cut from its lineage. Items and weights are
    packed as int32 and float32, which Arrow moves as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        number: dict[str, int] = {}
        for batch in batches:
            kept, chars, prose, items, weights = [], [], [], [], []
            for row, text in enumerate(x.as_py() for x in batch.column(1)):
                if text is None or not text.strip():
                    continue
                found, share, sentences = items_of(text)
                if len(number) > 1_000_000:
                    number.clear()
                for w in found:
                    if w not in number:
                        number[w] = xxhash.xxh3_64_intdigest(w) % ITEMS
                kept.append(row)
                chars.append(len(text))
                prose.append(share >= LEAST_PROSE and sentences >= LEAST_SENTENCES)
                items.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                weights.append(np.sqrt(np.fromiter(found.values(), np.float32, len(found))))
            packed = [pa.array([x.tobytes() for x in column], pa.binary()) for column in (items, weights)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(chars, pa.int64()), pa.array(prose, pa.bool_()), *packed], ["doc_id", "n_chars", "prose", "items", "weights"])

    return cut(documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, prose boolean, items binary, weights binary"))


def passed(level: np.ndarray) -> np.ndarray:
    """The chance of passing each step at a level; one column for each step."""
    return 1 / (1 + np.exp(-SLOPE * (np.asarray(level)[..., None] - np.array(STEPS))))


_GRID = np.linspace(STEPS[0] - 3, STEPS[-1] + 3, 4001)
_PASSED = passed(_GRID).sum(axis=1)


def at_mean(steps: np.ndarray) -> np.ndarray:
    """The level at which so many steps are passed in the mean."""
    return np.interp(steps, _PASSED, _GRID)


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(how many values each row packs, all of them)."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int32)
    n = np.diff(ends) // np.dtype(kind).itemsize
    return n, np.frombuffer(data, kind, n.sum(), ends[0]) if n.sum() else np.empty(0, kind)


def _added(total: np.ndarray, n: np.ndarray, items: np.ndarray, weights: np.ndarray, answers: np.ndarray, mass: float, shift: np.ndarray | int = 0) -> None:
    """Adds to the sums of each item: weight, weight * answer for each step, weight * steps passed ^ 2."""
    index = items + (np.repeat(shift, n) if isinstance(shift, np.ndarray) else shift)
    w = weights * mass
    total[:, 0] += np.bincount(index, w, len(total))
    for i, x in enumerate([*answers.T, answers.sum(axis=1) ** 2], 1):
        total[:, i] += np.bincount(index, w * np.repeat(x, n), len(total))


_SUMS = [f"s{i}" for i in range(len(STEPS) + 2)]


def _there(total: np.ndarray) -> pa.RecordBatch:
    there = np.flatnonzero(total[:, 0])
    return pa.RecordBatch.from_arrays([pa.array(there), *(pa.array(total[there, i]) for i in range(len(_SUMS)))], ["item", *_SUMS])


def _collected(parts: DataFrame, size: int) -> np.ndarray:
    rows = parts.groupBy("item").agg(*[F.sum(c).alias(c) for c in _SUMS]).toPandas()  # `size` rows at most
    out = np.zeros((size, len(_SUMS)))
    out[rows["item"]] = rows[_SUMS]
    return out


_SUM_SCHEMA = "item long, " + ", ".join(f"{c} double" for c in _SUMS)


def _labelled_sums(labelled: DataFrame) -> np.ndarray:
    """The sums over labelled documents; one array for each side. labelled: items, weights, answers and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * ITEMS, len(_SUMS)))
        for batch in batches:
            (n, items), (_, weights) = _unpacked(batch.column(0), np.int32), _unpacked(batch.column(1), np.float32)
            each = batch.column(2).flatten().to_numpy().reshape(-1, len(STEPS))
            _added(total, n, items, weights, each, ANCHOR, batch.column(3).to_numpy().astype(np.int64) * ITEMS)
        yield _there(total)

    parts = labelled.select("items", "weights", "answers", "side").mapInArrow(run, _SUM_SCHEMA)
    return _collected(parts, 2 * ITEMS).reshape(2, ITEMS, len(_SUMS))


def _other_sums(rest: DataFrame, model: tuple[np.ndarray, np.ndarray], curve: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The sums over the other documents, each at the level that the model and the curve give it; one pass."""
    shared = rest.sparkSession.sparkContext.broadcast((_products([model])[0], curve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weight, product), (xs, ys) = shared.value
        total = np.zeros((ITEMS, len(_SUMS)))
        for batch in batches:
            (n, items), (_, weights) = _unpacked(batch.column(0), np.int32), _unpacked(batch.column(1), np.float32)
            score = _scores(n, items, weights, weight, product)
            known = ~np.isnan(score)
            answers = np.where(known[:, None], passed(np.interp(np.where(known, score, 0), xs, ys)), 0)
            w = weights if known.all() else weights * np.repeat(known, n)
            _added(total, n, items, w, answers, 1.0)
        yield _there(total)

    return _collected(rest.select("items", "weights").mapInArrow(run, _SUM_SCHEMA), ITEMS)


def _items(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps passed in the mean, discrimination) of each item; no discrimination where it never occurs."""
    n, s, q = sums[:, 0], sums[:, 1:-1].sum(axis=1), sums[:, -1]
    mean = s.sum() / n.sum() if n.sum() else 0.0
    steps = (s + PRIOR * mean) / (n + PRIOR)
    variance = np.maximum((q + PRIOR * mean**2 + PRIOR) / (n + PRIOR) - steps**2, 0)
    return steps, np.minimum(n / 3, 1) / (variance + NOISE)


def log_likelihood(sums: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> float:
    """The model's mean log-likelihood of an answer, weighted by discrimination."""
    steps, a = model
    there = (sums[:, 0] > 0) & (a > 0)
    n, yes, a = sums[there, 0], sums[there, 1:-1], a[there]
    p = np.clip(passed(at_mean(steps[there])), 1e-12, 1 - 1e-12)
    total = (yes * np.log(p) + (n[:, None] - yes) * np.log(1 - p)).sum(axis=1)
    return float((a * total).sum() / max((a * n).sum() * len(STEPS), 1e-12))


def _products(models: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(a.astype(np.float32), (a * d).astype(np.float32)) for d, a in models]


def _scores(n: np.ndarray, items: np.ndarray, weights: np.ndarray, weight: np.ndarray, product: np.ndarray, shift: np.ndarray | int = 0) -> np.ndarray:
    """The level of each document before the curve; NaN where no item discriminates."""
    ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    index = items + (np.repeat(shift, n) if isinstance(shift, np.ndarray) else shift)
    low, high = (np.diff(np.concatenate([[0.0], np.cumsum(weights * x[index], dtype=np.float64)])[ends]) for x in (weight, product))
    return np.where(low > 0, at_mean(high / np.where(low > 0, low, 1)), np.nan)


def _scored(docs: DataFrame, models: list[tuple[np.ndarray, np.ndarray]], keep: list[str]) -> DataFrame:
    """keep and score (the level before the curve) of each document, by models[side] where docs has a side, else by the
    only model."""
    shared = docs.sparkSession.sparkContext.broadcast(_products(models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, product = (np.concatenate(x) for x in zip(*shared.value))
        for batch in batches:
            shift = batch.column(2).to_numpy().astype(np.int64) * ITEMS
            (n, items), (_, weights) = _unpacked(batch.column(0), np.int32), _unpacked(batch.column(1), np.float32)
            score = _scores(n, items, weights, weight, product, shift)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3, 3 + len(keep))), pa.array(score)], [*keep, "score"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    side = F.col("side").cast("int") if "side" in kinds else F.lit(0)
    return docs.select("items", "weights", side.alias("side"), *keep).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double"]))


def _curve(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Scores and the levels they stand for, never falling. pairs: score, level; seen as sums of at most BINS bins."""
    bin_ = F.least(F.floor(F.col("score") * F.lit(BINS / 5)), F.lit(2 * BINS))
    rows = pairs.where("not isnan(score)").groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum("score").alias("x"), F.sum("level").alias("y")).toPandas().sort_values("bin")  # 2 * BINS rows at most
    blocks: list[list[float]] = []
    for n, x, y in zip(rows["n"], rows["x"], rows["y"]):
        blocks.append([n, x, y])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][0] >= blocks[-1][2] / blocks[-1][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([x / n for n, x, _ in blocks]), np.array([y / n for n, _, y in blocks])


def _on_curve(docs: DataFrame, curve: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs with level for score, by straight lines between the curve's points."""
    xs, ys = curve

    @F.pandas_udf("double")
    def level(score: pd.Series) -> pd.Series:
        return pd.Series(np.interp(score, xs, ys) if len(xs) else np.full(len(score), np.nan))

    known = F.col("score").isNotNull() & ~F.isnan("score")
    return docs.withColumn("level", F.when(known, F.nanvl(level("score"), F.lit(None).cast("double"))))


@dataclass
class Fit:
    """docs: the features of running prose, with answers for labelled documents; model: of the items; curve; history:
    (round, log-likelihood, mean move of the difficulties)."""

    docs: DataFrame
    model: tuple[np.ndarray, np.ndarray]
    curve: tuple[np.ndarray, np.ndarray]
    history: list[tuple[int, float, float]]


def fit(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Fit:
    """Alternates between items and documents until the items settle."""
    docs = features(documents).where("prose")
    answers = F.array(*[F.avg((F.col("reading_level") > t).cast("double")) for t in STEPS]).alias("answers")
    known = labels.where("reading_level is not null and doc_id is not null")
    anchors = cut(known.groupBy("doc_id").agg(F.avg("reading_level").cast("double").alias("anchor"), answers))
    docs = docs.join(anchors, "doc_id", "left")
    labelled = cut(docs.where("anchor is not null").withColumn("side", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")))
    rest = docs.where("anchor is null").drop("answers")
    fixed = _labelled_sums(labelled)
    moving = np.zeros_like(fixed[0])
    model, curve = _items(fixed.sum(axis=0)), (np.empty(0), np.empty(0))
    history: list[tuple[int, float, float]] = []
    for step in range(1, rounds + 1):
        halves = [_items(fixed[1 - side] + moving) for side in range(2)]
        curve = _curve(_scored(labelled, halves, ["anchor"]).withColumnRenamed("anchor", "level"))
        sums = fixed.sum(axis=0) + moving
        old, model = at_mean(model[0]), _items(sums)
        weight = sums[:, 0] * model[1]
        moved = float((np.abs(at_mean(model[0]) - old) * weight).sum() / max(weight.sum(), 1e-12))
        history.append((step, log_likelihood(sums, model), moved))
        _LOG.info("round %d: log-likelihood %.6f, mean move %.4f", *history[-1])
        if not len(curve[0]) or step == rounds or (step > 1 and moved < SETTLED):
            break
        moving = _other_sums(rest, model, curve)
    return Fit(docs, model, curve, history)


def levels(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_chars, level) of each document of running prose."""
    found = fit(documents, labels, rounds)
    return _on_curve(_scored(found.docs, [found.model], ["doc_id", "n_chars"]), found.curve).select("doc_id", "n_chars", "level")


def demanding(documents: DataFrame, labels: DataFrame, least: float = DEMANDING) -> DataFrame:
    """The doc_id of documents of running prose, LEAST_CHARACTERS or more, whose level rounds to 4 or more."""
    return levels(documents, labels).where((F.col("n_chars") >= LEAST_CHARACTERS) & (F.col("level") >= least)).select("doc_id").distinct()


def profile(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, lang, reading_level, documents, characters): the corpus by rounded level (null without one)."""
    found = levels(documents, labels).withColumn("reading_level", F.floor(F.col("level") + 0.5).cast("int")).groupBy("doc_id").agg(F.max("reading_level").alias("reading_level"))
    sizes = documents.select("doc_id", "source", "lang", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return sizes.join(found, "doc_id", "left").groupBy("source", "lang", "reading_level").agg(F.count("*").alias("documents"), F.sum("n").cast("long").alias("characters"))
