"""Same or near-same records across splits.

Records are folded into classes of texts that are equal but for formatting and the order of their words. A class is
the set of its shingles, the runs of RUN characters of its joined words, which slips, added words and other word
breaks change little. Minwise hashes of the shingles in BANDS bands of ROWS put classes into buckets. Partners must
share a positive sheet, and must ask for the same period, so a bucket also names a sheet and the text's digits in
sorted order, which no formatting changes; only classes from different sides of the split meet in it, a class with
copies on both sides with itself. Sheets and digits found on one side only are left out before any band is written.

The exact Jaccard similarity of the shingles decides: pairs below LEAST_JACCARD are dropped. At that similarity two
classes share a bucket with a chance of 1 - (1 - LEAST_JACCARD ** ROWS) ** BANDS = 0.996, above it with more. An exact
check of what the statement adds (`same_request`) follows: no month is exchanged, and after pairing words that
differ by a typing slip or an abbreviation at most MOST_WORDS words are left over on one side and MOST_REPLACED on
the other, among them no two neighbouring words that were replaced by two others (another place).

Records without text, split or positive sheets take no part; a record is on the train side if its split is `train`
in any case and spacing. Records delivered twice count once. Texts without letters or digits equal no other.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from gridloom.functions.text import clean_ids, strip
from gridloom.runtime import cut, merged, skew_join

BANDS, ROWS = 40, 4
#: Characters of a shingle, and the least Jaccard similarity of two texts' shingles.
RUN, LEAST_JACCARD = 3, 0.6
#: Words, of all of both texts, that two texts must share.
LEAST_SHARED = 0.5
MOST_WORDS, MOST_REPLACED = 6, 2
#: Records of a profile that a task expands at once; see `_expanded`.
BLOCK = 1000

# The months' names in four languages, without accents, each line a language.
MONTHS = [
    "january february march april may june july august september october november december".split(),
    "januar februar marz april mai juni juli august september oktober november dezember".split(),
    "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
]
_MONTH = {name: i for names in MONTHS for i, name in enumerate(names)}
_WORD = re.compile(r"[^\W_]+")
_DIGIT = re.compile("[0-9]")


def words_of(text: str) -> list[str]:
    """Lower-case words of letters and digits, in order."""
    return _WORD.findall(unicodedata.normalize("NFC", text).lower())


def _bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def month_of(word: str) -> int | None:
    """The number of the month that the word names or abbreviates (by three letters or more)."""
    bare = _bare(word)
    if bare in _MONTH:
        return _MONTH[bare]
    hits = {i for name, i in _MONTH.items() if len(bare) >= 3 and name.startswith(bare)}
    return hits.pop() if len(hits) == 1 else None


def slip(a: str, b: str) -> bool:
    """Whether two words differ by a typing slip: one letter left out, added, replaced, or two exchanged (two such
    slips in words of eight letters or more); or one is the beginning of the other, of three letters or more."""
    if a.startswith(b) or b.startswith(a):
        return min(len(a), len(b)) >= 3
    most = 2 if min(len(a), len(b)) >= 8 else 1
    if abs(len(a) - len(b)) > most or min(len(a), len(b)) < 2:
        return False
    older: list[int] = []
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            cost = min(old[j] + 1, now[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            now.append(cost)
        older, old = old, now
    return old[-1] <= most


def same_request(a: list[str], b: list[str]) -> bool:
    """Whether two texts, as words, are the same or almost the same request."""
    count_a, count_b = Counter(a), Counter(b)
    if count_a == count_b or "".join(a) == "".join(b):
        return True
    if any(map(_DIGIT.search, (count_a - count_b) + (count_b - count_a))):
        a, b = _glued(a, b)
        count_a, count_b = Counter(a), Counter(b)
    only_a, only_b = list((count_a - count_b).elements()), list((count_b - count_a).elements())
    if max(len(only_a), len(only_b)) > MOST_WORDS + 2 or any(map(_DIGIT.search, only_a + only_b)):
        return False
    shared = sum((count_a & count_b).values())
    months = [{m for w in only if (m := month_of(w)) is not None} for only in (only_a, only_b)]
    if months[0] and months[1] and months[0] != months[1]:
        return False
    for w in list(only_a):
        near = next((v for v in only_b if slip(w, v)), None)
        if near is not None:
            only_a.remove(w)
            only_b.remove(near)
            shared += 1
    if max(len(only_a), len(only_b)) > MOST_WORDS or min(len(only_a), len(only_b)) > MOST_REPLACED:
        return False
    if shared < LEAST_SHARED * (shared + len(only_a) + len(only_b)):
        return False
    return not (_neighbours(a, only_a) and _neighbours(b, only_b))


def _glued(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """Both texts with each run of words that holds digits and is written with other breaks in the other text joined
    to one word: `1 000` and `1000`, `2020 q3` and `2020q3`."""
    only_a, only_b = Counter(a) - Counter(b), Counter(b) - Counter(a)
    at: dict[str, list[int]] = {}
    for k, w in enumerate(b):
        at.setdefault(w[0], []).append(k)
    ends_a: dict[int, int] = {}
    ends_b: dict[int, int] = {}
    taken_b: set[int] = set()
    done = 0
    for i, w in enumerate(a):
        if i < done:
            continue
        for k in at.get(w[0], []):
            if k in taken_b or w == b[k] or not (w.startswith(b[k]) or b[k].startswith(w)):
                continue
            x, y, m, n = w, b[k], i + 1, k + 1
            while x != y and (x.startswith(y) or y.startswith(x)):
                if len(x) < len(y) and m < len(a):
                    x, m = x + a[m], m + 1
                elif len(y) < len(x) and n < len(b) and n not in taken_b:
                    y, n = y + b[n], n + 1
                else:
                    break
            if x == y and _DIGIT.search(x) and any(v in only_a for v in a[i:m]) and any(v in only_b for v in b[k:n]):
                ends_a[i], ends_b[k], done = m, n, m
                taken_b.update(range(k, n))
                break
    return _joined(a, ends_a), _joined(b, ends_b)


def _joined(words: list[str], ends: dict[int, int]) -> list[str]:
    out, i = [], 0
    while i < len(words):
        end = ends.get(i, i + 1)
        out.append("".join(words[i:end]))
        i = end
    return out


def _neighbours(words: list[str], some: list[str]) -> bool:
    """Whether two of `some` stand side by side in words."""
    wanted = set(some)
    return any(x in wanted and y in wanted for x, y in zip(words, words[1:]))


def shingles(words: list[str]) -> set[str]:
    """The runs of RUN characters of the joined words; a shorter text is one shingle."""
    text = "".join(words)
    return {text[i : i + RUN] for i in range(max(1, len(text) - RUN + 1))}


def jaccard(a: list[str], b: list[str]) -> float:
    """Exact Jaccard similarity of the shingles of two texts."""
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


_FOLDED = StructType([StructField("words", StringType()), StructField("form", BinaryType()), StructField("flat", BinaryType()), StructField("numbers", LongType())])


@F.pandas_udf(_FOLDED)
def _folded(texts: pd.Series) -> pd.DataFrame:
    """The words of each text, joined by blanks, and digests of them in any order, without blanks, and of the sorted
    digits."""
    rows = []
    for text in texts:
        words = words_of(text)
        flat = "".join(words)
        digits = "".join(sorted(_DIGIT.findall(flat)))
        rows.append((" ".join(words), md5(" ".join(sorted(words)).encode()).digest(), md5(flat.encode()).digest(), int.from_bytes(md5(digits.encode()).digest()[:8], "big", signed=True)))
    return pd.DataFrame(rows, columns=["words", "form", "flat", "numbers"])


def records(queries: DataFrame) -> DataFrame:
    """(query_index, train, split, source, sheets, words, form, flat, numbers) of each delivered record that takes
    part; words: those of words_of, joined by blanks; the last three are digests (see _folded)."""
    split = F.lower(strip(F.col("split")))
    usable = queries.where("query_index is not null and query is not null and split is not null").select(
        "query_index", (split == "train").alias("train"), split.alias("split"), "source", "query", F.array_distinct(clean_ids(F.coalesce("positive_sheet_ids", "sheet_ids"))).alias("sheets")
    )
    folded = usable.where("size(sheets) > 0").withColumn("folded", _folded("query"))
    return folded.where("folded.words <> ''").select("query_index", "train", "split", "source", "sheets", "folded.*")


def _hash_words(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def signatures(texts: DataFrame, bands: int = BANDS, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """(class_id, band hashes) of each class of texts, from minwise hashes of its shingles."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    mixers = rng.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held = [list(shingles(w.split(" "))) for w in pdf["words"]]
            starts = np.cumsum([0, *map(len, held)])[:-1]
            hashes = _hash_words([s for x in held for s in x])
            least = np.empty((len(held), bands * rows), np.uint64)
            for i in range(bands * rows):
                mixed = hashes * factors[i] + shifts[i]
                least[:, i] = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(29)), starts)
            banded = least.reshape(len(held), bands, rows)
            keys = np.zeros((len(held), bands), np.uint64)
            for r in range(rows):
                keys = (keys ^ banded[:, :, r]) * mixers[r]
                keys ^= keys >> np.uint64(31)
            keys += np.arange(bands, dtype=np.uint64)
            yield pd.DataFrame({"class_id": pdf["class_id"], "bands": list(keys.view(np.int64))})

    return texts.select("class_id", "words").mapInPandas(run, "class_id binary, bands array<long>")


def verified(pairs: DataFrame, least: float = LEAST_JACCARD) -> DataFrame:
    """The pairs (with words_a and words_b) whose exact Jaccard similarity reaches `least` and that ask for the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = [[w.split(" ") for w in pdf.pop(c)] for c in ("words_a", "words_b")]
            pdf["jaccard"] = [jaccard(x, y) for x, y in zip(a, b)]
            yield pdf[[s >= least and same_request(x, y) for s, x, y in zip(pdf["jaccard"], a, b)]]

    return pairs.mapInPandas(run, "class_a binary, class_b binary, jaccard double")


@dataclass
class Classed:
    """members: (query_index, train, split, source, sheets, numbers, class_id) of the records that take part;
    texts: (class_id, words) of each text of a class, of those in the same words one, apart from them, as most steps
    need no words."""

    members: DataFrame
    texts: DataFrame


def classed(queries: DataFrame) -> Classed:
    """The records, with class_id equal for texts that are equal but for formatting or the order of words, and numbers,
    a digest of the sorted digits. Texts with the same words have one form; forms that share the same letters and
    digits in the same order are one class."""
    full = cut(records(queries))
    labels = merged(full.select("form", "flat").distinct(), "form", "flat")
    full = cut(skew_join(full.drop("flat"), labels, "form", "left").withColumn("class_id", F.coalesce("label", "form")).drop("label"))
    return Classed(cut(full.drop("words", "form")), cut(full.groupBy("class_id", "form").agg(F.min("words").alias("words")).drop("form")))


def candidates(recs: Classed) -> DataFrame:
    """(class_a, class_b): the pairs of classes, a on the train side and b on the other, that share a bucket; a class
    with records on both sides of a sheet is paired with itself. Cut from its lineage."""
    at = recs.members.select("class_id", "train", F.explode("sheets").alias("sheet"), "numbers").select("class_id", "train", F.xxhash64("sheet", "numbers").alias("place")).distinct()
    sides = at.groupBy("place").agg(F.bool_or("train").alias("a"), F.bool_or(~F.col("train")).alias("b")).where("a and b").select("place")
    at = cut(skew_join(at, sides, "place"))
    signed = signatures(recs.texts.join(at.select("class_id").distinct(), "class_id", "left_semi"))
    keyed = at.join(signed, "class_id").select("class_id", "train", F.explode(F.transform("bands", lambda b: F.xxhash64(b, "place"))).alias("bucket"))
    train = keyed.where("train").select("bucket", F.col("class_id").alias("class_a"))
    other = keyed.where("not train").select("bucket", F.col("class_id").alias("class_b"))
    return cut(train.join(other, "bucket").select("class_a", "class_b").distinct())


def class_pairs(recs: Classed) -> DataFrame:
    """(class_a, class_b, jaccard): the candidates that are similar enough and ask for the same; a class is to itself."""
    met = candidates(recs)
    itself, others = met.where("class_a = class_b").withColumn("jaccard", F.lit(1.0)), met.where("class_a <> class_b")
    words_a, words_b = (recs.texts.select(F.col("class_id").alias(f"class_{x}"), F.col("words").alias(f"words_{x}")) for x in "ab")
    passed = verified(others.join(words_a, "class_a").join(words_b, "class_b").select("class_a", "class_b", "words_a", "words_b"))
    return passed.groupBy("class_a", "class_b").agg(F.max("jaccard").alias("jaccard")).unionByName(itself)


@dataclass
class Linked:
    """members: (query_index, profile) of the records of linked classes, one row each; profiles: (profile, n, first),
    the number of records of each profile and the first of them; links: (profile_a, profile_b, jaccard), the pairs of
    profiles, a on the train side, whose records overlap."""

    members: DataFrame
    profiles: DataFrame
    links: DataFrame


def linked(recs: Classed) -> Linked:
    """Records with the same text, side and sheets are one profile: they overlap with the same records. So classes are
    expanded to pairs of profiles, of which exact copies make one, however many they are."""
    pairs = cut(class_pairs(recs))
    classes = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).distinct()
    mine = skew_join(recs.members.select("query_index", "class_id", "train", F.array_sort("sheets").alias("sheets")), classes, "class_id")
    held = mine.groupBy("query_index").agg(F.array_sort(F.collect_set(F.struct("class_id", "train", "sheets"))).alias("held"))
    full = cut(held.withColumn("profile", F.unhex(F.md5(F.to_json("held")))))
    profiles = cut(full.groupBy("profile").agg(F.count("*").alias("n"), F.min("query_index").alias("first"), F.min("held").alias("held")))
    places = profiles.select("profile", F.inline("held")).select("profile", "class_id", "train", F.explode("sheets").alias("sheet")).distinct()
    train = places.where("train").select(F.col("profile").alias("profile_a"), F.col("class_id").alias("class_a"), "sheet")
    other = places.where("not train").select(F.col("profile").alias("profile_b"), F.col("class_id").alias("class_b"), "sheet")
    links = pairs.join(train, "class_a").join(other, ["class_b", "sheet"]).groupBy("profile_a", "profile_b").agg(F.max("jaccard").alias("jaccard"))
    return Linked(full.select("query_index", "profile"), profiles.drop("held"), cut(links))


def _expanded(links: DataFrame, a: DataFrame, b: DataFrame, profiles: DataFrame) -> DataFrame:
    """(train_index, other_index, jaccard): each record of profile_a in a with each of profile_b in b. Profiles are met
    in blocks of about BLOCK records, so that no task holds a huge one."""
    blocks = profiles.select("profile", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = links.select("profile_a", "profile_b", "jaccard")
    sides = []
    for side, mine, index in (("a", a, "train_index"), ("b", b, "other_index")):
        number = blocks.withColumnRenamed("profile", f"profile_{side}")
        met = met.join(number, f"profile_{side}").withColumn(f"block_{side}", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        place = F.pmod(F.xxhash64("query_index"), F.col("blocks")).cast("int").alias(f"block_{side}")
        sides.append(skew_join(mine, blocks, "profile").select(F.col("profile").alias(f"profile_{side}"), place, F.col("query_index").alias(index)))
    return met.join(sides[0], ["profile_a", "block_a"]).join(sides[1], ["profile_b", "block_b"]).select("train_index", "other_index", "jaccard")


def overlaps(recs: Classed) -> DataFrame:
    """(train_index, other_index, jaccard): all pairs of records across the split that share a positive sheet and are
    the same or almost the same."""
    found = linked(recs)
    return _expanded(found.links, found.members, found.members, found.profiles).where("train_index <> other_index")


def report(recs: Classed) -> DataFrame:
    """(split, source, records, overlapping, pairs): per split and source of the records outside train, how many there
    are, how many overlap with train, and in how many pairs. Pairs are counted by the sizes of profiles, not listed."""
    found = linked(recs)
    sizes = found.profiles.select(F.col("profile").alias("profile_a"), "n")
    itself = F.when(F.col("profile_a") == F.col("profile_b"), 1).otherwise(0)
    per_profile = found.links.join(sizes, "profile_a").groupBy(F.col("profile_b").alias("profile")).agg(F.sum(F.col("n") - itself).alias("links")).where("links > 0")
    links = skew_join(found.members, per_profile, "profile").select("query_index", "links")
    mine = recs.members.where("not train").groupBy("query_index").agg(F.min("split").alias("split"), F.min("source").alias("source"))
    return (
        mine.join(links, "query_index", "left")
        .groupBy("split", "source")
        .agg(F.count("*").alias("records"), F.count("links").alias("overlapping"), F.coalesce(F.sum("links"), F.lit(0)).alias("pairs"))
    )
