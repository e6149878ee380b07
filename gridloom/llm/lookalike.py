"""Text that looks the same, in one plain form.

Words that hold full-width or letter-like forms, accents stored apart, invisible characters, ligatures, or letters of
several scripts are looked up in the vocabulary of plain words: a trie of it is walked by a weighted edit automaton,
in which look-alikes and invisible characters cost nothing, a look-alike of the other case (small capitals) NEARLY,
and any other edit 1. Of the plain words reached within BUDGET, one in the word's own script with the least cost,
and of these the most frequent, is its canonical spelling; a word is odd if that spelling is another word. Only
words that reach none are normalised by the table of look-alikes of three scripts. The automaton knows more
look-alikes than the table: those in ligatures, circled letters and rarer scripts stand for other letters only if
the vocabulary has the word that they then spell. Between words, blanks, hyphens and full-width signs become the
ordinary ones.

All words that a word can reach within the budget have its skeleton but for letter case, so tries are built per
bucket of skeletons, from the plain words only that share a skeleton with some other word. Each distinct value is
treated once, however many rows hold it, and met again by a skew-aware join.

Null values have no plain form and are left out of results; blank ones are plain. Words wholly in one script stay as
they are, as do raised digits and numerals that stand alone. A letter of another script without a look-alike stays.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import cut, skew_join

# Letters of three scripts that look alike; in each group Latin, Cyrillic, Greek ("." for none).
ALIKE = """
AАΑ BВΒ CС. EЕΕ HНΗ IІΙ JЈ. KКΚ MМΜ N.Ν OОΟ PРΡ QԚ. SЅ. TТΤ WԜ. XХΧ Y.Υ YУ. YҮ. Z.Ζ .ПΠ .ГΓ .ФΦ .ЛΛ
aаα cс. dԁ. eе. hһ. iіι jј. k.κ kк. lӏ. n.η oоο pрρ qԛ. sѕ. u.υ v.ν vѵ. wԝ. w.ω xхχ yуγ .пπ .фφ .тτ
ËЁ. ëё. ÏЇΪ ïїϊ Ó.Ό ó.ό Á.Ά á.ά É.Έ í.ί Í.Ί Ý.Ύ ú.ύ Ή.Ή
""".split()
# Letters of the same script that look like plain ones.
SAME = {"ɑ": "a", "ɡ": "g", "ɩ": "i", "ɪ": "I", "ʏ": "Y", "ᴀ": "A", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ʜ": "H", "ʟ": "L", "ɴ": "N", "ʀ": "R", "ϲ": "σ", "ϳ": "j"}
# Hyphens other than the ordinary one.
HYPHENS = "‐‑‒⁃−﹣－˗"
# Invisible characters beside the format and control characters.
INVISIBLE = "͏ᅟᅠㅤﾠ឴឵" + "".join(map(chr, range(0xFE00, 0xFE10)))
# Letters of rarer scripts that look like Latin ones, each before the letter it looks like.
RARE = {
    "ARMENIAN": "ՍU ՏS ՕO ցg զq հh ոn ռn սu օo",
    "CHEROKEE": "ᎠD ᎡR ᎢT ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᏀG ᏃZ ᏒR ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB",
    "LISU": "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU",
}
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")
#: What the automaton may spend on a word, and what a look-alike of the other case costs; any other edit costs 1.
BUDGET, NEARLY = 0.5, 0.5


def _tables() -> tuple[dict[str, dict[str, str]], dict[str, str]]:
    """The look-alike of a letter in each script; the skeleton of a letter."""
    to: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
    bone: dict[str, str] = {}
    for group in ALIKE:
        group = unicodedata.normalize("NFC", group)
        there = [(s, c) for s, c in zip(SCRIPTS, group) if c != "."]
        for s, c in there:
            for other, d in there:
                if other != s:
                    to[s].setdefault(d, c)
        first = next((bone[c] for _, c in there if c in bone), there[0][1])
        for _, c in there:
            bone.setdefault(c, first)
    for c, plain in SAME.items():
        bone[c] = bone.get(plain, plain)
    return to, bone


TO, BONE = _tables()
_RARE = {pair[0]: pair[1] for pairs in RARE.values() for pair in pairs.split()}
_LETTER_LIKE = re.compile("[℀-⅏Ⅰ-ↈ\U0001d400-\U0001d7ff]")
_ODD = re.compile(r"[^\x00-\x7f]")


def invisible(c: str) -> bool:
    return (unicodedata.category(c) in ("Cf", "Cc") and c not in "\t\n\r\x0b\x0c\x85") or c in INVISIBLE


def odd_blank(c: str) -> bool:
    return (unicodedata.category(c) in ("Zs", "Zl", "Zp") and c != " ") or c == "\x85"


def wide(c: str) -> str:
    """The ordinary form of a full-width character, else the character."""
    return chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else unicodedata.normalize("NFKC", c) if "￠" <= c <= "￦" else c


def letter_like(c: str) -> str:
    """The letter that a letter-like sign stands for, else the character."""
    if _LETTER_LIKE.match(c):
        plain = unicodedata.normalize("NFKC", c)
        return plain if len(plain) == 1 and plain.isalpha() else c
    return c


def joined_letters(c: str) -> str:
    """The letters that a ligature, a circled letter or a letter of a rarer script looks like; empty for others."""
    if c in _RARE:
        return _RARE[c]
    return unicodedata.normalize("NFKC", c) if "\ufb00" <= c <= "\ufb06" or "\u24b6" <= c <= "\u24e9" else ""


def _script(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0]


@lru_cache(100_000)
def _part_of_word(c: str) -> bool:
    return unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nl" or letter_like(c) != c or invisible(c) or joined_letters(c) != ""


def _words(value: str) -> list[tuple[bool, str]]:
    """The value as runs of (is a word, text). A run of invisible characters alone counts as part of a word."""
    runs: list[tuple[bool, str]] = []
    at = 0
    for i in range(1, len(value) + 1):
        if i == len(value) or _part_of_word(value[i]) != _part_of_word(value[at]):
            runs.append((_part_of_word(value[at]), value[at:i]))
            at = i
    return runs


def _units(word: str) -> list[str]:
    """The word's visible characters, in ordinary width, each with the accents stored behind it."""
    text = unicodedata.normalize("NFC", "".join(wide(c) for c in word if not invisible(c)))
    units: list[str] = []
    for c in text:
        if units and unicodedata.combining(c):
            units[-1] += c
        else:
            units.append(c)
    return units


def _script_of(units: list[str]) -> str:
    """The script of a word: of the letters that look like none of another script in it, else of most of its
    letters; where both leave it open, the first of SCRIPTS."""
    letters = [unicodedata.normalize("NFC", u)[0] for u in units]
    letters = [SAME.get(letter_like(c), letter_like(c)) for c in letters]
    scripts = [(c, s) for c in letters if (s := _script(c)) in SCRIPTS]
    all_ = Counter(s for _, s in scripts)
    sure = Counter(s for c, s in scripts if not any(c in TO[o] for o in all_ if o != s))
    return max(sure or all_, key=lambda s: ((sure or all_)[s], all_[s], -SCRIPTS.index(s)), default="LATIN")


def by_table(word: str) -> str:
    """The word in plain form without a vocabulary."""
    units = _units(word)
    if units and all(_LETTER_LIKE.match(u) for u in units):
        return "".join(units)  # a numeral that stands alone
    script = _script_of(units)
    plain = []
    for u in units:
        c = unicodedata.normalize("NFC", u)
        c = letter_like(c) if len(c) == 1 else c
        c = SAME.get(c, c)
        if len(c) > 1:
            c = TO[script].get(c[0], c[0]) + c[1:]
        plain.append(TO[script].get(c, c))
    return unicodedata.normalize("NFC", "".join(plain))


@lru_cache(100_000)
def _bones(word: str) -> tuple[tuple[str, bool], ...]:
    """What each visible character of the word looks like, and whether it only looks like that; a ligature gives
    several."""
    found: list[tuple[str, bool]] = []
    for u in _units(word):
        c = unicodedata.normalize("NFC", u)
        for x in joined_letters(c) or [letter_like(c)]:
            bone = BONE.get(x, x)
            found.append((bone, bone != c))
    return tuple(found)


@lru_cache(100_000)
def skeleton(word: str) -> str:
    """Equal for all words that look alike."""
    return "".join(bone for bone, _ in _bones(word))


@lru_cache(100_000)
def is_plain(word: str) -> bool:
    """Whether nothing about the word is odd: then it belongs to the vocabulary and isn't looked up."""
    if word.isascii():
        return True
    scripts = {s for c in word if (s := _script(c)) in SCRIPTS or s in RARE}
    return len(scripts) <= 1 and not any("\ufb00" <= c <= "\ufb06" or "\u24b6" <= c <= "\u24e9" for c in word) and by_table(word) == word


def _trie(words: Iterator[tuple[str, int]]) -> dict:
    root: dict = {}
    for word, n in words:
        node = root
        for u in _units(word):
            node = node.setdefault(u, {})
        node[""] = (word, n)
    return root


def reached(trie: dict, word: str, budget: float = 0) -> list[tuple[float, str, int]]:
    """(cost, plain word, its count) of every word of the trie that the automaton reaches within the budget."""
    bones = _bones(word)
    found: dict[str, tuple[float, str, int]] = {}
    todo: list[tuple[dict, int, float]] = [(trie, 0, 0)]
    while todo:
        node, i, cost = todo.pop()
        if i == len(bones) and "" in node:
            plain, n = node[""]
            if plain not in found or found[plain][0] > cost:
                found[plain] = (cost, plain, n)
        bone, alike = bones[i] if i < len(bones) else (None, False)
        for step, child in node.items():
            if step == "":
                continue
            if bone is not None:
                other = skeleton(step)
                price = 0 if other == bone else NEARLY if alike and other.lower() == bone.lower() else 1
                if cost + price <= budget:
                    todo.append((child, i + 1, cost + price))
            if cost + 1 <= budget:
                todo.append((child, i, cost + 1))
        if bone is not None and cost + 1 <= budget:
            todo.append((node, i + 1, cost + 1))
    return list(found.values())


def spelled(trie: dict, word: str, budget: float = BUDGET) -> str:
    """The canonical spelling of a word: of the plain words reached in its script the one of least cost, then the
    most frequent; by the table only if none is reached."""
    script = _script_of(_units(word))
    hits = [(cost, -n, plain) for cost, plain, n in reached(trie, word, budget) if _script_of(_units(plain)) == script]
    return min(hits)[2] if hits else by_table(word)


def _between(text: str) -> str:
    """Blanks, hyphens and full-width signs in their ordinary form."""
    return "".join(" " if odd_blank(c) else "-" if c in HYPHENS else wide(c) for c in text if not invisible(c))


def _word_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for value, n in zip(pdf["value"], pdf["n"]):
            for is_word, text in _words(value):
                if is_word:
                    rows.append((text, n, is_plain(text), skeleton(text).lower()))
        yield pd.DataFrame(rows, columns=["word", "n", "plain", "skeleton"])


def _ascii_words(values: DataFrame) -> DataFrame:
    """The words of values in ASCII, found without leaving the JVM; their skeletons too."""
    source = "".join(c for c in BONE if c.isascii())
    target = "".join(BONE[c] for c in source)
    words = values.select(F.explode(F.split("value", "[^A-Za-z]+")).alias("word"), "n").where("word <> ''")
    return words.select("word", "n", F.lit(True).alias("plain"), F.lower(F.translate("word", source, target)).alias("skeleton"))


def _spellings(pdf: pd.DataFrame) -> pd.DataFrame:
    plain = pdf[pdf["plain"]]
    trie = _trie(zip(plain["word"], plain["n"]))
    odd = pdf.loc[~pdf["plain"], "word"]
    return pd.DataFrame({"word": odd, "spelling": [spelled(trie, w) for w in odd]})


def _composed(pdf_iter: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdf_iter:
        out = []
        for value, words, spellings in zip(pdf["value"], pdf["words"], pdf["spellings"]):
            known = dict(zip(words, spellings))
            out.append("".join(known.get(t, t) if is_word else _between(t) for is_word, t in _words(value)))
        yield pd.DataFrame({"value": pdf["value"], "plain_form": out})


def plain_values(values: DataFrame, words_per_trie: int = 20_000) -> DataFrame:
    """(value, plain_form) of each distinct value with a character beyond ASCII. values: (value, n), distinct."""
    odd = values.where(F.col("value").rlike(r"[^\x00-\x7f]"))
    words = (
        _ascii_words(values.where(~F.col("value").rlike(r"[^\x00-\x7f]")))
        .unionByName(odd.mapInPandas(_word_rows, "word string, n long, plain boolean, skeleton string"))
        .groupBy("word", "plain", "skeleton")
        .agg(F.sum("n").alias("n"))
    )
    words = cut(words)
    buckets = max(16, words.where("not plain").count() // words_per_trie)
    asked = words.where("not plain").select("skeleton").distinct()
    spellings = (
        words.join(asked, "skeleton", "left_semi")
        .withColumn("bucket", F.pmod(F.xxhash64("skeleton"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandas(_spellings, "word string, spelling string")
    )
    holds = cut(odd.select("value", "n").mapInPandas(_value_words, "value string, word string"))
    with_words = skew_join(holds.where("word is not null"), spellings, "word").groupBy("value").agg(F.collect_list("word").alias("words"), F.collect_list("spelling").alias("spellings"))
    full = odd.select("value").join(with_words, "value", "left").select("value", F.coalesce("words", F.array().cast("array<string>")).alias("words"), F.coalesce("spellings", F.array().cast("array<string>")).alias("spellings"))
    return full.mapInPandas(_composed, "value string, plain_form string")


def _value_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(v, t) for v in pdf["value"] for t in {t for is_word, t in _words(v) if is_word and not is_plain(t)}]
        yield pd.DataFrame(rows, columns=["value", "word"])


def sheet_names(sheets: DataFrame) -> DataFrame:
    """(sheet_id, col_pos, value): the sheet names (col_pos -1) and column names that aren't null."""
    names = sheets.select("sheet_id", F.lit(-1).alias("col_pos"), F.col("name").alias("value"))
    columns = sheets.select("sheet_id", F.posexplode("columns").alias("col_pos", "c")).select("sheet_id", "col_pos", F.col("c.name").alias("value"))
    return names.unionByName(columns).where("value is not null")


def plain_names(names: DataFrame) -> DataFrame:
    """names with plain_form. names: any columns and value."""
    values = cut(names.groupBy("value").agg(F.count("*").alias("n")))
    odd = F.col("value").rlike(r"[^\x00-\x7f]")
    forms = cut(plain_values(values))
    return names.where(~odd).withColumn("plain_form", F.col("value")).unionByName(skew_join(names.where(odd), forms, "value").select(*names.columns, "plain_form"))


def odd_names(names: DataFrame) -> DataFrame:
    """The distinct names that aren't in plain form, with value and plain_form."""
    odd = names.where(F.col("value").rlike(r"[^\x00-\x7f]"))
    forms = cut(plain_values(cut(names.groupBy("value").agg(F.count("*").alias("n")))).where("value <> plain_form"))
    return skew_join(odd, forms, "value").distinct()
