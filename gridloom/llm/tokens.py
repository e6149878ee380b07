"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

The vocabulary's ranks are written, byte by byte, as a sentencepiece BPE model: each byte becomes one character, each
token the piece of its bytes' characters, scored by its negative rank, with identity normalisation. sentencepiece
merges the pair of the highest score first, leftmost first, which is the pair of the lowest rank. Texts are split
into pre-tokens; pre-tokens not met before are encoded in batches and remembered. A piece's index is its rank, so
the model's ids are the token ids; decoding maps them back to their bytes.

Null and empty texts have an empty list of ids; blank texts have the ids of their blanks. Texts of any length are
encoded whole. A string that looks like a special token is ordinary text.
"""

from __future__ import annotations

import base64
import os
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Folder of the public vocabulary files; GRIDLOOM_TOKENIZERS overrides it.
TOKENIZERS = os.environ.get("GRIDLOOM_TOKENIZERS", "/opt/tokenizers")
#: Pre-tokens that one worker remembers before it starts afresh, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes | int | float) -> bytes:
    if isinstance(payload, bytes):
        return _varint(number << 3 | 2) + _varint(len(payload)) + payload
    if isinstance(payload, float):
        return _varint(number << 3 | 5) + struct.pack("<f", payload)
    return _varint(number << 3) + _varint(payload)


#: The character of each byte: letters that no step treats specially.
CHARS = [chr(0x4E00 + b) for b in range(256)]
_CHAR_OF = {b: c for b, c in enumerate(CHARS)}


def as_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_CHAR_OF)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model file with the tokens as pieces, in rank order, and one unknown piece behind them."""
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, as_chars(t).encode()) + _field(2, float(-r)) + _field(3, normal) for t, r in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(ranks))
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, identity)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _char_class(categories: str) -> str:
    """The characters whose category begins with one of the letters, as ranges of a character class."""
    ranges: list[list[int]] = []
    for i in range(sys.maxunicode + 1):
        if unicodedata.category(chr(i))[0] in categories:
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


# The characters with the White_Space property.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def pre_token_pattern(letters: str, numbers: str, space: str = _SPACE) -> str:
    """Contractions, then runs of letters, numbers or signs with a blank before them, then white space (its last
    blank goes with what follows)."""
    return rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"


class Encoder:
    """Ids of texts, by the vocabulary of a rank file."""

    def __init__(self, path: str):
        import sentencepiece

        ranks = read_ranks(path)
        if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError(f"{path} must rank all bytes and leave no rank out")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.bytes_of = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.split_ascii = re.compile(pre_token_pattern("A-Za-z", "0-9", r"\t-\r ")).findall
        self.split_any = re.compile(pre_token_pattern(_char_class("L"), _char_class("N"))).findall
        self.known: dict[str, list[int]] = {}

    def pre_tokens(self, text: str) -> list[str]:
        return (self.split_ascii if text.isascii() else self.split_any)(text)

    def _learn(self, words: list[list[str]]) -> dict[str, list[int]]:
        """The ids of all pre-tokens of the words; keeps the short ones for later texts."""
        missing = list(set(chain.from_iterable(words)).difference(self.known))
        ids = self.model.encode([as_chars(w.encode()) for w in missing], out_type=int, num_threads=1) if missing else []
        if len(self.known) + len(missing) > REMEMBERED:
            self.known = {}
            missing = list(set(chain.from_iterable(words)))
            ids = self.model.encode([as_chars(w.encode()) for w in missing], out_type=int, num_threads=1)
        self.known.update((w, i) for w, i in zip(missing, ids) if len(w) <= LONGEST)
        return {**self.known, **dict(zip(missing, ids))} if any(len(w) > LONGEST for w in missing) else self.known

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text begins and the last one ends)."""
        words = [self.pre_tokens(t) if t else [] for t in texts]
        known = self._learn(words)
        parts = [np.fromiter(chain.from_iterable(map(known.__getitem__, w)), np.int32) for w in words]
        ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
        return (np.concatenate(parts) if parts else np.empty(0, np.int32)), ends

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        words = [self.pre_tokens(t) if t else [] for t in texts]
        known = self._learn(words)
        size = {w: len(known[w]) for w in set(chain.from_iterable(words))}
        return np.array([sum(map(size.__getitem__, w)) for w in words], np.int64)

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", errors="replace")


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)


def rank_file(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.tiktoken"


def _slices(column: pa.ChunkedArray | pa.Array, characters: int = 4_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of runs of rows with about so many bytes in all; a longer text is a run of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    run = np.cumsum(sizes) // characters
    starts = [0, *(np.flatnonzero(np.diff(run)) + 1), len(column)]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            yield int(a), column.slice(a, b - a).to_pylist()


def encoded(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """keep and ids of each document."""
    path = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for first, texts in _slices(batch.column(len(keep))):
                ids, ends = enc.encode_flat(texts)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, len(texts)) for i in range(len(keep))), lists], [*keep, "ids"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema]
    return documents.select(*keep, text).mapInArrow(run, ", ".join([*fields, "ids array<int>"]))


def counted(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """keep and n_tokens of each document."""
    path = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            sizes = [enc.count(texts) for _, texts in _slices(batch.column(len(keep)))]
            total = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(total)], [*keep, "n_tokens"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema]
    return documents.select(*keep, text).mapInArrow(run, ", ".join([*fields, "n_tokens bigint"]))


def decoded(ids: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """keep and text of each list of ids; null lists give null."""
    path = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [None if x is None else enc.decode(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], [*keep, "text"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ids.select(*keep).schema]
    return ids.select(*keep, "ids").mapInArrow(run, ", ".join([*fields, "text string"]))
