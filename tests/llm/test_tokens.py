import os
import random

import numpy as np
import pytest

from gridloom.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.rank_file()), reason="no vocabulary here")
SCHEMA = "doc_id long, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=tokens.read_ranks(tokens.rank_file()), special_tokens={})


def texts():
    rng = random.Random(0)
    alphabet = list("abc XYZ  \n\t\r0123.,'\"-_") + ["é", "é", "中文", "🙂", " ", "　", "​", "\x1c", "\x85", "ß", "²", "'s", "'LL", "<|endoftext|>", "\0", " ", "Ⅷ"]
    return [None, "", " ", "  \n ", "a" * 20_000, "中" * 5_000, " " * 3_000, *("".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(500))]


def test_ids_match_a_public_implementation(spark, reference):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())] + [(None, "null id", "x", "y"), (0, "twice", "x", "y")]
    got = tokens.encoded(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by_id = {(r.doc_id, tuple(r.ids)) for r in got}
    assert by_id == {(i, tuple(reference.encode_ordinary(t) if t else [])) for i, t, *_ in rows}
    counts = tokens.counted(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in counts) == sorted((i or -1, len(ids)) for i, ids in by_id)


def test_round_trip(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())]
    back = {r.doc_id: r.text for r in tokens.decoded(tokens.encoded(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert back == {i: t or "" for i, t, *_ in rows}


def test_a_full_memory_starts_afresh(monkeypatch, reference):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    enc = tokens.Encoder(tokens.rank_file())
    for t in texts()[7:200]:
        ids, ends = enc.encode_flat([t, None])
        assert ids.tolist() == reference.encode_ordinary(t) and ends.tolist() == [0, len(ids), len(ids)]
    assert len(enc.known) < 200


def test_a_vocabulary_must_be_whole(tmp_path):
    path = tmp_path / "v.tiktoken"
    path.write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        tokens.Encoder(str(path))


def test_empty(spark):
    assert tokens.encoded(spark.createDataFrame([], SCHEMA)).count() == 0
    assert tokens.Encoder(tokens.rank_file()).encode_flat([])[0].dtype == np.int32
