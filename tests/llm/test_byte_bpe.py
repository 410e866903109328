"""Operator 12 against the tiktoken library."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
import tiktoken

from labelwise.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})


def texts():
    rnd = random.Random(5)
    alphabet = " '  \n\tstremvldaé1२Ⅷ!?-中文字😀‍́　\x85ÇxyzAก\U0002a6df"
    rows = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    rows += ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 300))) for _ in range(300)]
    rows += [None, "", " ", "'s", "''s", " 's", "x'll'd're", "   a", "\n a", "a \n", "'re", "'r", "'rex", "a'", "<|endoftext|>"]
    rows += ["a" * k for k in range(300, 330)] + ["ab" * k for k in range(60, 140, 7)] + [" " * k for k in range(200)] + ["=" * k + "x" for k in range(150)]
    rows += ["-" * 20_000, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "the" * 5000,
             "".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(5000))]
    return rows


def test_equals_the_library(table, library):
    rows = [(i, t, "en") for i, t in enumerate(texts())]
    rows += rows[:20]
    got = byte_bpe.token_digests(table(rows, "doc_id long, text string, lang string"), PATH).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {(k, *v) for k, v in want.items()}


def test_ids_and_round_trip(table, library):
    rows = [(i, t, None) for i, t in enumerate(texts()[::7])]
    coded = byte_bpe.encode(table(rows, "id long, text string, `t` string"), PATH)
    assert {r.id: r.ids for r in coded.collect()} == {i: library.encode_ordinary(t or "") for i, t, _ in rows}
    back = byte_bpe.decode(coded, PATH)
    assert {r.id: bytes(r.bytes).decode() for r in back.collect()} == {i: t or "" for i, t, _ in rows}


def test_every_step_bound_gives_the_same(monkeypatch, table, library):
    monkeypatch.setattr(byte_bpe, "STATE_ROWS", 1)
    monkeypatch.setattr(byte_bpe, "QUERY_BYTES", 1)
    monkeypatch.setattr(byte_bpe, "KNOWN_BYTES", 40)
    rows = [(i, t) for i, t in enumerate(texts()[:60])]
    coded = byte_bpe.encode(table(rows, "id long, text string", files=1), PATH)
    assert {r.id: r.ids for r in coded.collect()} == {i: library.encode_ordinary(t or "") for i, t in rows}


def test_empty_table_bad_bytes_and_clashing_names(spark, table, library):
    assert byte_bpe.token_digests(table([], "doc_id long, text string"), PATH).count() == 0
    bad = spark.sql("SELECT 1L AS doc_id, CAST(X'6162FF63' AS STRING) AS text")
    assert byte_bpe.encode(bad, PATH).first().ids == library.encode_ordinary("ab�c")
    with pytest.raises(ValueError, match="made twice"):
        byte_bpe.encode(spark.sql("SELECT 'a' AS text, 1 AS IDS"), PATH)
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.sql("SELECT array(1, 999999) AS ids"), PATH).collect()
