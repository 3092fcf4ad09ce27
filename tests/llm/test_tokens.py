import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import tokens as K

VOCABULARY = K.VOCABULARY


@pytest.fixture(scope="module")
def mine():
    return K.encoder(*K.load(VOCABULARY))


@pytest.fixture(scope="module")
def theirs():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact(mine):
    name, h = K.load(VOCABULARY)
    assert len(h.slots) == h.n == len(set(h.values)) and None not in h.slots
    assert all(h.get(s) == v for s, v in zip(h.slots, h.values))
    assert h.get(b"no such entry at all") == h.get(b"") == -1
    tiny = K.PerfectHash({b"x": 3})
    assert (tiny.get(b"x"), tiny.get(b"y")) == (3, -1)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_same_as_the_public_encoder(mine, theirs, text):
    assert mine.encode(text) == theirs.encode_ordinary(text)


def test_odd_texts(mine, theirs):
    rnd = random.Random(1)
    for t in ["<|endoftext|> a", " " * 50 + "x", "\r\n\t\x1c\x85 　", "a" * 3000, "這是很長的一段沒有空格的文字" * 60, "".join(chr(rnd.randrange(0x20, 0xD7FF)) for _ in range(500))]:
        assert mine.encode(t) == theirs.encode_ordinary(t)


def test_column(spark, theirs):
    rows = [(1, "Hello <|endoftext|>", "x"), (2, None, "x"), (3, "", "x"), (None, "ok", "x"), (1, "Hello <|endoftext|>", "x"), (4, "long " * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in K.encode(df).collect()), key=str)
    assert got == sorted(((i, theirs.encode_ordinary(t) if t else []) for i, t, _ in rows), key=str)
    assert K.encode(df.where("false")).count() == 0


def test_round_trip(mine, small, spark):
    _, h = K.load(VOCABULARY)
    back = dict(zip(h.values, h.slots))
    for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect():
        assert b"".join(back[i] for i in mine.encode(r.text)).decode() == (r.text or "")


def test_slices():
    assert list(K.slices(["aa", None, "bbbb", "", "c"], 4)) == [(0, 2), (2, 4), (4, 5)]
    assert list(K.slices([])) == []
