import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scrivener.llm import bpe
from scrivener.llm.tokens import DEFAULT_VOCABULARY, count_column, encode_column

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(DEFAULT_VOCABULARY)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(DEFAULT_VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts, v):
    ids, size = bpe.encode(texts, v)
    ends = np.cumsum(size)
    return [ids[e - n : e].tolist() for e, n in zip(ends, size)]


HARD = ["", " ", "\n \n", "'s", "it's '' 's\n's x'll've", "aaaa" * 500, "a" * 7, "\x1c\x85b　 c ", "½²³ Ⅷ ١٢ é\0x\0", "<|endoftext|>", "日本語。 中文", "é", "😀👍🏽"]


def test_hard_texts(vocabulary, reference):
    assert encode(HARD, vocabulary) == [reference.encode_ordinary(t) for t in HARD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn", "Co"]), max_size=40), max_size=8))
def test_any_text(vocabulary, reference, texts):
    assert encode(texts, vocabulary) == [reference.encode_ordinary(t) for t in texts]
    assert bpe.count(texts, vocabulary).tolist() == [len(reference.encode_ordinary(t)) for t in texts]


def test_round_trip(vocabulary, reference):
    text = "Dosage of 5 mg isn't 10 ml.\n\tУже " * 3000
    assert reference.decode(encode([text], vocabulary)[0]) == text


def test_column(spark, reference):
    rows = [(1, None, "a"), (2, "", "b"), (3, "Hello world", "c"), (3, "Hello world", "c"), (None, "x " * 300_000, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode_column(df, "doc_id", "text").collect()
    assert [r.ids for r in out[:3]] == [[], [], reference.encode_ordinary("Hello world")] and out[3].ids == out[2].ids
    assert len(out[4].ids) == len(reference.encode_ordinary("x " * 300_000))
    assert [r.n_tokens for r in count_column(df, ["doc_id", "ids"], "text").collect()] == [len(r.ids) for r in out]
    assert encode_column(df.limit(0), "doc_id", "text").count() == 0
