import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import bpe

SCHEMA = "doc_id long, text string, tokens string, n_tokens string, lang string"
pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def both():
    import tiktoken

    own = bpe.Bpe(bpe.read_vocabulary(bpe.VOCABULARY))
    return own, tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=own.rank, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([" ", "  ", "\n", " \n ", "\t", "'s", "<|endoftext|>", "the", " the", "ß", "漢字", "\0", " ", "🙂"])), max_size=12).map("".join))
def test_against_another_encoder(both, text):
    own, other = both
    ids = own.encode(text)
    assert ids == other.encode_ordinary(text)
    assert own.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "\u00a0", " \u00a0", "\u00a0 ", " \u00a0 \u00a0 ", "\u3000", "\u2028", "\x85", "\x1c", "\t", "\n", "a", "the", "1", "."]), max_size=16).map("".join))
def test_white_space_of_other_kinds(both, text):
    own, other = both
    assert own.encode(text) == other.encode_ordinary(text)
    assert own.encode("a \u00a0 \u00a0 b") == [64, 11504, 275]


def test_another_pattern(both):
    import tiktoken

    pattern = r"[^\n]+|\n"
    own = bpe.Bpe(bpe.read_vocabulary(bpe.VOCABULARY), pattern)
    other = tiktoken.Encoding("lines", pat_str=pattern, mergeable_ranks=own.rank, special_tokens={})
    for text in ("of the people in the world", "a \u00a0 \u00a0 b\n\n of the"):
        assert own.encode(text) == other.encode_ordinary(text)


def test_small_cache_changes_nothing(both, monkeypatch):
    own, other = both
    monkeypatch.setattr(bpe, "CACHE", 5)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    texts = ["the quick brown fox", "jumps over the lazy dog", None, "", "the quick dog " * 30]
    import numpy as np

    for _ in range(2):
        got = own.encode_texts(texts)
        assert [np.frombuffer(g, "<i4").tolist() for g in got] == [other.encode_ordinary(t or "") for t in texts]


def test_unknown_token_is_an_error(both):
    with pytest.raises(ValueError):
        both[0].decode([60_000])


def test_frames(spark):
    rows = [(1, "Hello there, world", "a", "b", None), (2, None, "a", "b", "x"), (3, "", None, None, None), (1, "Hello there, world", "a", "b", None), (None, "<|endoftext|> é", "a", "b", None), (4, "long text\n" * 40_000, "", "", "")]
    out = bpe.encode(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "lang", "tokens", "n_tokens", "round_trip"]
    got = out.collect()
    assert [(x["tokens"] is None, x["round_trip"]) for x in got] == [(x["text"] is None, None if x["text"] is None else True) for x in got]
    assert {x["doc_id"]: x["n_tokens"] for x in got}[3] == 0
    back = bpe.decode(out).collect()
    assert sorted(((x["doc_id"], x["text"]) for x in back), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
    assert bpe.encode(spark.createDataFrame([], SCHEMA)).count() == 0
