"""Problem 6: ids against the tokenizer library, edge cases, and the round trip."""

import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import encoding, pretoken

PATH = encoding.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return pretoken.ByteBPE(PATH)


HARD = ["", " ", "  ", "\n\n", "a", "it's we've'll 's ''s x'd\n\n  y \t\n", "'re", "'s's't ''s", " b", "don't\r\n\r\nstop   ", "<|endoftext|>", "é́a​b", "한국어 문장입니다. 99번", "x" * 700 + " " + "ab!" * 300, "1²½٣x", "🙂👍🏽"]


def test_same_ids_as_the_library(bpe, library):
    ids, at, _, _ = bpe.encode(HARD)
    for k, text in enumerate(HARD):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode_ordinary(text), repr(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" '\n\tsdmtlrve한1.")), max_size=40), max_size=6))
def test_random_texts(bpe, library, texts):
    ids, at, ends, firsts = bpe.encode(texts)
    for k, text in enumerate(texts):
        own = ids[at[k] : at[k + 1]].tolist()
        assert own == library.encode_ordinary(text)
        assert bpe.decode(own) == text
        assert firsts[k + 1] == firsts[k] or ends[firsts[k + 1] - 1] == len(text)


def test_scan_is_the_automaton(bpe):
    symbols = np.random.default_rng(3).integers(0, 9, 5000).astype(np.uint8)
    state, want = 0, []
    for s in symbols:
        want.append(state)
        state = pretoken.STEP[s, state]
    assert pretoken.scan_states(symbols, 64).tolist() == want


def test_cache_limit_changes_nothing():
    small, large = pretoken.ByteBPE(PATH, cache_size=3), pretoken.ByteBPE(PATH)
    for texts in (HARD, HARD[::-1], HARD):
        assert small.encode(texts)[0].tolist() == large.encode(texts)[0].tolist()


def test_table(spark, library):
    rows = [(1, None, 9), (2, "", 9), (3, "Hello world", 9), (3, "Hello world", 9), (None, "x", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    out = encoding.encode_documents(df, PATH, offsets=True)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>"), ("piece_ends", "array<int>")]
    got = out.collect()
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in got) == [(0, tuple(library.encode_ordinary("x"))), (1, ()), (2, ()), (3, (15496, 995)), (3, (15496, 995))]
    assert [r.piece_ends for r in got if r.doc_id == 3][0] == [5, 11]
    back = encoding.decode_ids(out, PATH).collect()
    assert sorted(r.text for r in back) == ["", "", "Hello world", "Hello world", "x"]
    assert encoding.encode_documents(df.limit(0), PATH).count() == 0
