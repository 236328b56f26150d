"""Problem 2: pieces within the limit, shared overlap, right offsets, natural where possible."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import splitting


def check(text, limit, overlap):
    pieces, natural = splitting.split_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert b - c == overlap and a < c and b < d
    assert all(b - a <= limit for a, b in pieces)
    return pieces, natural


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.!? \n가나。", min_size=1, max_size=400), st.integers(20, 60), st.integers(0, 10))
def test_properties(text, limit, overlap):
    check(text, limit, overlap)


def test_sentences_are_natural():
    text = "A sentence of some words. " * 100
    pieces, natural = check(text, 300, 40)
    assert natural and all(text[b - 2 : b] == ". " for _, b in pieces)


def test_long_stretch_is_forced():
    text = "short. " + "word " * 300 + "end."
    pieces, natural = check(text, 300, 40)
    assert not natural and all(text[b - 1] == " " or b == len(text) for _, b in pieces)
    assert not check("x" * 1000, 300, 40)[1]


def test_sections_before_paragraphs():
    text = "intro line\n" * 10 + "\n# Head\n" + "body line\n" * 10
    assert text.index("# Head") in {b for _, b in splitting.split_text(text, 140, 0)[0]}


def test_overlap_must_fit():
    with pytest.raises(ValueError):
        splitting.split_text("abc", 10, 10)


def test_table(spark):
    long = "Eine Zeile.\n" * 200
    rows = [("a", long, "p/1", 5), ("a", long, "p/1", 5), ("b", None, None, 5), ("c", "", "s", 5), ("d", "x" * 1024, "s", 5), ("e", "가" * 2000, None, None), ("f", "y. " * 200_000, "s", 1)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, section_path string, piece_no int")
    distinct = splitting.latest_rows(df.withColumn("t", df.piece_no), "chunk_id", "t", ["text", "section_path"])
    got = splitting.split_oversized(distinct, ["chunk_id"], carry=("section_path",)).collect()
    by = {}
    for r in got:
        assert len(r.piece_text) <= 1024 and r.piece_end - r.piece_start == len(r.piece_text)
        by.setdefault(r.chunk_id, []).append(r)
    assert set(by) == {"a", "e", "f"}
    assert {r.cut_kind for r in by["a"]} == {"natural"} and {r.cut_kind for r in by["e"]} == {"forced"} and {r.section_path for r in by["a"]} == {"p/1"}
    assert splitting.split_oversized(df.limit(0), ["chunk_id"]).count() == 0
