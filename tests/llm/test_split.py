"""Splitting at natural boundaries."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from dossierflow.llm.split import bisect_cuts, cut_kinds, divided_stretches, split_oversized, split_text

TEXT = st.text(alphabet="abc .!?。\n\t", max_size=300)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(2, 60), st.integers(0, 70))
def test_pieces_cover_and_fit(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    used = max(0, overlap if overlap < limit else limit // 2)
    assert all(0 <= a <= b <= len(text) and b - a <= limit for a, b, *_ in pieces)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (_, e, *_), (s, _, core, _) in zip(pieces, pieces[1:]):
        assert core == e and e - s == min(used, e)
    assert "".join(text[c:e] for _, e, c, _ in pieces) == text


def test_strongest_boundary_near_the_middle():
    text = "a" * 40 + ". " + "b" * 8 + "\n\n" + "c" * 50
    assert bisect_cuts(text, 60) == [(52, "paragraph")]
    assert [k for _, k in bisect_cuts("word " * 30, 60)] == ["word"] * 3
    assert [k for _, k in bisect_cuts("x" * 100, 60)] == ["forced"]


def longest_run(text):
    return max(map(len, re.split(r"[\s.!?。！？।]", text)))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abcdefg .。\n", max_size=200), st.integers(2, 30), st.integers(0, 40))
def test_kinds_from_cuts_agree_with_the_definition(text, limit, overlap):
    made = split_text(text, limit, overlap)
    divided = divided_stretches(text, [core for _, _, core, kind in made if kind == "forced"])
    if len(text) > limit:
        assert (max(divided, default=0) > limit) == (longest_run(text) > limit)


def test_forced_cuts_of_short_words_stay_natural(spark):
    limits = spark.createDataFrame([("s", 100, 20)], "source string, max_chars int, overlap_chars int")
    pieces = split_oversized(frame(spark, [(1, " ".join(["w" * 95] * 3), "s", 0, "")]), limits, "id", "text", "source")
    assert {r.cut for r in pieces.collect()} >= {"forced"} and [r.cut_kind for r in cut_kinds(pieces).collect()] == ["natural"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, source string, max_chars int, piece string")


def test_operator(spark):
    limits = spark.createDataFrame([("s", 50, 10), ("s", 60, 0), ("t", 10, None), (None, 5, 5)], "source string, max_chars int, overlap_chars int")
    rows = [(1, "word " * 40, "s", 1, ""), (2, "x" * 120, "s", 1, ""), (3, "short", "s", 1, ""), (4, None, "s", 1, ""), (5, "y" * 99, "none", 1, ""), (6, "z " * 9, "t", 1, ""), (7, "y" * 99, None, 1, ""), (8, "", "s", 1, ""), (9, "𝑉" * 51, "s", 1, ""), (10, "𝑉" * 50, "s", 1, "")]
    pieces = split_oversized(frame(spark, rows), limits, "id", "text", "source")
    got = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.id, r.piece_no)):
        got.setdefault(r.id, []).append(r.piece)
    assert set(got) == {1, 2, 6, 9} and all(len(p) <= 50 for p in got[1] + got[2] + got[9])
    assert {r.id: r.cut_kind for r in cut_kinds(pieces).collect()} == {1: "natural", 2: "forced", 6: "natural", 9: "forced"}
    assert split_oversized(frame(spark, []), limits, "id", "text", "source").collect() == []
    assert split_oversized(frame(spark, rows), limits.limit(0), "id", "text", "source").collect() == []


def test_very_long_text(spark):
    limits = spark.createDataFrame([("s", 900, 120)], "source string, max_chars int, overlap_chars int")
    text = "One sentence of the text. " * 40_000
    pieces = split_oversized(frame(spark, [(1, text, "s", 0, "")]), limits, "id", "text", "source").collect()
    assert all(len(r.piece) <= 900 for r in pieces) and max(r.end_char for r in pieces) == len(text)
