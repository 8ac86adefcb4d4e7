"""Duplicates hidden by formatting."""

import unicodedata
from collections import defaultdict

from pyspark.sql import functions as F

from dossierflow.llm.canonical import canonical_groups, canonical_text, copy_links
from tests.conftest import DATA, needs_data


def reference(text):
    def kept(s):
        return "".join(c for c in s.casefold() if unicodedata.category(c)[0] in "LN")

    return "|".join(sorted(x for x in map(kept, text.split("|")) if x))


def pairs(rows):
    groups = defaultdict(list)
    for i, h in rows:
        if h is not None and reference(h):
            groups[reference(h)].append(i)
    return {(min(v), x) for v in groups.values() for x in v if x != min(v)}


ROWS = [(7, "GM1 A | Fuel – x | Issue 3"), (3, "fuel x|GM1 A|ISSUE­3"), (9, "Issue 3 | GM1 A | FUEL: X."), (1, None), (2, " "), (4, "– — |"), (5, "Größe"), (6, "GRÖSSE"), (8, "Grosse"), (10, "Größe"), (11, "GM1 A | Fuel"), (12, "ΣΑΣ"), (13, "σας")]


def frame(spark, rows):
    return spark.createDataFrame([(i, h, "k", 0) for i, h in rows], "id long, heading string, key string, form int")


def test_links(spark):
    got = {tuple(r) for r in copy_links(frame(spark, ROWS), "id", "heading").collect()}
    assert got == pairs(ROWS) == {(3, 7), (3, 9), (5, 6), (5, 10), (12, 13)}


def test_groups_count_copies(spark):
    got = {r.keep_id: (r.kept_text, r.n_copies, r.n_forms) for r in canonical_groups(frame(spark, ROWS), "id", "heading").collect()}
    assert got[3] == ("fuel x|GM1 A|ISSUE­3", 3, 3) and got[5] == ("Größe", 3, 2) and got[11][1] == 1
    assert 1 not in got and 2 not in got and 4 not in got


def test_empty_and_hot(spark):
    assert copy_links(frame(spark, []), "id", "heading").collect() == []
    hot = [(i, "same heading" if i % 3 else f"h{i}") for i in range(3000)]
    got = {tuple(r) for r in copy_links(frame(spark, hot), "id", "heading").collect()}
    assert got == pairs(hot) and len(got) == 1999


def test_folding_agrees_with_unicode(spark):
    """Over all letters and digits two characters share a form just if their full case foldings do (dotless i aside)."""
    chars = [chr(i) for i in range(0x3000) if unicodedata.category(chr(i)) not in ("Cn", "Cs", "Co")] + ["ﬁ", "ﬆ", "ﬅ", "ﬓ", "K", "Å", "𐐀", "𐐨"]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", canonical_text(F.col("c")).alias("k")).collect()
    ours, theirs = defaultdict(set), defaultdict(set)
    for r in rows:
        if r.c not in "ı|" and reference(r.c) and r.k:
            ours[r.k].add(reference(r.c))
            theirs[reference(r.c)].add(r.k)
    assert all(len(v) == 1 for v in ours.values()) and all(len(v) == 1 for v in theirs.values())


def test_marks_count_if_asked(spark):
    rows = frame(spark, [(1, "कि"), (2, "का"), (3, "- का ."), (4, "\u0301का")])
    assert {tuple(r) for r in copy_links(rows, "id", "heading").collect()} == {(1, 2), (1, 3), (1, 4)}
    assert {tuple(r) for r in copy_links(rows, "id", "heading", marks=True).collect()} == {(2, 3), (2, 4)}


@needs_data
def test_whole_table(spark, duck):
    rows = duck.execute("select id, heading from sections").fetchall()
    got = {tuple(r) for r in copy_links(spark.read.parquet(f"{DATA}/sections.parquet"), "id", "heading").collect()}
    assert got == pairs(rows)
