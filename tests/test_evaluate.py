"""Grounding in all texts and references in all titles, by brute force on small inputs in several languages."""

import re

from pyspark.sql import functions as F

from dossierflow.operators import evaluate as E
from dossierflow.operators import refs as R
from dossierflow.operators import runs as U

TEXTS = ["The Fuel  pump works", "Насос топлива", "Ο ΔΡΟΜΟΣ είναι", "運航者は 試験する", "", None, "öl Druck"]
CELLS = [(1, "a", "fuel pump;насос", 1), (2, "b", "FUEL PUMP;ölDruck;nowhere", 2), (3, "a", "試験 する;δρομος;pump", 4), (4, "b", "x;works Н;насос", 5), (5, "b", None, 0), (6, "a", "топлива", 3), (7, "b", "none", 6)]


def squash(x):
    return re.sub(r"\s+", "", x).lower()


def test_uniques_are_searched_in_all_references(spark):
    rows = spark.createDataFrame([(i, c, cell, TEXTS[k]) for i, c, cell, k in CELLS], "row_id long, column_name string, cell string, reference string")
    want = {}
    for _, c, cell, _ in CELLS:
        for e in (cell or "").split(";"):
            if e:
                want[c, e] = any(e.lower() in t.lower() or squash(e) in squash(t) for t in TEXTS if t)
    u = spark.createDataFrame(list(want), "column_name string, element string")
    old = E.BLOCK_LETTERS
    try:
        for E.BLOCK_LETTERS in (old, 10):
            assert {(r.column_name, r.element): r.is_grounded for r in E.grounded_uniques(u, rows).collect()} == want
    finally:
        E.BLOCK_LETTERS = old
    assert want["b", "FUEL PUMP"] and want["a", "насос"] and not want["b", "works Н"]
    sheet = {r.element: r.is_grounded for r in U.unique_sheet(rows).collect()}
    assert sheet == {e: want[c, e] for c, e in want}
    assert E.grounded_uniques(u, rows.limit(0)).where("is_grounded").count() == 0


def by_reference(value, titles):
    """The reference's three paths, one title after the other."""
    v = value.strip()
    rx = lambda s: re.compile(r"\b" + r"\s+".join(re.escape(p) for p in s.split()) + r"(?!\d)", re.I)
    m = re.match(r"^\s*([A-Z]{2,3}\d?)\s*(\d{2})\.(\d{2,4})(?!\d)", v)
    if m:
        return {(t, "rule id") for t in titles if rx(f"{m[1]} {m[2]}.{m[3]}").search(t)}
    m = re.match(r"^\s*(\d{2}\.[^\s(]+)", v)
    number = m and m[1].rstrip(".,;:-")
    if number and len(number) > 3 and (hits := {(t, "bare rule no.") for t in titles if rx(number).search(t)}):
        return hits
    low = v.lower()
    bare = low
    while (x := re.sub(r"\([^()]*\)", " ", bare)) != bare:
        bare = x
    bare = re.sub(r"\s+", " ", bare).strip(" ,;:-")
    hits = set()
    for t in titles:
        tl = t.strip().lower()
        for c in dict.fromkeys(x for x in (bare, low) if x):
            if tl and len(c) >= 3 and c in tl:
                hits.add((t, "value in section title"))
                break
            if len(tl) >= 3 and tl in c:
                hits.add((t, "section title in value"))
                break
    return hits


TITLES = ["CS 25.1309 Equipment", "AMC 25.219 Fuel", "23.1001 Fuel system", "21.A.3 Failures, malfunctions", "Fuel system", " Насос топлива ", "ab", "試験する", "23.10", "see (23.AB)", "23.A/2", "Fuel (main) system", "21.A.35 Flight tests"]
VALUES = ["CS 25.1309(a)", "AMC 25.21", "GM 23.1001", "23.1001(a) through (f)", "23.100", "21.A.3", "21.A.3(b), see", "25.1309", "77.99 fuel system", "see 21.A.3 Failures, malfunctions point (b)", "fuel (x) system", "Fuel", "насос", "перед насос топлива стоит", "試験", "運航者は試験する", "ab", "xaby", "(a)", "fuel (main) system", "23.A", "((((((deep))))))", "zz 9 nowhere"]


def test_three_paths_against_a_loop(spark):
    v = spark.createDataFrame([(x, i + 1) for i, x in enumerate(VALUES)], "value string, n long")
    t = spark.createDataFrame([(x, x) for x in [*TITLES, *TITLES[:3]]], "title_id string, title string")
    want = {(v, *h) for v in VALUES for h in by_reference(v, TITLES)}
    old = R.BLOCK_LETTERS
    try:
        for R.BLOCK_LETTERS in (old, 12):
            got = [tuple(r) for r in R.match_sections(v, "value", t).collect()]
            assert set(got) == want and len(got) == len(want)
    finally:
        R.BLOCK_LETTERS = old
    assert {h for _, _, h in want} == {"rule id", "bare rule no.", "value in section title", "section title in value"}
    tally = {}
    for x, title, _ in want:
        n, k = tally.get(title, (0, 0))
        tally[title] = (n + VALUES.index(x) + 1, k + 1)
    got = R.section_tally(R.match_sections(v, "value", t), v).collect()
    assert {r.title_id: (r.occurrences, r.n_values) for r in got} == tally
    counts = v.select(F.lit("References").alias("column_name"), "value", "n")
    block = R.section_block(R.match_sections(v, "value", t), counts).collect()
    assert [(r.title_id, r.occurrences, r.n_values) for r in sorted(block, key=lambda r: r.place)] == sorted(((x, *y) for x, y in tally.items()), key=lambda z: (-z[1], z[0]))
    runs = spark.createDataFrame([("References", VALUES[0], " S1 "), ("References", VALUES[0].upper(), "S2"), ("References", VALUES[0], ""), ("References", "x", "S3")], "column_name string, value string, section_title string")
    rows = R.ref_map(counts, runs, t).collect()
    matched = {(r.value, r.matched_section, r.match_type) for r in rows if r.match_type}
    assert matched == want and {r.value for r in rows} == set(VALUES)
    assert all(r.matched_section == "— no match —" for r in rows if not r.match_type) and any(not r.match_type for r in rows)
    assert {r.section_title for r in rows if r.value == VALUES[0]} == {"S1", "S2"} and {r.section_title for r in rows if r.value != VALUES[0]} == {""}
    using = {r.value: r.matched_using for r in rows}
    assert using["CS 25.1309(a)"] == "CS 25.1309" and using["fuel (x) system"] == "fuel system" and using["21.A.3(b), see"] == "21.A.3"
