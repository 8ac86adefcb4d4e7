"""The cell grammar."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dossierflow.operators.multivalue import CellGrammar, CellParser, split_cells

COMMA, PLAIN = CellParser(CellGrammar(comma=True)), CellParser(CellGrammar())


def values(p, cell):
    return [v for v, *_ in p.parse(cell)]


@pytest.mark.parametrize(
    "cell,want",
    [
        ("a, b; c|d\te\nf；g", ["a", "b", "c", "d", "e", "f", "g"]),
        ('weight & balance, "so-called ""Merkarrix"", x",', ["weight & balance", 'so-called "Merkarrix", x']),
        ('"night; instrument" | “the ″safe″ zone, aft”', ["night; instrument", "the ″safe″ zone, aft"]),
        ("take-off/landing, hand-over", ["take-off/landing", "hand-over"]),
        (";;, , ;", []),
        ("", []),
        (None, []),
        ('"open; b', ['"open', "b"]),
        ('say "x; y" twice; z', ['say "x; y" twice', "z"]),
        ("a;a;a", ["a", "a", "a"]),
        ('""; b', ["b"]),
    ],
)
def test_comma_cells(cell, want):
    assert values(COMMA, cell) == want


@pytest.mark.parametrize(
    "cell,want",
    [
        ("Annex 8, Part III, 3.6.6; Doc 6485, Ch. 14", ["Annex 8, Part III, 3.6.6", "Doc 6485, Ch. 14"]),
        ('1. AMC2 34.939(a)\n2. "limit A; or limit 7"', ["AMC2 34.939(a)", "limit A; or limit 7"]),
        ("• one pump • two", ["one pump", "two"]),
        ("- 76.4 h\n- b", ["76.4 h", "b"]),
        ("(EU) No 1606/2007;(a; b) c", ["(EU) No 1606/2007", "(a; b) c"]),
        ("43.3 kg", ["43.3 kg"]),
        ("(never; closed", ["(never", "closed"]),
    ],
)
def test_plain_cells(cell, want):
    assert values(PLAIN, cell) == want


def test_errors_and_offsets():
    rows = list(COMMA.parse('"a; b'))
    assert rows[0][3] == "malformed_quote" and rows[1][3] is None
    assert [(s, e) for _, s, e, _ in COMMA.parse("ab ; cd")] == [(0, 2), (5, 7)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab,;|"” x ', min_size=1, max_size=8).map(str.strip).filter(bool), max_size=6))
def test_quoted_round_trip(items):
    """Quoted values come back whatever they hold."""
    cell = ";".join('"' + x.replace('"', '""') + '"' for x in items)
    assert values(COMMA, cell) == [x.strip() for x in items]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='a,;|"“”()[]• 1.\n -', max_size=40))
def test_any_cell_ends(cell):
    for v in values(COMMA, cell):
        assert v and v == v.strip()


def test_operator_on_odd_tables(spark):
    df = spark.createDataFrame([(1, "a;b", None, "z"), (2, None, "c", "z"), (2, None, "c", "z")], "id long, x string, y string, value_pos string")
    got = sorted(tuple(r)[:4] for r in split_cells(df, "id", {"x": CellGrammar(), "y": CellGrammar()}).collect())
    assert got == [("x", 1, 1, "a"), ("x", 1, 2, "b"), ("y", 2, 1, "c"), ("y", 2, 1, "c")]
    assert split_cells(df.limit(0), "id", {"x": CellGrammar()}).collect() == []


@pytest.mark.parametrize("cell", ["(" * 100_000, '"a;' * 50_000, "“x | " * 50_000, "[(" * 30_000 + ";" + ")]" * 30_000, '""' * 60_000, "• " * 60_000])
def test_malformed_cells_stay_linear(cell):
    assert all(v for v in values(COMMA, cell))
