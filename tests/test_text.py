"""Text primitives evaluated through Spark."""

import pytest
from pyspark.sql import functions as F

from dossierflow.functions import text as X
from dossierflow.operators import evaluate as E
from dossierflow.operators import metrics as K


def ev(spark, f, *args):
    df = spark.createDataFrame([tuple(args)], ", ".join(f"a{i} {'array<string>' if isinstance(a, list) else 'string'}" for i, a in enumerate(args)))
    return df.select(f(*[F.col(f"a{i}") for i in range(len(args))]).alias("r")).head()[0]


@pytest.mark.parametrize("a", ["Part 21 ", "PART 21", "Part  21.", "– part 21 —"])
def test_normalize_heading(spark, a):
    assert ev(spark, X.normalize_heading, a) == "part 21"


def test_normalize_null_and_sharp_s(spark):
    assert ev(spark, X.normalize_heading, None) == ""
    assert ev(spark, X.normalize_heading, "Größe STRAẞE") == "grösse strasse"


@pytest.mark.parametrize("text,want", [("1. Scope", True), ("2.1 Applicability", True), ("IV.", True), ("A.", True), ("12", False), ("2021-04-01", False), ("01/02/2021", False), ("Part 21", True), ("EHPS.10 Scope", True), ("GENERAL", False), ("", False), (None, False), ("AMC1 ORO.GEN.200", True)])
def test_numbered(spark, text, want):
    assert ev(spark, X.is_numbered_heading, text) is want


@pytest.mark.parametrize("value,want", [("AMC 25.21(g)(a)", ("AMC", "25.21", None)), ("AMC223.2110 Stall", ("AMC2", "23.2110", None)), ("AMC25.1309", ("AMC", "25.1309", None)), ("GM 21.A.14", (None, None, None)), ("CS 1.5", (None, None, None)), ("cs 25.1309", (None, None, None)), ("23.1001(a) through (f)", (None, None, "23.1001")), ("23.1011, see also", (None, None, "23.1011")), ("23.", (None, None, None)), ("2.5 percent", (None, None, None))])
def test_rule_identifiers(spark, value, want):
    from dossierflow.operators.refs import parsed_values

    r = parsed_values(spark.createDataFrame([(value,)], "v string"), "v").head()
    assert (r.prefix, r.number, r.bare) == want


@pytest.mark.parametrize("value,want", [("AMC 25.21(g)(a)", "AMC 25.21"), ("21.A.14(b)", "21.A.14"), ("see 21.A.3A, point (b)", "see 21.A.3A, point"), ("(a(b))", "")])
def test_strip_parentheticals(spark, value, want):
    assert ev(spark, X.strip_parentheticals, value) == want


@pytest.mark.parametrize(
    "chain,want",
    [
        ("R|s|p|w|q|v", ("R", "s", "p", "w", "q", "v")),
        ("R|#|#|c|#|#", ("R", "", "", "c", "", "")),
        ("R|s|p|w|12 kg", ("R", "s", "p", "w", "", "12 kg")),
        ("R|s|p|w|q|v|x|y", ("R", "s", "p", "w", "q", "v|x|y")),
        ("AC 120-76D-efb-check-crew-5", ("AC 120-76D", "efb", "check", "crew", "", "5")),
        ("R-s", ("R", "s", "", "", "", "")),
        ("#|s", None),
        ("R|s", ("R", "s", "", "", "", "")),
    ],
)
def test_chains(spark, chain, want):
    got = ev(spark, X.chain_fields, chain)
    assert (tuple(got) if got else None) == want


def test_chain_detection(spark):
    assert ev(spark, X.looks_like_chain, "```text\nA|b|c|d|e|f;B|#|#|#|#|#\n```") is True
    for no in ("plain - prose", '{"a": "b|c"}', "", "A|b; no pipe"):
        assert ev(spark, X.looks_like_chain, no) is False


def test_grounding_ignores_white_space(spark):
    assert ev(spark, X.grounded, "remark on the specific line", "inaremark onthe specific lineofthat") is True
    assert ev(spark, X.grounded, "x", "") is False and ev(spark, X.grounded, "x", None) is False
    assert ev(spark, X.grounded, "GRÖSSE a", "grösse  a b") is True


def test_toc_cells(spark):
    f = lambda c: X.toc_entry_from_cells(c)
    assert tuple(ev(spark, f, ["1.2 Scope", "14"])) == ("1.2 Scope", 14)
    assert tuple(ev(spark, f, ["1.2", "Scope", "p. 14."])) == ("1.2 Scope", 14)
    assert tuple(ev(spark, f, ["1.2 Scope ......... 14"])) == ("1.2 Scope", 14)
    for no in (["Section", "Title"], ["12", "14"], [], ["nan", "-"]):
        assert ev(spark, f, no) is None


def test_items_and_separators(spark):
    assert ev(spark, X.split_items, " a ; ;b;") == ["a", "b"]
    assert ev(spark, X.split_items, None) == [] and ev(spark, X.split_items, "  ") == []
    assert ev(spark, lambda c: X.best_separator(c, (";", "|")), "a|b;c") == ";"
    assert ev(spark, lambda c: X.split_items(c, (";", "|")), "a|b|c;d") == ["a", "b", "c;d"]


def test_rounding_and_jaccard(spark):
    assert ev(spark, X.jaccard, "a b c", "b c d") == 0.5
    assert ev(spark, X.jaccard, "", None) == 0.0
    assert spark.range(1).select(E.coverage(F.lit(1), F.lit(16))).head()[0] == 6.2  # 6.25 rounds to even


def test_parentheses_of_any_depth(spark):
    for depth in (1, 2, 3, 6, 40):
        assert ev(spark, X.strip_parentheticals, "x " + "(a " * depth + ")" * depth + " y") == "x y"
    assert ev(spark, X.strip_parentheticals, "a (b (c) d") == "a (b d" and ev(spark, X.strip_parentheticals, "((a)) ) (b") == ") (b"


def test_names_and_times(spark):
    assert ev(spark, X.sanitize_filename, "A/B: c d__e") == "A_B_c_d_e"
    assert ev(spark, X.sanitize_filename, "") == "Unknown_Topic"
    assert ev(spark, X.safe_sheet_name, "a:b/c[d]") == "a b c d"
    assert ev(spark, X.ref_map_sheet, "Uniq Sheet1") == "Ref Map Sheet1"
    assert ev(spark, X.add_hms, "23:59:30", "01:00:45") == "25:00:15"
    assert ev(spark, X.hms, "3661") == "01:01:01"
    assert ev(spark, X.severity, "x [ERROR] y") == "err" and ev(spark, X.severity, "=== run") == "hdr" and ev(spark, X.severity, "x") is None
    assert ev(spark, X.count_value, "3.0") == 3 and ev(spark, X.count_value, "x") == 0 and ev(spark, X.count_value, None) == 0


@pytest.mark.parametrize(
    "text,want",
    [
        ("See No. 5 and e.g. the para. 3. next one. Limit is 2.5 bar. J. Smith agreed! Done", ["See No. 5 and e.g. the para. 3. next one.", "Limit is 2.5 bar.", "J. Smith agreed!", "Done"]),
        (None, []),
        (" \u00a0", []),
        ("One.  Two?\n\nThree!", ["One.", "Two?", "Three!"]),
        ('He said "Stop." Then he left. (See it.) Next', ['He said "Stop."', "Then he left.", "(See it.)", "Next"]),
        ("In the U.S. Army. In the X.Y. Army", ["In the U.S. Army.", "In the X.Y.", "Army"]),
        ("Rule 5. Next. Rule v.5 Next", ["Rule 5. Next.", "Rule v.5 Next"]),
        ("small. then. Big", ["small. then.", "Big"]),
        ("Nos. 3 and ETC. Next, 1.etc. Next", ["Nos. 3 and ETC. Next, 1.etc. Next"]),
        ("Really?! Yes. Ποιος; Ναι. ναι", ["Really?!", "Yes.", "Ποιος; Ναι. ναι"]),
    ],
)
def test_reference_sentences(spark, text, want):
    assert ev(spark, X.reference_sentences, text) == want


def test_metrics_by_hand():
    assert K.rouge_n(K.rouge_tokens("the cats sat"), K.rouge_tokens("the cat sat"), 1) == pytest.approx(1.0)
    assert K.rouge_l("a b c d".split(), "a c d e".split()) == pytest.approx(0.75)
    assert K.indel_ratio("kitten", "sitting") == pytest.approx(8 / 13)
    assert K.word_errors("the cat sat down", "the dog sat") == (pytest.approx(2 / 3), 1, 1, 0)
    assert K.bleu("a b c d e", "a b c d e") == pytest.approx(1.0) and K.bleu("x", "a b") == 0.0
    assert K.lcs_length("abcbdab", "bdcaba") == 4
    s = K.PorterStemmer()
    assert [s.stem(w) for w in ("caresses", "ponies", "relational", "hopping", "falling", "adjustable", "probate", "controlling")] == ["caress", "poni", "relat", "hop", "fall", "adjust", "probat", "control"]


def test_small_helpers(spark):
    assert ev(spark, lambda c: X.clean_folder_path(c, "/home/u"), ' "~/a b" ') == "/home/u/a b"
    assert ev(spark, X.cell_text, '["a", "b"]') == "a; b" and ev(spark, X.cell_text, '{"a": 1}') == '{"a": 1}' and ev(spark, X.cell_text, None) == ""
    assert [ev(spark, X.payload_kind, p) for p in ('[{"element_type": "x"}]', '[{"text": "x"}]', '{"merged_headings": []}', '{"chunks": []}', "{", "3", None)] == ["nodes", "chunks", "sections", "chunks", "invalid", "invalid", "invalid"]
    r = spark.range(1).select(X.message_tokens(F.lit(10), F.lit(True)), X.backoff_seconds(F.lit(3), F.lit(None).cast("double")), X.backoff_seconds(F.lit(1), F.lit(9.0))).head()
    assert tuple(r) == (17, 8.0, 9.0)
    v = spark.createDataFrame([([(1, [2.0]), (0, [1.0])],)], "e array<struct<index:int,embedding:array<double>>>").select(X.ordered_vectors(F.col("e")).alias("v")).head().v
    assert v == [[1.0], [2.0]]
