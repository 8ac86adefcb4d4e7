"""Language identification: phrases by brute force, cleaning, and accuracy on clean documents."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossierflow.llm.language import Classifier, SuffixAutomaton, build_model, classify, clean_sample, label_language, language_model, mislabelled, plain, plain_pieces, script_of, train
from tests.conftest import DATA, needs_data


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=40), st.text(alphabet="abcd", max_size=40))
def test_phrases_are_greedy_longest_matches(reference, text):
    n, i = 0, 0
    while i < len(text):
        size = max(k for k in range(len(text) - i + 1) if text[i : i + k] in reference)
        i += max(size, 1)
        n += 1
    assert SuffixAutomaton(reference).phrases(text) == n


EN = "the operator must test the oxygen mask before the next departure and record the result of the test in the log"
NL = "de exploitant moet vóór het volgende vertrek het zuurstofmasker controleren en het resultaat van de proef vastleggen"
DE = "der betreiber muss vor dem nächsten abflug die sauerstoffmaske prüfen und das ergebnis der prüfung eintragen"
RU = "каждый член экипажа проверяет кислородную маску перед следующим вылетом и записывает результат проверки в журнал"
JA = "運航者は次の出発の前に酸素マスクを試験し結果を記録簿に記録しなければならない"
MODEL = language_model({"en": EN, "nl": plain(NL), "de": plain(DE), "ru": plain(RU), "ja": plain(JA)})


def segments(text):
    return [(text[a:b], name) for a, b, name, *_ in Classifier(MODEL).segments(text)]


def test_segments():
    a, b = "The operator must test the mask.", "De exploitant moet het resultaat vastleggen."
    assert segments(f"{a} {b} {a}") == [(a, "en"), (b, "nl"), (a, "en")]
    assert segments(f"CS 25.1309 | AMC1 2.5\n\n{a}") == [(f"CS 25.1309 | AMC1 2.5\n\n{a}", "en")]
    assert [n for _, n in segments("Каждый член экипажа проверяет. The operator must test the mask. 運航者は試験する結果を記録。")] == ["ru", "en", "ja"]
    assert segments("12 34 5.6") == [("12 34 5.6", None)] and segments("") == []


def test_unmarked_turn_is_found():
    a, b = "The operator must record the result of the test before the next departure", "Der Betreiber muss das Ergebnis der Prüfung eintragen und die Sauerstoffmaske prüfen"
    assert segments(f"{a} {b}") == [(a, "en"), (b, "de")]


def test_endless_sentences_are_cut_at_every_turn():
    a, b = "The operator must record the result of the test before the next departure", "Der Betreiber muss das Ergebnis der Prüfung eintragen und die Sauerstoffmaske prüfen"
    assert [n for _, n in segments((f"{a} " * 8 + f"{b} " * 8) * 12)] == ["en", "de"] * 12


def test_markup_keeps_offsets():
    a, b = "The operator must test the mask", "De exploitant moet het resultaat vastleggen"
    text = f"<p>{a}</p><p>{b} <b>en</b> controleren</p>"
    runs = Classifier(MODEL).segments(text)
    assert [(r[0], r[2]) for r in runs] == [(3, "en"), (text.index(b), "nl")]


def test_scripts():
    assert script_of("abc")[0] == "latin" and script_of("運航者は")[0] == "kana" and script_of("申请人CS 25")[0] == "han" and script_of("12")[0] == ""
    assert script_of("Ο φορέας Lunvel")[0] == "greek"


def test_cleaning_drops_wrong_labels():
    other = [EN, EN.replace("operator", "handler"), EN.replace("mask", "bottle")]
    rows = [("en", ". ".join(other).capitalize() + f". The number {i} operator must record the log.") for i in range(20)] + [("nl", f"{NL.capitalize()}. De aanvrager {'abc'[i % 3]} moet controleren.") for i in range(20)] + [("nl", EN.capitalize() + ".")] * 2
    kept = clean_sample(rows)
    assert not any(" the " in s for s in kept["nl"]) and kept["en"]
    assert set(build_model(kept).references) == {"en", "nl"}


def test_labels(spark):
    got = spark.createDataFrame([(x,) for x in ("en", "EN", "en-GB", "pt_PT", "English", "jpn", "und", "", " de ", None, "mul")], "l string").select(label_language(F.col("l")).alias("r")).collect()
    assert [r.r for r in got] == ["en", "en", "en", "pt", "en", "ja", None, None, "de", None, None]


def test_operator_edges(spark):
    df = spark.createDataFrame([(1, "The operator must test the mask.", "en", 0), (2, "The operator must test the mask.", "nl", 0), (3, "The operator must test the mask.", None, 0), (4, None, "en", 0), (5, " ", "en", 0), (6, "5.6", "en", 0), (7, "The operator must test. De exploitant moet controleren.", "en", 0), (8, "12", "xx", 0)], "doc_id long, text string, lang string, label int")
    seg = classify(df, MODEL)
    assert sorted(tuple(r) for r in mislabelled(seg).collect()) == [(2, 0, "en"), (3, 0, "en"), (7, 0, "en"), (7, 24, "nl"), (8, 0, "und")]
    assert classify(df.limit(0), MODEL).collect() == []
    assert train(df.limit(0)).references == {}
    assert classify(df, language_model({})).count() == 6


@needs_data
def test_accuracy_on_script_languages(spark):
    """Held-out check: for labels whose script names the language, nearly all documents get it."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    rows = classify(docs, train(docs)).where("n_segments = 1 and label is not null").select("doc_id", "label", "doc_lang").collect()
    assert len(rows) > 500
    assert sum(r.label == r.doc_lang for r in rows) / len(rows) > 0.9



def test_foreign_sentence_behind_many_native_ones():
    a, b = "The operator must record the result of the test before the next departure", "Der Betreiber muss das Ergebnis der Prüfung eintragen"
    for n in (3, 5, 10, 100):
        native = " ".join([a] * n)
        assert segments(native) == [(native, "en")]
        assert segments(f"{native} {b}") == [(native, "en"), (b, "de")]
        assert segments(f"{native} {b} {native}") == [(native, "en"), (b, "de"), (native, "en")]


def test_foreign_words_inside_a_sentence_make_no_segment():
    text = " ".join(["The operator must test the oxygen mask Sauerstoffmaske Prüfung before the next departure"] * 5)
    assert segments(text) == [(text, "en")]


def test_candidates_come_from_the_reference_texts():
    assert MODEL.scripts == {"latin": ("de", "en", "nl"), "cyrillic": ("ru",), "kana": ("ja",), "han": ("ja",)}


def test_a_script_of_one_language_is_parsed_too():
    own = Classifier(MODEL).segments("Каждый член экипажа проверяет кислородную маску перед следующим вылетом.")
    other = Classifier(MODEL).segments("Рақмет сізге, бүгін ауа райы өте жақсы болды, ұшақ кешікті.")
    assert own[0][2] == other[0][2] == "ru" and own[0][3] > 0.9 > 0.5 > other[0][3]


def test_one_pass_agrees_with_sentence_by_sentence():
    import random

    rnd = random.Random(4)
    words = {x: t.split() for x, t in MODEL.references.items() if x != "ja"}
    for _ in range(60):
        names = rnd.choices(list(words), k=rnd.choice([1, 1, 2, 3]))
        text = " ".join((" ".join(rnd.choices(words[x], k=rnd.randint(3, 25)))).capitalize() + "." for x in names for _ in range(rnd.randint(1, 4)))
        c = Classifier(MODEL)
        fast = [r[:3] for r in c.segments(text)]
        c.settled = lambda *_: {}
        assert [r[:3] for r in c.segments(text)] == fast


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abZ é1.-<&\n/", max_size=12), min_size=1, max_size=5))
def test_pieces_are_plain_one_by_one(pieces):
    got = plain_pieces(pieces)
    assert len(got) == len(pieces) and all(set(x) <= set("abzé e") for x in got)
    if not any(c in x for x in pieces for c in "-1<&"):
        assert got == [plain(x) for x in pieces]
