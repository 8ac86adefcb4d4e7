"""Sentence boundaries over languages and scripts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dossierflow.llm.sentences import sentence_spans, split_sentences


def cut(text):
    return [text[a:b] for a, b in sentence_spans(text)]


CASES = [
    ["The limit is 2.5 bar (see e.g. Fig. 39.59) per App. C, Rev. 3.", "No. 5 is next, i.e. now."],
    ["It stays lit in the U.S. registered craft from 6 a.m. onwards.", "It ends at 11 p.m.", "The next begins."],
    ["It was sold in the U.S.", "Where practicable, stop etc.", "5 bar is the limit."],
    ['The placard reads "Do not open. Wait for the light." and must stay legible.', '"Is the gate closed?" is the question.', 'A note says: "Limit is 2 bar. See Sec. 7."', "The crew waits (the lamp must be lit. It may blink.) and then goes."],
    ["1. The operator shall test it.", "2. By way of exception, stop!", "(b) Each crew member waits.", "a) Last one."],
    ["Am 45. Tag (s. Tab. 81) endet u. U. Teil B der Probe.", "Er hat z. B. Ventile ab dem 23. Mai geprüft o. Ä.", "Der Druck sank auf 3,5 bar ... und stieg dann wieder an.", "„Ist das Tor zu?“ lautet die Frage.", "Auf dem Schild steht: „Nicht öffnen. Warten.“", "Ende."],
    ["Qui contrôle la pompe ?", "La plaque indique : « Ne pas ouvrir. Attendre. » et reste lisible.", "Arrêtez tout de suite !", "L’agent, p. ex. la nuit, note l’art. 5 au sens du n. 7 etc.", "Fin."],
    ["¿Quién revisa la bomba?", "¡Pare el motor!", "El cartel dice: «No abrir. Espere.»", "Además, p. ej. de noche, sí."],
    ["Op het bord staat: ‘Niet openen. Wacht op het licht.’", "Het moet o.a. leidingen en nr. 5 zien."],
    ["Заявитель работает 27,21 ч. работы согласно п. 15 и т. д.", "На табличке: «Не открывать. Ждать.»", "Кто проверяет?"],
    ["Ποιος ελέγχει την αντλία;", "Ο φορέας, π.χ. τη νύχτα, ελέγχει κ.λπ.", "Τέλος."],
    ["直ちに止めよ！", "銘板には「開けるな。灯を待て。」と書かれている。", "乗務員は（点くまで。）待つ。"],
    ["标牌上写着“不要打开。等待灯亮。”，并须清晰。", "机组须等待（灯亮为止。）再关门。", "申请人应在CS 36.614前完成。"],
    ["संचालक को पहले 10.30 घंटों में रखनी चाहिए।", "जाँच कौन करता है?"],
    ["ผู้ดำเนินการห้ามบรรทุกเกิน 34.88 กิโลกรัม", "ลูกเรือต้องทดสอบ"],
    ["THE CREW MUST WAIT FROM 6 A.M. ONWARDS (VOL. 2, PP. 9 FF.) AT ST. ORVEL.", "Did it sound?!", "Yes."],
]


@pytest.mark.parametrize("sentences", CASES)
def test_cases(sentences):
    joiner = "" if sentences[0][0] in "直标" else " "
    assert cut(joiner.join(sentences)) == sentences


def test_enumeration_after_a_colon_is_one_sentence():
    text = "The kit contains:\n(a) one clip;\n(b) two clips;\n(c) a spare fuse. The file shall hold: (a) the filter; and (b) the card."
    at = text.index(" The file")
    assert cut(text) == [text[:at], text[at + 1 :]]


def test_breaks_and_missing_spaces():
    assert cut("No mark here\n\nNext one.Third one. Fourth\nline goes on") == ["No mark here", "Next one.", "Third one.", "Fourth\nline goes on"]
    assert cut("Code LMO.OPS.443 and CS 25.1309(a) stay.The end.") == ["Code LMO.OPS.443 and CS 25.1309(a) stay.", "The end."]


def test_nothing_and_unclosed():
    assert cut(None) == cut("") == cut(" \n\t") == []
    assert cut('He said "wait. Then he left. It was late.') == ['He said "wait.', "Then he left.", "It was late."]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab AB.!?…"“”(«»)\n1;;。「」ก ์ü’‘', max_size=80))
def test_spans_cover_all_text(text):
    spans = sentence_spans(text)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert "".join("".join(text[a:b] for a, b in spans).split()) == "".join(text.split())


def test_long_text_is_linear():
    assert len(cut('A "quoted. Part" (and. More) goes on. ' * 20_000)) == 20_000
    assert len(cut("(" * 50_000 + " end. Next.")) <= 3


def test_operator(spark):
    df = spark.createDataFrame([("t", 1, "A b. C d.", 0), ("t", 2, None, 0), ("t", 3, "", 0), ("t", 1, "A b. C d.", 0)], "src_table string, row_id long, text string, start_char int")
    assert sorted(tuple(r) for r in split_sentences(df).collect()) == [("t", 1, 0, 4), ("t", 1, 0, 4), ("t", 1, 5, 9), ("t", 1, 5, 9)]
    assert split_sentences(df.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["et al. and so on. x " * 40_000, '"' * 100_001, "(a. " * 60_000, "„" * 60_000, "A. " * 60_000, "1. " * 60_000, "?! " * 60_000])
def test_odd_texts_stay_linear(text):
    spans = sentence_spans(text)
    assert spans and spans[-1][1] <= len(text)


def spans(text):
    from dossierflow.llm.sentences import sentence_spans

    return [text[a:b] for a, b in sentence_spans(text)]


def test_list_levels_are_a_stack():
    import re

    from dossierflow.llm.sentences import _MARK, Levels, roman

    assert [roman(x) for x in ("i", "iv", "ix", "xiv", "xl", "c", "iix", "vv", "ab")] == [1, 4, 9, 14, 40, None, None, None, None]
    levels = Levels()
    seen = []
    for mark in ("1.", "a)", "b)", "i)", "ii)", "c)", "2.", "a)", "7.", "3."):
        levels.enter(re.match(_MARK, mark + " "))
        seen.append(len(levels.stack))
    # `i)` opens roman numbers, `c)` closes them, `2.` closes the letters, and `7.` is no mark in order
    assert seen == [1, 2, 2, 3, 3, 2, 1, 2, 2, 1]
    assert levels.stack == [("1.", 3)]
    for _ in range(5):
        levels.enter(re.match(_MARK, "1. "))
    assert levels.stack == [("1.", 1)]


def test_marks_in_order_start_sentences_in_lower_case():
    assert spans("a. the pump is tested. b. the valve is closed. c. the log is kept.") == ["a. the pump is tested.", "b. the valve is closed.", "c. the log is kept."]
    assert spans("i) the pump is tested. ii) the valve is closed.") == ["i) the pump is tested.", "ii) the valve is closed."]
    # not in order: no list
    assert spans("See the pump of type. b. the valve is closed.") == ["See the pump of type. b. the valve is closed."]
    # levels stay open over blank lines
    assert spans("a. the pump is tested.\n\nb. the valve. c. the log.") == ["a. the pump is tested.", "b. the valve.", "c. the log."]
