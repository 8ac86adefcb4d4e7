"""Evaluation passages in training text, against a window-by-window search."""

import random
import re

from dossierflow.llm.leakage import LeakIndex, Stream, find_leaks, leaked_items

WORDS = [f"w{c}{d}" for c in "abcdefghij" for d in "xyz"]


def brute(docs, items, n):
    def words(t):
        return re.findall(r"[^\W_]+", re.sub(r"<[^<>]*>", " ", t).casefold())

    out = set()
    for d, text in docs:
        dw = words(text)
        have = {tuple(dw[i : i + n]) for i in range(len(dw) - n + 1)}
        for k, t in items:
            w = words(t)
            if any(tuple(w[i : i + n]) in have for i in range(len(w) - n + 1)):
                out.add((d, k))
    return out


def test_random_passages():
    rnd = random.Random(5)
    items = [(k, " ".join(rnd.choices(WORDS, k=rnd.randint(5, 30)))) for k in range(25)]
    docs = []
    for d in range(200):
        w = rnd.choices(WORDS, k=rnd.randint(0, 30))
        _, t = rnd.choice(items)
        own = t.split()
        a = rnd.randrange(len(own))
        part = own[a : a + rnd.randint(1, 20)]
        sep = rnd.choice([" ", "\n", ", ", " <b>x</b> ".replace("x", ""), " – "])
        docs.append((d, " ".join(w[:10]) + ". " + sep.join(x.upper() if rnd.random() < 0.3 else x for x in part) + "; " + " ".join(w[10:])))
    for n in (5, 8, 12):
        index = LeakIndex([(k, t, False) for k, t in items], n, 24)
        assert {(d, k) for d, t in docs for k in index.leaks(t)} == brute(docs, items, n)


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen"


def test_formatting_does_not_matter_but_words_do():
    index = LeakIndex([(1, ITEM, False), (2, ITEM.upper().replace(" ", "\n"), False), (3, "too short", False)], 12, 24)
    hit = index.leaks("x. <p>ONE two, three-\nfour fi-\n  ve six <b>seven</b> eight\nnine ten: eleven&nbsp;twelve</p> y")
    assert set(hit) == {1, 2} and [n for n, *_ in hit[1]] == [12]
    text = "x. <p>ONE two, three-\nfour fi-\n  ve six <b>seven</b> eight\nnine ten: eleven&nbsp;twelve</p> y"
    _, a, b = hit[1][0]
    assert text[a:b].startswith("ONE") and text[a:b].endswith("twelve")
    assert index.leaks("one two three four five six seven eight nine ten eleven") == {}
    assert index.leaks("xone two three four five six seven eight nine ten eleven twelve") == {}  # not the word `one`
    assert index.leaks("onetwo three four five six seven eight nine ten eleven twelve thirteen") == {}
    assert index.leaks("one two three four five six stop seven eight nine ten eleven twelve thirteen") == {}
    assert index.leaks("") == {}


def test_letters_for_scripts_without_spaces():
    item = "勤務の終わりにポンプを点検するのは誰か運航者は四日以内に着陸重量"
    index = LeakIndex([(1, item, True)], 12, 24)
    assert set(index.leaks("前。" + "、".join(item[:24]) + "後")) == {1}
    assert index.leaks("前。" + item[:23] + "後") == {}


def test_offsets():
    s = Stream("Straße <i>ab</i> c")
    assert s.text == "strasseabc" and s.offsets[4:6] == [4, 4] and s.offsets[7] == 10


def test_operator(spark):
    docs = spark.createDataFrame([(1, ITEM, 0), (2, None, 0), (3, "", 0), (4, "y " * 50_000 + ITEM, 0), (5, "nothing", 0), (1, ITEM, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, "en", ITEM), (8, None, ITEM), (9, "en", None), (10, "en", "a b")], "item_id long, lang string, text string")
    assert sorted({(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()}) == [(1, 7), (1, 8), (4, 7), (4, 8)]
    assert find_leaks(docs.limit(0), items).collect() == [] and find_leaks(docs, items.limit(0)).collect() == []


def test_tags_of_any_length():
    words = WORDS[:12]
    for size in (10, 400, 50_000):
        text = " ".join(words[:6]) + f' <a href="{"x" * size}">' + " ".join(words[6:])
        assert brute([(1, text)], [(7, " ".join(words))], 12) == {(1, 7)}
        assert set(LeakIndex([(7, " ".join(words), False)], 12, 24).leaks(text)) == {7}
    assert LeakIndex([(7, " ".join(words), False)], 12, 24).leaks("<a" * 200_000 + " " + " ".join(words)) != {}


def test_every_passage_of_a_pair(spark):
    half = " ".join(ITEM.split()[:12])
    text = f"{ITEM}. Other words. {half}, then stop {half}"
    index = LeakIndex([(7, ITEM, False)], 12, 24)
    got = index.leaks(text)[7]
    assert [n for n, *_ in got] == [13, 12, 12] and [text[a:b] for _, a, b in got] == [ITEM, half, half]
    docs = spark.createDataFrame([(1, text), (2, ITEM), (3, "no")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "en", ITEM), (8, "en", half), (9, "en", ITEM + " more")], "item_id long, lang string, text string")
    for letters in (10, 10**6):
        passages = find_leaks(docs, items, scan_letters=letters)
        assert sorted((r.doc_id, r.item_id, r.passage_no) for r in passages.collect()) == [(1, k, n) for k in (7, 8, 9) for n in (1, 2, 3)] + [(2, 7, 1), (2, 8, 1), (2, 9, 1)]
        assert sorted(tuple(r) for r in leaked_items(passages).collect()) == [(d, k) for d in (1, 2) for k in (7, 8, 9)]
