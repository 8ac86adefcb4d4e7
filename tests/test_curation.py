"""Triage, contents, merge folding and blocked windows against sequential loops."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from dossierflow.operators import merge as M
from dossierflow.operators import ordered as O
from dossierflow.operators import toc as T
from dossierflow.operators import triage as G

SCHEMA = "doc_uuid string, pos long, id long, action string, heading string, text string, labels array<string>, page int, add_heading boolean"


def random_decisions(seed, docs=12, n=14):
    rnd = random.Random(seed)
    out, k = [], 0
    for d in range(docs):
        for p in range(rnd.randint(0, n)):
            k += 1
            out.append((f"d{d}", p, k, rnd.choice(["log", "skip", "merge", "merge", "review"]), rnd.choice(["A", " a. ", "B", "", None]), rnd.choice(["x  ", "", None, "one\ntwo ", " y"]), rnd.sample(["p", "q", "r"], rnd.randint(0, 2)), rnd.choice([None, 1, 2]), rnd.random() < 0.4))
    return out


def fold(rows):
    """The sequential loop: what each kept row of a document ends up as."""
    out = []
    for doc in sorted({r[0] for r in rows}):
        target = None
        for _, _, i, action, heading, text, _, _, add in sorted(r for r in rows if r[0] == doc):
            text = text or ""
            if action == "skip":
                continue
            if action == "merge" and target is not None:
                body, head = text.rstrip(), (heading or "").strip()
                piece = body if not add or not head else f"{head}\n{body}" if body else head
                if piece.strip():
                    base = target[2].rstrip()
                    target[2] = base + "\n\n" + piece if base else piece
                target[3].append(i)
                continue
            target = [doc, i, text, []]
            out.append(target)
    return sorted((d, i, t, tuple(m)) for d, i, t, m in out)


@pytest.mark.parametrize("seed", range(4))
def test_merge_folding(spark, seed):
    rows = random_decisions(seed)
    got = M.resolve_merges(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_uuid, r.id, r.text, tuple(r.merged_from)) for r in got) == fold(rows)


def test_merged_labels_and_orphans(spark):
    rows = [("d", 0, 1, "merge", "H", "first", ["a", "a"], 1, False), ("d", 1, 2, "merge", "", "more", ["b", "b"], 1, False), ("d", 2, 3, "skip", "", "no", [], 9, False), ("d", 3, 4, "merge", "", "end", ["a"], 2, False)]
    r = M.resolve_merges(spark.createDataFrame(rows, SCHEMA)).head()
    assert (r.id, r.text, r.labels, r.pages) == (1, "first\n\nmore\n\nend", ["a", "a", "b"], [1, 2])
    h = {x.id: (x.status, x.merged_into) for x in M.history(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert h == {1: ("merged", None), 2: ("merged", 1), 3: ("skipped", None), 4: ("merged", 1)}
    assert [x.id for x in M.rows_from_orphans(spark.createDataFrame(rows, SCHEMA)).collect()] == [1]


def test_sections_in_parts_keep_all_text(spark):
    rows = [("d", p, p, "log", "Part 21 " if p % 2 else "PART 21", f"t{p}", [], None, False) for p in range(30)] + [(None, 0, 99, "log", "x", "t", [], None, False)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = M.merged_sections(df).collect()
    assert {r.doc_uuid for r in whole} == {"d", None} and len(whole) == 2
    whole = next(r for r in whole if r.doc_uuid)
    assert whole.merged_text == "\n\n".join(f"t{p}" for p in range(30)) and whole.heading == "PART 21" and whole.chunk_ids == list(range(30))
    parts = sorted((r for r in M.merged_sections(df, part_chars=90).collect() if r.doc_uuid), key=lambda r: r.part)
    assert len(parts) > 5 and "\n\n".join(r.merged_text for r in parts) == whole.merged_text and [i for r in parts for i in r.chunk_ids] == whole.chunk_ids
    assert {(r.heading, r.first_pos, r.n_chunks) for r in parts} == {("PART 21", 0, 30)}


@pytest.mark.parametrize("seed,part_chars", [(0, 10**6), (1, 10**6), (2, 60), (3, 25)])
def test_sections_with_their_links(spark, seed, part_chars):
    rows = random_decisions(seed)
    folds = fold(rows)
    at = {r[2]: r for r in rows}
    want = {}
    for d, i, text, merged in sorted(folds, key=lambda f: (f[0], at[f[1]][1], f[1])):
        ids = [i, *merged]
        s = want.setdefault((d, key_of(at[i][4])), {"heading": at[i][4], "texts": [], "ids": [], "labels": None, "pages": []})
        s["texts"].append(text)
        s["ids"] += ids
        for x in ids:
            if s["labels"] is None:
                s["labels"] = list(at[x][6])
            s["labels"] += [y for y in at[x][6] if y not in s["labels"]]
            s["pages"] += [y for y in [at[x][7]] if y is not None and y not in s["pages"]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in sorted(M.merged_sections(df, part_chars=part_chars).collect(), key=lambda r: r.part):
        got.setdefault((r.doc_uuid, r.key), []).append(r)
    assert set(got) == set(want)
    for k, parts in got.items():
        assert [i for r in parts for i in r.chunk_ids] == want[k]["ids"] and {r.heading for r in parts} == {want[k]["heading"]}
        if part_chars > 10**5:
            assert len(parts) == 1 and parts[0].merged_text == "\n\n".join(want[k]["texts"])
            assert parts[0].labels == want[k]["labels"] and parts[0].pages == want[k]["pages"] and parts[0].n_chunks == len(want[k]["texts"])
    members = M.section_members(M.merged_rows(df), part_chars).collect()
    assert sorted((r.doc_uuid, r.key, r.id) for r in members) == sorted((*k, i) for k, s in want.items() for i in s["ids"])


def test_folds_in_parts(spark):
    rows = [("d", p, p, "log" if p == 0 else "merge", "h", f"text {p}", [], None, False) for p in range(40)]
    parts = sorted(M.resolve_merges(spark.createDataFrame(rows, SCHEMA), part_chars=200).collect(), key=lambda r: r.part)
    assert len(parts) > 3 and {(r.id, r.heading) for r in parts} == {(0, "h")}
    assert "\n\n".join(r.text for r in parts) == "\n\n".join(f"text {p}" for p in range(40)) and [i for r in parts for i in r.merged_from] == list(range(1, 40))


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocked_windows(spark, block):
    rnd = random.Random(block)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(12)]), i, rnd.choice([None, None, "x", "y", "z"]), rnd.randint(0, 3)) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, pos long, id long, v string, n int")
    got = {r.id: (r.last, r.before) for r in O.carry_last(O.carry_last(df, ["k"], "pos", ["id"], {"last": F.col("v")}, block=block), ["k"], "pos", ["id"], {"before": F.col("v")}, inclusive=False, block=block).collect()}
    sums = {r.id: (r.s, r.b) for r in O.running_sum(O.running_sum(df, ["k"], "pos", ["id"], {"s": F.col("n")}, block=block), ["k"], "pos", ["id"], {"b": F.col("n")}, inclusive=False, block=block).collect()}
    for k in ("a", "b", None):
        last, total = None, 0
        for _, _, i, v, n in sorted((r for r in rows if r[0] == k), key=lambda r: (-1 if r[1] is None else r[1], r[2])):
            before, had = last, total
            last, total = v or last, total + n
            assert got[i] == (last, before) and sums[i] == (total, had)


def chunk(doc, pos, heading, text, labels=("text",), page=1):
    return doc, pos, pos, heading, text, list(labels), page


def test_triage_precedence(spark):
    body = "This is the text of a section, long enough to be content."
    rows = [
        chunk("d", 0, "", body), chunk("d", 1, "", body + " toc", ["document_index", "text"]), chunk("d", 2, "1. Scope", body + "a"), chunk("d", 3, "odd", body + "b"), chunk("d", 4, "", "  \n "),
        chunk("d", 5, "", "Page header text here, long", ["page_header", "page_footer"]), chunk("d", 6, "", "short"), chunk("d", 7, "", "short", ["title"]), chunk("d", 8, "", "2. Applies"), chunk("d", 9, "GENERAL", body + "c"),
        *[chunk("d", 10 + i, "", "running footer of the book", page=i) for i in range(4)],
    ]
    c = spark.createDataFrame(rows, "doc_uuid string, pos long, id long, heading string, text string, labels array<string>, page int")
    valid = spark.createDataFrame([("d", "general", "General", 0)], "doc_uuid string, key string, heading string, first_pos long")
    got = {r.id: (r.action, r.heading_out, r.confidence) for r in G.triage(c, valid, G.boilerplate(c)).collect()}
    assert got[0] == ("review", "", "low") and got[1][0] == "skip" and got[2] == ("log", "1. Scope", "high") and got[3] == ("log", "1. Scope", "medium")
    assert got[4][0] == "skip" and got[5] == ("skip", "", "high") and got[6] == ("skip", "", "medium")
    assert got[7] == ("log", "1. Scope", "medium") and got[8] == ("log", "1. Scope", "medium") and got[9] == ("log", "General", "high")
    assert all(got[i][0] == "skip" for i in range(10, 14))
    s = G.triage_summary(G.triage(c, valid, G.boilerplate(c))).head()
    assert (s.total, s.n_review, s.auto_handled_pct) == (14, 1, 92.9)
    toc = spark.createDataFrame([("d", 0)], "doc_uuid string, pos long")
    with_toc = {r.id: (r.action, r.toc_match) for r in G.triage(c, valid, G.boilerplate(c), toc).collect()}
    assert with_toc[0][0] == "skip" and with_toc[2] == ("log", False) and with_toc[3] == ("log", False) and with_toc[9] == ("log", True)
    assert G.triage(c.limit(0), valid, G.boilerplate(c)).collect() == []


def test_toc_run_stops_at_text(spark):
    lines = "1. Scope ..... 1\n2. Terms ..... 2\n3. Rules ..... 3"
    rows = [chunk("d", 0, "", "before"), chunk("d", 1, "Contents", "no lines here"), chunk("d", 2, "", lines), chunk("d", 3, "", lines), chunk("d", 4, "", "plain text of the book"), chunk("d", 5, "", lines), chunk("e", 0, "", lines)]
    c = spark.createDataFrame(rows, "doc_uuid string, pos long, id long, heading string, text string, labels array<string>, page int")
    assert sorted((r.doc_uuid, r.pos) for r in T.toc_run(c).collect()) == [("d", 1), ("d", 2), ("d", 3)]
    entries = T.distinct_entries(T.toc_lines(c).where("doc_uuid = 'd'"), ["pos", "line_no"]).collect()
    assert sorted((r.title, r.page) for r in entries) == [("1. Scope", 1), ("2. Terms", 2), ("3. Rules", 3)]


POOL = ["1.2 Fuel system", "Fuel system", "Fuel sistem", "Fuel system – records", "Fuel system – recorbs", "GENERAL", "General.", "generel", "abcd", "abXcd", "ab", "Cabin crew", "Cabin crew – general provisions", "", "3. Scope", "odd", "Page 3", "Äußere Türen", "ÄUSSERE TÜREN", "aaaa aaaa", "aaaaaaaaa"]


def key_of(h):
    return re.sub(r"\s+", " ", h or "").strip().strip(" .:;-–—_·").casefold()


def firsts(chunks):
    """Distinct headings in their first spelling, in order."""
    seen = {}
    for r in chunks:
        if key_of(r[3]):
            seen.setdefault(key_of(r[3]), r[3])
    return list(seen.values())


def sequential(chunks, valid, repeated, toc=(), ratio=0.88):
    """The decisions of one document, chunk after chunk."""
    out, current, from_toc = {}, "", None
    alike = lambda a, b: bool(a and b) and (a == b or (len(a) >= 4 and len(b) >= 4 and (a in b or b in a)) or (ratio is not None and SequenceMatcher(None, a, b).ratio() >= ratio))
    for _, pos, i, heading, text, labels, _ in chunks:
        norm = re.sub(r"\s+", " ", text).strip()
        numbered = bool(re.match(r"\s*(\d+(\.\d+)*\.?)\s+\S", heading))
        if "document_index" in labels or pos in toc or not norm or norm.casefold() in repeated or len(norm) < 25:
            out[i] = ("skip", heading, None)
            continue
        match = next((v for v in valid if alike(key_of(heading), key_of(v))), None)
        if match:
            current, from_toc = match, True
        elif heading and numbered:
            current, from_toc = heading, False
        out[i] = ("log", current, from_toc) if current else ("review", heading, None)
    return out


@pytest.mark.parametrize("ratio,block", [(0.88, 20_000), (0.88, 3), (None, 20_000)])
def test_triage_against_a_loop(spark, ratio, block, monkeypatch):
    rnd = random.Random(block)
    rows, k = [], 0
    for d in (*(f"d{i}" for i in range(15)), None):
        for p in range(rnd.randint(0, 25)):
            k += 1
            rows.append((d, p, k, rnd.choice(POOL), rnd.choice(["short", "  ", *["This is text long enough to be content."] * 5]), rnd.choice([["text"]] * 6 + [["document_index"]]), rnd.choice([1, 2, None])))
    c = spark.createDataFrame(rows, "doc_uuid string, pos long, id long, heading string, text string, labels array<string>, page int")
    match = T.match_headings
    monkeypatch.setattr(G, "match_headings", lambda h, v, r: match(h, v, r, block))
    entries = G.collect_headings(c.where("page = 1"))
    valid = G.valid_headings(c)
    none = G.boilerplate(c).limit(0)
    plain = {r.id: (r.action, r.heading_out) for r in G.triage(c, valid, none, ratio=ratio).collect()}
    toc = {r.id: (r.action, r.heading_out, r.toc_match) for r in G.triage(c, entries, none, c.where("pos = 0").select("doc_uuid", "pos"), ratio=ratio).collect()}
    assert len(plain) == len(toc) == len(rows)
    furniture = lambda h: not h or bool(re.match(r"(?i)^page\s+\d+", h)) or not (3 <= len(h.strip(" .·•_-")) <= 160)
    for d in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == d]
        names = [h for h in firsts(own) if not furniture(h)]
        for i, (a, h, _) in sequential(own, names, set(), ratio=ratio).items():
            assert plain[i] == (a, h)
        for i, x in sequential(own, firsts([r for r in own if r[6] == 1]), set(), {0}, ratio).items():
            assert toc[i] == x


def test_heading_index_agrees_with_comparing_all():
    rnd = random.Random(6)
    letters = ["abcd", "abcdefgh –", "ab"]
    for n in range(150):
        base = ["".join(rnd.choices(letters[n % 3], k=rnd.randint(1, rnd.choice([5, 12, 40])))).strip() for _ in range(12)]
        def edited(x):
            x = list(x)
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(len(x) + 1)
                x[at : at + rnd.randint(0, 2)] = rnd.choices(letters[n % 3], k=rnd.randint(0, 2))
            return "".join(x).strip()
        keys = [edited(rnd.choice(base)) for _ in range(25)]
        keys = [k for k in keys if k]
        for ratio in (0.88, None, 0.7):
            index = T.HeadingIndex(keys, ratio)
            for h in [edited(rnd.choice(base)) for _ in range(25)] + keys:
                assert index.first(h) == next((i for i, k in enumerate(keys) if T.headings_match(h, k, ratio)), None), (h, keys, ratio)


def test_match_headings_edges(spark):
    v = spark.createDataFrame([("d", "fuel system", "Fuel system", 1), (None, "x", "X", 0), ("d", "", "", 0)], "doc_uuid string, key string, heading string, first_pos long")
    h = spark.createDataFrame([("d", "fuel sistem", 1), ("d", "fuel sistem", 2), (None, "x", 0), ("e", "fuel system", 0), ("d", "", 0), ("d", None, 0)], "doc_uuid string, key string, known int")
    got = sorted((str(r.doc_uuid), r.key, r.known, r.known_pos) for r in T.match_headings(h, v).collect())
    assert got == [("None", "x", "X", 0), ("d", "fuel sistem", "Fuel system", 1)]
    assert T.match_headings(h.limit(0), v).collect() == [] and T.match_headings(h, v.limit(0)).collect() == []


def test_versions_and_edits(spark):
    a = spark.createDataFrame([("d", 1, "log"), ("d", 2, "skip"), ("e", 3, "log")], "doc_uuid string, id long, action string")
    b = spark.createDataFrame([("d", 2, "skip"), ("d", 1, "log"), ("e", 3, "skip"), ("f", 4, "log")], "doc_uuid string, id long, action string")
    assert {r.doc_uuid for r in M.changed_documents(a, b, ["id", "action"]).collect()} == {"e", "f"}


def test_entries_in_steps_agree_with_the_expression(spark):
    from dossierflow.functions.text import toc_entry_from_cells

    rnd = random.Random(8)
    pool = ["1.2 Scope", "14", "p. 14.", "Section", "Title", "nan", "-", "", None, "1.2 Scope ......... 14", "Contents", "12", "A.", "x  3", "General"]
    rows = [(i, rnd.choices(pool, k=rnd.randint(0, 4))) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, cells array<string>")
    one = {r.id: tuple(r.e) if r.e else (None, None) for r in df.select("id", toc_entry_from_cells(F.col("cells")).alias("e")).collect()}
    assert {r.id: (r.title, r.page) for r in T.with_entries(df).collect()} == one
