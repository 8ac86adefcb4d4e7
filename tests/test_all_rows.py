"""Queries over rows of every script, against brute force on a small multilingual fixture."""

from dossierflow.plans.documents import documents
from dossierflow.plans.evaluation import evaluation
from dossierflow.plans.layouts import layouts

WORDS = ['Fuel "A" <b> & [x]', " Топливный  насос\nи клапан ", "運航者は\t試験する", "Ελέγχει; το σύστημα", "ทดสอบ] หน้ากาก", "परीक्षण\r\n; मास्क", "C:\\dir;öl\\n", "12 %;a.b", "bell\x07 and \x0c feed", " ", "", None]
PAIRS = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in WORDS for b in WORDS)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def tables(spark, d):
    spark.createDataFrame([(i, a, b, i * 300) for i, a, b in PAIRS], "id long, heading string, text string, ordinal long").write.parquet(f"{d}/sections.parquet")
    spark.createDataFrame(PAIRS, "item_row_id long, item string, best_ref_sentence string").write.parquet(f"{d}/eval_items.parquet")


def test_every_row_is_read(spark, tmp_path):
    d = str(tmp_path)
    tables(spark, d)
    legal = lambda x: "".join(c for c in x or "" if c >= " " or c in "\t\n\r").strip()
    got = {r.id: (r.title, r.text_content, r.n_links) for r in documents.plans["xml_packages"](spark, d).collect()}
    assert got == {i: (legal(a), legal(b), 1) for i, a, b in PAIRS if legal(a) and legal(b)}
    got = {r.id: (r.title, r.raw) for r in documents.plans["model_toc"](spark, d).collect()}
    assert got == {i: (a.strip(), i * 300 % 20000) for i, a, _ in PAIRS if a and a.strip()}
    got = {r.item_row_id: r["items"] for r in layouts.plans["reply_lists"](spark, d).collect()}
    assert got == {i: " ¦ ".join(x.strip() for x in a.split(";") if x.strip()) for i, a, _ in PAIRS if a is not None}
    got = {r.row_id: r.distance for r in evaluation.plans["levenshtein_all"](spark, d).collect()}
    assert got == {i: distance(a, b) for i, a, b in PAIRS if a is not None and b is not None}
