"""Printed contents, tables, literal lists, conversion and whole runs."""

from pyspark.sql import functions as F

from dossierflow.operators import layout as Y
from dossierflow.operators import runs as U


def test_printed_contents(spark):
    entry = "\n".join(f"{i}. Title {chr(64 + i)} ..... {i}" for i in range(1, 5))
    pages = [("a", 1, "cover"), ("a", 2, "x\nTable of Contents\n" + entry), ("a", 3, entry.replace("Title", "More") + "\n1. Title A .... 9"), ("a", 4, "plain"), ("a", 5, entry.replace("Title", "Late")), ("b", 1, "Contents\n1. Only ..... 1"), ("c", 30, "Contents\n" + entry)]
    got = Y.printed_contents(spark.createDataFrame(pages, "doc_uuid string, page_no int, text string")).collect()
    assert len(got) == 8 and {r.doc_uuid for r in got} == {"a"} and not any("Late" in r.title for r in got)
    outline = spark.createDataFrame([("a", i, f" t{i} ", i) for i in range(4)] + [("b", 1, "x", 1)], "doc_uuid string, pos int, title string, page int")
    both = Y.outline_or_printed(outline, Y.printed_contents(spark.createDataFrame(pages, "doc_uuid string, page_no int, text string")))
    assert {(r.doc_uuid, r.source) for r in both.collect()} == {("a", "pdf-bookmarks")}


def test_tables_and_lists(spark):
    t = spark.createDataFrame([("d", 1, ["1. Scope", "4"], [["a", None]]), ("d", 2, ["Section", "Title"], [["b", "c"]]), ("d", 3, None, None)], "doc_uuid string, table_index int, header array<string>, records array<array<string>>")
    assert sorted((r.table_index, r.cells) for r in Y.table_rows(t).collect()) == [(1, ["1. Scope", "4"]), (1, ["a", ""]), (2, ["b", "c"])]
    n = spark.createDataFrame([(["a", "b", "a", "a"],)], "n array<string>").select(Y.numbered_names(F.col("n")).alias("n")).head().n
    assert n == ["a", "b", "a_1", "a_2"]
    df = spark.createDataFrame([(1, "x ['a', ' b ', ''] y"), (2, "none"), (3, None), (4, "[open")], "id long, r string")
    assert {r.id: r["items"] for r in Y.literal_lists(df, "id", "r").collect()} == {1: ["a", "b"], 2: [], 3: [], 4: []}
    assert [r.l for r in df.select(Y.string_list_from_reply(F.lit('so ["a", " b "] ok')).alias("l")).limit(1).collect()] == [["a", "b"]]


def test_first_match_and_conversion(spark):
    df = spark.createDataFrame([("g", 1, 1, "none"), ("g", 2, 2, "Fuel x"), ("g", 3, 3, "after"), ("h", 1, 4, "fuel last")], "k string, pos long, id long, t string")
    assert sorted((r.k, r.t, r.next_text) for r in Y.first_match(df, ["k"], "pos", "id", "t", ["FUEL"]).collect()) == [("g", "Fuel x", "after"), ("h", "fuel last", None)]
    files = spark.createDataFrame([("a", b"one\ftwo"), ("b", b"\xff")], "path string, content binary")
    got = Y.convert_files(files, lambda: lambda c: c.decode("utf8").split("\f")).orderBy("path", "page_no").collect()
    assert [(r.path, r.page_no, r.text) for r in got] == [("a", 1, "one"), ("a", 2, "two"), ("b", 0, None)] and got[2].error.startswith("UnicodeDecodeError")
    models = spark.createDataFrame([("chat",), ("text-embed-b",), ("e5-large",)], "name string")
    assert Y.pick_embedding_model(models, ["embed"]) == "text-embed-b" and Y.pick_embedding_model(models, ["zz"]) == "e5-large" and Y.pick_embedding_model(models.limit(0), ["zz"]) == "zz"


def test_run(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Sec A", "Items", "fuel pump;missing thing"), (2, " sec a ", "Items", None), (3, "Nope", "Items", "x"), (4, "Sec A", "Model Used", "m")], "row_id long, section_title string, column_name string, cell string")
    refs = spark.createDataFrame([("Sec A", "The fuel pump works. It stops at 2.5 bar. Another one.", 1), ("Sec A", "later", 2)], "section_title string, text string, pos long")
    r = U.evaluate_run(rows, refs, ["jaccard", "rougeL", "levenshtein_distance"])
    assert tuple(r.summary.head()) == (1, 2, 33.3)
    best = {x.item: (x.best_sentence, x.best_no) for x in r.by_metric["jaccard"].collect()}
    assert best["fuel pump"] == ("The fuel pump works.", 1) and "x" not in best
    assert {x.item for x in r.by_metric["rougeL"].collect()} == {"fuel pump", "missing thing"}
    names = U.write_run(r, str(tmp_path / "b"), "Run 1")
    assert names == ["Eval Run 1", "Jac Run 1", "RL Run 1", "Lev Run 1"] or set(names) == {"Eval Run 1", "Jac Run 1", "RL Run 1", "Lev Run 1"}
    assert U.wanted_metrics(["distance", "jaccard"]) == ["jaccard", "levenshtein_distance", "similarity_ratio", "word_error_rate"]
    ref_rows = spark.createDataFrame([(1, "c", "a;A;b", "has a")], "row_id long, column_name string, cell string, reference string")
    assert sorted((x.element, x.n, x.is_grounded) for x in U.unique_sheet(ref_rows).collect()) == [("A", 1, True), ("a", 1, True), ("b", 1, False)]
