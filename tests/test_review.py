"""The review chain, its payload, free-form and corpus replies, raw XML, images and persistence."""

import json

from pyspark.sql import functions as F

from dossierflow import models as L
from dossierflow.operators import layout as Y
from dossierflow.operators import runs as U
from dossierflow.operators import store as T
from dossierflow.operators.review import review
from dossierflow.sources import sinks, xmlpackage

BODY = "This is the text of a section, long enough to be content."
CHUNKS = "doc_uuid string, pos long, id long, heading string, text string, labels array<string>, page int"


def chunks(spark):
    rows = [("d", 0, 1, "1. Scope", BODY, ["title", "text"], 1), ("d", 1, 2, "", BODY + " More", ["text"], 2), ("d", 2, 3, "1. SCOPE", BODY, ["table"], 2), ("d", 3, 4, "", "", ["text"], 3), (None, 0, 5, "Terms", BODY, None, None)]
    return spark.createDataFrame(rows, CHUNKS)


def test_chain_from_chunks_to_payload(spark):
    r = review(chunks(spark))
    got = {x.doc_uuid: x for x in r.sections.collect()}
    assert got["d"].heading == "1. Scope" and got["d"].chunk_ids == [1, 2, 3] and got["d"].labels == ["title", "text", "table"] and got["d"].pages == [1, 2]
    assert got["d"].merged_text == "\n\n".join([BODY, BODY + " More", BODY]) and got[None].chunk_ids == [5]
    for part_chars in (10**6, 60):
        docs = sorted(sinks.payload_documents(r.payload.where("doc_uuid = 'd'"), part_chars).collect(), key=lambda x: x.part)
        loaded = [json.loads(x.payload) for x in docs]
        assert (len(docs) == 1) == (part_chars > 100)
        assert [h for x in loaded for h in x["merged_headings"]] == [{"heading": ["1. Scope"], "merged_text": got["d"].merged_text, "chunk_indices": [1, 2, 3], "types_of_docitem": ["title", "text", "table"], "page_nums": [1, 2]}]
        assert [h["status"] for x in loaded for h in x["raw_session_history"]] == ["logged (auto)"] * 3 + ["skipped"]
    assert review(chunks(spark).limit(0)).sections.collect() == []


class Failing:
    name = "down"

    def complete(self, prompt, system=""):
        raise OSError("no route")


class Saying:
    name = "said"

    def __init__(self, reply):
        self.reply, self.asked = reply, 0

    def complete(self, prompt, system=""):
        self.asked += 1
        return self.reply


def test_freeform_replies(spark):
    jobs = spark.createDataFrame([(1, "A", "text"), (2, None, None)], "row_id long, title string, text string")
    rows = {r.row_id: r for r in L.freeform(jobs, "Ask", lambda: L.FallbackModel(Failing(), Saying("free { text")), service="down").collect()}
    assert rows[1].response == rows[2].response == "free { text" and rows[1].service == "down" and rows[1].service_used == "said" and rows[1].fallback == "yes"
    rows = L.freeform(jobs, "Ask", lambda: L.FallbackModel(Failing())).collect()
    assert {(r.response, r.fallback) for r in rows} == {("[ERROR] no reply", "")}


def test_chains_are_not_asked_for_again(spark):
    prompts = spark.createDataFrame([(1, "p")], "row_id long, prompt string")
    assert L.is_chain("CS 1|a|b|c|d|e; CS 2|a") and not L.is_chain("text") and not L.is_chain("[a|b]") and not L.is_chain(" ; ")
    for reply, attempts in (("CS 1|a|b|c|d|e", 1), ("plain", 4), ('{"value": "x"}', 1)):
        assert [r.attempts for r in L.run_prompts(prompts, lambda reply=reply: L.FallbackModel(Saying(reply))).collect()] == [attempts]


def test_columns_in_one_call_or_each(spark):
    s = spark.createDataFrame([(1, "H", "body")], "row_id long, heading string, text string")
    ask = {"A": "first", "B c": "second"}
    assert [r.column_name for r in L.column_jobs(s, ask, True).collect()] == ["A", "B c"] and L.column_jobs(s, ask, False).count() == 1
    replies = spark.createDataFrame([(1, None, '{"A": "x", "B c": 2}'), (2, "A", '{"value": "y"}'), (3, "B c", "none"), (4, None, None)], "row_id long, column_name string, reply string")
    got = {(r.row_id, r.column_name): r.value for r in L.column_cells(replies, list(ask)).collect()}
    assert got == {(1, "A"): "x", (1, "B c"): "2", (2, "A"): "y", (3, "B c"): "[unparsed] none", (4, "A"): "[ERROR] no reply", (4, "B c"): "[ERROR] no reply"}


def test_analysis_of_a_corpus(spark):
    blocks = spark.createDataFrame([("e", 5, "two", 1), ("d", 0, "one", 3)], "doc_uuid string, at long, block string, sections_used int")
    r = L.analyse_corpus(blocks, "Why?", lambda: L.FallbackModel(Saying("because"))).collect()
    assert len(r) == 1 and r[0].result_text == "because" and json.loads(r[0].scope) == {"documents": ["d", "e"], "total_sections": 4}
    assert L.analyse_corpus(blocks.limit(0), "Why?", lambda: L.FallbackModel(Saying("x"))).collect() == []
    assert L.analyse_corpus(blocks, "Why?", lambda: L.FallbackModel(Failing())).collect() == []


def test_raw_json_keeps_everything(spark):
    xml = '<?xml version="1.0"?><w:doc xmlns:w="u" a="1"><w:p>x</w:p><w:p b="2"> y <i/> z </w:p><e/><t><![CDATA[<&>]]></t></w:doc>'
    assert xmlpackage.xml_to_dict(xml.encode()) == {"w:doc": {"@xmlns:w": "u", "@a": "1", "w:p": ["x", {"@b": "2", "i": None, "#text": "y  z"}], "e": None, "t": "<&>"}}
    deep = "<a>" * 3000 + "</a>" * 3000
    df = spark.createDataFrame([("p", bytearray(xml.encode())), ("q", bytearray(b"<a>")), ("r", None), ("s", bytearray(deep.encode()))], "path string, content binary")
    got = {r.path: r for r in xmlpackage.raw_json(df).collect()}
    assert json.loads(got["p"].json)["w:doc"]["@a"] == "1" and got["q"].json is None and got["q"].error and got["r"].error and got["s"].json.count("{") == 3000


def test_images_are_numbered(spark):
    def extractor():
        def extract(content):
            if content == b"bad":
                raise ValueError("broken")
            return [(3, b"png1", (0, 1, 2, 3)), (None, b"png2", None)]

        return extract

    df = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"bad"))], "path string, content binary")
    got = sorted(Y.extract_images(df, extractor).collect(), key=lambda r: (r.path, r.picture_no))
    assert [(r.path, r.file_name, r.page, r.bbox, r.error) for r in got] == [("a", "_page_3_picture_1.png", "3", [0.0, 1.0, 2.0, 3.0], None), ("a", "_page_unknown_picture_2.png", "unknown", None, None), ("b", None, None, None, "ValueError: broken")]
    assert bytes(got[0].data) == b"png1"


def test_results_in_every_format(spark, tmp_path):
    r = spark.createDataFrame([("T", "line 1\nline 2")], "title string, response string")
    for fmt in ("md", "txt", "csv", "json", "parquet"):
        sinks.write_results(r, f"{tmp_path}/{fmt}/out", fmt)
    assert "".join(x.value + "\n" for x in spark.read.text(f"{tmp_path}/md/out").collect()).startswith("## T\n\nline 1\nline 2\n")
    assert spark.read.text(f"{tmp_path}/txt/out").head().value == "=== T ==="
    assert sinks.read_sheet(spark, f"{tmp_path}/csv", "out", "csv").head().response == "line 1\nline 2"


def test_store_persists_and_resets(spark, tmp_path):
    store = T.TableStore(spark, str(tmp_path))
    doc = lambda *rows: spark.createDataFrame(rows, "doc_uuid string, doc_name string, status string, seq int")
    sec = lambda *rows: spark.createDataFrame(rows, "doc_uuid string, id long")
    T.persist_review(store, doc(("d", "n", "ok", 1), ("e", "m", None, 1)), sec(("d", 1), ("d", 2), ("e", 3)), ["seq"])
    assert T.persist_review(store, doc(("d", "n2", None, 2)), sec(("d", 9)), ["seq"]) == (2, 2)
    assert {tuple(r)[:3] for r in store.read("documents").collect()} == {("d", "n2", "ok"), ("e", "m", None)}
    assert {tuple(r) for r in store.read("sections").collect()} == {("d", 9), ("e", 3)}
    runs = lambda *xs: spark.createDataFrame([(x,) for x in xs], "t string")
    T.append_rows(store, "runs", runs("b", "a"), [F.col("t")], 3)
    T.append_rows(store, "runs", runs("c"), [F.col("t")], 3)
    assert sorted((r.id, r.t) for r in store.read("runs").collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert store.reset("runs") == 3 and store.read("runs").count() == 0 and store.read("runs", 2).count() == 3 and store.reset("none") is None


def test_sheets_of_unique_elements(spark, tmp_path):
    rows = spark.createDataFrame([(1, "S1", "References", "CS 25.1309;valve", "the valve"), (2, "S2", "Items", "pump;valve", "no")], "row_id long, section_title string, column_name string, cell string, reference string")
    titles = spark.createDataFrame([("t1", "CS 25.1309 Equipment"), ("t2", "Valves")], "title_id string, title string")
    names = U.write_uniques(rows, titles, str(tmp_path), "Run 1")
    assert names == ["Uniq Run 1", "Uniq Eval Run 1", "Ref Map Run 1"]
    got = {(r.value, r.matched_section, r.section_title) for r in sinks.read_sheet(spark, str(tmp_path), names[2]).collect()}
    assert got == {("CS 25.1309", "t1", "S1"), ("valve", "t2", "S1")}
    sheet = {(r.column_name, r.element): r.grounded for r in sinks.read_sheet(spark, str(tmp_path), names[1]).collect()}
    assert sheet == {("References", "CS 25.1309"): "False", ("References", "valve"): "True", ("References", "— COVERAGE —"): "1/2 (50.0%)", ("Items", "pump"): "False", ("Items", "valve"): "True", ("Items", "— COVERAGE —"): "1/2 (50.0%)"}


def test_edited_head_of_a_prompt(spark):
    df = spark.createDataFrame([(None,), ("\n---\nrest",), (" Mine \n---\nrest",)], "e string")
    assert [r.h for r in df.select(L.prompt_head(F.col("e"), F.lit("made")).alias("h")).collect()] == ["made", "made", "Mine"]


def test_chains_in_steps_agree_with_the_expression(spark):
    import random

    from dossierflow.functions.text import chain_fields
    from dossierflow.operators.entities import COMPONENTS, with_components

    rnd = random.Random(2)
    rows = [(i, rnd.choice("|-").join(rnd.choices(["", " a ", "#", "AC 1-2", "12 kg", "x"], k=rnd.randint(1, 9)))) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, chain string")
    one = {r.i: tuple(r.f) if r.f else None for r in df.select("i", chain_fields(F.col("chain")).alias("f")).collect()}
    steps = {r.i: tuple(r[c] for c in COMPONENTS) if r.reference else None for r in with_components(df, "chain").collect()}
    assert steps == one


def test_checkpoints_are_cleared(spark):
    from dossierflow.session import clear_checkpoints, ensure_checkpoint_dir, materialise

    folder = ensure_checkpoint_dir(spark)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    materialise(spark.range(3))
    assert len(fs.listStatus(path)) > 0
    clear_checkpoints(spark)
    assert len(fs.listStatus(path)) == 0 and materialise(spark.range(3)).count() == 3
