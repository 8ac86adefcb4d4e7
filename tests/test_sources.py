"""Archives, chunk caches, exports and the table store."""

import base64
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from dossierflow import models as L
from dossierflow.operators import graph as G
from dossierflow.operators import store as S
from dossierflow.operators import vectors as V
from dossierflow.sources import files, sinks, xmlpackage

PACKAGE = f"""<pkg:package xmlns:pkg="http://p" xmlns:w="http://w" xmlns:r="http://r" xmlns:a="http://a" xmlns:er="http://e" xmlns:pic="http://pic">
<pkg:part pkg:name="/word/_rels/document.xml.rels"><Relationships><Relationship Id="rId1" Target="https://example.org/x"/><Relationship Id="rId2" Target="media/image7.png"/></Relationships></pkg:part>
<pkg:part pkg:name="/word/media/image7.png"><pkg:binaryData>{base64.b64encode(b'pixels').decode()}</pkg:binaryData></pkg:part>
<pkg:part pkg:name="/customXml/item.xml"><er:document guid="g1" Domain="D" source-title="Rules"><er:toc><er:topic sdt-id="10" source-title=" First: topic "><er:topic sdt-id="11" Domain="X" other="no"/></er:topic></er:toc></er:document></pkg:part>
<pkg:part pkg:name="/word/document.xml"><w:body><w:p><w:t>before</w:t></w:p>
<w:sdt><w:sdtPr><w:id w:val="10"/></w:sdtPr><w:p><w:t>Hello</w:t><w:t> Hello </w:t><w:t>world</w:t></w:p><w:p><w:hyperlink r:id="rId1"><w:t>link</w:t></w:hyperlink><w:hyperlink><w:t>jump</w:t></w:hyperlink></w:p></w:sdt>
<w:sdt><w:sdtPr><w:id w:val="11"/></w:sdtPr><w:p><w:drawing><pic:cNvPr name="Picture 7"/><a:blip r:embed="rId2"/></w:drawing></w:p><w:p><w:t>Figure 1: Big plan of things</w:t></w:p><w:tbl><w:tr><w:tc><w:t>a</w:t></w:tc><w:tc><w:t>b</w:t></w:tc></w:tr><w:tr><w:tc/></w:tr></w:tbl></w:sdt>
</w:body></pkg:part></pkg:package>"""


@pytest.fixture
def archives(tmp_path):
    for name, entries in {"a.zip": {"__MACOSX/x.xml": "<no/>", "doc.xml": PACKAGE}, "sub/b.zip": {"x.txt": "none"}}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        with zipfile.ZipFile(p, "w") as z:
            for n, text in entries.items():
                z.writestr(n, text)
    (tmp_path / "c.zip").write_bytes(b"not a zip")
    return str(tmp_path)


def test_archives(spark, archives):
    facts = xmlpackage.read_archives(spark, archives)
    assert facts.where("kind = 'error'").count() == 2
    nodes = {r.sdt_id: r for r in xmlpackage.nodes(facts).collect()}
    assert nodes["10"].title == "First: topic" and nodes["10"].sanitized_name == "First_topic" and nodes["10"].lines == ["Hello", "world", "link", "jump"] and nodes["10"].n_links == 2
    assert nodes["11"].parent_id == "10" and nodes["11"].attributes == {"sdt-id": "11", "Domain": "X"} and nodes["11"].title == "topic_11" and nodes["11"].n_tables == 1
    assert [(r.text, r.target) for r in xmlpackage.links(facts).orderBy("pos").collect()] == [("link", "https://example.org/x"), ("jump", xmlpackage.DEFAULT_TARGET)]
    im = xmlpackage.images(facts).collect()
    assert [(r.sdt_id, bytes(r.data), r.image_no, r.file_name) for r in im] == [("11", b"pixels", 1, "Figure_1_Big_pl.png")]
    assert [(r.row_no, r.column_no, r.cell) for r in xmlpackage.tables(facts).orderBy("column_no").collect()] == [(0, 0, "a"), (0, 1, "b")]
    assert facts.where("kind = 'document'").head().attributes["guid"] == "g1"


def test_chunk_cache(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"chunks": [{"chunk_index": 1, "heading": [" "], "meta": {"headings": ["H"], "page_numbers": [2], "doc_items": [{"label": " Title "}]}, "text": "t"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"heading": ["X"], "chunk_text": "c", "text": "t", "type_of_docitem": ["Text"], "page_num": [1, 2]}]))
    (tmp_path / "c.json").write_text("{broken")
    got = sorted((r.heading, r.text, r.labels, r.pages, r.chunk_index) for r in files.chunk_cache(spark, str(tmp_path)).collect())
    assert got == [("H", "t", ["title"], [2], 1), ("X", "c", ["text"], [1, 2], 1)]
    found = files.find_files(spark, str(tmp_path), ".json", "b")
    assert [r.file_name for r in found.collect()] == ["b.json"]
    assert files.newest(files.find_files(spark, str(tmp_path), ".json")).head().path.endswith(".json")


def test_sheets(spark, tmp_path):
    book = str(tmp_path / "book")
    df = spark.createDataFrame([(1, 'a "q", x\n y ', ["z"]), (2, None, [])], "id int, section string, l array<string>")
    assert sinks.next_run(spark, book) == "Run 1"
    for name in ("Run 1", "Eval Run 1"):
        sinks.write_sheet(df, book, name, "csv")
    assert sinks.next_run(spark, book) == "Run 2" and sinks.evaluatable_sheets(spark, book, None) == ["Run 1"]
    assert [(r.id, r.section, r.l) for r in sinks.read_sheet(spark, book, "Run 1", "csv").orderBy("id").collect()] == [("1", 'a "q", x\n y ', '["z"]'), ("2", None, "[]")]
    with pytest.raises(ValueError):
        sinks.write_sheet(df, book, "x", "xlsx")


def test_store(spark, tmp_path):
    st = S.TableStore(spark, str(tmp_path))
    old = spark.createDataFrame([("a", "x", "s1", 1), ("b", "y", None, 1), (None, "n", None, 1)], "k string, v string, status string, created_at int")
    new = spark.createDataFrame([("a", None, None, 5, 1), ("a", "z", None, 6, 2), ("c", "w", "s", 7, 1)], "k string, v string, status string, created_at int, seq int")
    up = S.upsert(old, new, ["k"], ["seq"], coalesced=("status",))
    assert sorted(map(tuple, up.collect()), key=str) == [("a", "z", "s1", 1), ("b", "y", None, 1), ("c", "w", "s", 7), (None, "n", None, 1)]
    assert sorted(map(tuple, S.upsert(up, new, ["k"], ["seq"], coalesced=("status",)).collect()), key=str) == sorted(map(tuple, up.collect()), key=str)  # idempotent
    assert S.upsert(old, new.limit(0), ["k"], ["seq"]).count() == 3
    assert st.read("t") is None and st.write("t", old) == 1 and st.write_if_changed("t", old) == 1 and st.write_if_changed("t", up) == 2
    assert st.read("t", 1).count() == 3 and st.read("t").count() == 4
    assert sorted(r.k for r in S.replace_partition(up.where("k is not null"), up.where("k = 'a'"), "k").collect()) == ["a", "b", "c"]


def test_ids_and_rate_window(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    got = S.with_new_ids(df, [F.col("x")], 50, 5).collect()
    assert sorted((r.x, r.id) for r in got) == [(i, 51 + i) for i in range(1000)]
    calls = spark.createDataFrame([(i, t) for i, t in enumerate([0, 10, 60, 61, 200, 200])], "i int, s int").select("i", F.timestamp_seconds("s").alias("ts"))
    assert {r.i: r.calls_in_window for r in S.rate_window(calls, "ts", 60).collect()} == {0: 1, 1: 2, 2: 3, 3: 3, 4: 2, 5: 2}


def test_graph(spark):
    nodes = [{"attributes": {"sdt-id": "1", "source-title": "AMC 1 Fuel", "Domain": "D; "}, "text_content": "abc", "hyperlinks": [{"text": "see amc 2 oil now", "target": "#t"}, {"text": "outside", "target": None}, {"text": " "}, {"text": "outside"}]}, {"attributes": {"sdt-id": "2", "source-title": "AMC 2 Oil"}}]
    g = G.topic_graph(spark.createDataFrame([(1, json.dumps(nodes)), (2, None), (3, "{")], "record_id long, payload string")).collect()
    assert sorted((r.kind, r.node_id, r.other, r.relation) for r in g if r.kind == "edge") == [("edge", "AMC 1 Fuel", "AMC 2 Oil", "#t"), ("edge", "AMC 1 Fuel", "outside", "Unknown Target")]
    assert {(r.node_id, r.domain, r.text_size) for r in g if r.kind != "edge"} == {("AMC 1 Fuel", "D", 3), ("AMC 2 Oil", "Unknown", 0), ("outside", "External Reference", 0)}


def test_link_targets_against_all_pairs():
    import random

    rnd = random.Random(4)
    for _ in range(300):
        words = ["a", "B", "ab", "c", "abc", "Ca"]
        titles = [" ".join(rnd.choices(words, k=rnd.randint(1, 4))) for _ in range(rnd.randint(0, 8))]
        texts = {" ".join(rnd.choices(words, k=rnd.randint(1, 4))) for _ in range(rnd.randint(1, 6))}
        found = G.LinkTargets(titles, texts)
        ranked = sorted(titles, key=len, reverse=True)
        for text in texts:
            for source in [*titles, "none"]:
                want = next((t for t in ranked if t != source and (t.lower() in text.lower() or text.lower() in t.lower())), None)
                assert found.of(text, source) == want


def test_model_seam(spark):
    class Broken:
        name = "broken"

        def complete(self, prompt, system=""):
            raise RuntimeError

    assert L.FallbackModel(Broken(), L.EchoModel()).complete_named("a\n---\nb c")[1:] == ("echo", True)
    assert L.FallbackModel(Broken()).complete_named("x") == (None, None, False)
    df = spark.createDataFrame([('say {"value": "v"} ok',), ("A|b|#|#|#|#",), ("prose",), (None,), ('{"value": }',)], "r string")
    assert [r.c for r in df.select(L.cell_value(F.col("r")).alias("c")).collect()] == ["v", "A|b|#|#|#|#", "[unparsed] prose", "[ERROR] no reply", '[unparsed] {"value": }']
    toc = spark.createDataFrame([('x [{"title": " A ", "page": "3"}, {"name": "B", "page_number": "x"}, {"page": 1}] y',), ("none",)], "r string").select(L.toc_from_reply(F.col("r")).alias("t")).collect()
    assert [[(e.title, e.page) for e in r.t] for r in toc] == [[("A", 3), ("B", None)], []]

    def embed(ts):
        if len(ts) > 2 or "bad" in ts:
            raise ValueError
        return [[1.0]] * len(ts)

    assert set(L.embed_with_ladder(["a", "bad", "b", "a", " "], embed, batch=2)) == {"a", "b"}
    assert L.halving(["a", "b", "c"], lambda ts: [[float(len(t))] for t in ts] if len(ts) < 2 else []) == [[1.0], [1.0], [1.0]]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [-2.0, 0.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, 1.0, -1.0]
