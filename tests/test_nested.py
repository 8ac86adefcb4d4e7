"""Shredding of nested records: schema graph, tables, keys and odd shapes."""

import json

import pytest

from dossierflow.operators import nested as N


def frame(spark, payloads):
    return spark.createDataFrame([(i, p if p is None or isinstance(p, str) else json.dumps(p), "x") for i, p in enumerate(payloads, 1)], "record_id long, payload string, path string")


NODE = {"element_type": "topic", "attributes": {"sdt-id": "1", "title": "T", "Domain": None, "Keywords": "  "}, "extracted_images": ["a.png", "a.png", {"file": "b.png", "caption": "B"}], "children": [None, {"element_type": "leaf", "attributes": [{"name": "sdt-id", "value": "2"}, {"name": "x", "value": 5}]}]}


def found(spark, payloads):
    return sorted(tuple(r) for r in N.hierarchy_rows(frame(spark, payloads)).collect())


def test_rows_of_a_record(spark):
    assert found(spark, [{"rules_hierarchy": [NODE]}]) == [
        (1, "1", "attribute", "sdt-id"), (1, "1", "attribute", "title"), (1, "1", "image", "a.png"), (1, "1", "image", "b.png"), (1, "1", "node", "1"),
        (1, "1.1", "attribute", "sdt-id"), (1, "1.1", "attribute", "x"), (1, "1.1", "node", "2"),
    ]


def test_shapes_give_the_same_rows(spark):
    child = NODE["children"][1]
    shapes = [{"rules_hierarchy": [NODE]}, {"rules_hierarchy": NODE}, [NODE], {"rules_hierarchy": [dict(NODE, children=child)]}, {"rules_hierarchy": [dict(NODE, children=json.dumps([child]))]}, {"document_metadata": {"guid": "g"}, "rules_hierarchy": [dict(NODE, extracted_images=NODE["extracted_images"])]}]
    rows = found(spark, shapes)
    by = {}
    for r, *rest in rows:
        by.setdefault(r, []).append(tuple(rest))
    assert len(by) == len(shapes) and all(v == by[1] for v in by.values())


def test_bad_payloads_give_nothing(spark):
    assert found(spark, [None, "", "{", "[1, 2", "3", '"x"', "[]", "{}", {"rules_hierarchy": None}, {"rules_hierarchy": "no"}]) == []


def test_empty_table(spark):
    assert found(spark, []) == []


def test_schema_graph_decides_tables():
    edges = {("record", "document_metadata"): 1, ("document_metadata", "guid"): 1, ("record", "node"): 3, ("node", "node"): 2, ("node", "attribute"): 4, ("node", "image"): 1, ("node", "element_type"): 1}
    g = N.plan_tables(edges)
    assert g.tables == {"record", "node", "attribute", "image"}
    assert g.recursive == {"node"}
    assert g.inlined["document_metadata"] == "record" and g.inlined["guid"] == "document_metadata"
    plain = N.NestedSpec(forced=frozenset())
    assert N.plan_tables(edges, plain).inlined["image"] == "node" and "image" in N.plan_tables({**edges, ("node", "image"): 2}, plain).tables
    assert "guid" in N.plan_tables({**edges, ("node", "guid"): 1}).tables  # shared


def test_tables_keep_parent_links(spark):
    df = frame(spark, [{"document_metadata": {"guid": "g", "Domain": "D"}, "rules_hierarchy": [NODE]}])
    g = N.analyse(df)
    t = N.flat_tables(N.shred(df, g), g)
    record = t["record"].collect()
    assert (record[0]["record__document_metadata__guid"], record[0]["record__document_metadata__Domain"]) == ("g", "D")
    nodes = {r["path"]: r for r in t["node"].collect()}
    assert nodes["1"]["parent_table"] == "record" and nodes["1.1"]["parent_table"] == "node" and nodes["1.1"]["parent_id"] == nodes["1"]["node_id"]
    assert all(r["parent_id"] in {n["node_id"] for n in nodes.values()} for r in t["attribute"].collect())
    assert nodes["1"]["node__element_type"] == "topic"


def test_very_deep_record(spark):
    node = {"element_type": "leaf", "attributes": {"sdt-id": "z"}}
    for i in range(200):
        node = {"element_type": "t", "attributes": {"sdt-id": str(i)}, "children": [node]}
    assert len(found(spark, [{"rules_hierarchy": [node]}])) == 402


def test_an_image_alone_keeps_its_row(spark):
    node = {"element_type": "topic", "attributes": {"sdt-id": "1"}, "extracted_images": "p.png"}
    assert found(spark, [{"rules_hierarchy": node}]) == [(1, "1", "attribute", "sdt-id"), (1, "1", "image", "p.png"), (1, "1", "node", "1")]


def test_nesting_beyond_the_reader_of_the_library(spark):
    n = 4_000
    with pytest.raises(RecursionError):
        json.loads("[{\"a\":" * n * 5)
    text = '{"rules_hierarchy": ' + '{"element_type": "t", "children": [' * n + '{"attributes": {"sdt-id": "z"}}' + "]}" * n + "}"
    rows = found(spark, [text])
    assert len(rows) == n + 2 and sum(r[2] == "node" for r in rows) == n + 1
    n = 20_000
    odd = '{"rules_hierarchy": {"element_type": "t", "odd": ' + '{"a": [' * n + "1" + "]}" * n + "}}"
    assert [r[2] for r in found(spark, [odd])] == ["node"]


def test_iterative_reader_and_writer_agree_with_the_library():
    import math
    import random

    rnd = random.Random(3)

    def value(depth):
        k = rnd.randrange(9 if depth < 5 else 6)
        if k > 6:
            return [value(depth + 1) for _ in range(rnd.randrange(4))]
        if k == 6:
            return {rnd.choice("abcü\"\\"): value(depth + 1) for _ in range(rnd.randrange(4))}
        return [None, True, False, rnd.randrange(-9, 9), rnd.random() * 10 ** rnd.randrange(-20, 20), 'tä"x\n\\'][k]

    for _ in range(300):
        v = value(0)
        for text in (json.dumps(v), json.dumps(v, indent=2, ensure_ascii=False)):
            assert N.loads_deep(text) == v
        assert N.dumps_deep(v) == json.dumps(v, ensure_ascii=False)
    assert math.isnan(N.loads_deep(" NaN ")) and N.loads_deep('{"a": 1, "a": -Infinity}') == {"a": -math.inf}
    for bad in ("", "{", "[1,", "[1 2]", '{"a"}', '{"a":}', '{"a":1,}', "[,]", "01", "1x", "nul", '"a', '["a\n"]', "{1: 2}", "[1]]", "-", "[1}", '{"a": 1]'):
        for reader in (json.loads, N.loads_deep):
            with pytest.raises(ValueError):
                reader(bad)


def test_invalid_payloads_give_error_rows(spark):
    df = frame(spark, ["{", '{"rules_hierarchy": []}', None, '"x"'])
    rows = N.shred(df, N.analyse(df)).where("table_name = '_error'").collect()
    assert sorted(r["record_id"] for r in rows) == [1, 4]


def test_objects_whose_keys_are_data_become_pairs(spark):
    records = [{"index": {f"k{i}_{j}": {"v": j, f"w{i}_{j}": True} for j in range(30)}, "rules_hierarchy": [NODE]} for i in range(4)]
    df = frame(spark, records)
    g = N.analyse(df, open_children=40)
    assert "index" in g.spec.pairs and len(g.edges) < 40
    rows = N.shred(df, g).where("table_name = 'index'").collect()
    assert len(rows) == 120 and {r["name"] for r in rows} == {f"k{i}_{j}" for i in range(4) for j in range(30)}
    assert json.loads(next(r["value"] for r in rows if r["name"] == "k1_2")) == {"v": 2, "w1_2": True}


def test_columns_are_typed(spark):
    df = frame(spark, [{"m": {"n": 1, "f": 1, "b": True, "t": 1, "big": 2**70}}, {"m": {"n": 2, "f": 1.5, "b": False, "t": "x", "big": 1}}])
    g = N.analyse(df)
    assert g.columns_of("record") == {"m.b": "boolean", "m.big": "string", "m.f": "double", "m.n": "bigint", "m.t": "string"}
    got = {r["record_id"]: r for r in N.flat_table(N.shred(df, g), g, "record").collect()}
    assert (got[1]["record__m__n"], got[1]["record__m__f"], got[1]["record__m__b"], got[1]["record__m__t"], got[1]["record__m__big"]) == (1, 1.0, True, "1", str(2**70))
    assert got[2]["record__m__f"] == 1.5 and got[2]["record__m__b"] is False


def test_names_that_differ_in_case_are_numbered(spark):
    df = frame(spark, [{"m": {"Domain": "a", "domain": "b", "path": "c"}, "name": "d"}])
    g = N.analyse(df)
    t = N.flat_table(N.shred(df, g), g, "record")
    assert len({c.lower() for c in t.columns}) == len(t.columns) and not any("." in c for c in t.columns)
    r = t.select(*t.columns).head()
    assert (r["record__m__Domain"], r["record__m__domain_2"], r["record__m__path"], r["record__name"]) == ("a", "b", "c", "d")
