"""Deeply nested records to related flat tables (shared inlining).

Two distributed passes over the payloads. The first reports each record's
schema edges (parent element, child element, most occurrences in one parent);
their union is the schema graph, whose size is the number of distinct element
names, not of records. An element gets a table of its own if it is repeated,
shared by several parents or recursive; every other element is inlined into
the table of its nearest ancestor that has one. The second pass writes the
rows with the keys of their parents.

Objects whose keys are data (more than OPEN_CHILDREN distinct ones) become
tables of name-value pairs, so that the schema graph stays small.

Edge cases: a null payload gives no rows; one that is not a JSON object or
array gives one row of the table `_error`; nesting of any depth is read; an
empty table gives empty tables; a value of an unexpected kind is kept as JSON
text in a column of its own row; children held in an object, a list, a list
with nulls or a JSON string are read alike; extra columns of the input play no
part.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from json.decoder import scanstring

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.functions.arrowmap import map_rows

EDGE_SCHEMA = "parent string, child string, most long, n long, kinds int"
ROW_SCHEMA = "record_id long, table_name string, row_id long, parent_table string, parent_row_id long, path string, position long, name string, value string, columns map<string,string>"
ERROR_TABLE = "_error"
#: Distinct child names beyond which an object's keys are taken for data.
OPEN_CHILDREN = 1_000
#: Bits of the kinds of values met at an edge.
BOOL, LONG, DOUBLE, TEXT, NESTED = 1, 2, 4, 8, 16


@dataclass(frozen=True)
class NestedSpec:
    """How element names of the payload are read.

    `aliases` gives several keys one element type, `pairs` are elements that
    hold name-value pairs (as an object or as a list of objects with `name`
    and `value`), `label_keys` name the text of an object that stands for a
    single value (an image given as an object), and `forced` elements get a
    table whether they are repeated or not.
    """

    root: str = "record"
    aliases: dict[str, str] = field(default_factory=lambda: {"rules_hierarchy": "node", "children": "node", "attributes": "attribute", "extracted_images": "image"})
    pairs: frozenset[str] = frozenset({"attribute"})
    valued: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"image": ("file", "name", "path", "src", "filename", "image_path")})
    #: Types whose entries given as JSON text are parsed again.
    structured: frozenset[str] = frozenset({"node"})
    forced: frozenset[str] = frozenset({"node", "image"})
    bare_list: str = "rules_hierarchy"

    def type_of(self, key: str) -> str:
        return self.aliases.get(key, key)


@dataclass(frozen=True)
class SchemaGraph:
    """`tables` have rows of their own; `inlined` maps an element to the element it is a column of."""

    edges: dict[tuple[str, str], int]
    tables: frozenset[str]
    inlined: dict[str, str]
    recursive: frozenset[str]
    #: Bits of the value kinds of each edge.
    kinds: dict[tuple[str, str], int] = field(default_factory=dict)
    #: The spec with the objects whose keys turned out to be data.
    spec: NestedSpec = NestedSpec()

    def columns_of(self, table: str) -> dict[str, str]:
        """Inlined columns of a table (dotted names) with their types."""
        below: dict[str, list[str]] = {}
        for child, parent in self.inlined.items():
            below.setdefault(parent, []).append(child)
        out, todo = {}, [(table, "")]
        while todo:
            element, prefix = todo.pop()
            for child in sorted(below.get(element, ())):
                kinds = self.kinds.get((element, child), TEXT)
                if kinds & ~NESTED:
                    out[prefix + child] = _column_type(kinds & ~NESTED)
                todo.append((child, f"{prefix}{child}."))
        return dict(sorted(out.items()))


def _column_type(kinds: int) -> str:
    """The narrowest type that holds all kinds of values met."""
    return "boolean" if kinds == BOOL else "bigint" if kinds == LONG else "double" if kinds in (DOUBLE, LONG | DOUBLE) else "string"


_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_BLANKS = re.compile(r"[ \t\n\r]*")
_CONSTANTS = {"true": True, "false": False, "null": None, "NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}


def loads_deep(text: str):
    """json.loads without recursion, for nesting that the built-in reader gives up on; ValueError if invalid."""
    skip = lambda i: _BLANKS.match(text, i).end()
    opened: list = []  # containers being filled
    keys: list[str | None] = []
    i = skip(0)
    while True:
        # a value starts at i
        c = text[i : i + 1]
        if c == "{" or c == "[":
            opened.append({} if c == "{" else [])
            keys.append(None)
            i = skip(i + 1)
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                if c == "{":
                    i = _key(text, i, keys, skip)
                continue
            value, i = opened.pop(), i + 1
            keys.pop()
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        elif m := _NUMBER.match(text, i):
            value, i = (float if m[1] or m[2] else int)(m[0]), m.end()
        else:
            word = next((w for w in _CONSTANTS if text.startswith(w, i)), None)
            if word is None:
                raise ValueError(f"no value at {i}")
            value, i = _CONSTANTS[word], i + len(word)
        # the value is put where it belongs, and containers that end here with it
        while True:
            i = skip(i)
            if not opened:
                if i != len(text):
                    raise ValueError(f"more text at {i}")
                return value
            top = opened[-1]
            if isinstance(top, dict):
                top[keys[-1]] = value
            else:
                top.append(value)
            c = text[i : i + 1]
            if c == ",":
                i = skip(i + 1)
                if isinstance(top, dict):
                    i = _key(text, i, keys, skip)
                break
            if c != ("}" if isinstance(top, dict) else "]"):
                raise ValueError(f"no end at {i}")
            value, i = opened.pop(), i + 1
            keys.pop()


def _key(text: str, i: int, keys: list, skip) -> int:
    if text[i : i + 1] != '"':
        raise ValueError(f"no key at {i}")
    keys[-1], i = scanstring(text, i + 1, True)
    i = skip(i)
    if text[i : i + 1] != ":":
        raise ValueError(f"no colon at {i}")
    return skip(i + 1)


def dumps_deep(value) -> str:
    """json.dumps without recursion."""
    out, todo = [], [(False, value)]
    while todo:
        literal, x = todo.pop()
        if literal:
            out.append(x)
        elif isinstance(x, dict):
            todo.append((True, "}"))
            for k, (name, v) in reversed(list(enumerate(x.items()))):
                todo += [(False, v), (True, f"{', ' if k else ''}{json.dumps(name, ensure_ascii=False)}: ")]
            todo.append((True, "{"))
        elif isinstance(x, list):
            todo.append((True, "]"))
            for k, v in reversed(list(enumerate(x))):
                todo += [(False, v), (True, ", " if k else "")]
            todo.append((True, "["))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def _parse(text: str):
    try:
        return json.loads(text)
    except RecursionError:
        return loads_deep(text)


def _load(payload: str | None, spec: NestedSpec):
    if payload is None:
        return None
    try:
        value = _parse(payload)
    except ValueError:
        return None
    if isinstance(value, list):
        return {spec.bare_list: value}
    return value if isinstance(value, dict) else None


def _entries(kind: str, value, spec: NestedSpec) -> list[tuple[str | None, object]]:
    """The (name, value) entries of one element, whatever shape holds them."""
    if value is None:
        return []
    if kind in spec.pairs:
        if isinstance(value, dict):
            if set(value) == {"name", "value"} and not isinstance(value["value"], (dict, list)):
                return [(_text(value["name"]), value["value"])]
            return list(value.items())
        if isinstance(value, list):
            out = []
            for x in value:
                if isinstance(x, dict):
                    out.extend([(_text(x["name"]), x.get("value"))] if "name" in x else x.items())
            return out
        return []
    if kind in spec.structured and isinstance(value, str):
        try:
            value = _parse(value)
        except ValueError:
            return []
    if isinstance(value, list):
        return [(None, x) for x in value if x is not None]
    if kind in spec.structured and isinstance(value, dict) and value and all(isinstance(x, dict) for x in value.values()) and not any(k in spec.aliases or k == "element_type" for k in value):
        return [(k, x) for k, x in value.items()]
    return [(None, value)]


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return dumps_deep(value)


def _kind(value) -> int:
    if isinstance(value, (dict, list)):
        return NESTED if isinstance(value, dict) else TEXT
    return BOOL if isinstance(value, bool) else LONG if isinstance(value, int) and abs(value) < 1 << 63 else DOUBLE if isinstance(value, float) else TEXT


def schema_edges(payloads: DataFrame, spec: NestedSpec = NestedSpec()) -> DataFrame:
    """Distinct schema edges of column `payload` with the most occurrences in one parent and the kinds of values (bits)."""

    def of(payload: str | None) -> Iterator[tuple]:
        root = _load(payload, spec)
        if root is None:
            return
        found: dict[tuple[str, str], list[int]] = {}
        stack = [(spec.root, root)]
        while stack:
            kind, element = stack.pop()
            for key, value in element.items():
                child = spec.type_of(key)
                entries = _entries(child, value, spec)
                if not entries and not isinstance(value, list):
                    continue
                seen = found.setdefault((kind, child), [0, 0, 0])
                # a list is a repeated element even where it holds one entry
                seen[0] = max(seen[0], len(entries), 2 if isinstance(value, list) else 1)
                seen[1] += len(entries)
                # kinds are those of columns; pairs and forced tables have none
                if child not in spec.pairs and child not in spec.forced:
                    for _, x in entries:
                        seen[2] |= _kind(x)
                if child not in spec.pairs:
                    stack.extend((child, x) for _, x in entries if isinstance(x, dict))
        yield from ((p, c, *x) for (p, c), x in found.items())

    return map_rows(payloads.select("payload"), of, EDGE_SCHEMA).groupBy("parent", "child").agg(F.max("most").alias("most"), F.sum("n").alias("n"), F.bit_or("kinds").alias("kinds"))


def analyse(payloads: DataFrame, spec: NestedSpec = NestedSpec(), open_children: int = OPEN_CHILDREN) -> SchemaGraph:
    """The schema graph of all payloads, and which of its elements need tables.

    An element with more than `open_children` child names is an object whose
    keys are data: it is read as name-value pairs, and the graph is made again
    without what lies below it. What comes to the driver is bounded by the
    number of elements that are left times `open_children`.
    """
    fixed = {spec.root, *spec.structured, *spec.valued}
    while True:
        edges = schema_edges(payloads, spec)
        rows = edges.limit(open_children + 1).collect()
        if len(rows) <= open_children:
            break
        wide = edges.groupBy("parent").agg(F.count("*").alias("n")).where((F.col("n") > open_children) & ~F.col("parent").isin(*fixed))
        # a few at a time: what lies below an open object goes with it
        found = {r["parent"] for r in wide.orderBy(F.desc("n"), "parent").limit(100).collect()}
        if not found:
            rows = edges.collect()
            break
        spec = replace(spec, pairs=spec.pairs | found)
    return plan_tables({(r["parent"], r["child"]): r["most"] for r in rows}, spec, {(r["parent"], r["child"]): r["kinds"] for r in rows})


def plan_tables(edges: dict[tuple[str, str], int], spec: NestedSpec = NestedSpec(), kinds: dict[tuple[str, str], int] | None = None) -> SchemaGraph:
    children: dict[str, set[str]] = {}
    parents: dict[str, set[str]] = {}
    for p, c in edges:
        children.setdefault(p, set()).add(c)
        parents.setdefault(c, set()).add(p)

    def reach(start: str) -> set[str]:
        seen: set[str] = set()
        todo = list(children.get(start, ()))
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo.extend(children.get(x, ()))
        return seen

    elements = set(children) | set(parents)
    recursive = frozenset(e for e in elements if e in reach(e))
    repeated = {c for (_, c), most in edges.items() if most > 1}
    shared = {c for c, p in parents.items() if len(p) > 1}
    tables = frozenset({spec.root} | recursive | repeated | shared | (elements & (spec.pairs | spec.forced)))
    return SchemaGraph(dict(edges), tables, {c: next(iter(p)) for c, p in parents.items() if c not in tables}, recursive, kinds or {}, spec)


def shred(records: DataFrame, graph: SchemaGraph) -> DataFrame:
    """Rows of all tables of columns (record_id, payload).

    `row_id` is unique within the record; `path` is the dotted position among
    the parent's rows of the same type, from the top element of that type
    down; `position` its last part. `columns` holds the inlined descendants
    under their dotted names. For an element of name-value pairs or of plain
    values `name` and `value` are set.
    """
    tables, spec = graph.tables, graph.spec

    def of(record_id: int, payload: str | None) -> Iterator[tuple]:
        root = _load(payload, spec)
        if root is None:
            if payload is not None:
                yield record_id, ERROR_TABLE, 1, None, None, "", 1, None, "not a JSON object or array", {}
            return
        counter = 0
        out: list[tuple] = []
        # (kind, element, parent table, parent row, parent path of the same type, position, name)
        stack = [(spec.root, root, None, None, "", 1, None)]
        while stack:
            kind, element, parent_table, parent_row, path, position, name = stack.pop()
            counter += 1
            row, columns, todo = counter, {}, []
            own_path = f"{path}.{position}" if path else str(position)
            value = None
            if isinstance(element, dict) and kind not in spec.pairs:
                value = next((_text(element[k]) for k in spec.valued.get(kind, ()) if isinstance(element.get(k), str)), None)
                inline = [("", k, v) for k, v in element.items()]
                while inline:
                    prefix, key, held = inline.pop()
                    child = spec.type_of(key)
                    if child in tables:
                        entries = _entries(child, held, spec)
                        if child in spec.structured:
                            entries = [(n, x) for n, x in entries if isinstance(x, dict)]
                        below = own_path if child == kind else ("" if kind == spec.root else own_path)
                        todo.extend((child, x, kind, row, below, k + 1, n) for k, (n, x) in enumerate(entries))
                    elif isinstance(held, dict):
                        inline.extend((f"{prefix}{key}.", k, v) for k, v in held.items())
                    elif held is not None:
                        columns[f"{prefix}{key}"] = _text(held)
            else:
                value = _text(element)
            out.append((record_id, kind, row, parent_table, parent_row, own_path, position, name, value, columns))
            stack.extend(reversed(todo))
        yield from out

    return map_rows(records.select("record_id", "payload"), of, ROW_SCHEMA)


def flat_tables(rows: DataFrame, graph: SchemaGraph) -> dict[str, DataFrame]:
    """One DataFrame per table, with a foreign key to its parent's row and the inlined descendants as typed columns.

    A column's type is the narrowest that holds all values met under its name.
    """
    return {t: flat_table(rows, graph, t) for t in sorted(graph.tables)}


def flat_table(rows: DataFrame, graph: SchemaGraph, name: str) -> DataFrame:
    own = ["record_id", F.col("row_id").alias(f"{name}_id" if name != "record" else "record_row_id"), "parent_table", F.col("parent_row_id").alias("parent_id"), "path", "position", "name", "value"]
    # inlined names may clash with the keys' names, so they come behind the table's name; those that differ in case alone are numbered
    inlined, seen = [], {}
    for c, t in graph.columns_of(name).items():
        column = f"{name}__{c}".replace(".", "__").replace("`", "_")
        n = seen[column.lower()] = seen.get(column.lower(), 0) + 1
        inlined.append(F.try_element_at("columns", F.lit(c)).cast(t).alias(column if n == 1 else f"{column}_{n}"))
    return rows.where(F.col("table_name") == name).select(*own, *inlined)


def hierarchy_rows(records: DataFrame, spec: NestedSpec = NestedSpec()) -> DataFrame:
    """One row per node, per non-blank attribute and per image: record_id, node_path, row_kind, item_key.

    A row of an attribute or image holds its node's path already, since the
    paths of other types start with the path of the row they hang on.
    """
    rows = shred(records, analyse(records, spec))
    ustrip = r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$"
    present = F.regexp_replace(F.col("value"), ustrip, "") != ""
    flat = rows.where(F.col("table_name").isin("node", "attribute", "image")).where((F.col("table_name") == "node") | (F.col("parent_table") == "node")).where((F.col("table_name") == "node") | present)
    node_path = F.when(F.col("table_name") == "node", F.col("path")).otherwise(F.regexp_replace("path", r"\.[0-9]+$", ""))
    key = F.when(F.col("table_name") == "attribute", F.col("name")).when(F.col("table_name") == "image", F.col("value"))
    flat = flat.select("record_id", node_path.alias("node_path"), F.col("table_name").alias("row_kind"), key.alias("item_key"), "value")
    # the sdt-id of a node comes from its attribute rows: both are made by one task, so this is the only exchange
    sdt = F.max(F.when((F.col("row_kind") == "attribute") & (F.col("item_key") == "sdt-id"), F.col("value")))
    grouped = flat.groupBy("record_id", "node_path").agg(sdt.alias("sdt"), F.array_distinct(F.collect_list(F.struct("row_kind", "item_key"))).alias("items"))
    one = grouped.select("record_id", "node_path", "sdt", F.explode("items").alias("i"))
    return one.select("record_id", "node_path", F.col("i.row_kind").alias("row_kind"), F.when(F.col("i.row_kind") == "node", F.coalesce("sdt", F.lit(""))).otherwise(F.col("i.item_key")).alias("item_key"))
