"""Topic graph of structured documents: nodes, link edges and external references.

A record's links are compared with the titles of that record only. One payload
is one row, so the comparison runs inside its task: of the titles that hold the
link text, or are held by it, the longest is the target. Two automata find
them, of the titles over the links and of the links over the titles, so that a
record costs what its texts are long and not links times titles.

Edge cases: links without text and nodes without title or id are left out; a
node never links to its own title; repeated edges and nodes come once per
record; payloads that are not JSON give nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.functions.arrowmap import map_rows
from dossierflow.operators.hierarchy import entry_blocks, interval_blocks
from dossierflow.operators.nested import NestedSpec, _entries, _load, _text

GRAPH_SCHEMA = "record_id long, kind string, node_id string, other string, relation string, domain string, content_type string, text_size int"


def walk_nodes(payload: str | None, spec: NestedSpec = NestedSpec()) -> Iterator[tuple[dict, dict, str, int]]:
    """(node, attributes, dotted path, depth) of every node, parents first."""
    root = _load(payload, spec)
    if root is None:
        return
    top = next((v for k, v in root.items() if spec.type_of(k) == "node"), None)
    stack = [(x, str(i), 1) for i, (_, x) in enumerate([e for e in _entries("node", top, spec) if isinstance(e[1], dict)], 1)][::-1]
    while stack:
        node, path, depth = stack.pop()
        attributes = {k: _text(v) for k, v in _entries("attribute", node.get("attributes"), spec) if k}
        yield node, attributes, path, depth
        below = [x for _, x in _entries("node", node.get("children"), spec) if isinstance(x, dict)]
        stack.extend(reversed([(x, f"{path}.{i}", depth + 1) for i, x in enumerate(below, 1)]))


class LinkTargets:
    """For each link text the titles it matches, best first: longest, then first."""

    def __init__(self, titles: list[str], texts: set[str]):
        import ahocorasick

        #: distinct titles by length, the longest first
        self.ranked = sorted(dict.fromkeys(titles), key=len, reverse=True)
        held, holding = ahocorasick.Automaton(), ahocorasick.Automaton()
        for rank, title in enumerate(self.ranked):
            low = title.lower()
            held.add_word(low, [*(held.get(low) if low in held else []), rank])
        for text in texts:
            holding.add_word(text.lower(), text.lower())
        for automaton in (held, holding):
            if len(automaton):
                automaton.make_automaton()
        #: two are enough: a node never links to its own title
        self.best: dict[str, list[int]] = {}
        if len(holding):
            for rank, title in enumerate(self.ranked):
                for _, text in holding.iter(title.lower()):
                    own = self.best.setdefault(text, [])
                    if len(own) < 2 and rank not in own:
                        own.append(rank)
        for low in {t.lower() for t in texts} if len(held) else ():
            ranks = {*self.best.get(low, ()), *(r for _, rs in held.iter(low) for r in rs)}
            self.best[low] = sorted(ranks)[:2]

    def of(self, text: str, source: str) -> str | None:
        return next((self.ranked[r] for r in self.best.get(text.lower(), ()) if self.ranked[r] != source), None)


def topic_graph(records: DataFrame) -> DataFrame:
    """Rows of kind `topic`, `external` and `edge`; for an edge node_id is its source and other its target."""

    def rows(record_id: int, payload: str | None) -> Iterator[tuple]:
        topics: dict[str, tuple] = {}
        for node, a, _, _ in walk_nodes(payload):
            title, key = (a.get("source-title") or "").strip(), a.get("sdt-id") or _text(node.get("id"))
            if title and key:
                links = [x for x in node.get("hyperlinks") or [] if isinstance(x, dict)] if isinstance(node.get("hyperlinks"), list) else []
                text = node.get("text_content")
                topics[key] = (title, (a.get("Domain") or "Unknown").strip("; "), (a.get("TypeOfContent") or "General").strip("; "), links, len(text) if isinstance(text, str) else 0)
        known = {t[0] for t in topics.values()}
        texts = {(_text(link.get("text")) or "").strip() for t in topics.values() for link in t[3]} - {""}
        targets = LinkTargets([t[0] for t in topics.values()], texts) if texts else None
        external: set[str] = set()
        edges: set[tuple[str, str, str]] = set()
        for title, domain, content, links, size in topics.values():
            yield record_id, "topic", title, None, None, domain, content, size
        for title, _, _, links, _ in topics.values():
            for link in links:
                text, target = (_text(link.get("text")) or "").strip(), (_text(link.get("target")) or "Unknown Target").strip()
                if not text:
                    continue
                hit = targets.of(text, title)
                if hit is None and text not in external and text not in known:
                    external.add(text)
                    yield record_id, "external", text, None, None, "External Reference", "Hyperlink Fragment", 0
                edge = (title, hit or text, target)
                if edge not in edges:
                    edges.add(edge)
                    yield (record_id, "edge", *edge, None, None, None)

    return map_rows(records.select("record_id", "payload"), rows, GRAPH_SCHEMA)


NODE_SCHEMA = "record_id long, ordinal int, path string, depth int, sdt_id string, element_type string, title string, text_length int, n_links int, n_images int, n_children int, preview string"


def node_index(records: DataFrame) -> DataFrame:
    """One row per node in document order, with depth, title, text preview and counts."""

    def rows(record_id: int, payload: str | None) -> Iterator[tuple]:
        spec = NestedSpec()
        for k, (node, a, path, depth) in enumerate(walk_nodes(payload)):
            text = node.get("text_content")
            text = text if isinstance(text, str) else ""
            kind = _text(node.get("element_type")) or ""
            links = node.get("hyperlinks")
            yield record_id, k, path, depth, a.get("sdt-id"), kind, a.get("source-title") or a.get("title") or kind, len(text), len(links) if isinstance(links, list) else 0, len(_entries("image", node.get("extracted_images"), spec)), len([x for _, x in _entries("node", node.get("children"), spec) if isinstance(x, dict)]), text[:200].replace("\n", " ")

    return map_rows(records.select("record_id", "payload"), rows, NODE_SCHEMA)


def hierarchy_sections(records: DataFrame) -> DataFrame:
    """Section rows of the hierarchies: ordinal, node id (made up where missing), parent, level, heading and text."""
    schema = "record_id long, ordinal int, node_id string, parent_node_id string, level int, heading string, text string, n_images int"

    def rows(record_id: int, payload: str | None) -> Iterator[tuple]:
        ids: dict[str, str] = {}
        for k, (node, a, path, depth) in enumerate(walk_nodes(payload)):
            own = _text(node.get("node_id")) or _text(node.get("id")) or a.get("sdt-id") or f"node_{k}"
            ids[path] = own
            parent = ids.get(path.rpartition(".")[0])
            text = node.get("text_content")
            yield record_id, k, own, parent, depth, a.get("source-title") or a.get("title") or _text(node.get("element_type")) or "", text if isinstance(text, str) else "", len(_entries("image", node.get("extracted_images"), NestedSpec()))

    return map_rows(records.select("record_id", "payload"), rows, schema)


def references_by_title(sections: DataFrame) -> DataFrame:
    """(record_id, title, text): the first node of each title."""
    return sections.groupBy("record_id", F.col("heading").alias("title")).agg(F.min_by("text", "ordinal").alias("text"))


def document_summary(index: DataFrame) -> DataFrame:
    """Totals of each record and its most common element type."""
    kinds = index.groupBy("record_id", "element_type").agg(F.count("*").alias("n"))
    most = kinds.groupBy("record_id").agg(F.max_by("element_type", F.struct(F.col("n"), F.col("element_type"))).alias("most_common"), F.count("*").alias("n_types"))
    totals = index.groupBy("record_id").agg(F.count("*").alias("n_nodes"), F.sum("n_links").alias("n_links"), F.sum("n_images").alias("n_images"), F.sum("text_length").alias("n_chars"), F.max("depth").alias("max_depth"))
    return totals.join(most, "record_id")


def search_with_ancestors(nodes: DataFrame, matched: DataFrame) -> DataFrame:
    """Nodes (with tour, entry, size) that match or have a descendant that does; `matched` has tour and entry.

    A node is wanted if some match's entry lies in its interval: an equi-join on
    the aligned blocks of the intervals, without recursion.
    """
    blocks = interval_blocks(nodes, F.col("entry"), F.col("entry") + F.col("size") + 1)
    hit = entry_blocks(matched.select("tour", "entry"), blocks).select("tour", "level", "block").distinct()
    return blocks.join(hit, ["tour", "level", "block"], "left_semi").select(*nodes.columns).distinct()
