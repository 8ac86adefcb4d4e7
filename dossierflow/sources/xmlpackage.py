"""Zipped XML packages: nodes, links, texts, images and tables of rule documents.

Each archive is read in one pass of its own, archives in parallel. A row is
one fact: kind, sdt_id of the node it belongs to, position in the document,
and what the kind needs. A fact belongs to the node whose content control was
opened last (it stays open until the next one), as the documents are laid out.

Edge cases: an archive without XML, broken archives and broken XML give one
row of kind `error`; elements before the first content control belong to no
node and are left out; empty text runs are left out; an unknown relationship
gives the default target.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.parsers import expat

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossierflow.functions import text as X
from dossierflow.functions.arrowmap import map_rows
from dossierflow.operators.nested import dumps_deep

FACTS = "path string, kind string, pos long, sdt_id string, parent_id string, name string, value string, target string, attributes map<string,string>, grid array<array<string>>, data binary"
DEFAULT_TARGET = "Internal Jump Link"
#: Attributes that a node keeps (fixed values).
NODE_ATTRIBUTES = (
    "sdt-id", "source-title", "ERulesId", "Domain", "ActivityType", "AircraftUse", "AircraftCategory", "AmendedBy", "ApplicabilityDate", "EntryIntoForceDate", "EquivalentForeignRegulation",
    "ICAOReference", "Keywords", "RegistryState", "RegulatedEntity", "RegulatorySource", "RegulatorySubject", "TechnicalSubjectMatter", "TypeOfContent", "ParentIR", "EASACategory", "title",
)
DOCUMENT_FIELDS = ("guid", "pub-time", "source-title", "Domain")


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _attr(element: ET.Element, name: str) -> str | None:
    """An attribute by its local name, whatever its namespace."""
    if name in element.attrib:
        return element.attrib[name]
    return next((v for k, v in element.attrib.items() if _local(k) == name), None)


def _texts(element: ET.Element) -> list[str]:
    return [e.text for e in element.iter() if _local(e.tag) == "t" and e.text]


def package_facts(path: str, xml: bytes) -> Iterator[tuple]:
    """Facts of one flat XML package."""
    root = ET.fromstring(xml)
    pos = 0

    def fact(kind, sdt=None, parent=None, name=None, value=None, target=None, attributes=None, grid=None, data=None):
        nonlocal pos
        pos += 1
        return path, kind, pos, sdt, parent, name, value, target, attributes, grid, data

    parts = {(_attr(p, "name") or ""): p for p in root.iter() if _local(p.tag) == "part"}
    rels: dict[str, str] = {}
    for name, part in parts.items():
        if name.endswith(".xml.rels"):
            for r in part.iter():
                if _local(r.tag) == "Relationship" and _attr(r, "Id"):
                    rels[_attr(r, "Id")] = _attr(r, "Target") or ""
        elif "/word/media/" in name:
            data = next((e.text for e in part.iter() if _local(e.tag) in ("stringData", "binaryData") and e.text), None)
            yield fact("media", name=name, value=data)
    rules = next((e for e in root.iter() if _local(e.tag) == "document" and any(_attr(c, "sdt-id") for c in e.iter())), None)
    nodes: set[str] = set()
    if rules is not None:
        yield fact("document", attributes={k: (_attr(rules, k) or "") for k in DOCUMENT_FIELDS})
        stack: list[tuple[ET.Element, str | None]] = [(rules, None)]
        while stack:
            e, parent = stack.pop()
            own = _attr(e, "sdt-id")
            if own and own not in nodes:
                nodes.add(own)
                kept = {a: e.attrib[a].strip() for a in NODE_ATTRIBUTES if e.attrib.get(a, "").strip()}
                yield fact("node", own, parent, name=_local(e.tag), attributes=kept)
            elif own and parent:
                yield fact("edge", own, parent)
            # only a direct parent with an id counts as the parent of a node
            stack.extend((c, own) for c in reversed(list(e)))
    for rid, target in rels.items():
        yield fact("rel", name=rid, target=target)
    body = parts.get("/word/document.xml")
    active = None
    for e in body.iter() if body is not None else ():
        tag = _local(e.tag)
        if tag == "sdt":
            known = next((_attr(x, "val") for p in e.iter() if _local(p.tag) == "sdtPr" for x in p if _local(x.tag) == "id"), None)
            active = known if known in nodes else active
        if active is None:
            continue
        if tag == "t" and e.text and e.text.strip():
            yield fact("text", active, value=e.text.strip())
        elif tag == "p":
            yield fact("block", active, value=" ".join(_texts(e)).strip())
        elif tag == "hyperlink":
            if text := "".join(_texts(e)).strip():
                yield fact("link", active, name=_attr(e, "id"), value=text)
        elif tag == "drawing":
            alt = next((_attr(x, "name") for x in e.iter() if _local(x.tag) in ("cNvPr", "docPr") and _attr(x, "name")), None)
            for blip in (x for x in e.iter() if _local(x.tag) == "blip"):
                if embed := _attr(blip, "embed"):
                    yield fact("image", active, name=embed, value=alt)
        elif tag == "imagedata" and _attr(e, "id"):
            yield fact("image", active, name=_attr(e, "id"))
        elif tag == "tbl":
            grid = [[" ".join(_texts(c)).strip() for c in r.iter() if _local(c.tag) == "tc"] for r in e.iter() if _local(r.tag) == "tr"]
            yield fact("table", active, grid=[r for r in grid if any(r)])


def first_xml(archive: bytes) -> bytes | None:
    """The first XML entry of a zip archive, system folders aside."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        name = next((n for n in z.namelist() if n.lower().endswith(".xml") and "__MACOSX" not in n), None)
        return None if name is None else z.read(name)


def read_archives(spark: SparkSession, folder: str, pattern: str = "*.zip") -> DataFrame:
    """Facts of all archives below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return archive_facts(files.select("path", "content"))


def archive_facts(files: DataFrame, zipped: bool = True) -> DataFrame:
    """Facts of (path, content)."""

    def rows(path: str, content: bytes | None) -> Iterator[tuple]:
        try:
            xml = first_xml(bytes(content)) if zipped else bytes(content or b"")
            if not xml:
                raise ValueError("no XML in the archive")
            yield from list(package_facts(path, xml))
        except (ValueError, ET.ParseError, zipfile.BadZipFile, OSError) as e:
            yield path, "error", 0, None, None, None, str(e)[:500], None, None, None, None

    return map_rows(files.select(F.col("path").cast("string"), F.col("content").cast("binary")), rows, FACTS)


def nodes(facts: DataFrame) -> DataFrame:
    """Nodes with name, ordered distinct text runs, link, image and table counts."""
    n = facts.where("kind = 'node'").select("path", "sdt_id", "parent_id", F.col("name").alias("element_type"), "attributes", F.col("pos").alias("node_pos"))
    title = F.coalesce(F.col("attributes")["source-title"], F.col("attributes")["title"], F.concat_ws("_", "element_type", "sdt_id"))
    texts = facts.where("kind = 'text'").groupBy("path", "sdt_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"])).alias("lines"))
    counts = facts.where("kind in ('link', 'image', 'table')").groupBy("path", "sdt_id").agg(F.count_if(F.col("kind") == "link").alias("n_links"), F.count_if(F.col("kind") == "image").alias("n_images"), F.count_if(F.col("kind") == "table").alias("n_tables"))
    j = n.join(texts, ["path", "sdt_id"], "left").join(counts, ["path", "sdt_id"], "left").na.fill(0, ["n_links", "n_images", "n_tables"])
    return j.withColumns({"title": title, "sanitized_name": X.sanitize_filename(title), "text_content": F.trim(F.array_join(F.coalesce("lines", F.array().cast("array<string>")), ""))})


def links(facts: DataFrame) -> DataFrame:
    """Hyperlinks with the targets of their relationships, or the default."""
    rels = facts.where("kind = 'rel'").select("path", F.col("name").alias("rid"), F.col("target").alias("to"))
    j = facts.where("kind = 'link'").withColumnRenamed("name", "rid").join(rels, ["path", "rid"], "left")
    return j.select("path", "sdt_id", "pos", F.col("value").alias("text"), F.coalesce("to", F.lit(DEFAULT_TARGET)).alias("target"))


def images(facts: DataFrame) -> DataFrame:
    """Images with their media part, number within the node and name.

    The part is looked up under the relationship's target in its usual forms,
    then by the number in the drawing's own name. The figure title is the first
    of the block around the image and the next three that starts with `figure`.
    """
    rels = facts.where("kind = 'rel'").select("path", F.col("name").alias("rid"), F.ltrim(F.col("target"), F.lit("/")).alias("to"))
    media = facts.where("kind = 'media'").select("path", F.col("name").alias("part"), F.unbase64(F.regexp_replace("value", r"\s+", "")).alias("data"), F.regexp_extract("name", r"([^/]+)$", 1).alias("file"), F.regexp_extract(F.lower("name"), r"image(\d+)\.", 1).alias("number"))
    im = facts.where("kind = 'image'").select("path", "sdt_id", "pos", F.col("name").alias("rid"), F.col("value").alias("alt")).join(rels, ["path", "rid"], "left")
    im = im.withColumns({"file": F.regexp_extract("to", r"([^/]+)$", 1), "number": F.regexp_extract("alt", r"(\d+)", 1)})
    by_file = im.join(media.select("path", "file", F.col("part").alias("p1"), F.col("data").alias("d1")), ["path", "file"], "left")
    by_number = by_file.join(media.where("number != ''").groupBy("path", "number").agg(F.min(F.struct(F.col("part"), F.col("data"))).alias("m")), ["path", "number"], "left")
    found = by_number.withColumns({"part": F.coalesce("p1", "m.part"), "data": F.coalesce("d1", "m.data")}).where("part is not null")
    w = Window.partitionBy("path", "sdt_id").orderBy("pos")
    # captions: blocks of the same archive at or after the image
    blocks = facts.where("kind in ('block', 'image')").select("path", "pos", "kind", F.when(F.col("kind") == "block", F.col("value")).alias("b"))
    ahead = Window.partitionBy("path").orderBy("pos").rowsBetween(-1, 3)
    caption = F.filter(F.collect_list("b").over(ahead), lambda x: F.lower(x).startswith("figure"))
    titles = blocks.withColumn("caption", F.get(caption, F.lit(0))).where("kind = 'image'").select("path", "pos", F.substring(F.translate(F.regexp_replace("caption", r"[^\p{L}\p{N} _\-]", ""), " ", "_"), 1, 15).alias("figure"))
    named = found.join(titles, ["path", "pos"], "left").withColumns({"image_no": F.row_number().over(w), "extension": F.concat(F.lit("."), F.lower(F.regexp_extract("part", r"\.([A-Za-z0-9]{1,4})$", 1)))})
    return named.select("path", "sdt_id", "pos", "part", "image_no", F.concat(F.coalesce(F.nullif(F.col("figure"), F.lit("")), F.concat(F.lit("img_"), "sdt_id", F.lit("_"), "rid")), "extension").alias("file_name"), "data")


def tables(facts: DataFrame) -> DataFrame:
    """Cells of the tables in long form, numbered within their node; empty tables are left out."""
    w = Window.partitionBy("path", "sdt_id").orderBy("pos")
    t = facts.where("kind = 'table'").withColumn("table_no", F.row_number().over(w)).where(F.size("grid") > 0)
    r = t.select("path", "sdt_id", "table_no", F.posexplode("grid").alias("row_no", "cells"))
    return r.select("path", "sdt_id", "table_no", "row_no", F.posexplode("cells").alias("column_no", "cell"))


def xml_to_dict(data: bytes) -> dict:
    """An XML document as nested dicts: attributes under `@name`, text under `#text`, repeated children as lists.

    Names keep their prefixes and namespace declarations are attributes like
    others. Text loses white space at its ends; an element with nothing but
    text is that text, one with nothing at all is null.
    """
    root: dict = {}
    stack: list[tuple[dict, list[str]]] = [(root, [])]

    def start(name: str, attributes: dict[str, str]) -> None:
        stack.append(({f"@{k}": v for k, v in attributes.items()}, []))

    def end(name: str) -> None:
        held, parts = stack.pop()
        text = "".join(parts).strip()
        if text and held:
            held["#text"] = text
        value = held or text or None
        above = stack[-1][0]
        if name not in above:
            above[name] = value
        elif isinstance(above[name], list):
            above[name].append(value)
        else:
            above[name] = [above[name], value]

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda text: stack[-1][1].append(text)
    parser.Parse(data, True)
    return root


def raw_json(files: DataFrame) -> DataFrame:
    """(path, json, error) of XML documents (path, content), one row each; broken XML gives the error."""

    def rows(path: str, content: bytes | None) -> Iterator[tuple]:
        try:
            yield path, dumps_deep(xml_to_dict(bytes(content or b""))), None
        except expat.ExpatError as e:
            yield path, None, str(e)

    return map_rows(files.select("path", "content"), rows, "path string, json string, error string")
