"""Queries of pages, layout, titles, searches and whole runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dossierflow.functions import text as X
from dossierflow.operators import layout as Y
from dossierflow.operators import runs as U
from dossierflow.plans import jsonsql as J
from dossierflow.plans import sqltext as S
from dossierflow.plans.curation import ENTRY, chunks
from dossierflow.plans.evaluation import rows
from dossierflow.plans.registry import Registry
from dossierflow.plans.sqltext import CHUNKS, q
from dossierflow.session import ensure_checkpoint_dir
from dossierflow.sources import sinks
from dossierflow.sources.tables import table

layouts = Registry()


@layouts.query("layout_headings", f"WITH {CHUNKS} SELECT id, heading, CASE WHEN list_contains(labels, 'title') THEN 2 WHEN list_contains(labels, 'subtitle') THEN 3 ELSE 4 END AS level, coalesce(page, 1) AS page FROM chunks WHERE list_has_any(labels, ['section_header', 'title', 'subtitle'])")
def layout_headings(spark, d):
    return Y.layout_headings(chunks(spark, d)).select("id", "heading", "level", "page")


@layouts.query("section_titles", f"WITH {CHUNKS} SELECT id, '[' || pos || '] ' || CASE WHEN heading = '' THEN 'Untitled' ELSE heading END AS title FROM chunks")
def section_titles(spark, d):
    c = chunks(spark, d)
    return c.select("id", Y.section_title(F.col("pos"), F.when(F.col("heading") != "", F.array("heading"))).alias("title"))


@layouts.query("section_search", "SELECT id FROM sections WHERE contains(lower(coalesce(heading, '')), 'rotor') OR contains(lower(coalesce(text, '')), 'rotor')")
def section_search(spark, d):
    s = table(spark, d, "sections", "id", "heading", "text")
    return s.where(F.lower(F.coalesce("heading", F.lit(""))).contains("rotor") | F.lower(F.coalesce("text", F.lit(""))).contains("rotor")).select("id")


@layouts.query("first_match", f"""WITH {CHUNKS}, n AS (SELECT *, lead(heading) OVER (PARTITION BY doc_uuid ORDER BY pos, id) AS next_text FROM chunks)
SELECT doc_uuid, arg_min(heading, (pos, id)) AS heading, (arg_min({{'x': next_text}}, (pos, id))).x AS next_text FROM n WHERE contains(lower(heading), 'fuel') OR contains(lower(heading), 'rotor') GROUP BY 1""")
def first_match(spark, d):
    """The first heading of each document that names one of two words, with the heading after it."""
    return Y.first_match(chunks(spark, d), ["doc_uuid"], "pos", "id", "heading", ["fuel", "rotor"])


@layouts.query("prefix_search", "SELECT id FROM sections WHERE contains(lower(substr(text, 1, 40)), 'operator')")
def prefix_search(spark, d):
    """Texts that hold a word within their first characters (the feature is the prefix)."""
    from dossierflow.operators.items import found_in_first

    return table(spark, d, "sections", "id", "text").where(found_in_first(F.lower("text"), "operator", 40)).select("id")


@layouts.query("printed_contents", f"""WITH {CHUNKS}, c AS (SELECT doc_uuid, pos, id, floor(pos / 40)::INTEGER + 1 AS page_no, {S.ustrip("regexp_replace(heading, '[ \t-\r]+', ' ', 'g') || ' ..... ' || least(pos + 1, 9999)")} AS t FROM chunks WHERE heading <> ''),
ln AS (SELECT doc_uuid, page_no, t, row_number() OVER (PARTITION BY doc_uuid, page_no ORDER BY pos, id) + (page_no = 1)::INT AS n FROM c UNION ALL SELECT DISTINCT doc_uuid, 1, 'Table of Contents', 1 FROM c WHERE page_no = 1),
trimmed AS (SELECT * FROM ln WHERE page_no <= 30), {ENTRY},
pages AS (SELECT DISTINCT doc_uuid, page_no FROM trimmed), st AS (SELECT doc_uuid, min(page_no) AS first_page FROM trimmed WHERE n <= 15 AND page_no <= 20 AND {S.toc_title('t')} GROUP BY 1),
good AS (SELECT *, row_number() OVER (PARTITION BY doc_uuid, page_no ORDER BY n) - 1 AS k FROM entries WHERE title <> '' OR NOT m),
pc AS (SELECT p.doc_uuid, p.page_no, first_page, (SELECT count(*) FROM good g WHERE g.doc_uuid = p.doc_uuid AND g.page_no = p.page_no) AS n FROM pages p JOIN st USING (doc_uuid) WHERE p.page_no BETWEEN first_page AND first_page + 9),
live AS (SELECT doc_uuid, page_no FROM pc QUALIFY sum((page_no > first_page AND n < 3)::INT) OVER (PARTITION BY doc_uuid ORDER BY page_no) = 0),
u AS (SELECT g.doc_uuid, g.page_no, g.k::INTEGER AS k, g.title, g.epage AS page FROM good g JOIN live USING (doc_uuid, page_no) WHERE {S.norm_heading('title')} <> '' QUALIFY row_number() OVER (PARTITION BY g.doc_uuid, {S.norm_heading('title')} ORDER BY g.page_no, g.k) = 1)
SELECT * FROM u WHERE doc_uuid IN (SELECT doc_uuid FROM u GROUP BY 1 HAVING count(page) >= 4)""")
def printed_contents(spark, d):
    """Every document's headings printed as a contents page, read back."""
    c = chunks(spark, d).where("heading != ''").withColumn("page_no", (F.floor(F.col("pos") / 40) + 1).cast("int"))
    line = F.concat(F.regexp_replace("heading", r"\s+", " "), F.lit(" ..... "), F.least(F.col("pos") + 1, F.lit(9999)).cast("string"))
    pages = c.groupBy("doc_uuid", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", line.alias("l")))), lambda s: s["l"]), "\n").alias("text"))
    return Y.printed_contents(pages.withColumn("text", F.when(F.col("page_no") == 1, F.concat(F.lit("Table of Contents\n"), "text")).otherwise(F.col("text"))))


@layouts.query("table_rows", f"""WITH {CHUNKS}, t AS (SELECT doc_uuid, id AS table_index, {S.clean_cell('heading')} AS h, page FROM chunks WHERE labels_json = '["table"]')
SELECT doc_uuid, table_index, 1 AS n_header FROM t WHERE h <> '' AND page IS NOT NULL AND length(page::VARCHAR) <= 4 AND regexp_matches(trim(h, ' .·•_-' || chr(9)), '[A-Za-z]') AND NOT {S.toc_title('h')}""")
def table_rows(spark, d):
    """Tables whose header line is a promoted first entry."""
    c = chunks(spark, d).where(F.array_join("labels", ",") == "table")
    t = c.select("doc_uuid", F.col("id").alias("table_index"), F.array("heading", F.col("page").cast("string")).alias("header"), F.array(F.array(F.col("text"))).alias("records"))
    r = Y.table_rows(t).groupBy("doc_uuid", "table_index").agg((F.count("*") - 1).cast("int").alias("n_header"))
    return r.where("n_header = 1")


@layouts.query("numbered_columns", "SELECT attr_id, array_to_string([coalesce(domain, ''), CASE WHEN domain = type_of_content THEN coalesce(type_of_content, '') || '_1' ELSE coalesce(type_of_content, '') || CASE WHEN coalesce(domain, '') = coalesce(type_of_content, '') THEN '_1' ELSE '' END END], ' ¦ ') AS names FROM node_attributes")
def numbered_columns(spark, d):
    a = table(spark, d, "node_attributes", "attr_id", "domain", "type_of_content")
    return a.select("attr_id", F.array_join(Y.numbered_names(F.array(F.coalesce("domain", F.lit("")), F.coalesce("type_of_content", F.lit("")))), " ¦ ").alias("names"))


@layouts.query("master_index", f"""SELECT attr_id, node_id, CASE WHEN coalesce(source_title, '') = '' THEN 'Unknown_Topic' ELSE substr(trim(regexp_replace(regexp_replace(source_title, {q('[^a-zA-Z0-9' + S.WS[1:-1] + '.-]')}, '_', 'g'), {q('(?:' + S.WS + '|_)+')}, '_', 'g'), '_'), 1, 120) END AS sanitized_name,
coalesce(erules_id, '') AS erules_id, coalesce(domain, '') AS domain, coalesce(applicability_date, '') AS applicability_date, coalesce(type_of_content, '') AS type_of_content, length(coalesce(array_to_string([keywords, amended_by, icao_reference], ' '), ''))::BIGINT AS text_length FROM node_attributes""")
def master_index(spark, d):
    a = table(spark, d, "node_attributes", "attr_id", "node_id", "source_title", "erules_id", "domain", "applicability_date", "type_of_content", "keywords", "amended_by", "icao_reference")
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("erules_id", "domain", "applicability_date", "type_of_content")]
    return a.select("attr_id", "node_id", X.sanitize_filename(F.col("source_title")).alias("sanitized_name"), *blank, F.char_length(F.concat_ws(" ", "keywords", "amended_by", "icao_reference")).cast("long").alias("text_length"))


@layouts.query("latest_attributes", "SELECT doc_uuid, node_id, arg_max(attr_id, (updated_at, attr_id)) AS attr_id, count(*) AS n FROM node_attributes GROUP BY 1, 2")
def latest_attributes(spark, d):
    a = table(spark, d, "node_attributes", "doc_uuid", "node_id", "attr_id", "updated_at")
    return a.groupBy("doc_uuid", "node_id").agg(F.max_by("attr_id", F.struct("updated_at", "attr_id")).alias("attr_id"), F.count("*").alias("n"))


@layouts.query("reply_lists", f"SELECT item_row_id, array_to_string(list_filter(list_transform(string_split(item, ';'), lambda x: {S.ustrip('x')}), lambda x: x <> ''), ' ¦ ') AS items FROM eval_items WHERE item IS NOT NULL")
def reply_lists(spark, d):
    """Lists of every cell out of replies that wrap them in prose."""
    return _reply_items(table(spark, d, "eval_items", "item_row_id", "item").where("item is not null"))


def _reply_items(e):
    reply = F.concat(F.lit("Sure: "), F.to_json(F.split("item", ";")), F.lit(" - done"))
    return e.select("item_row_id", F.array_join(Y.string_list_from_reply(reply), " ¦ ").alias("items"))


@layouts.query("literal_lists", f"""WITH r AS (SELECT item_row_id, item, {S.ustrip("translate(item, chr(39) || chr(92) || chr(10), '   ')")} AS x FROM eval_items WHERE item IS NOT NULL)
SELECT item_row_id AS id, CASE WHEN contains(item, chr(13)) THEN '' WHEN x = '' THEN 'x' ELSE x || ' ¦ x' END AS items FROM r""")
def literal_lists(spark, d):
    """Lists in Python's notation read back; a carriage return inside a string makes a reply unreadable."""
    e = table(spark, d, "eval_items", "item_row_id", "item").where("item is not null")
    return Y.literal_lists(e.withColumn("r", F.concat(F.lit("['"), F.regexp_replace("item", r"['\\\n]", " "), F.lit("', 'x']"))), "item_row_id", "r").withColumn("items", F.array_join("items", " ¦ "))


def run_rows(spark, d):
    return rows(spark, d).select("row_id", "section_title", "column_name", "cell").where("section_title is not null")


def run_references(spark, d):
    return table(spark, d, "sections", "heading", "text", "id").where("heading is not null").select(F.col("heading").alias("section_title"), "text", F.col("id").alias("pos"))


@layouts.query("evaluate_run")
def evaluate_run(spark, d):
    """Best sentence of every item by ROUGE-L over a whole run, references found by title."""
    return U.evaluate_run(run_rows(spark, d), run_references(spark, d), ["rougeL"]).by_metric["rougeL"]


@layouts.query("evaluate_workbook")
def evaluate_workbook(spark, d):
    """A workbook's runs evaluated sheet by sheet; the evaluation's rows read back."""
    book = f"{ensure_checkpoint_dir(spark).rstrip('/')}/books/{uuid.uuid4().hex}"
    sinks.write_sheet(run_rows(spark, d), book, "Run 1")
    written = U.evaluate_workbook(spark, book, run_references(spark, d), ["jaccard"])
    return sinks.read_sheet(spark, book, written["Run 1"][0])


@layouts.query("payload_kinds", """SELECT record_id, CASE WHEN payload IS NULL OR NOT json_valid(payload) THEN 'invalid' WHEN left(ltrim(payload), 1) = '[' THEN CASE WHEN json_extract_string(CASE WHEN json_valid(payload) THEN payload END, '$[0].element_type') IS NOT NULL THEN 'nodes' ELSE 'chunks' END
WHEN json_extract_string(CASE WHEN json_valid(payload) THEN payload END, '$.rules_hierarchy') IS NOT NULL THEN 'hierarchy' ELSE 'invalid' END AS kind FROM structured_json""")
def payload_kinds(spark, d):
    return table(spark, d, "structured_json", "record_id", "payload").select("record_id", X.payload_kind(F.col("payload")).alias("kind"))


@layouts.query("node_badges", f"WITH RECURSIVE {J.TREE}, {J.INDEX} SELECT record_id, path, title || CASE WHEN n_children > 0 THEN ' ▸' || n_children ELSE '' END || CASE WHEN n_images > 0 THEN ' ▣' || n_images ELSE '' END || CASE WHEN n_links > 0 THEN ' ↗' || n_links ELSE '' END AS label FROM idx")
def node_badges(spark, d):
    from dossierflow.operators.graph import node_index

    n = node_index(table(spark, d, "structured_json", "record_id", "payload"))
    return n.select("record_id", "path", X.node_badge(F.col("title"), F.col("n_children"), F.col("n_images"), F.col("n_links")).alias("label"))


@layouts.query("sheet_names", f"SELECT DISTINCT section_title, CASE WHEN substr({S.ustrip('t')}, 1, 31) = '' THEN 'Uniq' ELSE substr({S.ustrip('t')}, 1, 31) END AS sheet FROM (SELECT section_title, regexp_replace(coalesce(section_title, ''), '[:\\\\/?*\\[\\]]', ' ', 'g') AS t FROM eval_items)")
def sheet_names(spark, d):
    return table(spark, d, "eval_items", "section_title").distinct().select("section_title", X.safe_sheet_name(F.col("section_title")).alias("sheet"))


@layouts.query("queue_status", "SELECT s.id, CASE WHEN e.n IS NULL THEN 'queued' WHEN e.f > 0 THEN 'failed' ELSE 'done' END AS status FROM sections s LEFT JOIN (SELECT doc_uuid, section_ordinal, count(*) AS n, count(*) FILTER (jaccard IS NULL) AS f FROM eval_items GROUP BY 1, 2) e ON s.doc_uuid = e.doc_uuid AND s.ordinal = e.section_ordinal")
def queue_status(spark, d):
    s = table(spark, d, "sections", "id", "doc_uuid", F.col("ordinal").alias("section_ordinal"))
    e = table(spark, d, "eval_items", "doc_uuid", "section_ordinal", "jaccard").groupBy("doc_uuid", "section_ordinal").agg(F.count("*").alias("n"), F.count_if(F.col("jaccard").isNull()).alias("f"))
    j = s.join(e, ["doc_uuid", "section_ordinal"], "left")
    return j.select("id", F.when(F.col("n").isNull(), "queued").when(F.col("f") > 0, "failed").otherwise("done").alias("status"))


@layouts.query("label_cells", "SELECT id, array_to_string(json_extract_string(labels_json, '$[*]'), '; ') AS cell FROM sections WHERE labels_json IS NOT NULL")
def label_cells(spark, d):
    return table(spark, d, "sections", "id", "labels_json").where("labels_json is not null").select("id", X.cell_text(F.col("labels_json")).alias("cell"))


@layouts.query("table_preview", "SELECT item_row_id, section_title, item FROM eval_items ORDER BY item_row_id LIMIT 200")
def table_preview(spark, d):
    """The first rows of a sheet, as the viewer shows them (the limit is the feature)."""
    return Y.preview(table(spark, d, "eval_items", "item_row_id", "section_title", "item"), "item_row_id")
