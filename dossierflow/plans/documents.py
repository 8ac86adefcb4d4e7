"""Queries of hierarchies, graphs, the table store, the model seam, streams and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow import models as L
from dossierflow.functions import text as X
from dossierflow.operators import graph as G
from dossierflow.operators import ordered as O
from dossierflow.operators import store as T
from dossierflow.operators.hierarchy import hierarchy
from dossierflow.plans import jsonsql as J_
from dossierflow.plans import sqltext as S
from dossierflow.plans.evaluation import REFERENCED, SPLIT, referenced, rows
from dossierflow.plans.registry import Registry
from dossierflow.plans.sqltext import q
from dossierflow.operators import evaluate as E
from dossierflow.session import ensure_checkpoint_dir, n_partitions
from dossierflow.sources import sinks, xmlpackage
from dossierflow.sources.tables import table
from dossierflow.streaming import incremental as J

documents = Registry()


def stamp(c):
    """A time as text, to the second."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def payloads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "structured_json", "record_id", "payload")


# ---- hierarchies and graphs ----


@documents.query("node_index", f"WITH RECURSIVE {J_.TREE}, {J_.INDEX} SELECT * FROM idx")
def node_index(spark, d):
    return G.node_index(payloads(spark, d))


@documents.query("tree_sections", f"WITH RECURSIVE {J_.TREE}, {J_.SECTIONS} SELECT * FROM sect")
def tree_sections(spark, d):
    """Hierarchies as section rows."""
    return G.hierarchy_sections(payloads(spark, d))


@documents.query("tree_references", f"WITH RECURSIVE {J_.TREE}, {J_.SECTIONS} SELECT record_id, heading AS title, arg_min(text, ordinal) AS text FROM sect GROUP BY 1, 2")
def tree_references(spark, d):
    return G.references_by_title(G.hierarchy_sections(payloads(spark, d)))


@documents.query("document_summary", f"""WITH RECURSIVE {J_.TREE}, {J_.INDEX}, k AS (SELECT record_id, element_type, count(*) AS n FROM idx GROUP BY 1, 2), m AS (SELECT record_id, arg_max(element_type, (n, element_type)) AS most_common, count(*) AS n_types FROM k GROUP BY 1)
SELECT record_id, count(*) AS n_nodes, sum(n_links)::BIGINT AS n_links, sum(n_images)::BIGINT AS n_images, sum(text_length)::BIGINT AS n_chars, max(depth) AS max_depth, any_value(most_common) AS most_common, any_value(n_types) AS n_types FROM idx JOIN m USING (record_id) GROUP BY 1""")
def document_summary(spark, d):
    return G.document_summary(G.node_index(payloads(spark, d)))


@documents.query("node_markdown", f"WITH RECURSIVE {J_.TREE}, {J_.SECTIONS} SELECT record_id, ordinal, repeat('#', least(level, 6)) || ' ' || heading || CASE WHEN text = '' THEN '' ELSE chr(10) || chr(10) || text END AS markdown FROM sect")
def node_markdown(spark, d):
    s = G.hierarchy_sections(payloads(spark, d))
    return s.select("record_id", "ordinal", sinks.markdown(F.col("level"), F.col("heading"), F.col("text")).alias("markdown"))


@documents.query("topic_graph", f"WITH RECURSIVE {J_.TREE}, {J_.GRAPH} {J_.GRAPH_ROWS}")
def topic_graph(spark, d):
    return G.topic_graph(payloads(spark, d))


@documents.query("external_nodes", f"WITH RECURSIVE {J_.TREE}, {J_.GRAPH} SELECT text AS node_id, count(*) AS n_records FROM ext GROUP BY 1")
def external_nodes(spark, d):
    return G.topic_graph(payloads(spark, d)).where("kind = 'external'").groupBy("node_id").agg(F.count("*").alias("n_records"))


TREE = f"""n AS (SELECT doc_uuid, {S.ustrip('node_id')} AS node_id, {S.ustrip('parent_node_id')} AS parent, heading FROM sections QUALIFY row_number() OVER (PARTITION BY doc_uuid, {S.ustrip('node_id')} ORDER BY updated_at DESC, id DESC) = 1),
tree AS (SELECT n.doc_uuid, n.node_id FROM n LEFT JOIN n p ON n.doc_uuid = p.doc_uuid AND n.parent = p.node_id WHERE p.node_id IS NULL UNION SELECT n.doc_uuid, n.node_id FROM n JOIN tree t ON n.doc_uuid = t.doc_uuid AND n.parent = t.node_id)"""


def section_tree(spark, d):
    s = table(spark, d, "sections", "id", "doc_uuid", "node_id", "parent_node_id", "updated_at")
    return hierarchy(s, "doc_uuid", "node_id", "parent_node_id", [F.col("updated_at"), F.col("id")])


@documents.query("subtree_search", f"""WITH RECURSIVE {TREE}, live AS (SELECT n.* FROM n JOIN tree USING (doc_uuid, node_id)),
up AS (SELECT doc_uuid, node_id, parent FROM live WHERE contains(lower(heading), 'fuel') UNION SELECT l.doc_uuid, l.node_id, l.parent FROM up JOIN live l ON l.doc_uuid = up.doc_uuid AND l.node_id = up.parent)
SELECT doc_uuid, node_id FROM up""")
def subtree_search(spark, d):
    """Nodes that match a word or have a descendant that does."""
    tree = section_tree(spark, d).where("role = 'none'").select("grp", "node", "tour", "entry", "size")
    s = table(spark, d, "sections", "doc_uuid", "node_id", "heading", "updated_at", "id").withColumn("node", X.ustrip(F.col("node_id")))
    last = O.last_per_key(s.withColumnRenamed("doc_uuid", "grp"), ["grp", "node"], ["updated_at", "id"], ["heading"])
    hits = last.where(F.lower("heading").contains("fuel")).join(tree, ["grp", "node"])
    return G.search_with_ancestors(tree, hits).select(F.col("grp").alias("doc_uuid"), F.col("node").alias("node_id"))


@documents.query("tree_depths", f"""WITH RECURSIVE n AS (SELECT doc_uuid, {S.ustrip('node_id')} AS node_id, {S.ustrip('parent_node_id')} AS parent FROM sections QUALIFY row_number() OVER (PARTITION BY doc_uuid, {S.ustrip('node_id')} ORDER BY updated_at DESC, id DESC) = 1),
t AS (SELECT n.doc_uuid, n.node_id, 1 AS depth FROM n LEFT JOIN n p ON n.doc_uuid = p.doc_uuid AND n.parent = p.node_id WHERE p.node_id IS NULL UNION ALL SELECT n.doc_uuid, n.node_id, depth + 1 FROM n JOIN t ON n.doc_uuid = t.doc_uuid AND n.parent = t.node_id)
SELECT depth::BIGINT AS depth, count(*) AS n FROM t GROUP BY 1""")
def tree_depths(spark, d):
    return section_tree(spark, d).where("role = 'none'").groupBy("depth").agg(F.count("*").alias("n"))


@documents.query("orphan_nodes", f"""WITH n AS (SELECT doc_uuid, {S.ustrip('node_id')} AS node_id, {S.ustrip('parent_node_id')} AS parent FROM sections QUALIFY row_number() OVER (PARTITION BY doc_uuid, {S.ustrip('node_id')} ORDER BY updated_at DESC, id DESC) = 1)
SELECT n.doc_uuid, n.node_id, n.parent FROM n ANTI JOIN n p ON n.doc_uuid = p.doc_uuid AND n.parent = p.node_id WHERE n.parent <> ''""")
def orphan_nodes(spark, d):
    """Nodes whose parent is not in their document."""
    s = table(spark, d, "sections", "doc_uuid", "node_id", "parent_node_id", "updated_at", "id").select("doc_uuid", X.ustrip(F.col("node_id")).alias("node_id"), X.ustrip(F.col("parent_node_id")).alias("parent"), "updated_at", "id")
    n = O.last_per_key(s, ["doc_uuid", "node_id"], ["updated_at", "id"], ["parent"])
    return n.where("parent != ''").join(n.select("doc_uuid", F.col("node_id").alias("parent")), ["doc_uuid", "parent"], "left_anti").select("doc_uuid", "node_id", "parent")


LEGAL = lambda c: f"regexp_replace({c}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{fffe}}\\x{{ffff}}]', '', 'g')"


@documents.query("xml_packages", f"WITH l AS (SELECT id, {S.ustrip(LEGAL('heading'))} AS title, {S.ustrip(LEGAL('text'))} AS text_content FROM sections) SELECT id, title, text_content, 1 AS n_links FROM l WHERE title <> '' AND text_content <> ''")
def xml_packages(spark, d):
    """Every section with heading and text printed as an XML package and read back."""
    return _packages(table(spark, d, "sections", "id", "heading", "text"))


def _legal(s):
    """Sections with heading and text, without what no XML can hold."""
    legal = lambda c: F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]", "")
    s = s.select("id", legal("heading").alias("heading"), legal("text").alias("text"))
    return s.where((X.ustrip(F.col("heading")) != "") & (X.ustrip(F.col("text")) != ""))


def _escaped(c):
    """Text for XML; line breaks and tabs too, as attributes would lose them."""
    for x, y in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        c = F.replace(c, F.lit(x), F.lit(y))
    return c


def _packages(s):
    s = _legal(s)
    xml = F.concat(F.lit('<package xmlns:w="w" xmlns:r="r"><part name="/word/_rels/document.xml.rels"><Relationship Id="r1" Target="other.html"/></part><part name="/rules.xml"><document guid="g"><topic sdt-id="7" source-title="'), _escaped(F.col("heading")), F.lit('"/></document></part><part name="/word/document.xml"><w:sdt><w:sdtPr><w:id w:val="7"/></w:sdtPr><w:p><w:t>'), _escaped(F.col("text")), F.lit('</w:t><w:hyperlink r:id="r1"><w:t>'), _escaped(F.col("text")), F.lit("</w:t></w:hyperlink></w:p></w:sdt></part></package>"))
    facts = xmlpackage.archive_facts(s.select(F.col("id").cast("string").alias("path"), F.encode(xml, "UTF-8").alias("content")), zipped=False)
    n = xmlpackage.nodes(facts)
    return n.select(F.col("path").cast("long").alias("id"), "title", "text_content", F.col("n_links").cast("int").alias("n_links"))


# ---- table store ----

LATEST = "latest AS (SELECT * FROM sections QUALIFY row_number() OVER (PARTITION BY doc_uuid, node_id ORDER BY updated_at DESC, id DESC) = 1)"


@documents.query("latest_sections", "SELECT doc_uuid, node_id, max_by(id, (updated_at, id)) AS id, count(*) AS n_deliveries FROM sections GROUP BY 1, 2")
def latest_sections(spark, d):
    """The last delivery of every section."""
    s = table(spark, d, "sections", "doc_uuid", "node_id", "id", "updated_at")
    return s.groupBy("doc_uuid", "node_id").agg(F.max_by("id", F.struct("updated_at", "id")).alias("id"), F.count("*").alias("n_deliveries"))


DOCS = "d AS (SELECT * FROM documents_index WHERE doc_uuid IS NOT NULL), o AS (SELECT * FROM d WHERE workspace_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY doc_uuid ORDER BY updated_at DESC NULLS LAST, id DESC) = 1), n AS (SELECT * FROM d WHERE workspace_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY doc_uuid ORDER BY updated_at DESC NULLS LAST, id DESC) = 1)"


def two_halves(spark, d):
    x = table(spark, d, "documents_index").where("doc_uuid is not null")
    cols = ["id", "workspace_id", "doc_name", "doc_type", "status", "updated_at"]
    return O.last_per_key(x.where("workspace_id % 2 = 0"), ["doc_uuid"], ["updated_at", "id"], cols), x.where("workspace_id % 2 = 1")


@documents.query("upsert_documents", f"WITH {DOCS} SELECT coalesce(o.doc_uuid, n.doc_uuid) AS doc_uuid, coalesce(n.id, o.id) AS id, CASE WHEN n.doc_uuid IS NOT NULL THEN n.doc_name ELSE o.doc_name END AS doc_name, coalesce(n.status, o.status) AS status, CASE WHEN o.doc_uuid IS NOT NULL THEN o.workspace_id ELSE n.workspace_id END AS workspace_id FROM o FULL JOIN n ON o.doc_uuid = n.doc_uuid")
def upsert_documents(spark, d):
    stored, incoming = two_halves(spark, d)
    return T.upsert(stored, incoming, ["doc_uuid"], ["updated_at", "id"], keep_first=("workspace_id",), coalesced=("status",)).select("doc_uuid", "id", "doc_name", "status", "workspace_id")


@documents.query("replace_sections", "WITH n AS (SELECT doc_uuid, node_id, id FROM sections WHERE source = 'toc'), r AS (SELECT DISTINCT doc_uuid FROM n) SELECT doc_uuid, node_id, id FROM sections WHERE source <> 'toc' AND doc_uuid NOT IN (SELECT doc_uuid FROM r) UNION ALL SELECT * FROM n")
def replace_sections(spark, d):
    s = table(spark, d, "sections", "doc_uuid", "node_id", "id", "source")
    return T.replace_partition(s.where("source != 'toc'").drop("source"), s.where("source = 'toc'").drop("source"), "doc_uuid")


@documents.query("register_workspaces", "SELECT workspace_id, strftime(min(updated_at), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS n_documents FROM documents_index GROUP BY 1")
def register_workspaces(spark, d):
    return table(spark, d, "documents_index").groupBy("workspace_id").agg(stamp(F.min("updated_at")).alias("first_seen"), stamp(F.max("updated_at")).alias("last_seen"), F.count("*").alias("n_documents"))


@documents.query("registry_join", "WITH w AS (SELECT workspace_id, max(updated_at) AS last_seen FROM documents_index WHERE status = 'reviewed' GROUP BY 1) SELECT i.id, i.doc_uuid, w.workspace_id, strftime(w.last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen FROM documents_index i JOIN w USING (workspace_id)")
def registry_join(spark, d):
    i = table(spark, d, "documents_index")
    w = i.where("status = 'reviewed'").groupBy("workspace_id").agg(F.max("updated_at").alias("last_seen"))
    return i.select("id", "doc_uuid", "workspace_id").join(w, "workspace_id").select("id", "doc_uuid", "workspace_id", stamp(F.col("last_seen")).alias("last_seen"))


@documents.query("latest_by_name", "WITH l AS (SELECT doc_name, arg_max(doc_uuid, (updated_at IS NOT NULL, coalesce(updated_at, TIMESTAMP '1970-01-01'), doc_uuid)) AS u FROM documents_index WHERE doc_name IS NOT NULL GROUP BY 1), n AS (SELECT DISTINCT section_title AS name FROM eval_items WHERE section_title IS NOT NULL UNION SELECT DISTINCT doc_name FROM documents_index WHERE doc_name IS NOT NULL) SELECT name, coalesce(u, substr(sha1('pdf::' || name), 1, 16)) AS doc_uuid, u IS NULL AS minted FROM n LEFT JOIN l ON l.doc_name = n.name")
def latest_by_name(spark, d):
    names = table(spark, d, "eval_items", "section_title").where("section_title is not null").select(F.col("section_title").alias("name")).union(table(spark, d, "documents_index", "doc_name").where("doc_name is not null"))
    return T.resolve_by_name(names, table(spark, d, "documents_index"))


@documents.query("sections_topn", "SELECT doc_uuid, id, CAST(row_number() OVER (PARTITION BY doc_uuid ORDER BY ordinal, id) AS INTEGER) AS rank FROM sections QUALIFY rank <= 5")
def sections_topn(spark, d):
    return T.first_sections(table(spark, d, "sections", "doc_uuid", "ordinal", "id"), 5).select("doc_uuid", "id", "rank")


CORPUS = f"""d AS (SELECT doc_uuid, any_value(doc_name) AS doc_name, max(updated_at) AS updated_at FROM documents_index WHERE doc_uuid IS NOT NULL GROUP BY 1),
s AS (SELECT doc_uuid, ordinal, id, {S.ustrip("coalesce(heading, '')")} AS h, substr({S.ustrip("coalesce(text, '')")}, 1, 1200) AS t FROM sections QUALIFY row_number() OVER (PARTITION BY doc_uuid ORDER BY ordinal, id) <= 40),
l AS (SELECT s.doc_uuid, s.ordinal, s.id, d.updated_at, CASE WHEN h <> '' THEN '- ' || h || ': ' || t ELSE '- ' || t END AS line FROM s JOIN d USING (doc_uuid)),
b AS (SELECT *, coalesce(sum(length(line)) OVER (ORDER BY updated_at DESC NULLS LAST, doc_uuid, ordinal, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM l)"""


def indexed_documents(spark, d):
    return table(spark, d, "documents_index").where("doc_uuid is not null").groupBy("doc_uuid").agg(F.max("updated_at").alias("updated_at"), F.min("doc_name").alias("doc_name"))


@documents.query("corpus_budget", f"WITH {CORPUS} SELECT doc_uuid, ordinal, id, line, before FROM b WHERE before < 60000")
def corpus_budget(spark, d):
    """Lines of the prompt corpus under its budget of characters."""
    return T.build_corpus(indexed_documents(spark, d), table(spark, d, "sections", "doc_uuid", "ordinal", "id", "heading", "text")).select("doc_uuid", "ordinal", "id", "line", "before")


@documents.query("corpus_blocks", f"WITH {CORPUS} SELECT doc_uuid, count(*)::INTEGER AS sections_used, string_agg(line, chr(10) ORDER BY ordinal, id) AS body FROM b WHERE before < 60000 GROUP BY 1")
def corpus_blocks(spark, d):
    c = T.corpus_text(T.build_corpus(indexed_documents(spark, d), table(spark, d, "sections", "doc_uuid", "ordinal", "id", "heading", "text")))
    return c.select("doc_uuid", "sections_used", F.regexp_replace("block", r"^\n### DOCUMENT: [^\n]*\n\n", "").alias("body"))


@documents.query("add_only_migration", "SELECT id, doc_uuid, CAST(NULL AS VARCHAR) AS toc_source, CAST(NULL AS BIGINT) AS num_tables FROM documents_index")
def add_only_migration(spark, d):
    return T.add_columns(table(spark, d, "documents_index", "id", "doc_uuid"), {"doc_uuid": "string", "toc_source": "string", "num_tables": "bigint"})


@documents.query("new_ids", "SELECT item_row_id, 1000 + row_number() OVER (ORDER BY evaluated_at NULLS FIRST, item_row_id) AS id FROM eval_items")
def new_ids(spark, d):
    r = table(spark, d, "eval_items", "item_row_id", "evaluated_at")
    return T.with_new_ids(r, [F.col("evaluated_at"), F.col("item_row_id")], 1000, n_partitions(spark)).select("item_row_id", "id")


@documents.query("document_ids", "SELECT id, substr(sha1(coalesce(doc_type, '') || '::' || coalesce(doc_name, '')), 1, 16) AS doc_id, substr(md5(coalesce(doc_name, '')), 1, 8) AS hash FROM documents_index")
def document_ids(spark, d):
    i = table(spark, d, "documents_index", "id", "doc_type", "doc_name")
    name = F.coalesce("doc_name", F.lit(""))
    return i.select("id", X.document_id(F.coalesce("doc_type", F.lit("")), name).alias("doc_id"), X.short_hash(name).alias("hash"))


@documents.query("file_names", f"SELECT heading, CASE WHEN coalesce(heading, '') = '' THEN 'Unknown_Topic' ELSE substr(trim(regexp_replace(regexp_replace(heading, {q('[^a-zA-Z0-9' + S.WS[1:-1] + '.-]')}, '_', 'g'), {q('(?:' + S.WS + '|_)+')}, '_', 'g'), '_'), 1, 120) END AS file_name FROM sections GROUP BY 1")
def file_names(spark, d):
    return table(spark, d, "sections", "heading").distinct().select("heading", X.sanitize_filename(F.col("heading")).alias("file_name"))


@documents.query("previews", f"SELECT id, CASE WHEN length({S.collapse('text')}) > 180 THEN substr({S.collapse('text')}, 1, 180) || ' …' ELSE {S.collapse('text')} END AS preview FROM sections WHERE text IS NOT NULL")
def previews(spark, d):
    return table(spark, d, "sections", "id", "text").where("text is not null").select("id", X.preview(F.col("text")).alias("preview"))


@documents.query("image_totals", "SELECT doc_uuid, coalesce(sum(json_array_length(extra_json, '$.images')), 0)::BIGINT AS num_images, coalesce(sum(json_array_length(extra_json, '$.tables')), 0)::BIGINT AS num_tables FROM sections GROUP BY 1")
def image_totals(spark, d):
    s = table(spark, d, "sections", "doc_uuid", "extra_json").withColumn("e", F.from_json("extra_json", "images array<string>, tables array<string>"))
    n = lambda c: F.coalesce(F.sum(F.greatest(F.size(f"e.{c}"), F.lit(0))), F.lit(0)).cast("long")
    return s.groupBy("doc_uuid").agg(n("images").alias("num_images"), n("tables").alias("num_tables"))


@documents.query("asset_paths", """WITH a AS (SELECT id, unnest(json_extract_string(extra_json, '$.images[*]')) AS file FROM sections WHERE extra_json IS NOT NULL), k AS (SELECT DISTINCT file FROM a WHERE id % 2 = 0)
SELECT a.id, a.file, CASE WHEN k.file IS NOT NULL THEN 'images/' || a.file END AS resolved FROM a LEFT JOIN k USING (file)""")
def asset_paths(spark, d):
    """Image references resolved against a listing."""
    a = table(spark, d, "sections", "id", "extra_json").select("id", F.explode(F.from_json("extra_json", "images array<string>")["images"]).alias("file"))
    known = a.where("id % 2 = 0").select("file").distinct().withColumn("there", F.lit(True))
    return a.join(known, "file", "left").select("id", "file", F.when(F.col("there"), F.concat(F.lit("images/"), "file")).alias("resolved"))


@documents.query("json_payloads", "SELECT record_id, json_valid(payload) AND payload IS NOT NULL AND left(ltrim(payload), 1) = '{' AS is_object FROM structured_json")
def json_payloads(spark, d):
    p = payloads(spark, d)
    return p.select("record_id", (F.coalesce(F.try_parse_json("payload").isNotNull(), F.lit(False)) & F.coalesce(F.ltrim("payload").startswith("{"), F.lit(False))).alias("is_object"))


# ---- logs, queues, provenance ----


@documents.query("rate_window", "SELECT event_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS calls_in_window FROM events")
def rate_window(spark, d):
    return T.rate_window(table(spark, d, "events", "event_id", "ts"), "ts", 60).select("event_id", "calls_in_window")


@documents.query("provenance_fold", "SELECT user_id, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS services, bool_or(event_type = 'error') AS any_fallback, count(*) AS n FROM events GROUP BY 1")
def provenance_fold(spark, d):
    e = table(spark, d, "events", "user_id", "event_type")
    return e.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), "; ").alias("services"), F.bool_or(F.col("event_type") == "error").alias("any_fallback"), F.count("*").alias("n"))


@documents.query("failed_rows", "SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def failed_rows(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    cells = e.withColumns({"a": F.when(F.col("event_type") == "error", "[ERROR] no reply").otherwise("done"), "b": F.lit("text")})
    return cells.where(T.failed(["a", "b"])).select("event_id", "user_id")


@documents.query("rerun_failed_merge", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'retried' ELSE event_type END AS result FROM events")
def rerun_failed_merge(spark, d):
    """Failed rows run again and laid over the saved ones."""
    saved = table(spark, d, "events", "event_id", "event_type").select("event_id", F.when(F.col("event_type") == "error", "[ERROR]").otherwise(F.col("event_type")).alias("result"), F.lit(0).alias("run"))
    again = saved.where(T.failed(["result"])).select("event_id", F.lit("retried").alias("result"), F.lit(1).alias("run"))
    return T.upsert(saved, again, ["event_id"], ["run"], keep_first=()).select("event_id", "result")


@documents.query("queue_anti_join", "SELECT id, heading FROM sections s WHERE decision = 'review' AND NOT EXISTS (SELECT 1 FROM eval_items e WHERE e.doc_uuid = s.doc_uuid AND e.section_ordinal = s.ordinal)")
def queue_anti_join(spark, d):
    s = table(spark, d, "sections", "id", "heading", "doc_uuid", "ordinal", "decision").where("decision = 'review'")
    done = table(spark, d, "eval_items", "doc_uuid", "section_ordinal").select("doc_uuid", F.col("section_ordinal").alias("ordinal")).distinct()
    return s.join(done, ["doc_uuid", "ordinal"], "left_anti").select("id", "heading")


@documents.query("resume_unprocessed", "SELECT item_row_id FROM eval_items WHERE item_row_id NOT IN (SELECT item_row_id FROM eval_items WHERE jaccard IS NULL)")
def resume_unprocessed(spark, d):
    e = table(spark, d, "eval_items", "item_row_id", "jaccard")
    return J.unprocessed(e, e.where("jaccard is null"), "item_row_id").select("item_row_id")


@documents.query("daily_log", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round_even(sum(value), 2)::DOUBLE AS total, strftime(TIMESTAMP '2000-01-01' + to_seconds(count(*) % 86400), '%H:%M:%S') AS elapsed FROM events GROUP BY 1, 2")
def daily_log(spark, d):
    e = table(spark, d, "events", "ts", "event_type", "value")
    g = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.bround(F.sum(F.col("value").cast("decimal(18,4)")), 2).cast("double").alias("total"))
    return g.withColumn("elapsed", X.hms(F.col("n")))


documents.sql["daily_log"] = documents.sql["daily_log"].replace("sum(value)", "sum(value::DECIMAL(18,4))")


@documents.query("events_windows", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_windows(spark, d):
    return J.windowed_counts(table(spark, d, "events", "ts", "event_type"), "ts", "1 hour").withColumn("window_start", stamp(F.col("window_start")))


# ---- streams: the same transforms over micro-batches ----


@documents.query("stream_windows", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    return J.run_windowed(J.stream_table(spark, d, "events").select("ts", "event_type"), "ts", "1 hour").withColumn("window_start", stamp(F.col("window_start")))


@documents.query("stream_grounding", f"""WITH {REFERENCED}, i AS (SELECT row_id, reference, {SPLIT('cell')} AS l FROM refd)
SELECT row_id, len(list_filter(l, lambda item: reference <> '' AND (contains(lower(reference), lower(item)) OR ({S.squash('item')} <> '' AND contains({S.squash('reference')}, {S.squash('item')})))))::BIGINT AS n_true, len(l)::BIGINT AS n_items FROM i""")
def stream_grounding(spark, d):
    """Cells evaluated as they arrive, with the batch evaluation's transform."""
    s = table(spark, d, "sections", "doc_uuid", "ordinal", "text", "updated_at", "id").groupBy("doc_uuid", F.col("ordinal").alias("section_ordinal")).agg(F.max_by(F.struct("text"), F.struct("updated_at", "id")).alias("s"))
    refs = s.select("doc_uuid", "section_ordinal", F.coalesce("s.text", F.lit("")).alias("reference"))

    def evaluate(batch: DataFrame) -> DataFrame:
        r = batch.select(F.col("item_row_id").alias("row_id"), "doc_uuid", "section_ordinal", F.col("item").alias("cell")).join(refs, ["doc_uuid", "section_ordinal"], "left").withColumn("reference", F.coalesce("reference", F.lit("")))
        return E.grounding_counts(r, ["row_id"]).select("row_id", "n_true", (F.col("n_true") + F.col("n_false")).alias("n_items"))

    return J.run_available(J.stream_table(spark, d, "eval_items"), evaluate).select("row_id", F.col("n_true").cast("long"), F.col("n_items").cast("long"))


# ---- model seam ----


@documents.query("model_columns")
def model_columns(spark, d):
    """A column filled for every section by the deterministic stand-in, with provenance."""
    s = table(spark, d, "sections", "id", "heading", "text")
    prompts = s.select(F.col("id").alias("row_id"), L.column_prompt("Name the subject.", F.col("heading"), F.col("text")).alias("prompt"))
    r = L.run_prompts(prompts, lambda: L.FallbackModel(L.EchoModel()))
    return r.select("row_id", L.cell_value(F.col("reply")).alias("value"), "service_used", "fallback", "attempts")


def _echo():
    return L.FallbackModel(L.EchoModel())


# The stand-in's reply: the first words of what follows the divider, or no JSON for one prompt in seventeen.
def echo_sql(prompt: str) -> str:
    body = f"substr({prompt}, instr({prompt}, chr(10) || '---' || chr(10)) + 5)"
    words = f"array_to_string(list_filter(regexp_split_to_array({body}, {q(S.WS + '+')}), lambda x: x <> '')[1:6], ' ')"
    return f"""CASE WHEN ('0x' || substr(sha1({prompt}), 1, 4))::INTEGER % 17 = 0 THEN 'no JSON here' ELSE '{{"value": "' || replace(replace({words}, chr(92), ''), '"', chr(39)) || '"}}' END"""


FREEFORM = "'Summarise.' || chr(10) || 'In one line.' || chr(10) || chr(10) || '---' || chr(10) || 'SECTION: ' || coalesce(heading, '') || chr(10) || chr(10) || coalesce(text, '')"


@documents.query("freeform_results", f"WITH p AS (SELECT id, heading, {FREEFORM} AS prompt FROM sections) SELECT id AS row_id, heading AS title, {echo_sql('prompt')} AS response, 'echo' AS service_used, '' AS fallback FROM p")
def freeform_results(spark, d):
    """One instruction over every section."""
    s = table(spark, d, "sections", "id", "heading", "text").select(F.col("id").alias("row_id"), F.col("heading").alias("title"), "text")
    return L.freeform(s, "Summarise.", _echo, "In one line.", "echo").select("row_id", "title", "response", "service_used", "fallback")


@documents.query("corpus_analysis", f"""WITH {CORPUS}, l2 AS (SELECT * FROM b WHERE before < 60000), one AS (SELECT count(*) AS n, count(DISTINCT doc_uuid) AS m, arg_min(line, before) AS first_line FROM l2)
SELECT 'cross-document analysis' AS name, n AS total_sections, m AS n_documents, 'echo' AS service_used FROM one WHERE n > 0""")
def corpus_analysis(spark, d):
    """A question asked over the corpus of all documents' first sections."""
    lines = T.build_corpus(indexed_documents(spark, d), table(spark, d, "sections", "doc_uuid", "ordinal", "id", "heading", "text"))
    r = L.analyse_corpus(T.corpus_text(lines), "What do they share?", _echo)
    scope = F.from_json("scope", "documents array<string>, total_sections long")
    return r.select("name", scope["total_sections"].alias("total_sections"), F.size(scope["documents"]).cast("long").alias("n_documents"), "service_used")


@documents.query("column_cells")
def column_cells(spark, d):
    """Two columns asked for in one call and in calls of their own, as cells."""
    s = table(spark, d, "sections", "id", "heading", "text").select(F.col("id").alias("row_id"), "heading", "text")
    ask = {"value": "Name the subject.", "Requirements": "List the duties."}
    cells = []
    for per_column in (False, True):
        jobs = L.column_jobs(s, ask, per_column)
        keyed = jobs.withColumn("row_id", F.col("row_id") * 2 + F.coalesce((F.col("column_name") == "value").cast("int"), F.lit(0)))
        replies = L.run_prompts(keyed.select("row_id", "prompt"), _echo).select("row_id", "reply")
        named = keyed.select("row_id", "column_name").join(replies, "row_id").withColumn("row_id", F.shiftright("row_id", 1))
        cells.append(L.column_cells(named, list(ask)).withColumn("per_column", F.lit(per_column)))
    return cells[0].unionByName(cells[1])


@documents.query("model_vectors")
def model_vectors(spark, d):
    """Items embedded once per distinct text and scored against their best sentence."""
    from dossierflow.operators import vectors as V

    e = table(spark, d, "eval_items", "item_row_id", "item", "best_ref_sentence").where("item is not null and best_ref_sentence is not null")
    both = e.select(F.col("item").alias("t")).union(e.select("best_ref_sentence"))
    v = L.hashed_vectors(both, "t")
    j = e.join(v.select(F.col("text").alias("item"), F.col("vector").alias("a")), "item").join(v.select(F.col("text").alias("best_ref_sentence"), F.col("vector").alias("b")), "best_ref_sentence")
    return j.select("item_row_id", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.bround(V.cosine(F.col("a"), F.col("b")), 4)).alias("cosine"))


@documents.query("refined_headings", f"""WITH {S.CHUNKS}, k AS (SELECT doc_uuid, pos, id, heading, {S.norm_heading('heading')} AS key FROM chunks),
h AS (SELECT doc_uuid, key, heading, pos AS first_pos FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_uuid, key ORDER BY pos, id) = 1)
SELECT * FROM h WHERE length(key) % 2 = 0 OR {S.numbered('heading')}""")
def refined_headings(spark, d):
    """A model's choice of headings with the numbered ones it left out put back."""
    from dossierflow.operators.triage import chunk_view, collect_headings

    h = collect_headings(chunk_view(table(spark, d, "sections", "doc_uuid", "ordinal", "id", "heading", "text", "labels_json", "page")))
    return L.refined_headings(h, h.where(F.char_length("key") % 2 == 0)).drop("first_id")


@documents.query("model_toc", f"SELECT id, {S.ustrip('heading')} AS title, CAST(ordinal % 20000 AS INTEGER) AS raw FROM sections WHERE {S.ustrip('heading')} <> ''")
def model_toc(spark, d):
    """Contents entries of every heading out of replies that wrap a JSON list in prose."""
    return _reply_entries(table(spark, d, "sections", "id", "heading", "ordinal").where("heading is not null"))


def _reply_entries(s):
    page = F.col("ordinal") % 20000
    entries = F.array(F.struct("heading", (page + 1).cast("string").alias("page")))
    reply = F.concat(F.lit("Here it is: "), F.to_json(entries), F.lit(" as asked."))
    e = s.select("id", page.cast("int").alias("raw"), F.explode(L.toc_from_reply(reply)).alias("e"))
    return e.select("id", F.col("e.title").alias("title"), "raw")


# ---- exports ----


@documents.query("sheet_roundtrip", "SELECT item_row_id::VARCHAR AS item_row_id, nullif(item, '') AS item FROM eval_items")
def sheet_roundtrip(spark, d):
    """A run sheet written as CSV and read back, quotes and line breaks kept."""
    book = f"{ensure_checkpoint_dir(spark).rstrip('/')}/books/{uuid.uuid4().hex}"
    e = table(spark, d, "eval_items", "item_row_id", "item")
    sheet = sinks.next_run(spark, book)
    sinks.write_sheet(e, book, sheet, "csv")
    return sinks.read_sheet(spark, book, sheet, "csv")


def _payload(spark, d):
    from dossierflow.operators import merge as M
    from dossierflow.plans.curation import decisions

    dec = decisions(spark, d)
    return sinks.review_payload(M.merged_sections(dec), M.history(dec))


@documents.query("review_payload")
def review_payload(spark, d):
    """Entries of the review's output: sections with their links, and the history of every chunk."""
    return _payload(spark, d)


@documents.query("payload_documents")
def payload_documents(spark, d):
    """The review's output, one JSON object a document."""
    return sinks.payload_documents(_payload(spark, d))


@documents.query("xml_raw_json", f"SELECT id, {S.ustrip(LEGAL('heading'))} AS heading, {S.ustrip(LEGAL('text'))} AS text FROM sections WHERE {S.ustrip(LEGAL('heading'))} <> '' AND {S.ustrip(LEGAL('text'))} <> ''")
def xml_raw_json(spark, d):
    """Sections printed as XML, turned into JSON without loss, and read from that."""
    s = _legal(table(spark, d, "sections", "id", "heading", "text"))
    xml = F.concat(F.lit('<s:doc xmlns:s="u"><s:h n="1">'), _escaped(F.col("heading")), F.lit("</s:h><s:t>"), _escaped(F.col("text")), F.lit("</s:t><s:t/></s:doc>"))
    j = xmlpackage.raw_json(s.select(F.col("id").cast("string").alias("path"), F.encode(xml, "UTF-8").alias("content")))
    return j.select(F.col("path").cast("long").alias("id"), F.get_json_object("json", "$['s:doc']['s:h']['#text']").alias("heading"), F.get_json_object("json", "$['s:doc']['s:t'][0]").alias("text"))


@documents.query("graph_sheets", f"WITH RECURSIVE {J_.TREE}, {J_.GRAPH}, r AS ({J_.GRAPH_ROWS}) SELECT record_id::VARCHAR AS record_id, node_id AS source, other AS target, relation FROM r WHERE kind = 'edge'")
def graph_sheets(spark, d):
    """Edges of the topic graph written as CSV and read back."""
    book = f"{ensure_checkpoint_dir(spark).rstrip('/')}/books/{uuid.uuid4().hex}"
    g = G.topic_graph(payloads(spark, d)).where("kind = 'edge'").select("record_id", F.col("node_id").alias("source"), F.col("other").alias("target"), "relation")
    sinks.write_sheet(g, book, "edges", "csv")
    return sinks.read_sheet(spark, book, "edges", "csv")


@documents.query("section_runs", f"WITH {LATEST} SELECT source, decision, count(*) AS n, count(*) FILTER (toc_match = 'yes') AS n_matched FROM latest GROUP BY 1, 2")
def section_runs(spark, d):
    """Counts by source and decision over the last deliveries."""
    s = table(spark, d, "sections", "doc_uuid", "node_id", "id", "updated_at", "source", "decision", "toc_match")
    last = O.last_per_key(s, ["doc_uuid", "node_id"], ["updated_at", "id"], ["source", "decision", "toc_match"])
    return last.groupBy("source", "decision").agg(F.count("*").alias("n"), F.count_if(F.col("toc_match") == "yes").alias("n_matched"))
