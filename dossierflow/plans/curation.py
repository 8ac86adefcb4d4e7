"""Queries of chunk triage, contents, merge folding and section building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.functions import text as X
from dossierflow.operators import merge as M
from dossierflow.operators import toc as T
from dossierflow.operators import triage as G
from dossierflow.operators.review import review
from dossierflow.plans import sqltext as S
from dossierflow.plans.registry import Registry
from dossierflow.plans.sqltext import CHUNKS, q
from dossierflow.session import materialise
from dossierflow.sources.tables import table

curation = Registry()
CHUNK_COLUMNS = ("doc_uuid", "ordinal", "id", "heading", "text", "labels_json", "page")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return G.chunk_view(table(spark, d, "sections", *CHUNK_COLUMNS))


@curation.query("chunk_lines", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, {S.ustrip('line')} AS line, {S.numbered('line')} AS numbered FROM l WHERE {S.ustrip('line')} <> ''""")
def chunk_lines(spark, d):
    lines = table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(X.ustrip(F.col("line")) != "").select("doc_id", F.col("pos").cast("long"), X.ustrip(F.col("line")).alias("line"), X.is_numbered_heading(F.col("line")).alias("numbered"))


@curation.query("chunk_projection", f"WITH {CHUNKS} SELECT doc_uuid, pos, id, heading, array_to_string(labels, ',') AS labels, page, CAST(length(text) AS BIGINT) AS n_chars FROM chunks")
def chunk_projection(spark, d):
    return chunks(spark, d).select("doc_uuid", "pos", "id", "heading", F.array_join("labels", ",").alias("labels"), "page", F.char_length("text").cast("long").alias("n_chars"))


@curation.query("normalized_headings", f"SELECT heading, {S.norm_heading('heading')} AS key, {S.numbered('heading')} AS numbered, {S.plausible('heading')} AS plausible, count(*) AS n FROM sections GROUP BY 1")
def normalized_headings(spark, d):
    g = table(spark, d, "sections", "heading").groupBy("heading").agg(F.count("*").alias("n"))
    h = F.col("heading")
    return g.select("heading", X.normalize_heading(h).alias("key"), X.is_numbered_heading(h).alias("numbered"), X.plausible_heading(h).alias("plausible"), "n")


@curation.query("boilerplate_texts", f"""
WITH {CHUNKS}, n AS (SELECT doc_uuid, {S.casefold(S.collapse('text'))} AS norm, coalesce(page, -1) AS page FROM chunks)
SELECT doc_uuid, norm, count(DISTINCT page) AS n_pages FROM n WHERE norm <> '' AND length(norm) <= 200 GROUP BY 1, 2 HAVING count(DISTINCT page) >= 1""")
def boilerplate_texts(spark, d):
    return G.boilerplate(chunks(spark, d), min_pages=1)


HEADS = f"keyed AS (SELECT doc_uuid, pos, id, heading, page, {S.norm_heading('heading')} AS key FROM chunks), heads AS (SELECT doc_uuid, key, heading, pos AS first_pos FROM keyed WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_uuid, key ORDER BY pos, id) = 1)"


@curation.query("ordered_distinct_headings", f"WITH {CHUNKS}, {HEADS} SELECT * FROM heads")
def ordered_distinct_headings(spark, d):
    return G.collect_headings(chunks(spark, d)).drop("first_id")


KNOWN = "known AS (SELECT h.doc_uuid, h.key, arg_min(v.heading, (v.pos, v.id)) AS known FROM (SELECT DISTINCT doc_uuid, key FROM keyed WHERE key <> '') h JOIN valid v ON h.doc_uuid = v.doc_uuid AND (h.key = v.key OR (length(h.key) >= 4 AND length(v.key) >= 4 AND (contains(h.key, v.key) OR contains(v.key, h.key)))) GROUP BY 1, 2)"
FIRSTS = "firsts AS (SELECT doc_uuid, key, heading, pos, id FROM keyed WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_uuid, key ORDER BY pos, id) = 1)"
VALID = f"valid AS (SELECT * FROM firsts WHERE {S.plausible('heading')})"

TRIAGE = f"""{CHUNKS}, {HEADS},
boiler AS (SELECT doc_uuid, norm FROM (SELECT doc_uuid, {S.casefold(S.collapse('text'))} AS norm, coalesce(page, -1) AS page FROM chunks) WHERE norm <> '' AND length(norm) <= 200 GROUP BY 1, 2 HAVING count(DISTINCT page) >= 4),
{FIRSTS}, {VALID}, {KNOWN},
c AS (SELECT c.*, {S.collapse('c.text')} AS norm, v.known, b.norm IS NOT NULL AS is_repeated
      FROM chunks c LEFT JOIN known v ON c.doc_uuid = v.doc_uuid AND v.key = {S.norm_heading('c.heading')}
      LEFT JOIN boiler b ON c.doc_uuid = b.doc_uuid AND b.norm = {S.casefold(S.collapse('c.text'))}),
s AS (SELECT *, CASE WHEN list_has_any(labels, ['document_index']) THEN 'index' WHEN norm = '' THEN 'empty'
        WHEN len(labels) > 0 AND len(list_filter(labels, lambda x: x NOT IN ('page_header', 'page_footer'))) = 0 THEN 'furniture'
        WHEN is_repeated THEN 'repeated'
        WHEN length(norm) < 25 AND NOT {S.numbered('norm')} AND NOT list_has_any(labels, ['title', 'subtitle', 'section_header']) THEN 'short'
        WHEN known IS NOT NULL THEN 'known' WHEN heading <> '' AND {S.numbered('heading')} THEN 'numbered' ELSE 'continue' END AS step FROM c),
w AS (SELECT *, last_value(CASE step WHEN 'known' THEN known WHEN 'numbered' THEN heading END IGNORE NULLS) OVER (PARTITION BY doc_uuid ORDER BY pos, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur FROM s),
triaged AS (SELECT doc_uuid, pos, id,
  CASE WHEN step IN ('index', 'empty', 'furniture', 'repeated', 'short') THEN 'skip' WHEN step IN ('known', 'numbered') OR cur IS NOT NULL THEN 'log' ELSE 'review' END AS action,
  CASE WHEN step IN ('known', 'numbered') OR (step = 'continue' AND cur IS NOT NULL) THEN cur ELSE heading END AS heading_out,
  CASE WHEN step = 'short' OR (step = 'continue' AND cur IS NOT NULL) THEN 'medium' WHEN step = 'continue' THEN 'low' ELSE 'high' END AS confidence FROM w)"""


def marked(spark, d):
    """Keys and flags of all chunks, written once without their texts."""
    return materialise(G.marked(chunks(spark, d)).drop("text"))


def triaged(spark, d, ratio=G.MATCH_RATIO):
    m = marked(spark, d)
    return G.triage(m, G.valid_headings(m), G.boilerplate(m), ratio=ratio)


def contained(spark, d):
    """Triage in which headings match if they are equal or one holds the other, which SQL can say as well."""
    return triaged(spark, d, ratio=None)


TRIAGE_COLUMNS = ("doc_uuid", "pos", "id", "action", "heading_out", "confidence")


@curation.query("triage_actions")
def triage_actions(spark, d):
    """Decisions of all chunks, with headings that are merely alike."""
    return triaged(spark, d).select(*TRIAGE_COLUMNS)


@curation.query("triage_contained", f"WITH {TRIAGE} SELECT * FROM triaged")
def triage_contained(spark, d):
    return contained(spark, d).select(*TRIAGE_COLUMNS)


# The contents are the headings that carry a page; the first chunk of a document is taken for the printed contents.
TOC_TRIAGE = TRIAGE.replace(FIRSTS, FIRSTS.replace("key <> ''", "key <> '' AND page IS NOT NULL")).replace(VALID, "valid AS (SELECT * FROM firsts)").replace("WHEN norm = '' THEN 'empty'", "WHEN pos = 0 THEN 'toc' WHEN norm = '' THEN 'empty'").replace("('index', 'empty'", "('index', 'toc', 'empty'")


@curation.query("triage_toc", f"""WITH {TOC_TRIAGE}, told AS (SELECT id, last_value(CASE step WHEN 'known' THEN true WHEN 'numbered' THEN false END IGNORE NULLS) OVER (PARTITION BY doc_uuid ORDER BY pos, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM s)
SELECT triaged.*, CASE WHEN action = 'log' THEN t END AS toc_match FROM triaged JOIN told USING (id)""")
def triage_toc(spark, d):
    """Triage against a table of contents, which holds the headings that carry a page."""
    m = marked(spark, d)
    entries = G.collect_headings(m.where("page is not null"))
    return G.triage(m, entries, G.boilerplate(m), m.where("pos = 0").select("doc_uuid", "pos"), ratio=None).select(*TRIAGE_COLUMNS, "toc_match")


@curation.query("triage_summary", f"""WITH {TRIAGE} SELECT doc_uuid, count(*) AS total, count(*) FILTER (action = 'log') AS n_log, count(*) FILTER (action = 'skip') AS n_skip, count(*) FILTER (action = 'review') AS n_review,
count(*) FILTER (action = 'merge') AS n_merge, count(*) FILTER (confidence = 'low') AS low_confidence, round_even(100.0::DOUBLE * count(*) FILTER (action IN ('log', 'skip', 'merge')) / count(*), 1)::DOUBLE AS auto_handled_pct FROM triaged GROUP BY 1""")
def triage_summary(spark, d):
    return G.triage_summary(contained(spark, d)).withColumn("auto_handled_pct", F.col("auto_handled_pct").cast("double"))


@curation.query("triage_view", f"WITH {TRIAGE} SELECT t.doc_uuid, t.id, t.action FROM triaged t JOIN chunks c USING (id) WHERE t.action = 'log' AND contains({S.casefold('c.heading || chr(32) || c.text')}, 'fuel')")
def triage_view(spark, d):
    """The review tool's view: kept chunks that hold a search word."""
    hits = chunks(spark, d).where(X.casefold(F.concat_ws(" ", "heading", "text")).contains("fuel")).select("id")
    return contained(spark, d).where("action = 'log'").join(hits, "id").select("doc_uuid", "id", "action")


@curation.query("heading_forward_fill", f"WITH {CHUNKS} SELECT doc_uuid, pos, id, heading, last_value(nullif(heading, '') IGNORE NULLS) OVER (PARTITION BY doc_uuid ORDER BY pos, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading_above FROM chunks")
def heading_forward_fill(spark, d):
    return G.heading_forward_fill(chunks(spark, d))


ACTION_SQL = """CASE WHEN decision = 'skip' THEN 'skip' WHEN labels_json IN ('["list_item"]', '["table"]') THEN 'merge' WHEN decision = 'review' THEN 'review' ELSE 'log' END"""
DECISIONS = f"{CHUNKS}, decisions AS (SELECT *, {ACTION_SQL} AS action FROM chunks)"


def decisions(spark, d):
    s = table(spark, d, "sections", *CHUNK_COLUMNS, "decision")
    action = F.when(F.col("decision") == "skip", "skip").when(F.col("labels_json").isin('["list_item"]', '["table"]'), "merge").when(F.col("decision") == "review", "review").otherwise("log")
    return G.chunk_view(s, action.alias("action"))


FOLD = f"""{DECISIONS},
k AS (SELECT *, action NOT IN ('skip', 'merge') AS kept0 FROM decisions),
o AS (SELECT *, sum(kept0::INT) OVER w AS ku, sum((action = 'merge')::INT) OVER w AS mu FROM k WINDOW w AS (PARTITION BY doc_uuid ORDER BY pos, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g0 AS (SELECT *, kept0 OR (action = 'merge' AND ku = 0 AND mu = 1) AS kept FROM o),
g AS (SELECT *, sum(kept::INT) OVER (PARTITION BY doc_uuid ORDER BY pos, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gid FROM g0),
pieces AS (SELECT doc_uuid, gid, min(pos) FILTER (kept) AS pos, min(id) FILTER (kept) AS id, min(heading) FILTER (kept) AS heading, min(text) FILTER (kept) AS base,
  list(regexp_replace(text, {q(S.WS + '+$')}, '') ORDER BY pos, id) FILTER (NOT kept AND {S.ustrip('text')} <> '') AS added, count(*) FILTER (NOT kept) AS n_merged
  FROM g WHERE action <> 'skip' GROUP BY 1, 2),
folded AS (SELECT doc_uuid, gid, pos, id, heading, n_merged,
  CASE WHEN added IS NULL OR len(added) = 0 THEN base WHEN regexp_replace(base, {q(S.WS + '+$')}, '') = '' THEN array_to_string(added, chr(10) || chr(10)) ELSE regexp_replace(base, {q(S.WS + '+$')}, '') || chr(10) || chr(10) || array_to_string(added, chr(10) || chr(10)) END AS text FROM pieces)"""


@curation.query("merge_fold", f"WITH {FOLD} SELECT doc_uuid, CAST(gid AS BIGINT) AS gid, pos, id, heading, CAST(n_merged AS BIGINT) AS n_merged, text FROM folded")
def merge_fold(spark, d):
    return M.resolve_merges(decisions(spark, d)).select("doc_uuid", "gid", "pos", "id", "heading", F.size("merged_from").cast("long").alias("n_merged"), "text")


@curation.query("merge_targets", f"WITH {DECISIONS} SELECT doc_uuid, pos, id, action, last_value(CASE WHEN action NOT IN ('skip', 'merge') THEN id END IGNORE NULLS) OVER (PARTITION BY doc_uuid ORDER BY pos, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target_id FROM decisions")
def merge_targets(spark, d):
    return M.merge_targets(decisions(spark, d))


# `ids`: what a kept row is made of, itself first
SECTIONS = """SELECT doc_uuid, key, 0::BIGINT AS part, arg_min(heading, (pos, id)) AS heading, min(pos) AS first_pos, count(*) AS n_chunks, string_agg(text, chr(10) || chr(10) ORDER BY pos, id) AS merged_text, string_agg(ids, ',' ORDER BY pos, id) AS chunk_ids FROM kept GROUP BY 1, 2"""
FOLDED_IDS = f"ids AS (SELECT doc_uuid, gid, string_agg(id::VARCHAR, ',' ORDER BY pos, id) AS ids FROM g WHERE action <> 'skip' GROUP BY 1, 2), kept AS (SELECT f.*, ids, {S.norm_heading('heading')} AS key FROM folded f JOIN ids USING (doc_uuid, gid))"


def as_rows(sections):
    """Sections with their chunks' ids as text."""
    return sections.withColumn("chunk_ids", F.array_join("chunk_ids", ",")).drop("labels", "pages")


@curation.query("merged_sections", f"WITH {FOLD}, {FOLDED_IDS} {SECTIONS}")
def merged_sections(spark, d):
    return as_rows(M.merged_sections(decisions(spark, d)))


@curation.query("section_members", f"WITH {FOLD}, {FOLDED_IDS} SELECT g.doc_uuid, k.key, 0::BIGINT AS part, k.id AS kept_id, g.id, g.pos FROM g JOIN kept k ON g.doc_uuid = k.doc_uuid AND g.gid = k.gid WHERE g.action <> 'skip'")
def section_members(spark, d):
    """Which chunks make up which section."""
    return M.section_members(M.merged_rows(M.with_add_heading(decisions(spark, d))))


ROWS_OF = "m AS (SELECT k.doc_uuid, k.key, k.pos AS kpos, k.id AS kid, g.pos, g.id, g.labels, g.page FROM g JOIN kept k ON g.doc_uuid = k.doc_uuid AND g.gid = k.gid WHERE g.action <> 'skip')"


@curation.query("section_labels", f"""WITH {FOLD}, {FOLDED_IDS}, {ROWS_OF}, l AS (SELECT doc_uuid, key, unnest(labels) AS label, generate_subscripts(labels, 1) AS n, kpos, kid, pos, id FROM m),
fl AS (SELECT doc_uuid, key, label, min((kpos, kid, pos, id, n)) AS first_at FROM l GROUP BY 1, 2, 3), fp AS (SELECT doc_uuid, key, page, min((kpos, kid, pos, id)) AS first_at FROM m WHERE page IS NOT NULL GROUP BY 1, 2, 3),
al AS (SELECT doc_uuid, key, string_agg(label, ',' ORDER BY first_at) AS labels FROM fl GROUP BY 1, 2), ap AS (SELECT doc_uuid, key, string_agg(page::VARCHAR, ',' ORDER BY first_at) AS pages FROM fp GROUP BY 1, 2)
SELECT k.doc_uuid, k.key, coalesce(labels, '') AS labels, coalesce(pages, '') AS pages FROM (SELECT DISTINCT doc_uuid, key FROM kept) k LEFT JOIN al USING (doc_uuid, key) LEFT JOIN ap USING (doc_uuid, key)""")
def section_labels(spark, d):
    """Labels and pages of every section in the order of its chunks."""
    return M.merged_sections(decisions(spark, d)).select("doc_uuid", "key", F.array_join("labels", ",").alias("labels"), F.array_join("pages", ",").alias("pages"))


@curation.query("sections_by_exact_heading", f"WITH {DECISIONS}, kept AS (SELECT *, heading AS key, id::VARCHAR AS ids FROM decisions WHERE action IN ('log', 'review')) {SECTIONS}")
def sections_by_exact_heading(spark, d):
    return as_rows(M.sections_by_exact_heading(decisions(spark, d).where("action in ('log', 'review')")))


@curation.query("baseline_sections", f"WITH {CHUNKS}, kept AS (SELECT * REPLACE (CASE WHEN heading = '' THEN 'General' ELSE heading END AS heading), CASE WHEN heading = '' THEN 'General' ELSE heading END AS key, id::VARCHAR AS ids FROM chunks WHERE {S.ustrip('text')} <> '') {SECTIONS}")
def baseline_sections(spark, d):
    return as_rows(M.baseline_sections(chunks(spark, d)))


@curation.query("reviewed_sections", f"WITH {TRIAGE}, kept AS (SELECT t.doc_uuid, t.pos, t.id, c.text, t.heading_out AS heading, {S.norm_heading('t.heading_out')} AS key, t.id::VARCHAR AS ids FROM triaged t JOIN chunks c USING (id) WHERE t.action <> 'skip') {SECTIONS}")
def reviewed_sections(spark, d):
    """From chunks to sections in one chain: triage accepted as proposed, and the sections it makes."""
    return as_rows(review(chunks(spark, d), ratio=None).sections)


@curation.query("review_history", f"""WITH {FOLD}, t AS (SELECT doc_uuid, gid, id AS into_id FROM g WHERE kept)
SELECT g.doc_uuid, g.pos, g.id, CASE g.action WHEN 'skip' THEN 'skipped' WHEN 'merge' THEN 'merged' ELSE 'logged (auto)' END AS status, CASE WHEN g.action = 'merge' AND NOT g.kept THEN t.into_id END AS merged_into
FROM g LEFT JOIN t ON g.doc_uuid = t.doc_uuid AND g.gid = t.gid AND g.action <> 'skip'""")
def review_history(spark, d):
    return M.history(decisions(spark, d))


@curation.query("resume_overlay", f"""WITH {TRIAGE}, past AS (SELECT doc_uuid, id, arg_max(decision, updated_at) AS status FROM sections WHERE decision <> '' GROUP BY 1, 2)
SELECT t.doc_uuid, t.id, CASE p.status WHEN 'skip' THEN 'skip' WHEN 'log' THEN 'log' ELSE t.action END AS action, p.status IS NOT NULL AS resumed FROM triaged t LEFT JOIN past p USING (doc_uuid, id)""")
def resume_overlay(spark, d):
    s = table(spark, d, "sections", "doc_uuid", "id", "decision", "updated_at").where("decision <> ''")
    past = s.select("doc_uuid", "id", F.col("updated_at").alias("seq"), F.when(F.col("decision") == "skip", "skipped").when(F.col("decision") == "log", "logged (auto)").otherwise(F.col("decision")).alias("status"))
    return M.overlay_history(contained(spark, d), past).select("doc_uuid", "id", "action", "resumed")


@curation.query("bulk_edit", f"WITH {DECISIONS} SELECT id, CASE WHEN action = 'review' THEN 'log' ELSE action END AS action, CASE WHEN action = 'review' THEN 'Reviewed' ELSE heading END AS heading, action = 'review' AS edited FROM decisions")
def bulk_edit(spark, d):
    """Accepts everything under review beneath one heading."""
    dec = decisions(spark, d).withColumn("toc_match", F.lit(None).cast("boolean"))
    edits = dec.where("action = 'review'").select("doc_uuid", "id", F.lit("log").alias("set_action"), F.lit("Reviewed").alias("set_heading"))
    return M.bulk_edit(dec, edits).select("id", "action", "heading", "edited")


@curation.query("use_heading_above", f"""WITH {DECISIONS} SELECT doc_uuid, pos, id,
last_value(CASE WHEN action NOT IN ('skip', 'merge') THEN heading END IGNORE NULLS) OVER w AS kept_above, lag(heading) OVER (PARTITION BY doc_uuid ORDER BY pos, id) AS any_above
FROM decisions WINDOW w AS (PARTITION BY doc_uuid ORDER BY pos, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def use_heading_above(spark, d):
    dec = decisions(spark, d)
    return M.heading_of_row_above(dec, True).withColumnRenamed("above", "kept_above").join(M.heading_of_row_above(dec, False).select("id", F.col("above").alias("any_above")), "id").select("doc_uuid", "pos", "id", "kept_above", "any_above")


@curation.query("versioned_save", f"WITH {TRIAGE}, decisions AS (SELECT id, doc_uuid, {ACTION_SQL} AS action FROM chunks) SELECT DISTINCT t.doc_uuid FROM triaged t JOIN decisions USING (id) WHERE t.action <> decisions.action")
def versioned_save(spark, d):
    """Documents whose saved review differs from what triage proposes now."""
    old = decisions(spark, d).select("doc_uuid", "id", "action")
    return M.changed_documents(old, contained(spark, d).select("doc_uuid", "id", "action"), ["id", "action"])


@curation.query("section_edits", f"""WITH s AS (SELECT doc_uuid, ordinal, any_value(heading) AS heading, any_value(text) AS text, count(*) AS n FROM sections GROUP BY 1, 2 HAVING count(*) = 1)
SELECT doc_uuid, ordinal, CASE WHEN ordinal % 10 = 3 THEN 'Edited' ELSE heading END AS heading, regexp_replace(CASE WHEN ordinal % 10 = 3 THEN 'edited text' ELSE text END, {q(S.WS + '+$')}, '') AS text FROM s WHERE ordinal % 10 <> 7
UNION ALL SELECT doc_uuid, ordinal + 1000000, 'Added', 'added text' FROM s WHERE ordinal % 10 = 5""")
def section_edits(spark, d):
    """Edits, deletions and additions told from the position in the document."""
    s = table(spark, d, "sections", "doc_uuid", "ordinal", "heading", "text").groupBy("doc_uuid", "ordinal").agg(F.first("heading").alias("heading"), F.first("text").alias("text"), F.count("*").alias("n")).where("n = 1").drop("n")
    m = F.col("ordinal") % 10
    op = F.when(m == 3, "edit").when(m == 7, "delete").when(m == 5, "add")
    edits = s.select("doc_uuid", F.when(m == 5, F.col("ordinal") + 1_000_000).otherwise(F.col("ordinal")).alias("ordinal"), op.alias("op"), F.when(m == 3, "Edited").otherwise("Added").alias("heading"), F.when(m == 3, "edited text").otherwise("added text").alias("text")).where("op is not null")
    return M.section_edits(s, edits)


TOC_LINE = f"{S.ustrip('line')}"
ENTRY = f"""matched AS (SELECT *, {S.matches('t', X.TOC_ENTRY)} AS m FROM trimmed),
entries AS (SELECT *, trim(CASE WHEN m THEN regexp_extract(t, {q(X.TOC_ENTRY)}, 1) ELSE t END, ' .·•_-' || chr(9)) AS title, CASE WHEN m THEN TRY_CAST(regexp_extract(t, {q(X.TOC_ENTRY)}, 2) AS INTEGER) END AS epage
  FROM matched WHERE t <> '' AND NOT {S.toc_title('t')} AND (m OR ({S.numbered('t')} AND length(t) <= 200)))"""


@curation.query("toc_entries", f"""WITH {CHUNKS}, trimmed AS (SELECT doc_uuid, pos, id, {S.ustrip("regexp_replace(heading, '[ \t-\r]+', ' ', 'g') || ' ..... ' || coalesce(page::VARCHAR, '')")} AS t FROM chunks), {ENTRY}
SELECT doc_uuid, pos, id, title, epage AS page FROM entries WHERE title <> ''""")
def toc_entries(spark, d):
    """Contents lines printed from the headings and their pages, read back."""
    c = chunks(spark, d).withColumn("text", F.concat(F.regexp_replace("heading", r"\s+", " "), F.lit(" ..... "), F.coalesce(F.col("page").cast("string"), F.lit(""))))
    return T.toc_lines(c).select("doc_uuid", "pos", "id", "title", "page")


@curation.query("toc_table_quality", f"""WITH {CHUNKS}, cells AS (SELECT doc_uuid, pos, id, {S.clean_cell('heading')} AS c1, {S.clean_cell('page::VARCHAR')} AS c2 FROM chunks),
joined AS (SELECT *, CASE WHEN c1 <> '' AND c2 <> '' THEN c1 || ' ' || c2 ELSE c1 || c2 END AS j, (c1 <> '')::INT + (c2 <> '')::INT AS n FROM cells),
e AS (SELECT *, CASE WHEN n = 2 THEN trim(c1, ' .·•_-' || chr(9)) WHEN n = 1 AND {S.matches('j', X.TOC_ENTRY)} THEN trim(regexp_extract(j, {q(X.TOC_ENTRY)}, 1), ' .·•_-' || chr(9)) WHEN n = 1 AND {S.numbered('j')} AND length(j) <= 200 THEN trim(j, ' .·•_-' || chr(9)) END AS title,
  CASE WHEN n = 2 THEN TRY_CAST(c2 AS INTEGER) WHEN n = 1 AND {S.matches('j', X.TOC_ENTRY)} THEN TRY_CAST(regexp_extract(j, {q(X.TOC_ENTRY)}, 2) AS INTEGER) END AS p FROM joined),
v AS (SELECT *, CASE WHEN title <> '' AND NOT {S.toc_title('title')} AND {S.matches('title', '[A-Za-z]')} THEN p END AS page FROM e),
w AS (SELECT *, last_value(page IGNORE NULLS) OVER (PARTITION BY doc_uuid ORDER BY pos, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM v)
SELECT doc_uuid, count(*) FILTER (n > 0) AS n_rows, count(page) AS n_paged, count(*) FILTER (page IS NOT NULL AND prev IS NOT NULL) AS n_pairs, count(*) FILTER (page >= prev) AS n_forward, count(*) FILTER (page IS NOT NULL AND length(title) >= 4) AS n_titled,
CASE WHEN count(*) FILTER (n > 0) = 0 THEN 'empty' WHEN count(page) < 4 THEN 'too few entries' WHEN count(page) / count(*) FILTER (n > 0) < 0.6 THEN 'too few rows are entries'
WHEN count(*) FILTER (page IS NOT NULL AND prev IS NOT NULL) > 0 AND count(*) FILTER (page >= prev) / count(*) FILTER (page IS NOT NULL AND prev IS NOT NULL) < 0.8 THEN 'pages do not run forwards'
WHEN count(*) FILTER (page IS NOT NULL AND length(title) >= 4) < 0.5 * count(page) THEN 'titles do not read as titles' ELSE 'usable' END AS verdict FROM w GROUP BY 1""")
def toc_table_quality(spark, d):
    rows = chunks(spark, d).select("doc_uuid", "pos", "id", F.array("heading", F.col("page").cast("string")).alias("cells"))
    return T.table_quality(rows)


@curation.query("toc_cascade", f"""WITH {CHUNKS}, a AS (SELECT doc_uuid, 'chunks' AS source, count(*) FILTER (heading <> '') AS n_entries, count(page) FILTER (heading <> '') AS n_paged, 3 AS rank FROM chunks GROUP BY 1
UNION ALL SELECT doc_uuid, 'llm', count(*) FILTER ({S.numbered('heading')}), 0, 5 FROM chunks GROUP BY 1),
u AS (SELECT *, n_entries >= 4 AND (source = 'llm' OR n_paged >= 4) AS usable FROM a),
b AS (SELECT *, count(*) OVER (PARTITION BY doc_uuid) AS n_attempts FROM u QUALIFY row_number() OVER (PARTITION BY doc_uuid ORDER BY CASE WHEN usable THEN 0 ELSE 1 END, CASE WHEN usable THEN rank ELSE -n_entries END, rank) = 1)
SELECT doc_uuid, source, usable, n_entries, n_attempts FROM b""")
def toc_cascade(spark, d):
    c = chunks(spark, d)
    head = F.col("heading") != ""
    a = c.groupBy("doc_uuid").agg(F.lit("chunks").alias("source"), F.count_if(head).alias("n_entries"), F.count_if(head & F.col("page").isNotNull()).alias("n_paged"))
    b = c.groupBy("doc_uuid").agg(F.lit("llm").alias("source"), F.count_if(X.is_numbered_heading(F.col("heading"))).alias("n_entries"), F.lit(0).cast("long").alias("n_paged"))
    return T.resolve_cascade(a.unionByName(b))


@curation.query("toc_run", f"""WITH {CHUNKS}, x AS (SELECT doc_uuid, pos, id, heading, CASE WHEN pos = 0 THEN 'Contents' ELSE heading || ' ..... 1' || chr(10) || heading || ' ..... 2' END AS txt FROM chunks),
ln AS (SELECT doc_uuid, pos, id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT *, regexp_split_to_array(txt, '\r\n|\r|\n') AS l FROM x)),
trimmed AS (SELECT doc_uuid, pos, id, n, {S.ustrip('line')} AS t FROM ln WHERE {S.ustrip('line')} <> ''), {ENTRY},
e AS (SELECT id, count(*) AS parsed FROM entries WHERE title <> '' OR NOT m GROUP BY 1), a AS (SELECT id, count(*) AS n, arg_min(t, n) AS first_line FROM trimmed GROUP BY 1),
f AS (SELECT x.doc_uuid, x.pos, x.id, {S.toc_title('x.heading')} OR {S.toc_title('a.first_line')} AS announces, coalesce(a.n, 0) > 0 AND coalesce(e.parsed, 0) >= greatest(2, floor(coalesce(a.n, 0) / 2)) AS parses FROM x LEFT JOIN a USING (id) LEFT JOIN e USING (id)),
b AS (SELECT *, sum(announces::INT) OVER (PARTITION BY doc_uuid ORDER BY pos, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS begun FROM f),
w AS (SELECT *, sum((begun > 0 AND NOT parses AND NOT (begun = 1 AND announces))::INT) OVER (PARTITION BY doc_uuid ORDER BY pos, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS broken FROM b)
SELECT doc_uuid, pos, id FROM w WHERE begun > 0 AND broken = 0""")
def toc_run(spark, d):
    """Printed contents: each document's headings become contents lines below an announcing chunk."""
    c = chunks(spark, d)
    return T.toc_run(c.withColumn("text", F.when(F.col("pos") == 0, F.lit("Contents")).otherwise(F.concat("heading", F.lit(" ..... 1\n"), F.col("heading"), F.lit(" ..... 2")))))


@curation.query("contents_tables", f"""WITH {CHUNKS}, t AS (SELECT doc_uuid, id AS table_index, page FROM chunks WHERE labels_json = '["table"]'), w AS (SELECT DISTINCT doc_uuid, page FROM chunks WHERE pos < 3 AND page IS NOT NULL)
SELECT t.* FROM t WHERE CASE WHEN t.doc_uuid IN (SELECT doc_uuid FROM w) THEN EXISTS (SELECT 1 FROM w WHERE w.doc_uuid = t.doc_uuid AND w.page = t.page) ELSE t.page <= 25 END""")
def contents_tables(spark, d):
    c = chunks(spark, d)
    tables = c.where(F.array_join("labels", ",") == "table").select("doc_uuid", F.col("id").alias("table_index"), "page")
    return T.tables_on_contents_pages(tables, c.where("pos < 3 and page is not null").select("doc_uuid", "page")).select("doc_uuid", "table_index", "page")


@curation.query("fuzzy_headings")
def fuzzy_headings(spark, d):
    """Every heading of a document with the first of the document's valid headings that it matches."""
    m = marked(spark, d)
    return T.match_headings(m, G.valid_headings(m))
