"""Queries of items, uniques, entities, references, grounding, metrics and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.functions import text as X
from dossierflow.operators import entities as N
from dossierflow.operators import evaluate as E
from dossierflow.operators import items as I
from dossierflow.operators import metrics as K
from dossierflow.operators import refs as R
from dossierflow.operators import runs as U
from dossierflow.operators import vectors as V
from dossierflow.plans import sqltext as S
from dossierflow.plans.registry import Registry
from dossierflow.plans.sqltext import q
from dossierflow.sources.tables import table

evaluation = Registry()

SPLIT = lambda x: f"list_filter(list_transform(string_split({S.ustrip(f'coalesce({x}, {q('')})')}, ';'), lambda y: {S.ustrip('y')}), lambda y: y <> '')"


def rows(spark: SparkSession, d: str) -> DataFrame:
    """Evaluated cells in long form."""
    return table(spark, d, "eval_items", "item_row_id", "doc_uuid", "section_ordinal", "section_title", "column_name", "item", "jaccard", "reference_found").select(F.col("item_row_id").alias("row_id"), "doc_uuid", "section_ordinal", "section_title", "column_name", F.col("item").alias("cell"), "jaccard", "reference_found")


def referenced(spark: SparkSession, d: str) -> DataFrame:
    """Cells with the text of the section they point at (the last delivery of it)."""
    s = table(spark, d, "sections", "doc_uuid", "ordinal", "text", "updated_at", "id").groupBy("doc_uuid", F.col("ordinal").alias("section_ordinal")).agg(F.max_by(F.struct("text"), F.struct("updated_at", "id")).alias("s"))
    return rows(spark, d).join(s, ["doc_uuid", "section_ordinal"], "left").withColumn("reference", F.coalesce("s.text", F.lit(""))).drop("s")


REFERENCED = "refd AS (SELECT e.item_row_id AS row_id, e.doc_uuid, e.section_ordinal, e.section_title, e.column_name, e.item AS cell, e.jaccard, coalesce(s.text, '') AS reference FROM eval_items e LEFT JOIN (SELECT doc_uuid, ordinal, text FROM sections QUALIFY row_number() OVER (PARTITION BY doc_uuid, ordinal ORDER BY updated_at DESC, id DESC) = 1) s ON e.doc_uuid = s.doc_uuid AND e.section_ordinal = s.ordinal)"


@evaluation.query("split_items", f"SELECT item_row_id AS row_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS item_no, unnest(l) AS item FROM (SELECT item_row_id, {SPLIT('item')} AS l FROM eval_items)")
def split_items(spark, d):
    return E.exploded_items(rows(spark, d), ["row_id"])


UNIQ = f"u AS (SELECT column_name, item_row_id AS o, unnest(l) AS element, generate_subscripts(l, 1) AS k FROM (SELECT column_name, item_row_id, {SPLIT('item')} AS l FROM eval_items))"


@evaluation.query("unique_elements", f"""WITH k AS (SELECT 'keywords' AS column_name, attr_id AS o, unnest({SPLIT('keywords')}) AS element FROM node_attributes UNION ALL SELECT 'amended_by', attr_id, unnest({SPLIT('amended_by')}) FROM node_attributes)
SELECT column_name, element, count(*) AS n, min(o) AS first_seen FROM k GROUP BY 1, 2""")
def unique_elements(spark, d):
    return I.unique_elements(table(spark, d, "node_attributes", "attr_id", "keywords", "amended_by"), "attr_id", ["keywords", "amended_by"])


@evaluation.query("unique_elements_ci_by_count", f"""WITH k AS (SELECT attr_id AS o, unnest(l) AS element, generate_subscripts(l, 1) AS k FROM (SELECT attr_id, {SPLIT('keywords')} AS l FROM node_attributes)),
g AS (SELECT arg_min(element, (o, k)) AS element, count(*) AS n FROM k GROUP BY lower(element))
SELECT 'keywords' AS column_name, element, n, CAST(row_number() OVER (ORDER BY n DESC, lower(element), element) AS INTEGER) AS place FROM g""")
def unique_elements_ci_by_count(spark, d):
    u = I.unique_elements(table(spark, d, "node_attributes", "attr_id", "keywords"), "attr_id", ["keywords"], case_insensitive=True)
    return I.ranked(u, by_count=True).select("column_name", "element", "n", "place")


COUNTS = ", ".join(f"length(c) - length(replace(c, {x}, '')) AS n{i}" for i, x in enumerate(("';'", "'|'", "chr(10)", "chr(9)", "','")))


@evaluation.query("best_separator", f"""WITH c AS (SELECT attr_id, keywords AS c FROM node_attributes WHERE keywords IS NOT NULL), n AS (SELECT *, {COUNTS} FROM c)
SELECT attr_id, CASE WHEN greatest(n0, n1, n2, n3, n4) = 0 THEN NULL WHEN n0 = greatest(n0, n1, n2, n3, n4) THEN ';' WHEN n1 = greatest(n0, n1, n2, n3, n4) THEN '|' WHEN n2 = greatest(n0, n1, n2, n3, n4) THEN chr(10) WHEN n3 = greatest(n0, n1, n2, n3, n4) THEN chr(9) ELSE ',' END AS separator FROM n""")
def best_separator(spark, d):
    return table(spark, d, "node_attributes", "attr_id", "keywords").where("keywords is not null").select("attr_id", X.best_separator(F.col("keywords"), I.UI_SEPARATORS).alias("separator"))


@evaluation.query("distinct_with_blanks", f"SELECT DISTINCT {S.ustrip('e')} AS element FROM (SELECT unnest(string_split(keywords, ';')) AS e FROM node_attributes WHERE keywords IS NOT NULL)")
def distinct_with_blanks(spark, d):
    return I.distinct_with_blanks(table(spark, d, "node_attributes", "keywords"), "keywords", ";")


@evaluation.query("unique_sheet", f"""WITH a AS (SELECT element, n, CAST(row_number() OVER (ORDER BY element) AS INTEGER) AS place FROM (SELECT e AS element, count(*) AS n FROM (SELECT unnest({SPLIT('icao_reference')}) AS e FROM node_attributes) GROUP BY 1)),
b AS (SELECT element, n, CAST(row_number() OVER (ORDER BY element) AS INTEGER) AS place FROM (SELECT e AS element, count(*) AS n FROM (SELECT unnest({SPLIT('amended_by')}) AS e FROM node_attributes) GROUP BY 1))
SELECT coalesce(a.place, b.place) AS place, a.element AS unique_icao, a.n AS count_icao, b.element AS unique_amended, b.n AS count_amended FROM a FULL JOIN b ON a.place = b.place""")
def unique_sheet(spark, d):
    """Two columns of unique elements side by side, padded with nulls."""
    u = I.unique_elements(table(spark, d, "node_attributes", "attr_id", "icao_reference", "amended_by"), "attr_id", ["icao_reference", "amended_by"])
    r = I.ranked(u, by_count=False)
    one = lambda c, s: r.where(F.col("column_name") == c).select("place", F.col("element").alias(f"unique_{s}"), F.col("n").alias(f"count_{s}"))
    return I.side_by_side(one("icao_reference", "icao"), one("amended_by", "amended"))


@evaluation.query("missing_elements", f"SELECT attr_id, array_to_string(list_filter({SPLIT('keywords')}, lambda x: NOT list_contains({SPLIT('amended_by')}, x)), ' ¦ ') AS missing FROM node_attributes")
def missing_elements(spark, d):
    a = table(spark, d, "node_attributes", "attr_id", "keywords", "amended_by")
    return a.select("attr_id", F.array_join(I.missing_elements(X.split_items(F.col("keywords")), X.split_items(F.col("amended_by"))), " ¦ ").alias("missing"))


@evaluation.query("near_duplicate_lists")
def near_duplicate_lists(spark, d):
    a = table(spark, d, "node_attributes", "attr_id", "keywords", "amended_by")
    return I.merge_near_duplicates(a.select("attr_id", X.split_items(F.col("keywords")).alias("a"), X.split_items(F.col("amended_by")).alias("b")), "attr_id", "a", "b")


@evaluation.query("entity_chains", """WITH c AS (SELECT attr_id, coalesce(erules_id, '') || '|' || coalesce(domain, '#') || '|#|' || coalesce(type_of_content, '#') || CASE WHEN attr_id % 3 = 0 THEN '|12 kg' WHEN attr_id % 3 = 1 THEN '|mass|12 kg' ELSE '|mass|12 kg|x' END AS chain FROM node_attributes),
p AS (SELECT attr_id, chain, list_transform(string_split(chain, '|'), lambda x: CASE WHEN trim(x) = '#' THEN '' ELSE trim(x) END) AS f FROM c)
SELECT attr_id, chain, f[1] AS reference, f[2] AS system_info, f[3] AS process, f[4] AS personal, CASE WHEN len(f) = 5 THEN '' ELSE f[5] END AS physical_quantity, CASE WHEN len(f) = 5 THEN f[5] WHEN len(f) > 6 THEN f[6] || '|' || f[7] ELSE f[6] END AS quantity_value FROM p WHERE f[1] <> ''""")
def entity_chains(spark, d):
    a = table(spark, d, "node_attributes", "attr_id", "erules_id", "domain", "type_of_content")
    tail = F.when(F.col("attr_id") % 3 == 0, "|12 kg").when(F.col("attr_id") % 3 == 1, "|mass|12 kg").otherwise("|mass|12 kg|x")
    cell = F.concat(F.coalesce("erules_id", F.lit("")), F.lit("|"), F.coalesce("domain", F.lit("#")), F.lit("|#|"), F.coalesce("type_of_content", F.lit("#")), tail)
    return N.parse_chains(a, cell, ["attr_id"]).drop("chain_no")


@evaluation.query("legacy_chains", """WITH c AS (SELECT attr_id, coalesce(nullif(trim(erules_id), ''), '#') || '-AC 1-part-inspection-#-12 kg' AS chain FROM node_attributes)
SELECT attr_id, chain, regexp_replace(chain, '-part-inspection-#-12 kg$', '') AS reference, 'part' AS system_info, 'inspection' AS process, '' AS personal, '12 kg' AS quantity_value FROM c""")
def legacy_chains(spark, d):
    a = table(spark, d, "node_attributes", "attr_id", "erules_id")
    cell = F.concat(F.coalesce(F.nullif(F.trim("erules_id"), F.lit("")), F.lit("#")), F.lit("-AC 1-part-inspection-#-12 kg"))
    return N.parse_chains(a, cell, ["attr_id"]).drop("chain_no", "physical_quantity")


@evaluation.query("grounding_counts", f"""WITH {REFERENCED}, i AS (SELECT column_name, row_id, reference, unnest({SPLIT('cell')}) AS item FROM refd),
g AS (SELECT column_name, (reference <> '' AND (contains(lower(reference), lower(item)) OR ({S.squash('item')} <> '' AND contains({S.squash('reference')}, {S.squash('item')}))))::INT AS hit FROM i)
SELECT column_name, sum(hit)::BIGINT AS n_true, (count(*) - sum(hit))::BIGINT AS n_false, round_even(100.0::DOUBLE * sum(hit) / count(*), 1)::DOUBLE AS coverage_pct FROM g GROUP BY 1""")
def grounding_counts(spark, d):
    return E.grounding_counts(referenced(spark, d), ["column_name"])


@evaluation.query("coverage_by_section", f"""WITH {REFERENCED}, i AS (SELECT doc_uuid, section_ordinal, reference, unnest({SPLIT('cell')}) AS item FROM refd),
g AS (SELECT doc_uuid, section_ordinal, (reference <> '' AND (contains(lower(reference), lower(item)) OR ({S.squash('item')} <> '' AND contains({S.squash('reference')}, {S.squash('item')}))))::INT AS hit FROM i),
n AS (SELECT doc_uuid, section_ordinal, sum(hit)::BIGINT AS n_true, (count(*) - sum(hit))::BIGINT AS n_false FROM g GROUP BY 1, 2)
SELECT s.doc_uuid, s.section_ordinal, coalesce(n_true, 0) AS n_true, coalesce(n_false, 0) AS n_false, CASE WHEN n_true IS NOT NULL THEN round_even(100.0::DOUBLE * n_true / (n_true + n_false), 1)::DOUBLE END AS coverage_pct
FROM (SELECT DISTINCT doc_uuid, section_ordinal FROM refd) s LEFT JOIN n USING (doc_uuid, section_ordinal)""")
def coverage_by_section(spark, d):
    return E.grounding_counts(referenced(spark, d), ["doc_uuid", "section_ordinal"])


WORDS = lambda x: f"list_distinct(list_filter(string_split(regexp_replace(lower({x}), {q(S.WS + '+')}, ' ', 'g'), ' '), lambda w: w <> ''))"
JACCARD = lambda a, b: f"CASE WHEN len(list_distinct(list_concat({WORDS(a)}, {WORDS(b)}))) = 0 THEN 0.0 ELSE round_even(len(list_intersect({WORDS(a)}, {WORDS(b)}))::DOUBLE / len(list_distinct(list_concat({WORDS(a)}, {WORDS(b)}))), 4)::DOUBLE END"


@evaluation.query("jaccard_cells", f"SELECT item_row_id AS row_id, {JACCARD('item', 'best_ref_sentence')} AS score FROM eval_items WHERE item IS NOT NULL AND best_ref_sentence IS NOT NULL")
def jaccard_cells(spark, d):
    e = table(spark, d, "eval_items", "item_row_id", "item", "best_ref_sentence").where("item is not null and best_ref_sentence is not null")
    return e.select(F.col("item_row_id").alias("row_id"), X.jaccard(F.col("item"), F.col("best_ref_sentence")).alias("score"))


@evaluation.query("levenshtein_all")
def levenshtein_all(spark, d):
    """Edit distance in characters of every pair, in any script; DuckDB counts bytes."""
    e = table(spark, d, "eval_items", "item_row_id", "item", "best_ref_sentence").where("item is not null and best_ref_sentence is not null")
    return e.select(F.col("item_row_id").alias("row_id"), F.levenshtein("item", "best_ref_sentence").cast("long").alias("distance"))


@evaluation.query("best_sentence", f"""WITH {REFERENCED}, i AS (SELECT row_id, doc_uuid, section_ordinal, unnest(l) AS item, CAST(generate_subscripts(l, 1) AS INTEGER) AS item_no FROM (SELECT row_id, doc_uuid, section_ordinal, {SPLIT('cell')} AS l FROM refd)),
t AS (SELECT DISTINCT doc_uuid, section_ordinal, reference FROM refd WHERE reference <> ''),
s AS (SELECT doc_uuid, section_ordinal, unnest(string_split(reference, '. ')) AS sentence, CAST(generate_subscripts(string_split(reference, '. '), 1) AS INTEGER) AS sentence_no FROM t),
p AS (SELECT i.*, sentence_no, {JACCARD('item', 'sentence')} AS score FROM i JOIN s USING (doc_uuid, section_ordinal))
SELECT row_id, item_no, item, score AS best_score, sentence_no AS best_no FROM p QUALIFY row_number() OVER (PARTITION BY row_id, item_no ORDER BY score DESC, sentence_no) = 1""")
def best_sentence(spark, d):
    """Best sentence of each item by Jaccard index; sentences are cut at full stops here, as the twin does."""
    r = referenced(spark, d)
    items = E.exploded_items(r, ["row_id", "doc_uuid", "section_ordinal"])
    s = r.where("reference != ''").select("doc_uuid", "section_ordinal", "reference").distinct().select("doc_uuid", "section_ordinal", F.posexplode(F.split("reference", "\\. ")).alias("n", "sentence")).select("doc_uuid", "section_ordinal", (F.col("n") + 1).alias("sentence_no"), "sentence")
    return E.best_sentences(items, s, ["doc_uuid", "section_ordinal"], "jaccard", X.jaccard(F.col("item"), F.col("sentence"))).select("row_id", "item_no", "item", "best_score", "best_no")


@evaluation.query("best_reference_sentence")
def best_reference_sentence(spark, d):
    """Best sentence of each item by Jaccard index, sentences as references are cut."""
    r = referenced(spark, d).withColumn("section", F.concat_ws(":", "doc_uuid", "section_ordinal"))
    s = E.with_sentences(r.where("reference != ''").select("section", F.col("reference").alias("text")).distinct())
    return E.best_sentences(E.exploded_items(r, ["row_id", "section"]), s, ["section"], "jaccard", X.jaccard(F.col("item"), F.col("sentence")))


@evaluation.query("sentence_split")
def sentence_split(spark, d):
    s = table(spark, d, "sections", "id", "text").select(F.col("id").cast("string").alias("section"), "text")
    return E.with_sentences(s)


@evaluation.query("sentence_matrix")
def sentence_matrix(spark, d):
    """Every item against every sentence of its section, nested."""
    r = referenced(spark, d).withColumn("section", F.concat_ws(":", "doc_uuid", "section_ordinal"))
    items = E.exploded_items(r, ["row_id", "section"])
    return E.sentence_matrix(items, E.with_sentences(r.select("section", F.col("reference").alias("text")).distinct()), ["section"])


@evaluation.query("metric_averages", """WITH g AS (SELECT column_name, count(*) AS n, round_even(avg(jaccard), 4)::DOUBLE AS jaccard FROM eval_items GROUP BY 1)
SELECT * FROM g UNION ALL SELECT '— AVERAGE —', NULL, round_even(avg(jaccard), 4)::DOUBLE FROM g""")
def metric_averages(spark, d):
    g = rows(spark, d).groupBy("column_name").agg(F.count("*").alias("n"), F.bround(F.avg("jaccard"), 4).alias("jaccard"))
    return E.with_average_row(g, "column_name", ["jaccard"])


@evaluation.query("run_summary", f"""WITH {REFERENCED}, i AS (SELECT reference, unnest({SPLIT('cell')}) AS item FROM refd), g AS (SELECT (reference <> '' AND (contains(lower(reference), lower(item)) OR ({S.squash('item')} <> '' AND contains({S.squash('reference')}, {S.squash('item')}))))::INT AS hit FROM i)
SELECT sum(hit)::BIGINT AS n_true, (count(*) - sum(hit))::BIGINT AS n_false, sum(hit) || '/' || count(*) || ' (' || round_even(100.0::DOUBLE * sum(hit) / count(*), 1)::DOUBLE || '%)' AS coverage FROM g""")
def run_summary(spark, d):
    g = E.grounding_counts(referenced(spark, d).withColumn("one", F.lit(1)), ["one"])
    return g.select("n_true", "n_false", E.coverage_text(F.col("n_true"), F.col("n_true") + F.col("n_false")).alias("coverage"))


# Every distinct element against every distinct reference.
GROUNDED = f"""r AS (SELECT DISTINCT lower(reference) AS low, {S.squash('reference')} AS squashed FROM refd WHERE reference <> ''), i AS (SELECT column_name, unnest({SPLIT('cell')}) AS element FROM refd), e AS (SELECT DISTINCT element, lower(element) AS low, {S.squash('element')} AS squashed FROM i),
h AS (SELECT DISTINCT e.element FROM e JOIN r ON contains(r.low, e.low) OR (e.squashed <> '' AND contains(r.squashed, e.squashed))),
g AS (SELECT column_name, element, count(*) AS n, element IN (SELECT element FROM h) AS hit FROM i GROUP BY 1, 2)"""


@evaluation.query("uniq_eval", f"WITH {REFERENCED}, {GROUNDED} SELECT column_name, count(*) AS n_unique, count(*) FILTER (hit) AS n_grounded, round_even(100.0::DOUBLE * count(*) FILTER (hit) / count(*), 1)::DOUBLE AS coverage_pct FROM g GROUP BY 1")
def uniq_eval(spark, d):
    r = referenced(spark, d)
    u = E.exploded_items(r, ["column_name"]).select("column_name", F.col("item").alias("element")).distinct()
    g = E.grounded_uniques(u, r)
    return g.groupBy("column_name").agg(F.count("*").alias("n_unique"), F.count_if("is_grounded").alias("n_grounded")).withColumn("coverage_pct", E.coverage(F.col("n_grounded"), F.col("n_unique")))


@evaluation.query("uniq_eval_sheet", f"""WITH {REFERENCED}, {GROUNDED} SELECT column_name, 0 AS is_total, element, n, CASE WHEN hit THEN 'True' ELSE 'False' END AS grounded FROM g
UNION ALL SELECT column_name, 1, '— COVERAGE —', NULL, count(*) FILTER (hit) || '/' || count(*) || ' (' || round_even(100.0::DOUBLE * count(*) FILTER (hit) / count(*), 1)::DOUBLE || '%)' FROM g GROUP BY 1""")
def uniq_eval_sheet(spark, d):
    """The sheet of unique elements: element, count, grounded, and a row of coverage for each column."""
    return U.uniq_eval_sheet(referenced(spark, d))


@evaluation.query("reference_lookup", f"""WITH r AS (SELECT heading, text, id AS pos FROM sections WHERE heading IS NOT NULL), x AS (SELECT heading, arg_min(coalesce(text, ''), pos) AS t FROM r GROUP BY 1), l AS (SELECT lower({S.ustrip('heading')}) AS k, arg_min(coalesce(text, ''), pos) AS t FROM r GROUP BY 1)
SELECT e.item_row_id AS row_id, length(coalesce(x.t, l.t, ''))::BIGINT AS n_chars, md5(coalesce(x.t, l.t, '')) AS digest FROM eval_items e LEFT JOIN x ON e.section_title = x.heading LEFT JOIN l ON lower({S.ustrip('e.section_title')}) = l.k""")
def reference_lookup(spark, d):
    """Section text by title: exact, else by trimmed lower-case title."""
    refs = table(spark, d, "sections", "heading", "text", "id").select(F.col("heading").alias("section_title"), "text", F.col("id").alias("pos"))
    r = E.attach_references(rows(spark, d), refs)
    return r.select("row_id", F.char_length("reference").cast("long").alias("n_chars"), F.md5("reference").alias("digest"))


@evaluation.query("metric_scores")
def metric_scores(spark, d):
    """ROUGE, BLEU, word error rate, InDel and sequence ratio of every evaluated cell."""
    e = table(spark, d, "eval_items", "item_row_id", "item", "best_ref_sentence")
    return K.score_pairs(e.select(F.col("item_row_id").alias("pair_id"), F.col("item").alias("candidate"), F.col("best_ref_sentence").alias("reference")))


@evaluation.query("eval_sheet", "PIVOT (SELECT doc_uuid || ':' || section_ordinal AS section, column_name, item AS cell, item_row_id FROM eval_items) ON column_name IN ('Quantities', 'References', 'Requirements', 'Specific entities') USING arg_max(cell, item_row_id) GROUP BY section")
def eval_sheet(spark, d):
    r = rows(spark, d).withColumn("section", F.concat_ws(":", "doc_uuid", "section_ordinal"))
    return E.pivot_sheet(r, ["Quantities", "References", "Requirements", "Specific entities"])


@evaluation.query("evaluated_columns", "SELECT DISTINCT column_name, contains(lower(column_name), 'reference') AS is_reference, lower(trim(column_name)) = 'specific entities' AS is_entity, substr('Jac ' || column_name, 1, 31) AS sheet, 'Ref Map ' || column_name AS ref_map FROM eval_items")
def evaluated_columns(spark, d):
    c = F.col("column_name")
    return rows(spark, d).select("column_name", X.is_reference_column(c).alias("is_reference"), X.is_entity_column(c).alias("is_entity"), X.sheet_name("Jac", c).alias("sheet"), X.ref_map_sheet(c).alias("ref_map")).distinct()


RULES = r"v AS (SELECT DISTINCT item AS value FROM eval_items WHERE item IS NOT NULL)"


@evaluation.query("rule_ids", r"""WITH v AS (SELECT DISTINCT unnest(string_split(item, ';')) AS value FROM eval_items), m AS (SELECT value, regexp_extract(value, '^\s*([A-Z]{2,3}\d?)\s*(\d{2})\.(\d{2,4})([^0-9]|$)', ['a', 'b', 'c', 'z']) AS r, regexp_extract(value, '^\s*(\d{2}\.[^\s(]+)', 1) AS b FROM v)
SELECT value, nullif(r.a, '') AS prefix, CASE WHEN r.a <> '' THEN r.b || '.' || r.c END AS number, CASE WHEN r.a = '' AND length(rtrim(b, '.,;:-')) > 3 THEN rtrim(b, '.,;:-') END AS bare FROM m""")
def rule_ids(spark, d):
    v = table(spark, d, "eval_items", "item").select(F.explode(F.split("item", ";")).alias("value")).distinct()
    return R.parsed_values(v, "value").select("value", "prefix", "number", "bare")


TITLES = "t AS (SELECT md5(title) AS title_id, upper(title) AS u, title FROM (SELECT DISTINCT unnest([heading, text]) AS title FROM sections) WHERE title IS NOT NULL)"
VALUES = f"v AS (SELECT DISTINCT {S.ustrip('value')} AS value FROM (SELECT unnest(string_split(item, ';')) AS value FROM eval_items))"
RULE_HITS = f"""m AS (SELECT value, regexp_extract(value, '^\\s*([A-Z]{{2,3}}\\d?)\\s*(\\d{{2}})\\.(\\d{{2,4}})([^0-9]|$)', ['a', 'b', 'c', 'z']) AS r FROM v), k AS (SELECT value, upper(r.a || ' ' || r.b || '.' || r.c) AS needle FROM m WHERE r.a <> ''),
h AS (SELECT title_id, unnest(regexp_extract_all(u, '\\b[A-Z]{{2,3}}\\d?\\s+\\d{{2}}\\.\\d{{2,}}')) AS hit FROM t)"""


def _values(spark, d):
    return table(spark, d, "eval_items", "item").select(F.explode(F.split("item", ";")).alias("value")).select(X.ustrip(F.col("value")).alias("value"))


def _titles(spark, d):
    """Headings and texts of all sections, which the queries of this group take as titles, under their digests."""
    s = table(spark, d, "sections", "heading", "text")
    return s.select(F.explode(F.array("heading", "text")).alias("title")).where("title is not null").select(F.md5("title").alias("title_id"), "title")


@evaluation.query("ref_section_match", f"WITH {VALUES}, {TITLES}, {RULE_HITS} SELECT DISTINCT value, title_id, 'rule id' AS how FROM k JOIN h ON regexp_replace(h.hit, '\\s+', ' ', 'g') = k.needle")
def ref_section_match(spark, d):
    """Rule identifiers in values against the section titles that name them."""
    return R.match_rules(_values(spark, d), "value", _titles(spark, d))


@evaluation.query("bare_rule_match", f"""WITH {VALUES}, {TITLES}, b AS (SELECT value, upper(rtrim(regexp_extract(value, '^\\s*(\\d{{2}}\\.[^\\s(]+)', 1), '.,;:-')) AS bare FROM v WHERE NOT regexp_matches(value, '^\\s*[A-Z]{{2,3}}\\d?\\s*\\d{{2}}\\.\\d{{2,4}}([^0-9]|$)')),
c AS (SELECT value, bare, title_id, u FROM b JOIN t ON length(bare) > 3 AND contains(u, bare))
SELECT DISTINCT value, title_id, 'bare rule no.' AS how FROM c WHERE regexp_matches(u, '\\b' || regexp_escape(bare) || '([^0-9]|$)')""")
def bare_rule_match(spark, d):
    """Values that are bare rule numbers of any form against the section titles that hold the number."""
    return R.match_bare(_values(spark, d).distinct(), "value", _titles(spark, d))


@evaluation.query("title_substrings")
def title_substrings(spark, d):
    """Values and section titles of which one holds the other."""
    titles = _titles(spark, d).withColumn("title_id", F.unhex("title_id"))  # half as long in the joins
    return R.match_titles(_values(spark, d), "value", titles).withColumn("title_id", F.lower(F.hex("title_id")))


@evaluation.query("rule_tally", f"""WITH {VALUES}, {TITLES}, {RULE_HITS}, n AS (SELECT {S.ustrip('value')} AS value, count(*) AS n FROM (SELECT unnest(string_split(item, ';')) AS value FROM eval_items) GROUP BY 1),
d AS (SELECT DISTINCT value, title_id FROM k JOIN h ON regexp_replace(h.hit, '\\s+', ' ', 'g') = k.needle) SELECT title_id, sum(n)::BIGINT AS occurrences, count(*) AS n_values FROM d JOIN n USING (value) GROUP BY 1""")
def rule_tally(spark, d):
    """Occurrences and values of every section title by rule identifiers alone."""
    n = _values(spark, d).groupBy("value").agg(F.count("*").alias("n"))
    return R.section_tally(R.match_rules(n, "value", _titles(spark, d)), n)


@evaluation.query("section_tally")
def section_tally(spark, d):
    """Occurrences and values of every section title by all three paths of reference matching, in order."""
    n = _values(spark, d).where("value != ''").groupBy("value").agg(F.count("*").alias("n"))
    titles = _titles(spark, d).withColumn("title_id", F.unhex("title_id"))  # half as long in the joins
    return R.section_tally(R.match_sections(n, "value", titles, ("n",)), n).withColumn("title_id", F.lower(F.hex("title_id")))


def _reference_values(spark, d):
    u = E.exploded_items(rows(spark, d).where("column_name = 'References'"), ["column_name", "section_title"]).select("column_name", "section_title", F.col("item").alias("value"))
    return u, u.groupBy("column_name", "value").agg(F.count("*").alias("n"))


@evaluation.query("ref_map")
def ref_map(spark, d):
    """Every unique value of the reference column with the titles it matched and the sections it comes from; values without match too."""
    u, n = _reference_values(spark, d)
    return R.ref_map(n, u, _titles(spark, d))


@evaluation.query("section_block")
def section_block(spark, d):
    """The section columns beside the unique elements: title, occurrences and matched values, most referenced first."""
    _, n = _reference_values(spark, d)
    return R.section_block(R.match_sections(n, "value", _titles(spark, d)), n)


SOURCES = f"""WITH u AS (SELECT unnest({SPLIT('item')}) AS value, section_title FROM eval_items WHERE column_name = 'References'),
s AS (SELECT DISTINCT lower({S.ustrip('value')}) AS k, section_title FROM u WHERE {S.ustrip('section_title')} <> ''), n AS (SELECT value, count(*) AS n FROM u GROUP BY 1)"""


@evaluation.query("ref_map_fanout", f"{SOURCES} SELECT n.value, n.n, coalesce(s.section_title, '') AS source_section FROM n LEFT JOIN s ON lower({S.ustrip('n.value')}) = s.k")
def ref_map_fanout(spark, d):
    """Each unique reference value with every section it was found in."""
    u = E.exploded_items(rows(spark, d).where("column_name = 'References'"), ["section_title"]).select(F.col("item").alias("value"), "section_title")
    n = u.groupBy("value").agg(F.count("*").alias("n"))
    return R.section_sources(n, "value", u, "value", "section_title")


@evaluation.query("strip_parentheticals", r"SELECT DISTINCT heading, trim(trim(regexp_replace(regexp_replace(coalesce(heading, ''), '\([^()]*\)', ' ', 'g'), '[\t-\r \x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+', ' ', 'g')), ' ,;:-') AS stripped FROM sections")
def strip_parentheticals(spark, d):
    return table(spark, d, "sections", "heading").distinct().select("heading", X.strip_parentheticals(F.col("heading")).alias("stripped"))


@evaluation.query("cosine_topk", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id, round_even(list_cosine_similarity(a.e, b.e), 4)::DOUBLE AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p QUALIFY rank <= 10")
def cosine_topk(spark, d):
    """The ten nearest of every vector whose id is divisible by 100, against all vectors."""
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return V.cosine_to_queries(v, queries, 10)


@evaluation.query("centroid_cosine", """WITH p AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS m FROM p GROUP BY 1)
SELECT a.label AS a, b.label AS b, round_even(list_cosine_similarity(a.m, b.m), 4)::DOUBLE AS score FROM c a JOIN c b ON a.label < b.label""")
def centroid_cosine(spark, d):
    c = V.centroids(table(spark, d, "embeddings", "label", "embedding"), "label")
    o = c.select(F.col("label").alias("b"), F.col("centroid").alias("cb"))
    return c.join(o, F.col("label") < F.col("b")).select(F.col("label").alias("a"), "b", F.bround(V.cosine(F.col("centroid"), F.col("cb")), 4).alias("score"))


@evaluation.query("greedy_prf", """WITH v AS (SELECT vec_id, vec_id // 20 AS k, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT a.k, a.vec_id AS c, b.vec_id AS r, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.k = b.k AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
pr AS (SELECT k, avg(m) AS p FROM (SELECT k, c, max(s) AS m FROM p GROUP BY 1, 2) GROUP BY 1), re AS (SELECT k, avg(m) AS r FROM (SELECT k, r, max(s) AS m FROM p GROUP BY 1, 2) GROUP BY 1)
SELECT k, round_even(p, 4)::DOUBLE AS precision, round_even(r, 4)::DOUBLE AS recall, round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4)::DOUBLE AS f1 FROM pr JOIN re USING (k)""")
def greedy_prf(spark, d):
    """Twenty vectors at a time stand for the tokens of two texts."""
    v = table(spark, d, "embeddings", "vec_id", "embedding").withColumn("k", F.floor(F.col("vec_id") / 20))
    c = v.where("vec_id % 2 = 0").select("k", F.col("vec_id").alias("cand_id"), F.col("embedding").alias("c"))
    r = v.where("vec_id % 2 = 1").select("k", F.col("vec_id").alias("ref_id"), F.col("embedding").alias("r"))
    return V.greedy_scores(c, r, "k").select("k", *[F.bround(x, 4).alias(x) for x in ("precision", "recall", "f1")])
