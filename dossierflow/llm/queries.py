"""Queries of the problems of text for language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.llm.canonical import canonical_groups, copy_links
from dossierflow.llm.language import classify, mislabelled, train
from dossierflow.llm.leakage import find_leaks, leaked_items
from dossierflow.llm.mixing import Mixture, mix_sources, shuffled_shards
from dossierflow.llm.sentences import split_sentences
from dossierflow.llm.split import cut_kinds, split_oversized
from dossierflow.plans.registry import Registry
from dossierflow.plans.sqltext import WS, q
from dossierflow.sources.tables import table

llm_queries = Registry()

# Letters and digits by field, under the case folding that the headings' letters need (ß is the only one that expands).
FORMS = r"""f AS (SELECT id, heading, array_to_string(list_sort(list_filter(string_split(regexp_replace(lower(replace(replace(heading, 'ß', 'ss'), 'ẞ', 'ss')), '[^\p{L}\p{N}|]', '', 'g'), '|'), lambda x: x <> '')), '|') AS key FROM sections WHERE heading IS NOT NULL)"""
P3_SQL = f"WITH {FORMS}, k AS (SELECT key, min(id) AS keep_id FROM f WHERE key <> '' GROUP BY 1) SELECT keep_id, id AS copy_id FROM f JOIN k USING (key) WHERE id <> keep_id"
P3_GROUPS_SQL = f"WITH {FORMS} SELECT min(id) AS keep_id, arg_min(heading, id) AS kept_text, count(*) AS n_copies, count(DISTINCT heading) AS n_forms FROM f WHERE key <> '' GROUP BY key"
P4_SQL = f"""SELECT id, CASE WHEN coalesce(list_max(list_transform(regexp_extract_all(text, {q('[^' + WS[1:-1] + '.!?。！？।]+')}), lambda x: length(x))), 0) > max_chars THEN 'forced' ELSE 'natural' END AS cut_kind FROM sections JOIN split_limits USING (source) WHERE length(text) > max_chars"""
# Windows of 12 words (24 letters in Japanese); a hyphen at a line's end joins or divides.
P7_SQL = r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '</?[A-Za-z!][^<>]*>', ' ', 'g'), '&[a-zA-Z]+;', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, regexp_replace(t, '-[ ]*\n\s*', '', 'g') AS t FROM c UNION SELECT doc_id, t FROM c),
dw AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(replace(t, 'ß', 'ss')), '[\p{L}\p{N}]+') AS w FROM v),
iw AS (SELECT item_id, lang, regexp_extract_all(lower(replace(text, 'ß', 'ss')), '[\p{L}\p{N}]+') AS w FROM heldout_items),
g AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM iw WHERE lang <> 'ja' AND len(w) >= 12),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM dw WHERE len(w) >= 12),
ij AS (SELECT item_id, array_to_string(w, '') AS s FROM iw WHERE lang = 'ja'), gj AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(s) - 22), lambda i: substr(s, i, 24))) AS g FROM ij WHERE length(s) >= 24),
dj AS (SELECT doc_id, array_to_string(w, '') AS s FROM dw WHERE regexp_matches(array_to_string(w, ''), '[ぁ-ヺ一-龥]{6}')), hj AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(s) - 22), lambda i: substr(s, i, 24))) AS g FROM dj WHERE length(s) >= 24)
SELECT DISTINCT doc_id, item_id FROM dg JOIN g USING (g) UNION SELECT DISTINCT doc_id, item_id FROM hj JOIN gj USING (g)"""


@llm_queries.query("p3_found", P3_SQL)
def p3_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return copy_links(table(spark, data_dir, "sections", "id", "heading"), "id", "heading")


@llm_queries.query("p3_groups", P3_GROUPS_SQL)
def p3_groups(spark: SparkSession, data_dir: str) -> DataFrame:
    return canonical_groups(table(spark, data_dir, "sections", "id", "heading"), "id", "heading")


def _pieces(spark: SparkSession, data_dir: str) -> DataFrame:
    return split_oversized(table(spark, data_dir, "sections", "id", "text", "source"), table(spark, data_dir, "split_limits"), "id", "text", "source")


@llm_queries.query("p4_found", P4_SQL)
def p4_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return cut_kinds(_pieces(spark, data_dir))


@llm_queries.query("p4_pieces")
def p4_pieces(spark: SparkSession, data_dir: str) -> DataFrame:
    return _pieces(spark, data_dir).select("id", "piece_no", "start_char", "end_char", "cut", "piece")


@llm_queries.query("p5_found")
def p5_found(spark: SparkSession, data_dir: str) -> DataFrame:
    sections = table(spark, data_dir, "sections", "id", "text", "labels_json").where(F.col("labels_json") == '["text"]').select(F.lit("sections").alias("src_table"), F.col("id").alias("row_id"), "text")
    items = table(spark, data_dir, "eval_items", "item_row_id", "best_ref_sentence").select(F.lit("eval_items").alias("src_table"), F.col("item_row_id").alias("row_id"), F.col("best_ref_sentence").alias("text"))
    return split_sentences(sections.unionAll(items))


def _leaks(spark: SparkSession, data_dir: str) -> DataFrame:
    return find_leaks(table(spark, data_dir, "documents", "doc_id", "text"), table(spark, data_dir, "heldout_items"))


@llm_queries.query("p7_found", P7_SQL)
def p7_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return leaked_items(_leaks(spark, data_dir))


@llm_queries.query("p7_passages")
def p7_passages(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every leaked passage with its place in the document."""
    return _leaks(spark, data_dir)


def _mixture(spark: SparkSession, data_dir: str) -> Mixture:
    return mix_sources(table(spark, data_dir, "documents", "doc_id", "text", "source"), table(spark, data_dir, "mix_targets"))


@llm_queries.query("p8_mix")
def p8_mix(spark: SparkSession, data_dir: str) -> DataFrame:
    """The chosen documents of every mix with their repeats."""
    return _mixture(spark, data_dir).documents()


@llm_queries.query("p8_shares")
def p8_shares(spark: SparkSession, data_dir: str) -> DataFrame:
    return _mixture(spark, data_dir).shares()


@llm_queries.query("p8_shards")
def p8_shards(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every draw with its output shard, shuffled within the shard; ranges of slots keep a shard of any size in many tasks."""
    return shuffled_shards(_mixture(spark, data_dir).draws)


def _segments(spark: SparkSession, data_dir: str) -> DataFrame:
    documents = table(spark, data_dir, "documents", "doc_id", "text", "lang")
    return classify(documents, train(documents))


@llm_queries.query("p9_found")
def p9_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return mislabelled(_segments(spark, data_dir))


@llm_queries.query("p9_segments")
def p9_segments(spark: SparkSession, data_dir: str) -> DataFrame:
    """Language and confidence of every document and of each of its segments."""
    return _segments(spark, data_dir)
