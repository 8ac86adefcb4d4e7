"""Queries of the general problems: nested records, hierarchies, packed cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.operators.hierarchy import descendants, hierarchy
from dossierflow.operators.multivalue import CellGrammar, split_cells
from dossierflow.operators.nested import analyse, flat_table, hierarchy_rows, schema_edges, shred
from dossierflow.plans import jsonsql as J
from dossierflow.plans.registry import Registry
from dossierflow.plans.sqltext import ustrip
from dossierflow.sources.tables import table

problems = Registry()

# Circles: what doesn't hang on a root; of these, the nodes that reach themselves.
P2_SQL = f"""WITH RECURSIVE n AS (SELECT doc_uuid, {ustrip('node_id')} AS node_id, {ustrip('parent_node_id')} AS parent FROM sections WHERE {ustrip('node_id')} <> '' QUALIFY row_number() OVER (PARTITION BY doc_uuid, {ustrip('node_id')} ORDER BY updated_at DESC, id DESC) = 1),
t AS (SELECT n.doc_uuid, n.node_id, n.node_id AS root_node_id, 1 AS depth, [n.node_id] AS chain FROM n LEFT JOIN n p ON n.doc_uuid = p.doc_uuid AND n.parent = p.node_id WHERE p.node_id IS NULL
  UNION ALL SELECT n.doc_uuid, n.node_id, t.root_node_id, t.depth + 1, list_append(t.chain, n.node_id) FROM n JOIN t ON n.doc_uuid = t.doc_uuid AND n.parent = t.node_id),
d AS (SELECT doc_uuid, a AS node_id, count(*) - 1 AS n_descendants FROM (SELECT doc_uuid, unnest(chain) AS a FROM t) GROUP BY 1, 2),
rest AS (SELECT n.* FROM n ANTI JOIN t ON n.doc_uuid = t.doc_uuid AND n.node_id = t.node_id),
up AS (SELECT doc_uuid, node_id, parent AS at FROM rest UNION SELECT up.doc_uuid, up.node_id, r.parent FROM up JOIN rest r ON r.doc_uuid = up.doc_uuid AND r.node_id = up.at)
SELECT doc_uuid, node_id, root_node_id, depth::BIGINT AS depth, n_descendants::BIGINT AS n_descendants, array_to_string(chain, '/') AS node_path, 'none' AS cycle_role FROM t JOIN d USING (doc_uuid, node_id)
UNION ALL SELECT doc_uuid, node_id, '', -1, -1, '', CASE WHEN EXISTS (SELECT 1 FROM up WHERE up.doc_uuid = rest.doc_uuid AND up.node_id = rest.node_id AND up.at = rest.node_id) THEN 'on' ELSE 'below' END FROM rest"""

ATTRIBUTE_CELLS = {"keywords": CellGrammar(comma=True), "amended_by": CellGrammar(comma=True), "icao_reference": CellGrammar()}
ITEM_CELLS = {"item": CellGrammar()}


@problems.query("p1_found", f"WITH RECURSIVE {J.TREE} {J.FOUND}")
def p1_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return hierarchy_rows(table(spark, data_dir, "structured_json", "record_id", "payload"))


@problems.query("p1_schema_edges")
def p1_schema_edges(spark: SparkSession, data_dir: str) -> DataFrame:
    return schema_edges(table(spark, data_dir, "structured_json", "payload"))


@problems.query("p2_found", P2_SQL)
def p2_found(spark: SparkSession, data_dir: str) -> DataFrame:
    rows = table(spark, data_dir, "sections", "id", "doc_uuid", "node_id", "parent_node_id", "updated_at")
    h = hierarchy(rows, "doc_uuid", "node_id", "parent_node_id", [F.col("updated_at"), F.col("id")])
    return h.select(F.col("grp").alias("doc_uuid"), F.col("node").alias("node_id"), F.col("root_node").alias("root_node_id"), "depth", F.col("size").alias("n_descendants"), F.col("path").alias("node_path"), F.col("role").alias("cycle_role"))


@problems.query("p1_tables")
def p1_tables(spark: SparkSession, data_dir: str) -> DataFrame:
    """Rows of all flat tables with the keys of their parents."""
    records = table(spark, data_dir, "structured_json", "record_id", "payload")
    return shred(records, analyse(records)).withColumn("columns", F.to_json("columns"))


def _flat(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """One flat table; its rows name their record, their node and the node above it."""
    records = table(spark, data_dir, "structured_json", "record_id", "payload")
    graph = analyse(records)
    own = flat_table(shred(records, graph), graph, name).where(F.col("parent_table").isin("record", "node"))
    above = lambda c: F.when(c.contains("."), F.regexp_replace(c, r"\.[^.]+$", ""))
    node = F.col("path") if name == "node" else above(F.col("path"))
    return own.withColumns({"node_path": node, "parent_node_path": above(node)})


@problems.query("p1_nodes")
def p1_nodes(spark: SparkSession, data_dir: str) -> DataFrame:
    """Flat table of nodes, inlined fields as typed columns."""
    return _flat(spark, data_dir, "node").drop("name", "value")


@problems.query("p1_attributes")
def p1_attributes(spark: SparkSession, data_dir: str) -> DataFrame:
    """Flat table of the nodes' attributes."""
    return _flat(spark, data_dir, "attribute")


@problems.query("p1_images")
def p1_images(spark: SparkSession, data_dir: str) -> DataFrame:
    """Flat table of the nodes' images."""
    return _flat(spark, data_dir, "image")


@problems.query("p2_intervals")
def p2_intervals(spark: SparkSession, data_dir: str) -> DataFrame:
    """Entry intervals of every node: its descendants are the nodes of its tour whose entry lies in (entry, entry + n_descendants]."""
    rows = table(spark, data_dir, "sections", "id", "doc_uuid", "node_id", "parent_node_id", "updated_at")
    h = hierarchy(rows, "doc_uuid", "node_id", "parent_node_id", [F.col("updated_at"), F.col("id")])
    return h.select(F.col("grp").alias("doc_uuid"), F.col("node").alias("node_id"), "tour", "entry", F.col("size").alias("n_descendants"), "depth", F.col("role").alias("cycle_role"))


P2_BELOW = f"""{P2_SQL[: P2_SQL.index("d AS (")].rstrip().rstrip(",")}, q AS (SELECT DISTINCT doc_uuid, {ustrip('node_id')} AS node_id FROM sections WHERE id % 100 = 0),
p AS (SELECT doc_uuid, node_id AS descendant_id, unnest(chain[1:depth - 1]) AS node_id, depth - generate_subscripts(chain[1:depth - 1], 1) AS distance FROM t WHERE depth > 1)
SELECT p.doc_uuid, p.node_id, p.descendant_id, p.distance::BIGINT AS distance FROM p JOIN q USING (doc_uuid, node_id)"""


@problems.query("p2_descendants", P2_BELOW)
def p2_descendants(spark: SparkSession, data_dir: str) -> DataFrame:
    """All descendants of every node delivered under an id divisible by 100 (a stated query set against all nodes)."""
    rows = table(spark, data_dir, "sections", "id", "doc_uuid", "node_id", "parent_node_id", "updated_at")
    h = hierarchy(rows, "doc_uuid", "node_id", "parent_node_id", [F.col("updated_at"), F.col("id")])
    asked = rows.where("id % 100 = 0").select(F.col("doc_uuid").alias("grp"), F.regexp_replace("node_id", r"(?U)^\s+|\s+$", "").alias("node"))
    d = descendants(h, asked)
    return d.select(F.col("grp").alias("doc_uuid"), F.col("ancestor").alias("node_id"), F.col("node").alias("descendant_id"), "distance")


def packed_values(spark: SparkSession, data_dir: str) -> DataFrame:
    attributes = split_cells(table(spark, data_dir, "node_attributes", "attr_id", *ATTRIBUTE_CELLS), "attr_id", ATTRIBUTE_CELLS)
    items = split_cells(table(spark, data_dir, "eval_items", "item_row_id", *ITEM_CELLS), "item_row_id", ITEM_CELLS)
    return attributes.unionAll(items)


@problems.query("p6_found")
def p6_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return packed_values(spark, data_dir).select("src_field", "row_id", "value_pos", "field_value")


@problems.query("p6_value_counts")
def p6_value_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    """How often each value occurs in a field, over all cells."""
    return packed_values(spark, data_dir).groupBy("src_field", "field_value").agg(F.count("*").alias("n_values"), F.countDistinct("row_id").alias("n_cells"))
