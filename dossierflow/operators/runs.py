"""Evaluation of whole runs: from cells and references to all result sheets.

A run is (row_id, section_title, column_name, cell); references are
(section_title, text, pos). Everything stays lazy until a sheet is written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.functions import text as X
from dossierflow.operators import evaluate as E
from dossierflow.operators import metrics as K
from dossierflow.operators import refs as R
from dossierflow.operators.items import unique_elements
from dossierflow.sources import sinks

PROVENANCE = ("Service Used", "Model Used", "Fallback?")
#: Metric choices of the analysis view (fixed values).
FAMILIES = {"lexical": ("jaccard", "rouge1", "rouge2", "rougeL", "bleu"), "distance": ("levenshtein_distance", "similarity_ratio", "word_error_rate"), "semantic": ("semantic_cosine", "bertscore_precision", "bertscore_recall", "bertscore_f1")}


def wanted_metrics(choices: list[str]) -> list[str]:
    """Metrics of the choices in their fixed order; a family stands for its members."""
    chosen = {m for c in choices for m in FAMILIES.get(c, (c,))}
    return [m for m in E.METRIC_CODES if m in chosen]


@dataclass
class RunResult:
    """Sheets of an evaluated run."""

    entries: DataFrame
    items: DataFrame
    summary: DataFrame
    by_metric: dict[str, DataFrame] = field(default_factory=dict)


def evaluate_run(rows: DataFrame, references: DataFrame, metrics: list[str]) -> RunResult:
    """Grounding per cell and row, and per item the best sentence by each metric; provenance columns are left out."""
    cells = E.attach_references(rows.where(~F.col("column_name").isin(*PROVENANCE)), references)
    entries = E.grounding_counts(cells, ["section_title", "column_name"])
    items = E.exploded_items(cells, ["row_id", "section_title", "column_name", "reference"])
    items = items.withColumn("grounding", X.grounded(F.col("item"), F.col("reference"))).drop("reference")
    sentences = E.with_sentences(cells.select(F.col("section_title").alias("section"), F.col("reference").alias("text")).where("text != ''").groupBy("section").agg(F.max("text").alias("text"))).withColumnRenamed("section", "section_title")
    keys = items.select("row_id", "section_title", "column_name", "item_no", "item")
    by_metric: dict[str, DataFrame] = {}
    native = {"jaccard": X.jaccard(F.col("item"), F.col("sentence")), "levenshtein_distance": F.levenshtein("item", "sentence").cast("double")}
    for m in metrics:
        if m in native:
            by_metric[m] = E.best_sentences(keys, sentences, ["section_title"], m, native[m])
    scored = tuple(m for m in metrics if m in K.METRICS)
    if scored:
        # each distinct pair of texts is scored once; 256 bits stand for the pair in the join
        pair = F.sha2(F.concat(F.char_length("item").cast("string"), F.lit(":"), "item", "sentence"), 256)
        pairs = keys.join(sentences, "section_title").withColumn("pair_id", pair)
        one = pairs.groupBy("pair_id").agg(F.first("item").alias("candidate"), F.first("sentence").alias("reference"))
        scores = K.score_pairs(one.select("pair_id", "candidate", "reference"), scored, "string")
        for m in scored:
            values = scores.select("pair_id", F.col(m).alias("value"))
            sent = pairs.join(values, "pair_id").select(*keys.columns, "sentence_no", "sentence", "value").where("value is not null")
            sign = F.col("value") if m in K.LOWER_IS_BETTER else -F.col("value")
            g = sent.groupBy(*keys.columns).agg(F.min_by(F.struct("value", "sentence", "sentence_no"), F.struct(sign, F.col("sentence_no"))).alias("b"))
            by_metric[m] = g.select(*keys.columns, F.col("b.value").alias("best_score"), F.col("b.sentence").alias("best_sentence"), F.col("b.sentence_no").alias("best_no"))
    total = entries.agg(F.coalesce(F.sum("n_true"), F.lit(0)).alias("n_true"), F.coalesce(F.sum("n_false"), F.lit(0)).alias("n_false"))
    summary = total.withColumn("coverage_pct", E.coverage(F.col("n_true"), F.col("n_true") + F.col("n_false")))
    return RunResult(entries, items, summary, by_metric)


def write_run(result: RunResult, workbook: str, sheet: str) -> list[str]:
    """Writes the sheets of an evaluated run and gives their names."""
    names = [f"Eval {sheet}"[:31]]
    sinks.write_sheet(E.with_average_row(result.entries, "section_title", ["n_true", "n_false", "coverage_pct"]), workbook, names[0])
    for m, df in result.by_metric.items():
        names.append(f"{E.METRIC_CODES[m]} {sheet}"[:31])
        sinks.write_sheet(E.with_average_row(df, "section_title", ["best_score"]), workbook, names[-1])
    return names


def evaluate_workbook(spark: SparkSession, workbook: str, references: DataFrame, metrics: list[str]) -> dict[str, list[str]]:
    """Evaluates every run sheet of a workbook."""
    out = {}
    for sheet in sinks.evaluatable_sheets(spark, workbook, "section_title"):
        out[sheet] = write_run(evaluate_run(sinks.read_sheet(spark, workbook, sheet), references, metrics), workbook, sheet)
    return out


COVERAGE_LABEL, NO_MATCH = "— COVERAGE —", "— no match —"


def uniq_eval_sheet(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """Unique elements of each column with count and whether some reference holds them, closed by a row with the column's coverage."""
    u = rows.select("column_name", order, F.posexplode(X.split_items(F.col("cell"))).alias("k", "element")).groupBy("column_name", "element").agg(F.count("*").alias("n"))
    g = E.grounded_uniques(u.select("column_name", "element"), rows).join(u, ["column_name", "element"])
    lines = g.select("column_name", F.lit(0).alias("is_total"), "element", "n", F.initcap(F.col("is_grounded").cast("string")).alias("grounded"))
    total = g.groupBy("column_name").agg(F.count_if("is_grounded").alias("t"), F.count("*").alias("a"))
    return lines.unionByName(total.select("column_name", F.lit(1).alias("is_total"), F.lit(COVERAGE_LABEL).alias("element"), F.lit(None).cast("long").alias("n"), E.coverage_text(F.col("t"), F.col("a")).alias("grounded")))


def write_uniques(rows: DataFrame, titles: DataFrame, workbook: str, run: str) -> list[str]:
    """Writes the sheets of unique elements, of their evaluation and of the matches of reference columns; gives their names.

    `rows` has (row_id, section_title, column_name, cell, reference), `titles` (title_id, title).
    """
    names = [f"Uniq {run}"[:31], f"Uniq Eval {run}"[:31], f"Ref Map {run}"[:31]]
    u = rows.select("column_name", F.explode(X.split_items(F.col("cell"))).alias("value"), "section_title")
    counts = u.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    sinks.write_sheet(counts, workbook, names[0])
    sinks.write_sheet(uniq_eval_sheet(rows), workbook, names[1])
    refs = counts.where(X.is_reference_column(F.col("column_name")))
    sinks.write_sheet(R.ref_map(refs, u, titles), workbook, names[2])
    return names


def unique_sheet(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """Unique elements of every column of a run with counts, and whether they are grounded."""
    wide = rows.select(order, "column_name", "cell", "reference")
    u = unique_elements(wide.withColumn("element_source", F.col("cell")), order, ["element_source"]).select("element", "n")
    return E.grounded_uniques(u.withColumn("column_name", F.lit("")), wide.withColumn("column_name", F.lit(""))).select("element", "n", "is_grounded")
