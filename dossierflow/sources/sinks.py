"""Exports: run sheets, evaluation details, review payloads, graphs and node texts.

A sheet is a dataset directory; a workbook is the directory above. Writers
stay distributed: nothing is gathered into one file unless it is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.operators.ordered import running_sum
from dossierflow.session import materialise

#: Prefixes of sheets that evaluation writes itself (fixed values).
RESULT_PREFIXES = ("Grd ", "Jac ", "R1 ", "R2 ", "RL ", "Bleu ", "Lev ", "Sim ", "WER ", "Cos ", "BsP ", "BsR ", "BsF ", "Eval", "Uniq", "Ref Map", "Entities")
FORMATS = ("parquet", "csv", "json")
CSV = {"header": True, "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def is_output_sheet(name: str) -> bool:
    return name.startswith(RESULT_PREFIXES)


def write_sheet(df: DataFrame, workbook: str, sheet: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Writes a sheet and gives its path; nested columns become JSON in CSV."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    path = f"{workbook.rstrip('/')}/{sheet}"
    if fmt == "csv":
        nested = {c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "struct", "map"))}
        df.withColumns(nested).write.mode(mode).options(**CSV).csv(path)
    else:
        getattr(df.write.mode(mode), fmt)(path)
    return path


def read_sheet(spark: SparkSession, workbook: str, sheet: str, fmt: str = "parquet") -> DataFrame:
    path = f"{workbook.rstrip('/')}/{sheet}"
    if fmt == "csv":
        return spark.read.options(**CSV).csv(path)
    return getattr(spark.read, fmt)(path)


def sheets(spark: SparkSession, workbook: str) -> list[str]:
    """Names of a workbook's sheets in order."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(workbook)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def evaluatable_sheets(spark: SparkSession, workbook: str, require: str | None = "section") -> list[str]:
    """Sheets that evaluation may read: not its own output and, if asked, with the key column."""
    names = [s for s in sheets(spark, workbook) if not is_output_sheet(s)]
    return [s for s in names if require is None or require in read_sheet(spark, workbook, s).columns]


def next_run(spark: SparkSession, workbook: str) -> str:
    """Name of the next run sheet."""
    return f"Run {sum(s.startswith('Run ') for s in sheets(spark, workbook)) + 1}"


def review_payload(sections: DataFrame, history: DataFrame) -> DataFrame:
    """Sections and history as nested rows (doc_uuid, kind, at, entry): one JSON line each."""
    heading = F.when(F.coalesce("heading", F.lit("")) != "", F.array("heading")).otherwise(F.array().cast("array<string>")).alias("heading")
    fields = F.struct(heading, "merged_text", F.col("chunk_ids").alias("chunk_indices"), F.col("labels").alias("types_of_docitem"), F.col("pages").alias("page_nums"))
    a = sections.select("doc_uuid", F.lit("merged_headings").alias("kind"), F.col("first_pos").alias("at"), F.to_json(fields).alias("entry"))
    b = history.select("doc_uuid", F.lit("raw_session_history").alias("kind"), F.col("pos").alias("at"), F.to_json(F.struct("id", "status", "merged_into")).alias("entry"))
    return a.unionByName(b)


def write_results(results: DataFrame, path: str, fmt: str, mode: str = "overwrite") -> None:
    """Writes free-form results (title, response, ...) as md, txt, csv, json or parquet; texts keep one result a block."""
    if fmt in ("md", "txt"):
        head = F.concat(F.lit("## "), "title") if fmt == "md" else F.concat(F.lit("=== "), "title", F.lit(" ==="))
        results.select(F.concat(head, F.lit("\n\n"), F.coalesce("response", F.lit("")), F.lit("\n")).alias("value")).write.mode(mode).text(path)
    else:
        folder, _, name = path.rstrip("/").rpartition("/")
        write_sheet(results, folder, name, fmt, mode)


def payload_documents(entries: DataFrame, part_chars: int = 8_000_000) -> DataFrame:
    """(doc_uuid, part, payload): the entries of review_payload as JSON objects with `merged_headings` and `raw_session_history`.

    A document is one object up to part_chars characters; a larger one comes in
    several, numbered from 0, each with the entries that begin within it. The
    entries are written once to the checkpoint folder.
    """
    sized = materialise(entries).withColumns({"_rank": (F.col("kind") == "raw_session_history").cast("long"), "_size": F.char_length("entry") + 2})
    heavy = sized.groupBy("doc_uuid").agg(F.sum("_size").alias("_all")).where(F.col("_all") > part_chars).select("doc_uuid", F.lit(True).alias("_heavy"))
    marked = sized.join(heavy, "doc_uuid", "left")
    # the history follows the sections: positions of both kinds in one order
    place = F.col("at") + F.col("_rank") * F.lit(1 << 40)
    placed = running_sum(marked.where("_heavy").withColumn("_place", place), ["doc_uuid"], "_place", ["entry"], {"_before": F.col("_size")}, inclusive=False).drop("_place")
    parts = marked.where("_heavy is null").withColumn("part", F.lit(0).cast("long")).drop("_heavy").unionByName(placed.withColumn("part", F.floor(F.col("_before") / part_chars).cast("long")).drop("_heavy", "_before"))
    listed = lambda kind: F.concat(F.lit("["), F.array_join(F.transform(F.filter("l", lambda x: x["kind"] == kind), lambda x: x["entry"]), ","), F.lit("]"))
    g = parts.groupBy("doc_uuid", "part").agg(F.array_sort(F.collect_list(F.struct("at", "entry", "kind"))).alias("l"))
    return g.select("doc_uuid", "part", F.concat(F.lit('{"merged_headings":'), listed("merged_headings"), F.lit(',"raw_session_history":'), listed("raw_session_history"), F.lit("}")).alias("payload"))


def markdown(depth: Column, title: Column, text: Column) -> Column:
    """A node as Markdown: its title under at most six marks, then its text."""
    head = F.concat(F.repeat(F.lit("#"), F.least(depth, F.lit(6))), F.lit(" "), title)
    return F.when(F.coalesce(text, F.lit("")) == "", head).otherwise(F.concat_ws("\n\n", head, text))
