"""Files and chunk caches as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.functions import text as X

CHUNK_SCHEMA = "chunk_index int, type string, heading array<string>, chunk_text string, type_of_docitem array<string>, page_num array<int>, text string, meta struct<headings:array<string>,page_numbers:array<int>,doc_items:array<struct<label:string,page_no:int>>>"


def chunk_cache(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of cached conversions: documents with a list `chunks`, or bare lists; broken files give none."""
    chunk = spark.createDataFrame([], CHUNK_SCHEMA).schema.simpleString()
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("path"), "value")
    bare = F.from_json("value", f"array<{chunk}>")
    held = F.from_json("value", f"struct<chunks:array<{chunk}>>")["chunks"]
    rows = raw.select("path", F.posexplode(F.when(F.ltrim("value").startswith("["), bare).otherwise(held)).alias("pos", "c"))
    none = F.array().cast("array<string>")
    heading = F.get(F.filter(F.concat(F.coalesce("c.heading", none), F.coalesce("c.meta.headings", none)), lambda h: X.ustrip(h) != ""), F.lit(0))
    labels = F.when(F.size(F.coalesce("c.type_of_docitem", F.array().cast("array<string>"))) > 0, F.col("c.type_of_docitem")).otherwise(F.transform("c.meta.doc_items", lambda d: d["label"]))
    return rows.select("path", "pos", F.coalesce("c.chunk_index", F.col("pos") + 1).alias("chunk_index"), F.coalesce(X.ustrip(heading), F.lit("")).alias("heading"), F.coalesce(F.nullif(F.col("c.chunk_text"), F.lit("")), "c.text", F.lit("")).alias("text"), F.transform(F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.lower(X.ustrip(x))).alias("labels"), F.coalesce("c.page_num", "c.meta.page_numbers", F.array().cast("array<int>")).alias("pages"))


def find_files(spark: SparkSession, folder: str, extension: str, needle: str = "") -> DataFrame:
    """(path, file_name, modified, size) of the files with an extension whose name holds `needle`, case counted."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return f.select("path", name.alias("file_name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size")).where(F.col("file_name").contains(needle))


def newest(files: DataFrame) -> DataFrame:
    """The file modified last."""
    return files.agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def categorised(files: DataFrame, categories: DataFrame) -> DataFrame:
    """Files with the category of their stripped name; of several the last by `seq` counts."""
    c = categories.groupBy(X.ustrip(F.col("file_name")).alias("k")).agg(F.max_by("category", "seq").alias("category"))
    return files.withColumn("k", X.ustrip(F.col("file_name"))).join(c, "k", "left").drop("k")
