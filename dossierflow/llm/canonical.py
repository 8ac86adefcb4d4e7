"""Duplicates hidden by formatting: collapse by canonical text.

Byte-identical rows are collapsed first, with map-side counts, so that a text
held by a third of all rows costs one row per task. Only the distinct
survivors are canonicalised, and they are grouped again on their full
canonical text, counts summed; no hash stands in for it.

The canonical text of a value is its letters and digits in order under full
case folding; fields between vertical bars are canonicalised one by one, empty
ones dropped, and sorted. Vowel signs and accents that are characters of their
own are neither letters nor digits and don't count; `marks` makes them count
where two texts that differ in them alone are to stay apart.

Edge cases: null, blank and wordless texts belong to no group; of a group the
smallest id is kept; a repeated id counts as often as it occurs; an empty table
gives an empty table; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_text(c: Column, separator: str = "|", marks: bool = False) -> Column:
    """Letters and digits under full case folding, fields sorted; '' where there are none.

    Upper casing expands what full folding expands (ß, ligatures), lower casing
    levels the rest; the stripping between them also keeps the optimizer from
    dropping the first of the two. Lower casing gives a sigma by its place in a
    word, so both forms are made one. The dotless i counts as an i. With
    `marks` a combining mark behind a letter stays.
    """
    other = rf"[^\p{{L}}\p{{N}}\p{{M}}\{separator}]|(?<![\p{{L}}\p{{M}}])\p{{M}}" if marks else rf"[^\p{{L}}\p{{N}}\{separator}]"
    kept = F.regexp_replace(F.upper(F.translate(c, "ẞİ", "ßi")), other, "")
    folded = F.translate(F.lower(kept), "ς", "σ")
    fields = F.filter(F.split(folded, rf"\{separator}"), lambda x: x != "")
    return F.array_join(F.array_sort(fields), separator)


def distinct_forms(df: DataFrame, id_col: str, text_col: str, marks: bool = False) -> DataFrame:
    """form, first_id, n of each byte-identical text, with its canonical text `key`."""
    raw = df.where(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("form")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("n"))
    return raw.withColumn("key", canonical_text(F.col("form"), marks=marks)).where(F.col("key") != "")


def canonical_groups(df: DataFrame, id_col: str, text_col: str, marks: bool = False) -> DataFrame:
    """keep_id, kept_text, n_copies, n_forms: one row for each distinct canonical text."""
    return distinct_forms(df, id_col, text_col, marks).groupBy("key").agg(F.min("first_id").alias("keep_id"), F.min_by("form", "first_id").alias("kept_text"), F.sum("n").alias("n_copies"), F.count("*").alias("n_forms")).drop("key")


def copy_links(df: DataFrame, id_col: str, text_col: str, marks: bool = False) -> DataFrame:
    """(keep_id, copy_id) of every row that is a copy of another.

    The rows are joined with the forms of repeated texts only; that join is an
    ordinary inner join on the raw text, whose hot keys AQE splits.
    """
    forms = distinct_forms(df, id_col, text_col, marks)
    groups = forms.groupBy("key").agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("copies")).where(F.col("copies") > 1)
    # true of every form of a group; it keeps both sides of the join on the same columns, so that the collapse of the raw rows is made once
    own = (F.col("first_id") >= F.col("keep_id")) & (F.col("n") <= F.col("copies"))
    kept = forms.join(groups, "key").where(own).select("form", "keep_id")
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("copy_id"), F.col(text_col).alias("form"))
    return rows.join(kept, "form").where(F.col("copy_id") != F.col("keep_id")).select("keep_id", "copy_id")
