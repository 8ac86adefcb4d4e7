"""Item lists in cells: unique elements, counts and list arithmetic.

Edge cases: null and blank cells have no items; an element repeated in one
cell counts each time; of spellings that differ in case the first seen stays;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.functions import text as X
from dossierflow.functions.arrowmap import map_rows
from dossierflow.operators.store import with_new_ids
from dossierflow.session import n_partitions

UI_SEPARATORS = (";", "|", "\n", "\t", ",")


def unique_elements(df: DataFrame, order: str, columns: list[str], separators: tuple[str, ...] = (";",), case_insensitive: bool = False) -> DataFrame:
    """(column_name, element, n, first_seen): how often each element occurs in each column."""
    # one scan for all columns
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), X.split_items(F.col(c), separators).alias("items")) for c in columns])
    rows = df.select(F.col(order).alias("o"), F.explode(cells).alias("c")).select("c.column_name", "o", F.posexplode("c.items").alias("k", "element"))
    key = F.lower("element") if case_insensitive else F.col("element")
    g = rows.groupBy("column_name", key.alias("key")).agg(F.min_by("element", F.struct("o", "k")).alias("element"), F.count("*").alias("n"), F.min("o").alias("first_seen"))
    return g.select("column_name", "element", "n", "first_seen")


def placed(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Adds each row's place in the order of its group, from 1.

    Ranges of rows in the order (group, order) are numbered, then each group
    starts anew: no task sorts a group of any size. Runs jobs.
    """
    numbered = with_new_ids(rows, [F.col(group), *order], 0, n_partitions(rows.sparkSession), "_at")
    first = numbered.groupBy(F.col(group).alias("_g")).agg(F.min("_at").alias("_first"))
    return numbered.join(first, F.col(group).eqNullSafe(F.col("_g"))).withColumn("place", (F.col("_at") - F.col("_first") + 1).cast("int")).drop("_at", "_g", "_first")


def ranked(uniques: DataFrame, by_count: bool) -> DataFrame:
    """Elements with their place in the output order of their column."""
    return placed(uniques, "column_name", [F.desc("n"), F.lower("element"), F.col("element")] if by_count else [F.col("element")])


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of different length next to each other by `place`, the shorter one padded with nulls."""
    return left.join(right, "place", "full_outer")


def distinct_with_blanks(df: DataFrame, column: str, separator: str) -> DataFrame:
    """Distinct stripped elements of a column, the empty one included."""
    return df.where(F.col(column).isNotNull()).select(F.explode(F.split(column, "\\Q" + separator + "\\E")).alias("e")).select(X.ustrip(F.col("e")).alias("element")).distinct()


def missing_elements(a: Column, b: Column) -> Column:
    """Elements of a that b lacks, in order, repeats kept."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def without(a: Column, value: Column) -> Column:
    return F.filter(a, lambda x: x != value)


def similar_words(a: str | None, b: str | None, threshold: float = 0.8) -> bool:
    """Whether the word sequences are alike; false if either is empty."""
    x, y = (a or "").strip().lower().split(), (b or "").strip().lower().split()
    return bool(x and y) and SequenceMatcher(None, x, y).ratio() >= threshold


def merge_near_duplicates(df: DataFrame, id_col: str, first: str, second: str) -> DataFrame:
    """(id, merged): two lists of a row merged in order, leaving out what is like an element kept before.

    The rule depends on the order, so it runs per row; lists are of a row, not of a group.
    """

    def rows(rid: int, a: list[str] | None, b: list[str] | None) -> Iterator[tuple]:
        kept: list[str] = []
        for x in [*(a or []), *(b or [])]:
            if x is not None and not any(x == y or similar_words(x, y) for y in kept):
                kept.append(x)
        yield rid, kept

    return map_rows(df.select(F.col(id_col).cast("long"), first, second), rows, "id long, merged array<string>")


def found_in_first(c: Column, needle: str, n: int) -> Column:
    """Whether the first n characters hold the needle."""
    return F.substring(c, 1, n).contains(needle)
