"""Order-dependent columns that don't need a whole group in one task.

A window over a group sorts it in one task. Here a group is cut into blocks of
positions; windows run inside blocks, each block is reduced to one summary row,
and a second window carries the summaries along the blocks of a group. A group
of n rows costs tasks of block size and one of n / block rows.

`position` is a numeric column; a null position sorts first. Ties are broken
by `ties`. Rows keep all their columns. Rows without a position are divided by
their first tie where that is a number; rows that share one position stay in
one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

BLOCK = 10_000
#: Blocks of rows without position come before all others.
_NULLS = -(1 << 62)


def _blocks(df: DataFrame, keys: list[str], position: str, ties: list[str], block: int):
    # null-safe keys: a null group is a group
    safe = [F.coalesce(F.col(k).cast("string"), F.lit("\x00")).alias(f"_k{i}") for i, k in enumerate(keys)]
    numeric = ties and isinstance(df.schema[ties[0]].dataType, NumericType)
    without = F.lit(_NULLS) + (F.coalesce(F.floor(F.col(ties[0]) / block), F.lit(-(1 << 52))) if numeric else F.lit(0))
    out = df.select("*", *safe, F.coalesce(F.floor(F.col(position) / block), without).cast("long").alias("_b"))
    names = [f"_k{i}" for i in range(len(keys))]
    within = Window.partitionBy(*names, "_b").orderBy(F.col(position).asc_nulls_first(), *ties)
    return out, names, within, Window.partitionBy(*names).orderBy("_b")


def carry_last(df: DataFrame, keys: list[str], position: str, ties: list[str], values: dict[str, Column], inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """Adds, for each name in `values`, the last non-null value up to the row (or before it)."""
    marked, names, within, across = _blocks(df.withColumns({f"_v_{n}": v for n, v in values.items()}), keys, position, ties, block)
    upto = within.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = marked.withColumns({f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(upto) for n in values})
    order = F.struct(F.col(position), *[F.col(t) for t in ties])
    ends = marked.groupBy(*names, "_b").agg(*[F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), order)).alias(f"_e_{n}") for n in values])
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*names, "_b", *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in values])
    joined = local.join(carried, [*names, "_b"], "left").withColumns({n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in values})
    return joined.drop(*names, "_b", *[f"_{p}_{n}" for p in "vlc" for n in values])


def running_sum(df: DataFrame, keys: list[str], position: str, ties: list[str], values: dict[str, Column], inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """Adds, for each name in `values`, the sum up to the row (or before it), 0 at the start."""
    marked, names, within, across = _blocks(df.withColumns({f"_v_{n}": F.coalesce(v, F.lit(0)).cast("long") for n, v in values.items()}), keys, position, ties, block)
    upto = within.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = marked.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(upto), F.lit(0)) for n in values})
    sums = marked.groupBy(*names, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_e_{n}") for n in values])
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*names, "_b", *[F.coalesce(F.sum(f"_e_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in values])
    joined = local.join(carried, [*names, "_b"]).withColumns({n: F.col(f"_l_{n}") + F.col(f"_c_{n}") for n in values})
    return joined.drop(*names, "_b", *[f"_{p}_{n}" for p in "vlc" for n in values])


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column], columns: list[str]) -> DataFrame:
    """The first row of each key by an aggregation (no window): keys and `columns`."""
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), rank).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns])


def last_per_key(df: DataFrame, keys: list[str], order: list[str | Column], columns: list[str]) -> DataFrame:
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), rank).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns])
