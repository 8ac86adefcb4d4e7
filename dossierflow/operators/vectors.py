"""Vector scores over array columns; a zero vector scores 0.

Everything is native: aggregate and zip_with run in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))).otherwise(F.lit(0.0))


#: Numbers of query vectors that one broadcast may hold (8 bytes each).
BROADCAST_NUMBERS = 8_000_000


def cosine_to_queries(vectors: DataFrame, queries: DataFrame, k: int, broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """The k nearest vectors (vec_id, embedding) of each query (query_id, q): a stated query set against all rows.

    The queries are counted, and taken in as many blocks as the size of a
    broadcast asks for, one pass over the vectors each. A task keeps its own k
    best before the shuffle (rank in a window over the query).
    """
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width")).head()
    blocks = max(1, -(-size["n"] * max(size["width"] or 1, 1) // broadcast_numbers))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def nearest(block: int) -> DataFrame:
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        pairs = vectors.join(F.broadcast(own), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.bround(cosine(F.col("embedding"), F.col("q")), 4).alias("score"))
        return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    return reduce(DataFrame.unionAll, map(nearest, range(blocks)))


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Unit centroid of each group, by component so that partial sums combine before the shuffle."""
    parts = vectors.select(group, F.posexplode("embedding").alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    g = parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    return g.select(group, unit(F.col("mean")).alias("centroid"))


def greedy_scores(candidates: DataFrame, references: DataFrame, on: str) -> DataFrame:
    """Greedy precision, recall and F1 of the cosine matrix of each key: mean of row maxima, of column maxima, and their harmonic mean."""
    p = candidates.join(references, on).select(on, "cand_id", "ref_id", cosine(F.col("c"), F.col("r")).alias("s"))
    prec = p.groupBy(on, "cand_id").agg(F.max("s").alias("m")).groupBy(on).agg(F.avg("m").alias("precision"))
    rec = p.groupBy(on, "ref_id").agg(F.max("s").alias("m")).groupBy(on).agg(F.avg("m").alias("recall"))
    both = F.col("precision") + F.col("recall")
    return prec.join(rec, on).withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))
