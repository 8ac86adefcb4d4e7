"""Table store: upserts, replacement, migration, ids and reads as pure transforms.

Writing is copy-on-write: a transform takes the stored table and the incoming
rows and gives the new table, which `TableStore` writes as a new version
before it moves the pointer. A failed write leaves the old version in place.

Edge cases: a null key never equals another one and is kept as it is; of
several incoming rows of a key the last by `order` counts; an empty incoming
table changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossierflow.functions import text as X
from dossierflow.operators.ordered import last_per_key

ENRICHED = ("status", "review_path", "num_sections", "metadata_json")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], keep_first: tuple[str, ...] = ("created_at",), coalesced: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows with incoming ones laid over by key.

    `keep_first` columns keep the stored value; `coalesced` ones take the new
    value only if it is not null; all others take the new value as it is.
    """
    columns = [c for c in stored.columns if c not in keys]
    new = last_per_key(incoming, keys, order, [c for c in columns if c in incoming.columns]).withColumn("_new", F.lit(True))
    old = stored.withColumn("_old", F.lit(True))
    j = old.alias("o").join(new.alias("n"), keys, "full_outer")

    def value(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(f"o.{c}")
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keep_first:
            return F.when(F.col("_old"), o).otherwise(n)
        return F.coalesce(n, o) if c in coalesced else F.when(F.col("_new"), n).otherwise(o)

    return j.select(*keys, *[value(c).alias(c) for c in columns])


def replace_partition(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows of the incoming keys replaced by the incoming rows."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def add_columns(stored: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Columns that are missing are added as nulls; none is changed or removed."""
    return stored.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in stored.columns})


def with_new_ids(rows: DataFrame, order: list[Column], start: int, partitions: int, name: str = "id") -> DataFrame:
    """Consecutive ids after `start` in a given order, numbered by ranges, not in one task."""
    from dossierflow.session import materialise

    ranged = materialise(rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before", "_first")
    # one row for each partition
    return ranged.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_m") - F.col("_first") + F.col("_before") + 1 + start).drop("_p", "_m", "_before", "_first")


def resolve_by_name(names: DataFrame, documents: DataFrame) -> DataFrame:
    """(name, doc_uuid): the most recently updated document of each name, or a minted id."""
    latest = last_per_key(documents.where("doc_name is not null"), ["doc_name"], ["updated_at", "doc_uuid"], ["doc_uuid"])
    j = names.select(F.col("name").alias("doc_name")).distinct().join(latest, "doc_name", "left")
    return j.select(F.col("doc_name").alias("name"), F.coalesce("doc_uuid", F.substring(F.sha1(F.concat(F.lit("pdf::"), F.col("doc_name"))), 1, 16)).alias("doc_uuid"), F.col("doc_uuid").isNull().alias("minted"))


def first_sections(sections: DataFrame, n: int) -> DataFrame:
    """The first n sections of each document by ordinal; Spark limits each group before it shuffles."""
    w = Window.partitionBy("doc_uuid").orderBy("ordinal", "id")
    return sections.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def build_corpus(documents: DataFrame, sections: DataFrame, per_section: int = 1200, per_document: int = 40, total: int = 60_000) -> DataFrame:
    """Lines of the prompt corpus: documents by recency, their first sections, until `total` characters are reached.

    A line has two characters at least, so no more than total / 2 documents can
    matter; their lengths alone are put in one order. Lines are then numbered
    within their document, and only of the documents that begin below the total.
    """
    head, body = X.ustrip(F.coalesce("heading", F.lit(""))), F.substring(X.ustrip(F.coalesce("text", F.lit(""))), 1, per_section)
    line = F.when(head != "", F.concat(F.lit("- "), head, F.lit(": "), body)).otherwise(F.concat(F.lit("- "), body))
    live = documents.join(sections.select("doc_uuid").distinct(), "doc_uuid", "left_semi")
    recent = live.orderBy(F.desc("updated_at"), "doc_uuid").limit(total // 2 + 1).select("doc_uuid", "doc_name", "updated_at")
    # the documents are at most total / 2; their sections are limited before the join
    rows = first_sections(sections, per_document).join(F.broadcast(recent), "doc_uuid").select("doc_uuid", "doc_name", "updated_at", "ordinal", "id", line.alias("line"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a document, at most total / 2 of them
    sums = rows.groupBy("doc_uuid", "updated_at").agg(F.sum(F.char_length("line")).alias("chars"))
    begins = sums.select("doc_uuid", before(Window.orderBy(F.desc("updated_at"), "doc_uuid"), "chars").alias("begins")).where(F.col("begins") < total)
    own = rows.join(F.broadcast(begins), "doc_uuid")
    within = Window.partitionBy("doc_uuid").orderBy("ordinal", "id")
    return own.withColumn("before", F.col("begins") + before(within, F.char_length("line"))).where(F.col("before") < total).select("doc_uuid", "doc_name", "ordinal", "id", "line", "before")


def corpus_text(lines: DataFrame) -> DataFrame:
    """One block of text per document, with its place in the corpus."""
    g = lines.groupBy("doc_uuid", "doc_name").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id", "line"))).alias("l"), F.min("before").alias("at"))
    return g.select("doc_uuid", "at", F.concat(F.lit("\n### DOCUMENT: "), F.coalesce("doc_name", "doc_uuid"), F.lit("\n\n"), F.array_join(F.transform("l", lambda s: s["line"]), "\n")).alias("block"), F.size("l").alias("sections_used"))


def failed(columns: list[str]) -> Column:
    """Whether a cell of the row starts with a failure mark."""
    return F.exists(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), lambda x: x.startswith("[ERROR]") | x.startswith("[unparsed]"))


def rate_window(calls: DataFrame, ts: str, seconds: int) -> DataFrame:
    """How many calls fall into the seconds up to each call (itself included).

    Calls of one instant are counted first, so that a burst costs one row.
    Instants are bucketed by the window's length: each looks at its own bucket
    and the one before, so no task needs the whole history.
    """
    stamped = calls.withColumn("_s", F.unix_micros(F.col(ts).cast("timestamp")))
    span = seconds * 1_000_000
    instants = stamped.where("_s is not null").groupBy("_s").agg(F.count("*").alias("_n"))
    both = instants.select("_s", "_n", F.explode(F.array(F.struct(F.floor(F.col("_s") / span).alias("_g"), F.lit(True).alias("_own")), F.struct((F.floor(F.col("_s") / span) + 1).alias("_g"), F.lit(False).alias("_own")))).alias("_b")).select("_s", "_n", "_b.*")
    w = Window.partitionBy("_g").orderBy("_s").rangeBetween(-span, 0)
    counted = both.withColumn("calls_in_window", F.sum("_n").over(w)).where("_own").select("_s", "calls_in_window")
    return stamped.join(counted, "_s", "left").drop("_s")


class TableStore:
    """Versioned Parquet tables in a directory; readers see the version the pointer names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self, name: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(p)]
        done = []
        for v in found:
            if v.startswith("version="):
                f2, ok = self._fs(f"{self.root}/{name}/{v}/_SUCCESS")
                if f2.exists(ok):
                    done.append(int(v.split("=")[1]))
        return sorted(done)

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        known = self.versions(name)
        if not known:
            return None
        return self.spark.read.parquet(f"{self.root}/{name}/version={version or known[-1]}")

    def write(self, name: str, df: DataFrame) -> int:
        """Writes the next version; a version counts only once its files are all there."""
        version = (self.versions(name) or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/version={version}")
        return version

    def write_if_changed(self, name: str, df: DataFrame) -> int:
        """The current version if the rows are the same, else a new one."""
        old = self.read(name)
        if old is not None and set(old.columns) == set(df.columns):
            same = old.exceptAll(df.select(old.columns)).isEmpty() and df.select(old.columns).exceptAll(old).isEmpty()
            if same:
                return self.versions(name)[-1]
        return self.write(name, df)

    def reset(self, name: str) -> int | None:
        """An empty version with the columns of the current one: progress starts anew, older versions stay readable."""
        old = self.read(name)
        return None if old is None else self.write(name, old.limit(0))


def persist_review(store: TableStore, documents: DataFrame, sections: DataFrame, order: list[str]) -> tuple[int, int]:
    """Stores reviewed documents (doc_uuid, ...) by upsert and replaces their sections; gives the versions of `documents` and `sections`."""
    known, held = store.read("documents"), store.read("sections")
    merged = documents if known is None else upsert(known, documents, ["doc_uuid"], order, coalesced=tuple(c for c in ENRICHED if c in known.columns))
    replaced = sections if held is None else replace_partition(held, sections, "doc_uuid")
    return store.write("documents", merged), store.write("sections", replaced)


def append_rows(store: TableStore, name: str, rows: DataFrame, order: list[Column], partitions: int) -> int:
    """Appends rows (runs, reviews, entities, analyses) under new consecutive ids."""
    old = store.read(name)
    start = 0 if old is None else old.agg(F.coalesce(F.max("id"), F.lit(0))).head()[0]
    new = with_new_ids(rows, order, start, partitions)
    return store.write(name, new if old is None else old.unionByName(new, allowMissingColumns=True))
