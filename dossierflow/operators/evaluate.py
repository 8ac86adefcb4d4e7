"""Evaluation of extracted values against the text of their sections.

Rows are in long form: (row_id, section, column_name, cell). References are
(section, text). Items of a cell are scored against each sentence of the
section they come from, and the best sentence is kept; ties go to the first.

Edge cases: null and blank cells have no items; a section without text grounds
nothing; null scores are left out of means; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.functions import text as X
from dossierflow.functions.arrowmap import map_rows
from dossierflow.operators.metrics import LOWER_IS_BETTER
from dossierflow.operators.ordered import first_per_key

#: Sheet codes of the metrics (fixed values).
METRIC_CODES = {"grounding": "Grd", "jaccard": "Jac", "rouge1": "R1", "rouge2": "R2", "rougeL": "RL", "bleu": "Bleu", "levenshtein_distance": "Lev", "similarity_ratio": "Sim", "word_error_rate": "WER", "semantic_cosine": "Cos", "bertscore_precision": "BsP", "bertscore_recall": "BsR", "bertscore_f1": "BsF"}
#: Letters of elements per automaton.
BLOCK_LETTERS = 1_000_000
#: Sentences in a row of the sentence matrix.
MATRIX_SENTENCES = 10_000
_CACHE: dict[int, object] = {}


def with_sentences(references: DataFrame) -> DataFrame:
    """(section, sentence_no, sentence) of (section, text)."""
    return references.select(F.col("section").cast("string").alias("section"), F.posexplode(X.reference_sentences(F.col("text"))).alias("n", "sentence")).select("section", (F.col("n") + 1).alias("sentence_no"), "sentence")


def attach_references(rows: DataFrame, references: DataFrame, title: str = "section_title") -> DataFrame:
    """Adds `reference`: the text of the section with the row's exact title, else of the first with the same trimmed lower-case one, else ''.

    Both lookups are equi-joins on titles reduced to one row each.
    """
    key = lambda c: F.lower(X.ustrip(c))
    refs = references.where(F.col(title).isNotNull())
    exact = first_per_key(refs, [title], ["pos"], ["text"]).select(F.col(title).alias("t1"), F.col("text").alias("r1"))
    loose = first_per_key(refs.withColumn("t2", key(F.col(title))), ["t2"], ["pos"], ["text"]).select("t2", F.col("text").alias("r2"), F.lit(True).alias("hit2"))
    j = rows.join(exact, rows[title] == exact["t1"], "left").withColumn("t2", key(F.col(title))).join(loose, "t2", "left")
    return j.withColumn("reference", F.coalesce(F.when(F.col("t1").isNotNull(), F.coalesce("r1", F.lit(""))), F.coalesce("r2", F.lit("")))).drop("t1", "t2", "r1", "r2", "hit2")


def exploded_items(rows: DataFrame, keep: list[str], cell: str = "cell", separators: tuple[str, ...] = (";",)) -> DataFrame:
    return rows.select(*keep, F.posexplode(X.split_items(F.col(cell), separators)).alias("item_no", "item")).withColumn("item_no", F.col("item_no") + 1)


def grounding_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, how many items of `cell` the row's `reference` holds, how many not, and the coverage in percent."""
    items = X.split_items(F.col("cell"))
    hit = F.size(F.filter(items, lambda i: X.grounded(i, F.col("reference"))))
    one = rows.select(*keys, hit.alias("hit"), F.size(items).alias("all_items"))
    g = one.groupBy(*keys).agg(F.sum("hit").alias("n_true"), F.sum(F.col("all_items") - F.col("hit")).alias("n_false"))
    return g.withColumn("coverage_pct", coverage(F.col("n_true"), F.col("n_true") + F.col("n_false")))


def coverage(n_true: Column, n: Column) -> Column:
    return F.when(n > 0, F.bround(n_true * 100.0 / n, 1)).cast("double")


def coverage_text(n_true: Column, n: Column) -> Column:
    return F.when(n > 0, F.format_string("%d/%d (%s%%)", n_true, n, coverage(n_true, n).cast("string"))).otherwise("0/0")


def best_sentences(items: DataFrame, sentences: DataFrame, on: list[str], metric: str, score: Column) -> DataFrame:
    """The best sentence of each item by `score` (first on ties, nulls left out): an equi-join on the section, then one aggregation."""
    pairs = items.join(sentences, on).withColumn("score", score)
    sign = F.col("score") if metric in LOWER_IS_BETTER else -F.col("score")
    keys = [c for c in items.columns]
    g = pairs.where("score is not null").groupBy(*keys).agg(F.min_by(F.struct("score", "sentence", "sentence_no"), F.struct(sign, F.col("sentence_no"))).alias("b"))
    return g.select(*keys, F.col("b.score").alias("best_score"), F.col("b.sentence").alias("best_sentence"), F.col("b.sentence_no").alias("best_no"))


def sentence_matrix(items: DataFrame, sentences: DataFrame, on: list[str]) -> DataFrame:
    """Every item against every sentence of its section, nested per item in sentence order.

    Sections of more than MATRIX_SENTENCES sentences come in parts of so many, numbered from 0.
    """
    pairs = items.join(sentences, on).withColumn("jaccard", X.jaccard(F.col("item"), F.col("sentence"))).withColumn("grounding", X.grounded(F.col("item"), F.col("sentence")))
    part = F.floor((F.col("sentence_no") - 1) / MATRIX_SENTENCES).alias("part")
    return pairs.groupBy(*items.columns, part).agg(F.array_sort(F.collect_list(F.struct("sentence_no", "sentence", "grounding", "jaccard"))).alias("sentences"))


def with_average_row(df: DataFrame, label: str, numbers: list[str]) -> DataFrame:
    """The rows and one more with the mean of each numeric column, 4 decimals, nulls left out."""
    mean = df.agg(*[F.bround(F.avg(n), 4).alias(n) for n in numbers]).withColumn(label, F.lit("— AVERAGE —"))
    return df.unionByName(mean, allowMissingColumns=True)


def grounded_uniques(uniques: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds to each (column_name, element) whether some reference of the rows holds it, be it of another cell or column.

    An element is looked for in the references of the cells it comes from; what
    is not found there is searched in all distinct references by `found_anywhere`.
    """
    items = exploded_items(rows, ["column_name", "reference"]).select("column_name", F.col("item").alias("element"), X.grounded(F.col("item"), F.col("reference")).alias("g"))
    own = uniques.join(items.groupBy("column_name", "element").agg(F.max("g").alias("own")), ["column_name", "element"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    there = found_anywhere(own.where("not own").select("element").distinct(), rows.select("reference")).withColumn("there", F.lit(True))
    return own.join(there, "element", "left").select(*uniques.columns, (F.col("own") | F.coalesce("there", F.lit(False))).alias("is_grounded"))


def found_anywhere(elements: DataFrame, references: DataFrame) -> DataFrame:
    """The distinct elements (element) that some text of `references` (reference) holds, letter case and white space aside.

    Automata over blocks of a bounded number of the elements' letters run along
    each distinct text, as in lower case and without white space. A passage
    that runs on from one text into another doesn't count.
    """
    forms = lambda c: [F.lower(c), X.squash_ws(F.col(c))]
    texts = references.where("reference != ''").select("reference").distinct().select(*forms("reference"))
    found, block, size = None, [], 0

    def scan(part: list[tuple[str, str, str]]) -> DataFrame:
        def setup() -> list:
            key = hash(tuple(part))
            if key not in _CACHE:
                import ahocorasick

                _CACHE.clear()
                _CACHE[key] = [ahocorasick.Automaton(), ahocorasick.Automaton()]
                for k, a in enumerate(_CACHE[key], 1):
                    for x in part:
                        if x[k]:
                            a.add_word(x[k], [*a.get(x[k], []), x[0]])
                    if len(a):
                        a.make_automaton()
            return _CACHE[key]

        def hits(automata: list, *text: str) -> Iterator[tuple]:
            yield from ((e,) for e in {e for a, t in zip(automata, text) if len(a) for _, held in a.iter(t) for e in held})

        return map_rows(texts, hits, "element string", setup)

    for r in elements.where("element != ''").select("element", *forms("element")).distinct().toLocalIterator():
        block.append(tuple(r))
        size += len(r[0])
        if size >= BLOCK_LETTERS:
            part = scan(block)
            found, block, size = part if found is None else found.unionAll(part), [], 0
    if block or found is None:
        part = scan(block)
        found = part if found is None else found.unionAll(part)
    return found.distinct()


def pivot_sheet(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Long rows (section, column_name, cell) as a sheet with one column for each name; the last cell of a repeat counts."""
    return rows.groupBy("section").pivot("column_name", columns).agg(F.max_by("cell", "row_id"))
