"""Chunk triage: which chunks are content, and under which heading.

A chunk is a row (doc_uuid, pos, id, heading, text, labels, page): position in
its document with id as tie-breaker, attached heading, text, item labels and
page. Decisions follow a fixed precedence: index label, contents page, empty,
page furniture, repeated text, too short, known heading, numbered heading,
continuation of the last heading, review. A heading is known if it equals one
of its document's valid headings, holds it or is held by it, or is alike; of
several the first in the document counts.

All that decisions need of a chunk's texts are a few flags and keys: `marked`
adds them in one pass, and a table of them without the texts may be written
once and read by all steps.

Edge cases: null texts are empty chunks; null headings are blank; a null
document is a document of its own; repeated rows are decided each; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.functions import text as X
from dossierflow.operators.ordered import carry_last, first_per_key
from dossierflow.operators.toc import MATCH_RATIO, match_headings

# fixed values
BOILERPLATE_LABELS = ("page_header", "page_footer")
INDEX_LABELS = ("document_index",)
HEADING_LABELS = ("title", "subtitle", "section_header")
BOILERPLATE_REPEAT_PAGES = 4
BOILERPLATE_MAX_CHARS = 200


def page_number(c: Column) -> Column:
    """First number in a page notation ('3', 'p. 3', '3/10')."""
    return F.nullif(F.regexp_extract(c, r"\d+", 0), F.lit("")).try_cast("int")


def chunk_view(sections: DataFrame, *keep: Column) -> DataFrame:
    """Chunks of a sections table, with further columns to keep."""
    labels = F.coalesce(F.from_json("labels_json", "array<string>"), F.array().cast("array<string>"))
    clean = F.filter(F.transform(labels, lambda x: F.lower(X.ustrip(x))), lambda x: x.isNotNull() & (x != ""))
    return sections.select("doc_uuid", F.col("ordinal").alias("pos"), "id", X.ustrip(F.coalesce("heading", F.lit(""))).alias("heading"), F.coalesce("text", F.lit("")).alias("text"), clean.alias("labels"), page_number(F.col("page")).alias("page"), *keep)


MARKS = ("key", "fold", "is_index", "is_empty", "is_furniture", "is_short", "is_numbered", "is_plausible")


def marked(chunks: DataFrame) -> DataFrame:
    """Adds what the decisions need of heading, text and labels; chunks that have it stay as they are."""
    if set(MARKS) <= set(chunks.columns):
        return chunks
    labels, norm, heading = F.col("labels"), F.col("norm"), F.col("heading")
    has = F.size(labels) > 0
    among = lambda names: F.arrays_overlap(labels, F.array(*map(F.lit, names)))
    # in steps, so that no expression over a text is evaluated twice; only texts that can be boilerplate keep a key
    c = chunks.withColumns({"key": X.normalize_heading(heading), "norm": X.collapse_ws(F.col("text")), "is_numbered": (heading != "") & X.is_numbered_heading(heading)})
    folded = X.casefold(norm)
    fold = F.when(F.char_length(folded) <= BOILERPLATE_MAX_CHARS, folded)
    short = (F.char_length(norm) < X.MIN_CONTENT_CHARS) & ~X.is_numbered_heading(norm) & ~among(HEADING_LABELS)
    flags = {"fold": fold, "is_index": has & among(INDEX_LABELS), "is_empty": norm == "", "is_furniture": has & F.forall(labels, lambda x: x.isin(*BOILERPLATE_LABELS)), "is_short": short, "is_plausible": X.plausible_heading(heading)}
    return c.withColumns(flags).drop("norm")


def boilerplate(chunks: DataFrame, min_pages: int = BOILERPLATE_REPEAT_PAGES) -> DataFrame:
    """(doc_uuid, norm, n_pages) of short texts that stand on at least `min_pages` pages; missing pages count as one."""
    keyed = marked(chunks).select("doc_uuid", F.col("fold").alias("norm"), F.coalesce("page", F.lit(-1)).alias("page")).where("norm != ''")
    # two aggregations instead of a distinct count: both combine before they shuffle
    return keyed.groupBy("doc_uuid", "norm", "page").agg(F.lit(1).alias("one")).groupBy("doc_uuid", "norm").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)


def collect_headings(chunks: DataFrame, *keep: str) -> DataFrame:
    """(doc_uuid, key, heading, first_pos, first_id): distinct headings by normalised form, in their first spelling."""
    key = F.col("key") if "key" in chunks.columns else X.normalize_heading(F.col("heading"))
    keyed = chunks.select("doc_uuid", "pos", "id", "heading", key.alias("key"), *keep).where("key != ''")
    return first_per_key(keyed, ["doc_uuid", "key"], ["pos", "id"], ["heading", "pos", "id", *keep]).withColumnsRenamed({"pos": "first_pos", "id": "first_id"})


def valid_headings(chunks: DataFrame) -> DataFrame:
    """Headings that the rules take for section headings."""
    return collect_headings(marked(chunks), "is_plausible").where("is_plausible").drop("is_plausible")


def triage(chunks: DataFrame, valid: DataFrame, repeated: DataFrame, toc_pages: DataFrame | None = None, ratio: float | None = MATCH_RATIO) -> DataFrame:
    """Adds action, heading_out, reason, confidence and toc_match to every chunk.

    `valid` has (doc_uuid, key, heading, first_pos), `repeated` (doc_uuid,
    norm); with `toc_pages` (doc_uuid, pos) there is a table of contents, whose
    entries `valid` then are, and kept chunks say whether their heading is in
    it. Without a ratio headings that are merely alike don't match. The text is
    passed on if `chunks` has it.
    """
    has_toc = toc_pages is not None
    c = marked(chunks)
    doc = F.coalesce("doc_uuid", F.lit("\x00"))
    known = match_headings(c, valid, ratio).select(doc.alias("_doc"), "key", "known")
    said = repeated.select(doc.alias("_doc"), F.col("norm").alias("_fold"), F.lit(True).alias("is_repeated"))
    # chunks that cannot be boilerplate get a key that matches nothing, spread so that they don't meet in one task
    spread = F.concat(F.lit("\x00"), (F.col("id") % 997).cast("string"))
    c = c.withColumns({"_doc": doc, "_fold": F.coalesce("fold", spread)})
    c = c.join(known, ["_doc", "key"], "left").join(said, ["_doc", "_fold"], "left")
    if has_toc:
        c = c.join(toc_pages.select(doc.alias("_doc"), "pos", F.lit(True).alias("on_toc")).distinct(), ["_doc", "pos"], "left")
    else:
        c = c.withColumn("on_toc", F.lit(None).cast("boolean"))
    step = F.when(F.col("is_index"), "index").when(F.col("on_toc"), "toc").when(F.col("is_empty"), "empty").when(F.col("is_furniture"), "furniture").when(F.col("is_repeated"), "repeated").when(F.col("is_short"), "short").when(F.col("known").isNotNull(), "known").when(F.col("is_numbered"), "numbered").otherwise("continue")
    c = c.withColumn("step", step)
    opened = F.when(F.col("step") == "known", F.struct(F.col("known").alias("h"), F.lit(True).alias("t"))).when(F.col("step") == "numbered", F.struct(F.col("heading").alias("h"), F.lit(False).alias("t")))
    c = carry_last(c, ["doc_uuid"], "pos", ["id"], {"current": opened})
    skip = F.col("step").isin("index", "toc", "empty", "furniture", "repeated", "short")
    goes_on = (F.col("step") == "continue") & F.col("current").isNotNull()
    kept = F.col("step").isin("known", "numbered") | goes_on
    out = {
        "action": F.when(skip, "skip").when(kept, "log").otherwise("review"),
        "heading_out": F.when(kept, F.col("current.h")).otherwise(F.col("heading")),
        "confidence": F.when(F.col("step").isin("short") | goes_on, "medium").when(F.col("step") == "continue", "low").otherwise("high"),
        "toc_match": F.when(kept & F.lit(has_toc), F.col("current.t")),
        "reason": F.when(F.col("step") == "continue", F.when(F.col("current").isNull(), "no heading yet").when(F.col("heading") != "", "folded into the heading above").otherwise("continues the heading above")).otherwise(F.col("step")),
    }
    return c.withColumns(out).select("doc_uuid", "pos", "id", "action", "heading_out", "heading", "reason", "confidence", "toc_match", "page", "labels", *(["text"] if "text" in chunks.columns else []))


def triage_summary(decisions: DataFrame) -> DataFrame:
    """Counts by action and the share that needs no reviewer, per document."""
    n = lambda a: F.count_if(F.col("action") == a)
    decided = F.count_if(F.col("action").isin("log", "skip", "merge"))
    return decisions.groupBy("doc_uuid").agg(F.count("*").alias("total"), n("log").alias("n_log"), n("skip").alias("n_skip"), n("review").alias("n_review"), n("merge").alias("n_merge"), F.count_if(F.col("confidence") == "low").alias("low_confidence"), F.bround(decided * 100.0 / F.count("*"), 1).alias("auto_handled_pct"))


def heading_forward_fill(chunks: DataFrame) -> DataFrame:
    """The last non-blank heading at or above every chunk."""
    return carry_last(chunks, ["doc_uuid"], "pos", ["id"], {"heading_above": F.nullif(F.col("heading"), F.lit(""))}).select("doc_uuid", "pos", "id", "heading", "heading_above")
