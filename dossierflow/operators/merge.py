"""Merge folding, section building and the edits of review decisions.

Decisions are rows (doc_uuid, pos, id, action, heading, text, labels, page)
with a unique id and action log, review, skip or merge. A `merge` row's text goes to the
nearest row above that is kept; with none above, it is kept itself.

Where a row goes is worked out on positions, keys and lengths alone, which are
written once to the checkpoint folder while the plan is made; each text then
moves once, to the row it becomes part of. A section (or a kept row with
its merges) comes in parts of about PART_CHARS characters, numbered from 0, so
that no cell outgrows a task: its text is the parts' texts with SEPARATOR
between, its ids, labels and pages are those of its parts. Heading, first
position and number of chunks are those of the whole on every part.

Edge cases: null texts count as empty; a run of merges lands in one row;
merges behind a skip pass over it; a null document is a document of its own; a
part whose rows hold no text has the text ''; an empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.functions import text as X
from dossierflow.operators.ordered import carry_last, first_per_key, running_sum
from dossierflow.session import materialise

#: Characters of a part; a row counts ROW_CHARS more, for what else is kept of it.
PART_CHARS, ROW_CHARS = 8_000_000, 16
SEPARATOR = "\n\n"


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def block_text(text: Column, heading: Column, add_heading: Column) -> Column:
    """What a merged row contributes: its text, under its heading where asked for."""
    body = rstrip(F.coalesce(text, F.lit("")))
    head = X.ustrip(F.coalesce(heading, F.lit("")))
    titled = F.when(head == "", body).when(body == "", head).otherwise(F.concat_ws("\n", head, body))
    return F.when(F.coalesce(add_heading, F.lit(False)), titled).otherwise(body)


def merge_groups(decisions: DataFrame) -> DataFrame:
    """Adds gid (the kept row a row belongs to, counted from 1 in its document; null for skips) and kept.

    All columns go through the windows: pass slim rows.
    """
    kept0 = ~F.col("action").isin("skip", "merge")
    d = running_sum(decisions, ["doc_uuid"], "pos", ["id"], {"kept_upto": kept0.cast("int"), "merges_upto": (F.col("action") == "merge").cast("int")})
    # a document whose first row that isn't skipped is a merge keeps that one, which the sum doesn't count
    first = decisions.where("action != 'skip'").groupBy(_doc().alias("_d")).agg(F.min_by("action", F.struct("pos", "id")).alias("first"))
    d = d.withColumn("_d", _doc()).join(first, "_d", "left")
    begun = (F.col("first") == "merge") & ((F.col("kept_upto") > 0) | (F.col("merges_upto") > 0))
    gid = F.col("kept_upto") + F.coalesce(begun, F.lit(False)).cast("int")
    orphan = (F.col("action") == "merge") & (F.col("kept_upto") == 0) & (F.col("merges_upto") == 1)
    return d.withColumns({"gid": F.when(F.col("action") != "skip", gid), "kept": kept0 | orphan}).drop("_d", "first", "kept_upto", "merges_upto")


def _doc(c: str = "doc_uuid") -> Column:
    return F.coalesce(c, F.lit("\x00"))


def folded_rows(decisions: DataFrame) -> DataFrame:
    """Slim rows of everything that is kept or merged: id, _doc, pos, size, lead, the kept row they belong to (gid, kept_pos, kept_id, key, heading) and `has_item`, `trimmed`.

    A kept row gives its text as it is, without trailing white space if text
    is merged into it, and nothing if it is blank then; a merged row gives its
    block unless that is blank.
    """
    text = F.coalesce("text", F.lit(""))
    blank = X.ustrip(F.when(F.col("action") == "merge", block_text(F.col("text"), F.col("heading"), F.col("add_heading"))).otherwise(text)) == ""
    alone = X.ustrip(text) == ""
    # written once: texts are looked at in one pass, and the plans of the steps below stay small
    slim = materialise(decisions.select("doc_uuid", "pos", "id", "action", "heading", blank.alias("blank"), alone.alias("alone"), (F.char_length(text) + F.char_length(F.coalesce("heading", F.lit("")))).alias("size")))
    d = merge_groups(slim).where(F.col("gid").isNotNull()).withColumn("_doc", _doc())
    own = F.struct("pos", "id", "heading", "alone")
    folds = d.groupBy("_doc", "gid").agg(F.min(F.when(F.col("kept"), own)).alias("k"), F.count_if(~F.col("kept") & ~F.col("blank")).alias("added"))
    rows = d.select("_doc", "gid", "pos", "id", "kept", "blank", "size").join(folds, ["_doc", "gid"])
    has_item = F.when(F.col("kept"), (F.col("added") == 0) | ~F.col("k.alone")).otherwise(~F.col("blank"))
    return materialise(rows.select("id", "_doc", "gid", "pos", "size", F.col("kept").alias("lead"), F.col("k.pos").alias("kept_pos"), F.col("k.id").alias("kept_id"), F.col("k.heading").alias("heading"), has_item.alias("has_item"), (F.col("kept") & (F.col("added") > 0)).alias("trimmed")))


def in_parts(rows: DataFrame, keys: list[str], part_chars: int = PART_CHARS) -> DataFrame:
    """Adds part, first (kept_pos, kept_id, heading) and n_chunks of the whole to slim rows grouped by `keys`.

    Only wholes beyond part_chars need running sums; for all others the part
    is 0 anyway.
    """
    weight = F.col("size") + ROW_CHARS
    wholes = rows.groupBy(*keys).agg(F.sum(weight).alias("_all"), F.count_if("lead").alias("n_chunks"), F.min(F.struct("kept_pos", "kept_id", "heading")).alias("first"))
    heavy = wholes.where(F.col("_all") > part_chars).select(*keys)
    sums = running_sum(rows.join(heavy, keys, "left_semi").select("id", *keys, "kept_pos", "kept_id", "pos", "size"), keys, "kept_pos", ["kept_id", "pos", "id"], {"_before": weight}, inclusive=False)
    part = sums.select("id", F.floor(F.col("_before") / part_chars).cast("long").alias("part"))
    return rows.join(wholes.drop("_all"), keys).join(part, "id", "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))


def assembled(decisions: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of the wholes: keys, part, heading, first_pos, first_id, n_chunks, text, chunk_ids, merged_from, labels, pages."""
    lost = [c for c, t in (("labels", "array<string>"), ("page", "int")) if c not in decisions.columns]
    held = decisions.withColumns({c: F.lit(None).cast({"labels": "array<string>", "page": "int"}[c]) for c in lost})
    held = held.select("id", "labels", "page", F.col("heading").alias("_own"), *(["add_heading"] if "add_heading" in decisions.columns else [F.lit(False).alias("add_heading")]), F.coalesce("text", F.lit("")).alias("text"))
    full = held.join(placed, "id")
    text = F.when(F.col("lead"), F.when(F.col("trimmed"), rstrip(F.col("text"))).otherwise(F.col("text"))).otherwise(block_text(F.col("text"), F.col("_own"), F.col("add_heading")))
    row = F.struct("kept_pos", "kept_id", "pos", "id", "lead", "labels", "page", F.when(F.col("has_item"), text).alias("item"))
    g = full.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.min("first").alias("first"), F.min("n_chunks").alias("n_chunks"))
    of = lambda name: F.transform("rows", lambda r: r[name])
    none = F.array().cast("array<string>")
    labels = F.flatten(F.transform("rows", lambda r: F.coalesce(r["labels"], none)))
    return g.select(
        *keys, "part", F.col("first.heading").alias("heading"), F.col("first.kept_pos").alias("first_pos"), F.col("first.kept_id").alias("first_id"), F.col("n_chunks").cast("long").alias("n_chunks"),
        F.array_join(F.filter(of("item"), lambda x: x.isNotNull()), SEPARATOR).alias("text"),
        of("id").alias("chunk_ids"), F.transform(F.filter("rows", lambda r: ~r["lead"]), lambda r: r["id"]).alias("merged_from"),
        _union_lists(F.coalesce(F.col("rows")[0]["labels"], none), labels).alias("labels"), F.array_distinct(F.filter(of("page"), lambda p: p.isNotNull())).alias("pages"),
    )


def with_add_heading(decisions: DataFrame) -> DataFrame:
    return decisions if "add_heading" in decisions.columns else decisions.withColumn("add_heading", F.lit(False))


def resolve_merges(decisions: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """One row per kept row and part: its text with the texts merged into it, labels and pages united in order.

    Optional boolean column add_heading asks for the heading line of a merged row.
    """
    decisions = with_add_heading(decisions)
    placed = in_parts(folded_rows(decisions), ["_doc", "gid"], part_chars)
    a = assembled(decisions, placed, ["_doc", "gid"])
    return a.select(_nulled("_doc").alias("doc_uuid"), "gid", "part", F.col("first_pos").alias("pos"), F.col("first_id").alias("id"), "heading", "text", "merged_from", "labels", "pages")


def _nulled(c: str) -> Column:
    return F.nullif(F.col(c), F.lit("\x00"))


def _union_lists(first: Column, all_: Column) -> Column:
    """The first row's list as it is, then what later rows add."""
    return F.concat(first, F.array_except(all_, first))


def merge_targets(decisions: DataFrame) -> DataFrame:
    """For every row the id of the nearest row above that is neither skipped nor merged."""
    kept = F.when(~F.col("action").isin("skip", "merge"), F.col("id"))
    return carry_last(decisions, ["doc_uuid"], "pos", ["id"], {"target_id": kept}, inclusive=False).select("doc_uuid", "pos", "id", "action", "target_id")


def kept_rows(kept: DataFrame, key: Column) -> DataFrame:
    """Slim rows, as of folded_rows, of rows that are kept as they are, with the key of their section."""
    size = F.char_length(F.coalesce("text", F.lit(""))) + F.char_length(F.coalesce("heading", F.lit("")))
    return materialise(kept.select("id", _doc().alias("_doc"), "pos", size.alias("size"), F.lit(True).alias("lead"), F.col("pos").alias("kept_pos"), F.col("id").alias("kept_id"), "heading", F.lit(True).alias("has_item"), F.lit(False).alias("trimmed"), key.alias("key")))


def merged_rows(decisions: DataFrame) -> DataFrame:
    """Slim rows of decisions with merges folded in, and the key of their section: the kept row's normalised heading."""
    return folded_rows(decisions).withColumn("key", X.normalize_heading(F.col("heading")))


def section_members(rows: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_uuid, key, part, kept_id, id, pos): which chunks make up which section, one row each."""
    return in_parts(rows, ["_doc", "key"], part_chars).select(_nulled("_doc").alias("doc_uuid"), "key", "part", "kept_id", "id", "pos")


def build_sections(decisions: DataFrame, rows: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Sections of the slim rows with the decisions' texts: doc_uuid, key, part, heading, first_pos, n_chunks, merged_text, chunk_ids, labels, pages."""
    a = assembled(decisions, in_parts(rows, ["_doc", "key"], part_chars), ["_doc", "key"])
    return a.select(_nulled("_doc").alias("doc_uuid"), "key", "part", "heading", "first_pos", "n_chunks", F.col("text").alias("merged_text"), "chunk_ids", "labels", "pages")


def merged_sections(decisions: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Sections by normalised heading from decisions, merges folded in first; blank headings form one section."""
    decisions = with_add_heading(decisions)
    return build_sections(decisions, merged_rows(decisions), part_chars)


def sections_by_exact_heading(kept: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Sections by the heading as written (the sequential review's grouping)."""
    return build_sections(kept, kept_rows(kept, F.coalesce("heading", F.lit(""))), part_chars)


def baseline_sections(chunks: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Sections by heading, or `General`, from chunks with text."""
    named = chunks.where(X.ustrip(F.coalesce("text", F.lit(""))) != "").withColumn("heading", F.when(F.coalesce("heading", F.lit("")) == "", "General").otherwise(F.col("heading")))
    return build_sections(named, kept_rows(named, F.col("heading")), part_chars)


# ---- review history and edits ----


def history(decisions: DataFrame) -> DataFrame:
    """Session history: status of every decision, and for merges where they went."""
    d = merge_groups(decisions.select("doc_uuid", "pos", "id", "action"))
    target = d.where("kept").select("doc_uuid", "gid", F.col("id").alias("into"))
    joined = d.join(target, [d["doc_uuid"].eqNullSafe(target["doc_uuid"]), d["gid"] == target["gid"]], "left").select(d["*"], "into")
    status = F.when(F.col("action") == "skip", "skipped").when(F.col("action") == "merge", "merged").otherwise("logged (auto)")
    return joined.select("doc_uuid", "pos", "id", status.alias("status"), F.when(F.col("action") == "merge", F.when(~F.col("kept"), F.col("into"))).alias("merged_into"))


def overlay_history(proposals: DataFrame, past: DataFrame) -> DataFrame:
    """Proposals with the last history entry of each chunk (doc_uuid, id, seq, status) laid over."""
    last = past.groupBy("doc_uuid", "id").agg(F.max_by("status", "seq").alias("status"))
    action = F.when(F.col("status") == "skipped", "skip").when(F.col("status") == "merged", "merge").when(F.col("status").startswith("logged"), "log")
    return proposals.join(last, ["doc_uuid", "id"], "left").withColumn("resumed", F.col("status").isNotNull()).withColumn("action", F.coalesce(action, F.col("action"))).drop("status")


def bulk_edit(decisions: DataFrame, edits: DataFrame) -> DataFrame:
    """Applies edits (doc_uuid, id, set_action, set_heading): what is set replaces, clears toc_match and marks the row."""
    d = decisions.join(edits, ["doc_uuid", "id"], "left")
    edited = F.col("set_action").isNotNull() | F.col("set_heading").isNotNull()
    return d.withColumns({"edited": edited, "action": F.coalesce("set_action", "action"), "heading": F.coalesce("set_heading", "heading"), "toc_match": F.when(~edited, F.col("toc_match"))}).drop("set_action", "set_heading")


def heading_of_row_above(decisions: DataFrame, kept_only: bool) -> DataFrame:
    """The heading of the row above: of the last kept one (bulk tool) or of any, skipped ones too (sequential tool)."""
    value = F.when(~F.col("action").isin("skip", "merge") | F.lit(not kept_only), F.coalesce("heading", F.lit("")))
    return carry_last(decisions, ["doc_uuid"], "pos", ["id"], {"above": value}, inclusive=False).select("doc_uuid", "pos", "id", "above")


def fingerprint(decisions: DataFrame, fields: list[str]) -> DataFrame:
    """One value per document that changes with any of `fields` in any row, whatever the order.

    Row hashes are summed in two independent ways, so no list of rows is built.
    """
    row = F.sha2(F.to_json(F.struct(*fields)), 256)
    high = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    low = F.conv(F.substring(row, 13, 12), 16, 10).cast("decimal(38,0)")
    return decisions.groupBy("doc_uuid").agg(F.count("*").alias("n"), F.sum(high).alias("a"), F.sum(low).alias("b")).select("doc_uuid", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("fingerprint"))


def changed_documents(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """Documents whose review differs from the saved one, for versioned saves."""
    a, b = fingerprint(old, fields), fingerprint(new, fields).withColumnRenamed("fingerprint", "f2")
    return a.join(b, "doc_uuid", "full_outer").where(~F.col("fingerprint").eqNullSafe(F.col("f2"))).select("doc_uuid")


def section_edits(sections: DataFrame, edits: DataFrame) -> DataFrame:
    """Section table with edits (doc_uuid, ordinal, op, heading, text): add, edit or delete."""
    kept = sections.join(edits.where("op = 'delete'").select("doc_uuid", "ordinal"), ["doc_uuid", "ordinal"], "left_anti")
    changed = first_per_key(edits.where("op = 'edit'"), ["doc_uuid", "ordinal"], ["heading"], ["heading", "text"]).withColumnsRenamed({"heading": "h2", "text": "t2"})
    merged = kept.join(changed, ["doc_uuid", "ordinal"], "left").select("doc_uuid", "ordinal", F.coalesce("h2", "heading").alias("heading"), rstrip(F.coalesce("t2", "text")).alias("text"))
    return merged.unionByName(edits.where("op = 'add'").select("doc_uuid", "ordinal", "heading", rstrip(F.col("text")).alias("text")))


def rows_from_orphans(decisions: DataFrame) -> DataFrame:
    """Merges with nothing above them, which are kept as rows of their own."""
    return merge_groups(decisions.select("doc_uuid", "pos", "id", "action")).where((F.col("action") == "merge") & F.col("kept")).select("doc_uuid", "pos", "id")
