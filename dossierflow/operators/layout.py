"""Pages, layout headings, extracted tables and titles of documents.

Edge cases: null texts are empty; pages without lines end a contents run; a
table without records has no rows; repeated column names get numbered.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.functions import text as X
from dossierflow.functions.arrowmap import map_rows
from dossierflow.operators.ordered import carry_last, first_per_key, running_sum

# fixed values
SCAN_PAGES, RUN_PAGES, TITLE_LINES, MIN_ENTRIES, MIN_PAGE_ENTRIES = 20, 10, 15, 4, 3
HEADING_LABELS = ("section_header", "title", "subtitle")


def printed_contents(pages: DataFrame) -> DataFrame:
    """Entries of the contents printed on a document's first pages (doc_uuid, page_no, text).

    It starts on the first page that announces it among its first lines and goes
    on while pages hold entries; a document needs enough entries with pages.
    """
    lines = F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")
    p = pages.where(F.col("page_no") <= SCAN_PAGES + RUN_PAGES).withColumn("lines", lines)
    p = p.withColumns({"announces": F.exists(F.slice("lines", 1, TITLE_LINES), lambda x: X.is_toc_title(X.ustrip(x))) & (F.col("page_no") <= SCAN_PAGES), "entries": F.filter(F.transform("lines", X.toc_entry), lambda e: e.isNotNull())})
    start = p.where("announces").groupBy("doc_uuid").agg(F.min("page_no").alias("start"))
    p = p.join(start, "doc_uuid").where(F.col("page_no").between(F.col("start"), F.col("start") + RUN_PAGES - 1))
    ends = (F.col("page_no") > F.col("start")) & (F.size("entries") < MIN_PAGE_ENTRIES)
    p = running_sum(p, ["doc_uuid"], "page_no", ["page_no"], {"broken": ends.cast("int")}).where("broken = 0")
    e = p.select("doc_uuid", "page_no", F.posexplode("entries").alias("k", "e")).select("doc_uuid", "page_no", "k", "e.title", "e.page")
    e = e.withColumn("key", X.normalize_heading(F.col("title"))).where("key != ''")
    unique = first_per_key(e, ["doc_uuid", "key"], ["page_no", "k"], ["page_no", "k", "title", "page"])
    enough = unique.groupBy("doc_uuid").agg(F.count("page").alias("n")).where(F.col("n") >= MIN_ENTRIES)
    return unique.join(enough.select("doc_uuid"), "doc_uuid", "left_semi").select("doc_uuid", "page_no", "k", "title", "page")


def outline_or_printed(outline: DataFrame, printed: DataFrame) -> DataFrame:
    """Bookmarks (doc_uuid, pos, title, page) where a document has enough of them, else its printed contents."""
    named = outline.where(X.ustrip(F.coalesce("title", F.lit(""))) != "")
    rich = named.groupBy("doc_uuid").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_ENTRIES).select("doc_uuid")
    a = named.join(rich, "doc_uuid", "left_semi").select("doc_uuid", "pos", X.ustrip(F.col("title")).alias("title"), "page", F.lit("pdf-bookmarks").alias("source"))
    b = printed.join(rich, "doc_uuid", "left_anti").select("doc_uuid", (F.col("page_no") * 1000 + F.col("k")).alias("pos"), "title", "page", F.lit("pdf-text").alias("source"))
    return a.unionByName(b)


def layout_headings(items: DataFrame) -> DataFrame:
    """Headings among layout items (labels, heading, page): the label's level plus one, page 1 where missing."""
    level = F.when(F.array_contains("labels", "title"), 1).when(F.array_contains("labels", "subtitle"), 2).otherwise(3)
    return items.where(F.arrays_overlap("labels", F.array(*map(F.lit, HEADING_LABELS)))).withColumns({"level": level + 1, "page": F.coalesce("page", F.lit(1))})


def numbered_names(names: Column) -> Column:
    """Column names with repeats numbered: a, a_1, a_2."""
    before = lambda x, i: F.size(F.filter(F.slice(names, 1, i), lambda y: y.eqNullSafe(x)))
    return F.transform(names, lambda x, i: F.when(before(x, i) > 0, F.concat(x, F.lit("_"), before(x, i).cast("string"))).otherwise(x))


def table_rows(tables: DataFrame) -> DataFrame:
    """Rows of tables (doc_uuid, table_index, header array, records array<array>): the header counts as a row only if it reads as an entry with a page."""
    head = X.toc_entry_from_cells(F.col("header"))
    rows = F.when(head["page"].isNotNull(), F.concat(F.array("header"), F.coalesce("records", F.array().cast("array<array<string>>")))).otherwise(F.coalesce("records", F.array().cast("array<array<string>>")))
    return tables.select("doc_uuid", "table_index", F.posexplode(rows).alias("row_no", "cells")).withColumn("cells", F.transform("cells", lambda c: F.coalesce(c, F.lit(""))))


PREVIEW_ROWS, PREVIEW_COLUMNS = 200, 30


def preview(rows: DataFrame, order: str) -> DataFrame:
    """The first rows and columns of a table, as the viewer shows them."""
    return rows.orderBy(order).limit(PREVIEW_ROWS).select(*rows.columns[:PREVIEW_COLUMNS])


def section_title(number: Column, headings: Column) -> Column:
    """`[n] A → B`, or `[n] Untitled`."""
    label = F.when(F.size(F.coalesce(headings, F.array().cast("array<string>"))) > 0, F.array_join(headings, " → ")).otherwise("Untitled")
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), label)


def first_match(lines: DataFrame, keys: list[str], position: str, tie: str, text: str, targets: list[str]) -> DataFrame:
    """Per group the first text that holds one of the targets, with the text after it; null where it is the last."""
    hit = F.exists(F.array(*[F.lit(t.lower()) for t in targets]), lambda t: F.lower(text).contains(t))
    # the row after a row is the one before it in the reversed order
    back = lines.withColumns({"_pos": -F.col(position), "_tie": -F.col(tie)})
    nxt = carry_last(back, keys, "_pos", ["_tie"], {"next_text": F.col(text)}, inclusive=False)
    return first_per_key(nxt.where(hit), keys, [position, tie], [text, "next_text"])


def string_list_from_reply(reply: Column) -> Column:
    """Strings of the outermost JSON list of a reply; [] if there is none."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\[.*\]", 0)
    return F.filter(F.transform(F.coalesce(F.from_json(body, "array<string>"), F.array().cast("array<string>")), X.ustrip), lambda x: x != "")


def literal_lists(df: DataFrame, id_col: str, reply: str) -> DataFrame:
    """(id, items) of replies that hold a list in Python's notation, which no built-in reads."""

    def rows(rid: int, text: str | None) -> Iterator[tuple]:
        t = text or ""
        a, b = t.find("["), t.rfind("]")
        try:
            value = ast.literal_eval(t[a : b + 1].strip() if 0 <= a < b else t.strip())
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            value = None
        yield rid, [str(v).strip() for v in value if str(v).strip()] if isinstance(value, (list, tuple)) else []

    return map_rows(df.select(F.col(id_col).cast("long"), reply), rows, "id long, items array<string>")


def convert_files(files: DataFrame, converter: Callable[[], Callable[[bytes], list[str]]]) -> DataFrame:
    """Pages of (path, content) by an injected converter (PDF, office): path, page_no, text, error.

    `converter()` is called once per task, so a heavy one is shared by the
    files of a task; a file that fails gives one row with the error.
    """

    def rows(convert: Callable[[bytes], list[str]], path: str, content: bytes) -> Iterator[tuple]:
        try:
            pages = convert(bytes(content))
        except Exception as e:  # noqa: BLE001 - a broken file must not stop the others
            yield path, 0, None, f"{type(e).__name__}: {e}"[:500]
            return
        for n, text in enumerate(pages, 1):
            yield path, n, text, None

    return map_rows(files.select("path", "content"), rows, "path string, page_no int, text string, error string", converter)


IMAGE_SCHEMA = "path string, picture_no int, page string, file_name string, bbox array<double>, data binary, error string"


def extract_images(files: DataFrame, extractor: Callable[[], Callable[[bytes], list[tuple]]]) -> DataFrame:
    """Pictures of (path, content) by an injected extractor that gives (page or None, PNG bytes, box or None) in reading order.

    Pictures are numbered within their file and named by page and number; a
    missing page is `unknown`; a file that fails gives one row with the error.
    """

    def rows(extract: Callable[[bytes], list[tuple]], path: str, content: bytes) -> Iterator[tuple]:
        try:
            found = extract(bytes(content))
        except Exception as e:  # noqa: BLE001 - a broken file must not stop the others
            yield path, 0, None, None, None, None, f"{type(e).__name__}: {e}"[:500]
            return
        for n, (page, data, box) in enumerate(found, 1):
            where = "unknown" if page is None else str(page)
            yield path, n, where, f"_page_{where}_picture_{n}.png", None if box is None else [float(x) for x in box], data, None

    return map_rows(files.select("path", "content"), rows, IMAGE_SCHEMA, extractor)


def pick_embedding_model(models: DataFrame, preferred: list[str]) -> str | None:
    """The first preferred model among a service's embedding models (by name, then by part of it), else the first of them, else the first preferred."""
    low = F.lower("name")
    names = models.where(low.contains("embed") | low.startswith("e5")).select("name")
    rank = F.lit(None).cast("int")
    for n, p in reversed([(2 * i + k, c) for i, p in enumerate(preferred) for k, c in enumerate((F.col("name") == p, F.col("name").contains(p)))]):
        rank = F.when(p, n).otherwise(rank)
    best = names.agg(F.min(F.struct(F.coalesce(rank, F.lit(1 << 30)).alias("rank"), "name")).alias("b")).head()["b"]
    return best["name"] if best else next(iter(preferred), None)
