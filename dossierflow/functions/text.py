"""Text primitives as column expressions; everything stays in generated JVM code.

White space is Unicode white space throughout, lengths are in code points and
null means missing; a null argument gives null unless said otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: patterns that decide what counts as a heading or contents entry ----
DESIGNATOR = r"(?i)^\s*(part|subpart|section|chapter|annex|appendix|article|amc\d*|gm\d*|cs)\s+[\w.\-]+"
CODE = r"^\s*[A-Z]{2,}(\.[A-Z]+)*[.\s]\s*\d+"
NUMBERED_TITLE = r"^\s*(\d+(\.\d+)*\.?|[IVXLC]+\.|[A-Z]\.)\s+\S"
MARKER = r"^\s*([IVXLC]+\.|[A-Z]\.)\s*$"
DATE = r"^\s*\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\s*$"
TOC_TITLE = r"(?i)^\s*(table\s+of\s+contents|contents|inhaltsverzeichnis|index)\s*$"
TOC_ENTRY = r"^\s*(\S.*?)(?:[\s.·•_-]{2,}|\s{2,}|\t+)(\d{1,4})\s*$"
HEADING_TRIM = " .:;-–—_·"
TOC_TRIM = " .·•_-\t"
MIN_CONTENT_CHARS = 25
MAX_UNPAGED_ENTRY = 200


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def ustrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def casefold(c: Column) -> Column:
    """Case folding of text in which ß is the only letter that expands."""
    return F.lower(F.replace(F.replace(c, F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("ss")))


def squash_ws(c: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def normalize_heading(c: Column) -> Column:
    """Form in which two spellings of a heading are compared; '' for null."""
    return casefold(F.btrim(collapse_ws(F.coalesce(c, F.lit(""))), F.lit(HEADING_TRIM)))


def is_numbered_heading(c: Column) -> Column:
    """Whether a heading carries a section number or designator; dates and bare digits don't."""
    t = ustrip(F.coalesce(c, F.lit("")))
    return (t != "") & ~t.rlike(DATE) & (t.rlike(DESIGNATOR) | t.rlike(CODE) | t.rlike(NUMBERED_TITLE) | t.rlike(MARKER))


def is_toc_title(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(TOC_TITLE)


def plausible_heading(c: Column) -> Column:
    """Rule for headings where neither contents nor a model names the valid ones."""
    t = ustrip(F.coalesce(c, F.lit("")))
    bare = F.btrim(t, F.lit(" .·•_-"))
    furniture = bare.rlike(r"^[\d\s./\-]+$") | bare.rlike(r"(?i)^page\s+\d+")
    return (t != "") & ~is_toc_title(t) & (is_numbered_heading(t) | (~furniture & F.char_length(bare).between(3, 160)))


def clean_cell(c: Column) -> Column:
    """A table cell as comparable text; markers of emptiness become ''."""
    t = collapse_ws(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(t).isin("", "nan", "none", "null", "-", "—"), "").otherwise(t)


def page_from_cell(c: Column) -> Column:
    """The page number in a cell ('14.', 'p. 14'), or null."""
    t = F.btrim(F.regexp_replace(clean_cell(c), r"(?i)^(page|p\.?|pg\.?|seite)\s*", ""), F.lit(" .·•_-"))
    return F.when(t.rlike(r"^\d{1,4}$"), t.try_cast("int"))


def toc_entry(line: Column) -> Column:
    """struct(title, page) of a contents line, or null; page is null where only a numbered heading stands."""
    t = ustrip(F.coalesce(line, F.lit("")))
    matched = t.rlike(TOC_ENTRY)
    title = F.btrim(F.when(matched, F.regexp_extract(t, TOC_ENTRY, 1)).otherwise(t), F.lit(TOC_TRIM))
    page = F.when(matched, F.regexp_extract(t, TOC_ENTRY, 2).try_cast("int"))
    unpaged = is_numbered_heading(t) & (F.char_length(t) <= MAX_UNPAGED_ENTRY)
    return F.when((t != "") & ~is_toc_title(t) & F.when(matched, title != "").otherwise(unpaged), F.struct(title.alias("title"), page.alias("page")))


def toc_entry_from_cells(cells: Column) -> Column:
    """struct(title, page) of a row of table cells, or null."""
    full = F.filter(F.transform(cells, clean_cell), lambda x: x != "")
    n = F.size(full)
    last = F.try_element_at(full, F.lit(-1))
    page = page_from_cell(last)
    joined = F.array_join(full, " ")
    glued = joined.rlike(TOC_ENTRY)
    head = F.array_join(F.slice(full, 1, F.greatest(n - 1, F.lit(0))), " ")
    one = F.when(glued, F.regexp_extract(joined, TOC_ENTRY, 1)).when(is_numbered_heading(joined) & (F.char_length(joined) <= MAX_UNPAGED_ENTRY), joined)
    many = F.when(page.isNotNull(), head).when(glued, F.regexp_extract(joined, TOC_ENTRY, 1))
    title = F.btrim(F.when(n == 1, one).when(n > 1, many), F.lit(TOC_TRIM))
    number = F.when((n > 1) & page.isNotNull(), page).when(glued, F.regexp_extract(joined, TOC_ENTRY, 2).try_cast("int"))
    return F.when((title != "") & ~is_toc_title(title) & title.rlike("[A-Za-z]"), F.struct(title.alias("title"), number.alias("page")))


# ---- items and separators ----


def split_items(cell: Column, separators: tuple[str, ...] = (";",)) -> Column:
    """Items of a cell by its most frequent separator (the first one on ties); [] for null and blank."""
    t = ustrip(F.coalesce(cell, F.lit("")))
    parts = F.array(t)
    best = best_separator(t, separators)
    for s in reversed(separators):
        parts = F.when(best == s, F.split(t, "\\Q" + s + "\\E")).otherwise(parts)
    return F.filter(F.transform(parts, ustrip), lambda x: x != "")


def count_of(t: Column, needle: str) -> Column:
    return ((F.char_length(t) - F.char_length(F.replace(t, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def best_separator(cell: Column, separators: tuple[str, ...]) -> Column:
    """The separator that occurs most often, the first one on ties, null if none does."""
    counts = [count_of(cell, s) for s in separators]
    most = F.greatest(*counts) if len(counts) > 1 else counts[0]
    found = F.lit(None).cast("string")
    for s, n in reversed(list(zip(separators, counts))):
        found = F.when((n == most) & (most > 0), s).otherwise(found)
    return found


def grounded(item: Column, reference: Column) -> Column:
    """Whether the reference holds the item, letter case and white space aside; false on an empty reference."""
    ref, it = F.coalesce(reference, F.lit("")), F.coalesce(item, F.lit(""))
    squashed = squash_ws(it)
    return (ref != "") & (F.lower(ref).contains(F.lower(it)) | ((squashed != "") & squash_ws(ref).contains(squashed)))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of the lower-case word sets, 4 decimals; 0 if both are empty."""
    x, y = word_set(F.coalesce(a, F.lit(""))), word_set(F.coalesce(b, F.lit("")))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.bround(F.size(F.array_intersect(x, y)) / union, 4))


# ---- rule identifiers ----
RULE_ID = r"^\s*([A-Z]{2,3}\d?)\s*(\d{2})\.(\d{2,4})(?!\d)"
BARE_RULE_ID = r"^\s*(\d{2}\.[^\s(]+)"
RULE_PREFIX_IN_TITLE = r"\b([A-Z]{2,3}\d?)\s+\d{2}\.\d{2}"


def rule_prefix(c: Column) -> Column:
    return F.when(c.rlike(RULE_ID), F.regexp_extract(c, RULE_ID, 1))


def rule_number(c: Column) -> Column:
    return F.when(c.rlike(RULE_ID), F.concat_ws(".", F.regexp_extract(c, RULE_ID, 2), F.regexp_extract(c, RULE_ID, 3)))


def bare_rule_number(c: Column) -> Column:
    n = F.rtrim(F.regexp_extract(c, BARE_RULE_ID, 1), F.lit(".,;:-"))
    return F.when(F.char_length(n) > 3, n)


PARENTHETICAL = r"\([^()]*\)"


def strip_parentheticals(c: Column) -> Column:
    """Text without parentheses of any depth, tidied at the ends; ones without a partner stay.

    Each pass takes the innermost ones. A text whose parentheses are not used
    up by the first passes gets as many more as it has opening ones left.
    """
    text = out = F.coalesce(c, F.lit(""))
    for _ in range(2):
        out = F.regexp_replace(out, PARENTHETICAL, " ")
    left = F.when(out.rlike(PARENTHETICAL), count_of(out, "(")).otherwise(0)
    out = F.aggregate(F.array_repeat(F.lit(0), left), out, lambda t, _: F.regexp_replace(t, PARENTHETICAL, " "))
    out = F.when(F.contains(text, F.lit("(")), out).otherwise(text)  # most texts have none
    return F.btrim(collapse_ws(out), F.lit(" ,;:-"))


# ---- sentences of references (fixed values) ----
ABBREVIATIONS = (
    "e.g", "i.e", "eg", "ie", "etc", "vs", "viz", "cf", "al", "no", "nos", "fig", "figs", "eq", "eqs", "ref", "refs", "sec", "secs", "art", "arts", "para", "paras", "reg", "regs",
    "ch", "chap", "pt", "pts", "pp", "vol", "vols", "ed", "eds", "approx", "ca", "incl", "excl", "min", "max", "avg", "std", "est", "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "rev",
    "inc", "ltd", "co", "corp", "dept", "univ", "govt", "assn", "u.s", "u.k", "e.u", "u.n", "no.s",
)


def _sentence_gap() -> str:
    """Pattern of the white space between two sentences of a reference.

    Behind an end mark (and one closing sign), but not behind a digit, an
    abbreviation or an initial with its stop, nor before a lower-case letter.
    """
    end = r"[.!?][\"'”’)\]]?"
    word = r"(?<![A-Za-z])(?<![A-Za-z]\.)"
    vetoes = (rf"\d{end}", rf"{word}(?i:{'|'.join(map(re.escape, ABBREVIATIONS))}){end}", rf"{word}[A-Z]{end}")
    return rf"(?U)(?<={end}){''.join(f'(?<!{v})' for v in vetoes)}\s++(?!\p{{Ll}})"


SENTENCE_GAP = _sentence_gap()


def reference_sentences(c: Column) -> Column:
    """Sentences of a reference text, careful rather than keen; [] for null and blank."""
    pieces = F.transform(F.split(ustrip(F.coalesce(c, F.lit(""))), SENTENCE_GAP), ustrip)
    return F.filter(pieces, lambda x: x != "")


# ---- chains ----


def chain_fields(chain: Column) -> Column:
    """struct of the six components of one chain, or null without a reference.

    Six fields divided by pipes; five are the older form without physical
    quantity, more than six overflow into the value; chains without a pipe are
    divided by hyphens from the right.
    """
    blank = lambda x: F.when(ustrip(x) == "#", "").otherwise(ustrip(x))
    parts = F.transform(F.split(chain, r"\|"), blank)
    n = F.size(parts)
    at = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))
    extra = F.array_join(F.filter(F.slice(parts, 7, F.greatest(n - 6, F.lit(0))), lambda x: x != ""), "|")
    value = F.when(extra != "", F.btrim(F.concat(at(parts, 5), F.lit("|"), extra), F.lit("|"))).otherwise(at(parts, 5))
    piped = _chain(at(parts, 0), at(parts, 1), at(parts, 2), at(parts, 3), F.when(n == 5, "").otherwise(at(parts, 4)), F.when(n == 5, at(parts, 4)).otherwise(value))
    raw = F.split(chain, "-")
    old = F.transform(raw, blank)
    m = F.size(old)
    head = blank(F.array_join(F.slice(raw, 1, F.greatest(m - 4, F.lit(0))), "-"))
    right = lambda k: F.when(m >= 5, F.get(old, m - k)).otherwise(at(old, 5 - k))
    hyphened = _chain(F.when(m >= 5, head).otherwise(at(old, 0)), right(4), right(3), right(2), F.lit(""), right(1))
    made = F.when(chain.contains("|"), piped).otherwise(hyphened)
    return F.when(made["reference"] != "", made)


def _chain(*cs: Column) -> Column:
    names = ("reference", "system_info", "process", "personal", "physical_quantity", "quantity_value")
    return F.struct(*[c.alias(n) for c, n in zip(cs, names)])


def unfenced(reply: Column) -> Column:
    """A reply without a surrounding code fence."""
    t = ustrip(F.coalesce(reply, F.lit("")))
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*(\n|$)", ""), r"(\n\s*```[^\n]*)+$", "")
    return F.when(t.startswith("```"), ustrip(inner)).otherwise(t)


def looks_like_chain(reply: Column) -> Column:
    t = unfenced(reply)
    segments = F.filter(F.transform(F.split(t, ";"), ustrip), lambda x: x != "")
    return t.contains("|") & ~t.startswith("{") & ~t.startswith("[") & F.forall(segments, lambda s: s.contains("|")) & F.exists(segments, lambda s: chain_fields(s).isNotNull())


# ---- names, ids, JSON ----


def sanitize_filename(c: Column, most: int = 120) -> Column:
    """A title as a file name."""
    t = F.regexp_replace(c, r"(?U)[^a-zA-Z0-9\s\-.]", "_")
    t = F.substring(F.btrim(F.regexp_replace(t, r"(?U)[\s_]+", "_"), F.lit("_")), 1, most)
    return F.when(F.coalesce(c, F.lit("")) == "", "Unknown_Topic").otherwise(t)


def document_id(kind: Column, path: Column) -> Column:
    return F.substring(F.sha1(F.concat(kind, F.lit("::"), path)), 1, 16)


def short_hash(c: Column) -> Column:
    return F.substring(F.md5(c), 1, 8)


def sheet_name(code: str, base: Column, most: int = 31) -> Column:
    return F.substring(F.concat(F.lit(f"{code} "), base), 1, most)


def safe_sheet_name(c: Column, most: int = 31) -> Column:
    t = F.substring(ustrip(F.translate(F.coalesce(c, F.lit("")), ":\\/?*[]", "       ")), 1, most)
    return F.when(t == "", "Uniq").otherwise(t)


def ref_map_sheet(base: Column) -> Column:
    b = F.when(F.lower(base).startswith("uniq "), F.substring(base, 6, 1_000)).otherwise(base)
    return F.substring(F.concat(F.lit("Ref Map "), b), 1, 31)


def json_object_in(c: Column) -> Column:
    """Text from the first { to the last } if that is a JSON object, else null."""
    body = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when((body != "") & F.try_parse_json(body).isNotNull(), body)


def preview(c: Column, limit: int = 180) -> Column:
    t = collapse_ws(F.coalesce(c, F.lit("")))
    return F.when(F.char_length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit(" …"))).otherwise(t)


def count_value(c: Column) -> Column:
    """A count cell as a whole number; 0 where it is none."""
    d = c.cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(d), d).try_cast("long"), F.lit(0).cast("long"))


def hms(seconds: Column) -> Column:
    """HH:MM:SS of a number of seconds, within a day."""
    s = F.pmod(seconds.cast("long"), F.lit(86400))
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"), (F.pmod(s, F.lit(3600)) / 60).cast("int"), F.pmod(s, F.lit(60)).cast("int"))


def add_hms(a: Column, b: Column) -> Column:
    """Sum of two HH:MM:SS durations; hours go beyond 24."""
    total = lambda c: sum(F.split(c, ":")[i].try_cast("int") * w for i, w in enumerate((3600, 60, 1)))
    s = total(a) + total(b)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("int"), F.pmod(s, F.lit(60)).cast("int"))


def severity(message: Column) -> Column:
    """Class of a console line by the marks in it, or null."""
    m = F.coalesce(message, F.lit(""))
    any_of = lambda *marks: F.exists(F.array(*map(F.lit, marks)), lambda x: m.contains(x))
    return F.when(any_of("[ERROR]", "❌"), "err").when(any_of("⚠", "↻", "[WARN]", "[unparsed]"), "warn").when(m.startswith("===") | m.startswith("⚖"), "hdr").when(any_of("💾", "✅", "✔", "→ wrote"), "ok")


def is_reference_column(c: Column) -> Column:
    return F.lower(c).contains("reference")


def is_entity_column(c: Column) -> Column:
    return F.lower(ustrip(c)) == "specific entities"


def payload_kind(c: Column) -> Column:
    """Shape of a JSON payload: hierarchy, nodes, sections, chunks, or invalid."""
    t = F.ltrim(F.coalesce(c, F.lit("")))
    has = lambda k: F.get_json_object(c, f"$.{k}").isNotNull()
    first = F.get_json_object(c, "$[0].element_type")
    valid = F.try_parse_json(c).isNotNull()
    kind = F.when(t.startswith("["), F.when(first.isNotNull(), "nodes").otherwise("chunks")).when(has("rules_hierarchy"), "hierarchy").when(has("merged_headings"), "sections").when(has("chunks"), "chunks").otherwise("invalid")
    return F.when(F.coalesce(valid, F.lit(False)) & (t.startswith("[") | t.startswith("{")), kind).otherwise("invalid")


def cell_text(c: Column) -> Column:
    """A JSON value as a cell: lists joined by `; `, objects as JSON, null as ''."""
    t = F.ltrim(F.coalesce(c, F.lit("")))
    items = F.from_json(c, "array<string>")
    return F.when(t.startswith("[") & items.isNotNull(), F.array_join(items, "; ", "")).otherwise(F.coalesce(c, F.lit("")))


def clean_folder_path(c: Column, home: str) -> Column:
    """A path without surrounding quotes and blanks, `~` expanded."""
    bare = ustrip(F.btrim(ustrip(c), F.lit("\"'")))
    return F.when(bare.rlike(r"^~(/|$)"), F.concat(F.lit(home), F.substring(bare, 2, 100_000))).otherwise(bare)


def message_tokens(n_tokens: Column, has_name: Column) -> Column:
    """Tokens of a chat message: three for its frame, one for a name, three to prime the reply."""
    return n_tokens + 3 + F.when(has_name, 1).otherwise(0) + 3


def backoff_seconds(attempt: Column, retry_after: Column, first: float = 2.0) -> Column:
    """Wait before the next attempt: doubling, not below what the service asks for."""
    return F.greatest(F.pow(F.lit(2.0), attempt - 1) * first, F.coalesce(retry_after, F.lit(0.0)))


def ordered_vectors(entries: Column) -> Column:
    """Vectors of a service's reply entries (index, embedding) in the order of their index."""
    return F.transform(F.array_sort(F.transform(entries, lambda e: F.struct(e["index"].alias("i"), e["embedding"].alias("v")))), lambda s: s["v"])


def node_badge(title: Column, n_children: Column, n_images: Column, n_links: Column) -> Column:
    """Label of a tree node with what hangs on it."""
    mark = lambda n, s: F.when(n > 0, F.concat(F.lit(f" {s}"), n.cast("string"))).otherwise("")
    return F.concat(title, mark(n_children, "▸"), mark(n_images, "▣"), mark(n_links, "↗"))
