"""Tables of contents: entries in text, in tables, and which source is usable."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.functions import text as X
from dossierflow.functions.arrowmap import map_rows
from dossierflow.operators.ordered import carry_last, first_per_key, running_sum

# fixed values
MIN_TOC_ENTRIES = 4
MIN_ROW_RATIO = 0.6
MIN_ORDER_RATIO = 0.8
MAX_SCAN_PAGE = 25
MATCH_RATIO = 0.88
#: Headings of a document that one task compares with as many valid ones.
MATCH_BLOCK = 20_000


def toc_lines(chunks: DataFrame) -> DataFrame:
    """Contents entries of every line of the chunks' texts: doc_uuid, pos, id, line_no, title, page."""
    lines = chunks.select("doc_uuid", "pos", "id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "line"))
    return lines.withColumn("e", X.toc_entry(F.col("line"))).where(F.col("e").isNotNull()).select("doc_uuid", "pos", "id", "line_no", "e.title", "e.page")


def toc_run(chunks: DataFrame) -> DataFrame:
    """The chunks of each document's printed contents: from the first one that announces it as long as chunks parse as entries."""
    lines = F.filter(F.split("text", r"\r\n|\r|\n"), lambda x: X.ustrip(x) != "")
    parsed = F.size(F.filter(lines, lambda x: X.toc_entry(x).isNotNull()))
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    c = chunks.withColumns({"announces": X.is_toc_title(F.col("heading")) | X.is_toc_title(first), "parses": (F.size(lines) > 0) & (parsed >= F.greatest(F.lit(2), F.floor(F.size(lines) / 2)))})
    c = running_sum(c, ["doc_uuid"], "pos", ["id"], {"begun": F.col("announces").cast("int")})
    # chunks from the start on that don't parse, the start itself aside
    c = running_sum(c, ["doc_uuid"], "pos", ["id"], {"broken": F.when((F.col("begun") > 0) & ~F.col("parses") & ~((F.col("begun") == 1) & F.col("announces")), 1)})
    return c.where("begun > 0 and broken = 0").select("doc_uuid", "pos", "id")


def distinct_entries(entries: DataFrame, order: list[str]) -> DataFrame:
    """First entry of each normalised title of a document."""
    keyed = entries.withColumn("key", X.normalize_heading(F.col("title"))).where("key != ''")
    return first_per_key(keyed, ["doc_uuid", "key"], order, [*order, "title", "page"])


def with_entries(rows: DataFrame) -> DataFrame:
    """Adds title and page of the entry that each row of cells gives (as text.toc_entry_from_cells), and whether any cell is filled.

    In steps, so that no pattern is matched twice.
    """
    r = rows.withColumn("_full", F.filter(F.transform("cells", X.clean_cell), lambda x: x != ""))
    r = r.withColumns({"_n": F.size("_full"), "_joined": F.array_join("_full", " "), "_last": X.page_from_cell(F.try_element_at("_full", F.lit(-1)))})
    n, joined, last = F.col("_n"), F.col("_joined"), F.col("_last")
    paged = (n > 1) & last.isNotNull()
    r = r.withColumn("_glued", F.when(~paged, joined.rlike(X.TOC_ENTRY)).otherwise(False))
    head = F.array_join(F.slice("_full", 1, F.greatest(n - 1, F.lit(0))), " ")
    bare = (n == 1) & (F.char_length(joined) <= X.MAX_UNPAGED_ENTRY) & X.is_numbered_heading(joined)
    raw = F.when(paged, head).when(F.col("_glued"), F.regexp_extract(joined, X.TOC_ENTRY, 1)).when(bare, joined)
    r = r.withColumns({"_title": F.btrim(raw, F.lit(X.TOC_TRIM)), "_page": F.when(paged, last).when(F.col("_glued"), F.regexp_extract(joined, X.TOC_ENTRY, 2).try_cast("int"))})
    good = (F.col("_title") != "") & ~X.is_toc_title(F.col("_title")) & F.col("_title").rlike("[A-Za-z]")
    r = r.withColumns({"title": F.when(good, F.col("_title")), "page": F.when(good, F.col("_page")), "filled": n > 0})
    return r.drop("_full", "_n", "_joined", "_last", "_glued", "_title", "_page")


def table_quality(rows: DataFrame) -> DataFrame:
    """Whether tables read as contents: rows (doc_uuid, pos, id, cells) -> counts, ratios, verdict and why.

    Page order compares each entry with the one before it in the table.
    """
    r = carry_last(with_entries(rows).drop("cells"), ["doc_uuid"], "pos", ["id"], {"previous": F.col("page")}, inclusive=False)
    paged = F.col("page").isNotNull()
    titled = paged & (F.char_length("title") >= 4)
    g = r.groupBy("doc_uuid").agg(F.count_if("filled").alias("n_rows"), F.count_if(paged).alias("n_paged"), F.count_if(paged & F.col("previous").isNotNull()).alias("n_pairs"), F.count_if(paged & (F.col("page") >= F.col("previous"))).alias("n_forward"), F.count_if(titled).alias("n_titled"))
    why = F.when(F.col("n_rows") == 0, "empty").when(F.col("n_paged") < MIN_TOC_ENTRIES, "too few entries").when(F.col("n_paged") / F.col("n_rows") < MIN_ROW_RATIO, "too few rows are entries").when((F.col("n_pairs") > 0) & (F.col("n_forward") / F.col("n_pairs") < MIN_ORDER_RATIO), "pages do not run forwards").when(F.col("n_titled") < 0.5 * F.col("n_paged"), "titles do not read as titles").otherwise("usable")
    return g.withColumn("verdict", why)


def is_usable(n_entries: Column, n_paged: Column, source: Column) -> Column:
    """Enough entries, with pages unless bookmarks or a model give them."""
    return (n_entries >= MIN_TOC_ENTRIES) & (source.isin("bookmarks", "llm") | (n_paged >= MIN_TOC_ENTRIES))


def resolve_cascade(attempts: DataFrame, order: tuple[str, ...] = ("bookmarks", "pdf-text", "chunks", "tables", "llm")) -> DataFrame:
    """Per document the first usable source of attempts (doc_uuid, source, n_entries, n_paged), else the richest partial one."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    a = attempts.withColumns({"rank": rank, "usable": is_usable(F.col("n_entries"), F.col("n_paged"), F.col("source"))})
    best = F.struct(F.when(F.col("usable"), 0).otherwise(1), F.when(F.col("usable"), F.col("rank")).otherwise(-F.col("n_entries")), F.col("rank"))
    return a.groupBy("doc_uuid").agg(F.min_by(F.struct("source", "usable", "n_entries"), best).alias("b"), F.count("*").alias("n_attempts")).select("doc_uuid", "b.source", "b.usable", "b.n_entries", "n_attempts")


def tables_on_contents_pages(tables: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tables (doc_uuid, table_index, page) on a document's contents pages, or on its first pages if none are known."""
    known = wanted.select("doc_uuid").distinct().withColumn("known", F.lit(True))
    pages = wanted.select("doc_uuid", "page").distinct().withColumn("hit", F.lit(True))
    t = tables.join(known, "doc_uuid", "left").join(pages, ["doc_uuid", "page"], "left")
    return t.where(F.when(F.col("known"), F.col("hit")).otherwise(F.col("page") <= MAX_SCAN_PAGE)).drop("known", "hit")


def headings_match(a: str, b: str, ratio: float | None = MATCH_RATIO) -> bool:
    """Equal, one within the other (4 characters at least), or alike (not asked for without a ratio); both already normalised."""
    if not a or not b:
        return False
    if a == b or (len(a) >= 4 and len(b) >= 4 and (a in b or b in a)):
        return True
    if ratio is None:
        return False
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= ratio and m.quick_ratio() >= ratio and m.ratio() >= ratio


class HeadingIndex:
    """The first of a list of normalised headings that matches a heading, found without comparing it with all.

    Equality is a lookup, containment a search by automaton and in the joined
    list. Two texts of T letters together that are alike at ratio r have M >=
    rT/2 letters in at most T - 2M + 1 common blocks, hence at least M - 2(T -
    2M + 1) three-letter grams in common; only those that do are compared, in
    order. At 0.88 only pairs of 4 and 5 letters can do without a common gram:
    they differ by one letter put in, and are looked up by that.
    """

    def __init__(self, keys: list[str], ratio: float | None = MATCH_RATIO):
        import ahocorasick

        self.keys, self.ratio = keys, ratio
        self.exact: dict[str, int] = {}
        self.tiny: dict[str, list[int]] = {}
        self.held = ahocorasick.Automaton()
        grams: dict[str, list[int]] = {}
        for i, k in enumerate(keys):
            if k in self.exact:
                continue
            self.exact[k] = i
            if len(k) >= 4:
                self.held.add_word(k, i)
            for short in {k} if len(k) == 4 else {k[:j] + k[j + 1 :] for j in range(5)} if len(k) == 5 else ():
                self.tiny.setdefault(short, []).append(i)
            if ratio is not None:
                for g in _grams(k):
                    grams.setdefault(g, []).append(i)
        if len(self.held):
            self.held.make_automaton()
        self.sizes = np.array([len(k) for k in keys], dtype=np.int64)
        self.grams = {g: np.array(v, dtype=np.int64) for g, v in grams.items()}
        self.starts, at = [], 0
        for k in keys:
            self.starts.append(at)
            at += len(k) + 1
        self.joined = "\n".join(keys)

    def first(self, key: str) -> int | None:
        """Place of the first heading of the list that matches `key`."""
        if not key or not self.keys:
            return None
        best = self.exact.get(key, len(self.keys))
        if len(key) >= 4:
            if len(self.held):
                best = min((i for _, i in self.held.iter(key) if i < best), default=best)
            at = self.joined.find(key)
            while at >= 0:
                i = bisect_right(self.starts, at) - 1
                if i >= best:
                    break
                if len(self.keys[i]) >= 4:
                    best = i
                    break
                at = self.joined.find(key, at + 1)
        if self.ratio is not None and best:
            best = self._first_alike(key, best)
        return best if best < len(self.keys) else None

    def _first_alike(self, key: str, best: int) -> int:
        n = len(key)
        lists = [self.grams[g] for g in _grams(key) if g in self.grams]
        total = n + self.sizes[:best]
        if self.ratio >= 0.88:
            shared = np.bincount(np.concatenate(lists), minlength=len(self.keys))[:best] if lists else np.zeros(best, np.int64)
            likely = shared >= np.maximum(1, np.ceil(total / 2 - 2.5 * (1 - self.ratio) * total - 2 - 1e-9))
        else:
            likely = np.ones(best, bool)
        likely &= 2 * np.minimum(n, self.sizes[:best]) >= self.ratio * total - 1e-9
        places = np.flatnonzero(likely).tolist()
        if n in (4, 5):
            near = [key] if n == 4 else [key[:j] + key[j + 1 :] for j in range(5)]
            places = sorted({*places, *(i for x in near for i in self.tiny.get(x, ()) if i < best)})
        m = SequenceMatcher(None)
        for i in places:
            # the second text is the one that a matcher prepares, so the order is kept as in headings_match
            m.set_seqs(key, self.keys[i])
            if m.quick_ratio() >= self.ratio and m.ratio() >= self.ratio:
                return i
        return best


def _grams(key: str) -> list[str]:
    """Three-letter grams, repeated ones told apart by their number."""
    seen: dict[str, int] = {}
    out = []
    for i in range(len(key) - 2):
        g = key[i : i + 3]
        n = seen[g] = seen.get(g, 0) + 1
        out.append(g if n == 1 else f"{g}{n}")
    return out


def match_headings(headings: DataFrame, valid: DataFrame, ratio: float | None = MATCH_RATIO, block: int = MATCH_BLOCK) -> DataFrame:
    """(doc_uuid, key, known, known_pos): for each normalised heading of a document the first of its valid ones that matches; those without are left out.

    `headings` has (doc_uuid, key), `valid` (doc_uuid, key, heading, first_pos)
    and, if places are shared, first_id. Only distinct keys are compared. A
    document of more than `block` valid or other headings is divided by hash;
    each of its blocks names its first match, and the first of these counts, so
    no task holds a whole document of unknown size.
    """
    doc = F.coalesce("doc_uuid", F.lit("\x00")).alias("doc")
    tie = F.col("first_id").cast("long") if "first_id" in valid.columns else F.lit(0).cast("long")
    h = headings.select(doc, "key").where("key != ''").distinct()
    v = valid.select(doc, "key", "heading", F.col("first_pos").cast("long").alias("pos"), tie.alias("tie")).where("key != ''")
    n_v = v.groupBy("doc").agg(F.ceil(F.count("*") / block).cast("int").alias("vs"))
    sizes = h.groupBy("doc").agg(F.ceil(F.count("*") / block).cast("int").alias("hs")).join(n_v, "doc")
    part = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = v.join(sizes, "doc").withColumns({"vb": part("vs")}).withColumn("hb", every("hs"))
    right = h.join(sizes, "doc").withColumns({"hb": part("hs")}).withColumn("vb", every("vs"))
    none = F.lit(None)
    rows = left.select("doc", "vb", "hb", F.lit(0).alias("kind"), "pos", "tie", "key", "heading").unionAll(right.select("doc", "vb", "hb", F.lit(1).alias("kind"), none.cast("long").alias("pos"), none.cast("long").alias("tie"), "key", none.cast("string").alias("heading")))
    # a block's valid headings come first, in order
    ordered = rows.repartition("doc", "vb", "hb").sortWithinPartitions("doc", "vb", "hb", "kind", F.col("pos").asc_nulls_first(), "tie", "key")

    def match(state: dict, doc: str, vb: int, hb: int, kind: int, pos: int | None, tie: int | None, key: str, heading: str | None) -> Iterator[tuple]:
        if state.get("of") != (doc, vb, hb):
            state.update(of=(doc, vb, hb), valid=[], index=None)
        if kind == 0:
            state["valid"].append((key, heading, pos, tie))
            return
        if state["index"] is None:
            state["index"] = HeadingIndex([x[0] for x in state["valid"]], ratio)
        at = state["index"].first(key)
        if at is not None:
            yield doc, key, *state["valid"][at][1:]

    found = map_rows(ordered, match, "doc string, key string, known string, known_pos long, tie long", dict)
    first = found.groupBy("doc", "key").agg(F.min_by(F.struct("known", "known_pos"), F.struct("known_pos", "tie")).alias("f"))
    return first.select(F.nullif(F.col("doc"), F.lit("\x00")).alias("doc_uuid"), "key", "f.known", "f.known_pos")
