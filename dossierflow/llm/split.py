"""Cutting oversized texts at natural boundaries, by recursive bisection.

A span longer than the limit less the overlap is cut at the strongest boundary
near its midpoint (paragraph, line, sentence, word, in that order), and its
halves are treated alike; then each piece but the first is extended to the
left by the overlap. Only where no boundary lies inside a span is it cut at
its midpoint by force.

All lengths and offsets are in code points. Edge cases: a null text or limit
gives no pieces; a text within its limit gives one piece; an overlap not
below the limit is taken as half the limit; a negative overlap as none; an
empty table gives an empty table; repeated ids are split one by one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.functions.arrowmap import map_rows

PIECE_SCHEMA = "id long, piece_no int, start_char int, end_char int, core_start int, cut string, divided int, max_chars int, piece string"

#: Boundaries from strongest to weakest; each cut falls behind the match.
BOUNDARIES = (
    ("paragraph", re.compile(r"\n\s*\n\s*")),
    ("line", re.compile(r"\n\s*")),
    ("sentence", re.compile(r"[.!?][\"'”’»)\]]*\s+|[。！？।][」』”’）]*\s*")),
    ("word", re.compile(r"\s+")),
)
_BREAK = re.compile(r"[\s.!?。！？।]")


def bisect_cuts(text: str, limit: int) -> list[tuple[int, str]]:
    """Cuts (position, kind) that leave no span longer than `limit`."""
    levels: list[list[int]] = []
    for _, pattern in BOUNDARIES:
        levels.append([m.end() for m in pattern.finditer(text)])
    cuts: list[tuple[int, str]] = []
    stack = [(0, len(text))]
    while stack:
        a, b = stack.pop()
        if b - a <= limit:
            continue
        mid, near = (a + b) / 2, (b - a) / 4
        at, kind = None, "forced"
        for low, high in ((mid - near, mid + near), (a + 1, b - 1)):
            for (name, _), ends in zip(BOUNDARIES, levels):
                i, j = bisect_left(ends, low), bisect_right(ends, high)
                if i < j:
                    k = bisect_left(ends, mid, i, j)
                    at = min(ends[max(i, k - 1) : min(j, k + 1)], key=lambda p: abs(p - mid))
                    kind = name
                    break
            if at is not None:
                break
        if at is None or not a < at < b:
            at, kind = (a + b) // 2, "forced"
        cuts.append((at, kind))
        stack += [(a, at), (at, b)]
    return sorted(cuts)


def split_text(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """Pieces (start, end, core start, kind of the cut before it) of at most max_chars."""
    max_chars = max(1, max_chars)
    if len(text) <= max_chars:
        return [(0, len(text), 0, "none")]
    overlap = max(0, overlap if overlap < max_chars else max_chars // 2)
    cuts = bisect_cuts(text, max_chars - overlap)
    starts = [(0, "none"), *cuts]
    ends = [*(c for c, _ in cuts), len(text)]
    return [(max(0, s - overlap), e, s, kind) for (s, kind), e in zip(starts, ends)]


def divided_stretches(text: str, cuts: list[int]) -> list[int]:
    """For each cut the length of the stretch without whitespace or sentence mark that it divides (0 at the edge of one)."""
    if not cuts:
        return []
    breaks = [-1, *(m.start() for m in _BREAK.finditer(text)), len(text)]
    out = []
    for at in cuts:
        k = bisect_left(breaks, at)
        a, b = breaks[k - 1] + 1, breaks[k]
        out.append(b - a if a < at < b else 0)
    return out


def split_oversized(df: DataFrame, limits: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Pieces of the texts longer than the max_chars of their source.

    `limits` has (source, max_chars, overlap_chars); the shorter texts are
    filtered out before any text leaves the JVM. Of several limits of a source
    the smallest counts.
    """
    one = limits.where(F.col("source").isNotNull()).groupBy("source").agg(F.min(F.struct("max_chars", "overlap_chars")).alias("l")).select(F.col("source").alias("_s"), F.col("l.max_chars").alias("_m"), F.coalesce("l.overlap_chars", F.lit(0)).alias("_o"))
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(source_col).alias("_s")).where(F.col("_t").isNotNull())
    long_ = rows.join(one, "_s").where(F.char_length("_t") > F.col("_m")).select(F.col("_id").cast("long"), "_t", F.col("_m").cast("int"), F.col("_o").cast("int"))

    def pieces(rid: int, text: str, most: int, overlap: int) -> Iterator[tuple]:
        made = split_text(text, most, overlap)
        # the longest stretch that a forced cut of this text divides stands on each of its pieces
        divided = max(divided_stretches(text, [core for _, _, core, kind in made if kind == "forced"]), default=0)
        for k, (a, b, core, kind) in enumerate(made, 1):
            yield rid, k, a, b, core, kind, divided, most, text[a:b]

    return map_rows(long_, pieces, PIECE_SCHEMA)


def cut_kinds(pieces: DataFrame) -> DataFrame:
    """(id, cut_kind) of each split text: `forced` if one of its forced cuts divides a stretch longer than the limit.

    No piece is longer than the limit and no boundary lies inside a stretch,
    so every stretch beyond the limit is divided by a forced cut. A forced cut
    of a shorter stretch (the pieces' cores stay under the limit less the
    overlap) leaves the text `natural`.
    """
    first = pieces.where(F.col("piece_no") == 1)
    return first.select("id", F.when(F.col("divided") > F.col("max_chars"), "forced").otherwise("natural").alias("cut_kind"))
