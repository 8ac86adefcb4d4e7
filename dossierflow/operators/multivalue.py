"""Several values packed in one cell, split by a parsing expression grammar.

    cell    <- gap (value gap)* end
    value   <- mark* (quoted / bare)
    quoted  <- open (doubled / !close .)* close &(space* (delimiter / end))
    bare    <- (bracketed / inner_quoted / !delimiter .)+
    mark    <- bullet space+ / digits [.)] space+

Alternatives are ordered: a quoted value that finds no closing quote before a
delimiter is tried again as a bare one and flagged, and so is a bracket that
never closes. Positions count the non-empty values from 1; offsets are in code
points of the cell.

Edge cases: a null, blank or delimiter-only cell gives no values; repeated
values keep their own positions; an empty table gives an empty table; input
columns with other names are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.functions.arrowmap import map_rows

VALUE_SCHEMA = "src_field string, row_id long, value_pos int, field_value string, start_char int, end_char int, error string"

QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "‘": "’", "「": "」"}
BRACKETS = {"(": ")", "[": "]", "{": "}", "（": "）"}
HARD_DELIMITERS = ";；|\n\r\t•‣▪●"
_OPENERS_OF: dict[str, str] = {}
for _o, _cs in [*QUOTES.items(), *BRACKETS.items()]:
    for _c in _cs:
        _OPENERS_OF[_c] = _OPENERS_OF.get(_c, "") + _o
_PAIRED = re.compile("[" + re.escape("".join({*QUOTES, *BRACKETS, *_OPENERS_OF}) + "\r\n\t") + "]")
_MARK = re.compile(r"(?:[•‣▪●◦·*–—\-]\s+|\(?\d{1,3}[.)]\s+)")
_SPACE = re.compile(r"[\s​﻿]*")


@dataclass(frozen=True)
class CellGrammar:
    """Delimiters of one field; `comma` says whether unquoted commas separate."""

    comma: bool = False

    @property
    def delimiters(self) -> str:
        return HARD_DELIMITERS + (",，、" if self.comma else "")


class CellParser:
    def __init__(self, grammar: CellGrammar):
        d = re.escape(grammar.delimiters)
        self.delimiter = re.compile(f"[{d}]")
        self.boundary = re.compile(rf"[\s​﻿]*(?:[{d}]|$)")
        self.gap = re.compile(rf"[\s​﻿{d}]*")
        special = re.escape(grammar.delimiters + "".join(QUOTES) + "".join(BRACKETS))
        self.plain = re.compile(f"[^{special}]*")
        closers = re.escape("".join(QUOTES.values()))
        self.closing = re.compile(rf"[{closers}](?=[\s​﻿]*(?:[{d}]|$))")

    def parse(self, cell: str | None) -> Iterator[tuple[str, int, int, str | None]]:
        """(value, start, end, error) of each non-empty value."""
        if cell is None:
            return
        at, n = 0, len(cell)
        # what is looked up per cell once, so that malformed cells stay linear
        last_close = {m.group(): m.start() for m in self.closing.finditer(cell)} if any(c in cell for c in QUOTES) else {}
        pairs: dict[int, int] | None = None
        while True:
            at = self.gap.match(cell, at).end()
            if at >= n:
                return
            while m := _MARK.match(cell, at):
                at = m.end()
                if at < n and self.delimiter.match(cell, at):
                    break
            if at >= n:
                return
            error = None
            if cell[at] in QUOTES:
                if any(last_close.get(x, -1) > at for x in QUOTES[cell[at]]) and (found := self._quoted(cell, at)):
                    value, end = found
                    if value.strip():
                        yield value.strip(), at, end, None
                    at = end
                    continue
                error = "malformed_quote"
            if pairs is None:
                pairs = _pairs(cell)
            end, bad = self._bare(cell, at, pairs)
            value = cell[at:end]
            kept = value.strip(" ​﻿").strip()
            if kept:
                yield kept, at, at + len(value.rstrip()), error or bad
            at = max(end, at + 1) if end <= at else end

    def _quoted(self, cell: str, at: int) -> tuple[str, int] | None:
        close, n = QUOTES[cell[at]], len(cell)
        out, i = [], at + 1
        while i < n:
            c = cell[i]
            if c in close:
                if i + 1 < n and cell[i + 1] == c:
                    out.append(c)
                    i += 2
                    continue
                if self.boundary.match(cell, i + 1):
                    return "".join(out), i + 1
            out.append(c)
            i += 1
        return None

    def _bare(self, cell: str, at: int, pairs: dict[int, int]) -> tuple[int, str | None]:
        """End of the bare value at `at`, and what is malformed in it."""
        i, n, bad = at, len(cell), None
        while i < n:
            i = self.plain.match(cell, i).end()
            if i >= n:
                break
            c = cell[i]
            if self.delimiter.match(c):
                break
            if (c in BRACKETS or i > at) and i in pairs:
                i = pairs[i]
                continue
            if c in BRACKETS:
                bad = bad or "malformed_bracket"
            i += 1
        return i, bad


def _pairs(cell: str) -> dict[int, int]:
    """Position of each bracket or quotation mark that closes on its line -> past its end."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for m in _PAIRED.finditer(cell):
        c, i = m.group(), m.start()
        if c in "\r\n\t":
            open_.clear()
            continue
        opener = next((o for o in _OPENERS_OF.get(c, ()) if open_.get(o)), None)
        if opener is not None:
            out[open_[opener].pop()] = i + 1
        elif c in BRACKETS or c in QUOTES:
            open_.setdefault(c, []).append(i)
    return out


def split_cells(df: DataFrame, row_id: str, fields: dict[str, CellGrammar]) -> DataFrame:
    """Every value of the columns `fields` of `df`, one row each; see the module for the grammar."""
    names = list(fields)
    grammars = [fields[n] for n in names]

    def setup() -> list[CellParser]:
        return [CellParser(g) for g in grammars]

    def rows(parsers: list[CellParser], rid: int, *cells: str | None) -> Iterator[tuple]:
        for name, parser, cell in zip(names, parsers, cells):
            if cell:
                for pos, (value, a, b, error) in enumerate(parser.parse(cell), 1):
                    yield name, rid, pos, value, a, b, error

    packed = df.select(F.col(row_id).cast("long").alias("row_id"), *[F.col(n).cast("string").alias(n) for n in names])
    return map_rows(packed, rows, VALUE_SCHEMA, setup)
