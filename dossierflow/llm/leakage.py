"""Evaluation passages in training text, found with one Aho-Corasick automaton.

Texts are reduced to their letters and digits under case folding; markup, soft
hyphens, punctuation and spacing go, and word boundaries are kept beside. Any
run of n consecutive words of an item holds one of its aligned blocks of n/2
words whole, so the automaton has only these blocks. Each hit is extended in
both directions, letter by letter, and counts if n whole words agree; at a
hyphen at a line's end a word may go on or end. For scripts without spaces
the unit is the letter.

The items are a stated query set, held by the driver and by every Python
worker: one automaton over all of them scans each text once. Only a set of
more than SCAN_LETTERS letters is taken in several such scans, so that an
automaton fits in a worker; the rows are the same.

Edge cases: null or blank texts match nothing, nor do items with fewer than n
words; equal items under several ids are all reported; a passage that stands
twice in a document is reported twice; repeated documents are reported each; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.functions.arrowmap import map_rows, spread

LEAK_SCHEMA = "doc_id long, item_id long, passage_no int, n_units int, start_char int, end_char int"

#: Letters of items that one automaton takes, about 60 bytes each in a worker.
SCAN_LETTERS = 4_000_000
# a tag is sought up to the next angle bracket, so that stray ones cost no more than the text is long
_WORD = re.compile(r"[^\W_]+")
_SKIP = re.compile(r"</?[A-Za-z!][^<>]*>|&(?:[a-zA-Z]{2,8}|#\d{1,6}|#x[0-9a-fA-F]{1,6});|[­​‌‍⁠﻿]+|-[^\S\n]*\r?\n\s*")
_MARKUP = re.compile(r"</?[A-Za-z!][^<>]*>|&(?:[a-zA-Z]{2,8}|#\d{1,6}|#x[0-9a-fA-F]{1,6});")


def letters(text: str) -> str:
    """Letters and digits of a text, case folded, markup left out."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return "".join(_WORD.findall(text.casefold()))


class Stream:
    """Letters of a text with word boundaries and offsets in the text.

    `hard` holds the letter positions where a word surely starts, `soft` those
    where it may (behind a hyphen at a line's end, markup or a soft hyphen).
    """

    def __init__(self, text: str):
        parts: list[str] = []
        self.offsets: list[int] = []
        self.hard: set[int] = {0}
        self.soft: set[int] = set()
        n, at = 0, 0
        skips = [(m.start(), m.end()) for m in _SKIP.finditer(text)]
        skips.append((len(text), len(text)))
        pending = "hard"
        for a, b in skips:
            for m in _WORD.finditer(text, at, a):
                if m.start() > at:
                    pending = "hard"
                (self.hard if pending == "hard" else self.soft).add(n)
                for k, c in enumerate(m.group(), m.start()):
                    folded = "".join(x for x in c.casefold() if x.isalnum())
                    parts.append(folded)
                    self.offsets.extend([k] * len(folded))
                    n += len(folded)
                at, pending = m.end(), "hard"
            if at == a:
                pending = "soft" if n else "hard"
            at = b
        self.text = "".join(parts)
        self.hard.add(n)
        self.soft -= self.hard


def unit_starts(text: str, by_letter: bool) -> tuple[str, list[int]]:
    """Letters of an item and where its words (or letters) start, with the end."""
    parts, starts, n = [], [], 0
    for w in _WORD.findall(_SKIP.sub(lambda m: "" if m.group()[0] in "-­​‌‍⁠﻿" else " ", text).casefold()):
        starts.append(n)
        parts.append(w)
        n += len(w)
    s = "".join(parts)
    return s, list(range(n + 1)) if by_letter else [*starts, n]


class LeakIndex:
    """Automaton over the aligned half-length blocks of the items."""

    def __init__(self, items: list[tuple[int, str, bool]], n_words: int, n_letters: int):
        import ahocorasick

        self.items, self.need = [], []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text, by_letter in items:
            s, starts = unit_starts(text, by_letter)
            need = n_letters if by_letter else n_words
            if len(starts) - 1 < need:
                continue
            k = len(self.items)
            self.items.append((item_id, s, starts, by_letter))
            half = max(1, need // 2)
            for i in range(0, len(starts) - half, half):
                found.setdefault(s[starts[i] : starts[i + half]], []).append((k, starts[i]))
            self.need.append(need)
        self.automaton = ahocorasick.Automaton()
        for key, places in found.items():
            self.automaton.add_word(key, (len(key), places))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def leaks(self, text: str) -> dict[int, list[tuple[int, int, int]]]:
        """item_id -> (units, start, end) of every passage of it in the text, in order."""
        if self.empty:
            return {}
        hits = list(self.automaton.iter(letters(text)))
        if not hits:
            return {}
        stream = Stream(text)
        s, found, done = stream.text, {}, set()
        if s != letters(text):
            hits = list(self.automaton.iter(s))
        for last, (size, places) in hits:
            first = last - size + 1
            for k, at in places:
                item_id, t, starts, by_letter = self.items[k]
                shift = first - at
                if (k, shift, at) in done:
                    continue
                a, b = 0, size
                while first + a > 0 and at + a > 0 and s[first + a - 1] == t[at + a - 1]:
                    a -= 1
                while first + b < len(s) and at + b < len(t) and s[first + b] == t[at + b]:
                    b += 1
                lo, hi = at + a, at + b
                done.update((k, shift, x) for x in starts[bisect_left(starts, lo) : bisect_left(starts, hi)])
                for n, x, y in self._runs(stream, starts, shift, lo, hi, by_letter):
                    if n >= self.need[k]:
                        found.setdefault(item_id, set()).add((n, stream.offsets[x + shift], stream.offsets[y + shift - 1] + 1))
        return {item_id: sorted(v, key=lambda p: p[1:]) for item_id, v in found.items()}

    @staticmethod
    def _runs(stream: Stream, starts: list[int], shift: int, lo: int, hi: int, by_letter: bool) -> Iterator[tuple[int, int, int]]:
        """Runs of whole units in item letters [lo, hi) whose boundaries agree: (units, first letter, end)."""
        if by_letter:
            yield hi - lo, lo, hi
            return
        begun = None
        i = bisect_left(starts, lo)
        while i + 1 < len(starts) and starts[i + 1] <= hi:
            a, b = starts[i] + shift, starts[i + 1] + shift
            whole = (a in stream.hard or a in stream.soft) and (b in stream.hard or b in stream.soft) and not any(x in stream.hard for x in range(a + 1, b))
            if whole:
                begun = i if begun is None else begun
            elif begun is not None:
                yield i - begun, starts[begun], starts[i]
                begun = None
            i += 1
        if begun is not None:
            yield i - begun, starts[begun], starts[i]


_CACHE: dict[int, LeakIndex] = {}


def find_leaks(documents: DataFrame, items: DataFrame, n_words: int = 12, n_letters: int = 24, letter_langs: tuple[str, ...] = ("ja",), scan_letters: int = SCAN_LETTERS) -> DataFrame:
    """Every passage of n consecutive words or more of an item in a document: (doc_id, item_id, passage_no, n_units, start_char, end_char).

    Needs documents (doc_id, text) and items (item_id, lang, text). In items of
    `letter_langs` the unit is the letter.
    """
    docs = spread(documents).select(F.col("doc_id").cast("long"), "text").where(F.col("text").isNotNull())
    result, block, size = None, [], 0

    def scan(part: list[tuple[int, str, bool]]) -> DataFrame:
        part = list(part)

        def setup() -> LeakIndex:
            key = hash((tuple(part), n_words, n_letters))
            if key not in _CACHE:
                _CACHE.clear()
                _CACHE[key] = LeakIndex(part, n_words, n_letters)
            return _CACHE[key]

        def rows(index: LeakIndex, doc_id: int, text: str) -> Iterator[tuple]:
            for item_id, passages in index.leaks(text).items():
                for no, (n, a, b) in enumerate(passages, 1):
                    yield doc_id, item_id, no, n, a, b

        return map_rows(docs, rows, LEAK_SCHEMA, setup)

    for r in items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text", F.coalesce(F.lower("lang").isin(*letter_langs), F.lit(False)).alias("by_letter")).distinct().toLocalIterator():
        block.append((r["item_id"], r["text"], r["by_letter"]))
        size += len(r["text"])
        if size >= scan_letters:
            part = scan(block)
            result, block, size = part if result is None else result.unionAll(part), [], 0
    if block or result is None:
        part = scan(block)
        result = part if result is None else result.unionAll(part)
    return result


def leaked_items(passages: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the passages, once for each scanned document and item."""
    return passages.where(F.col("passage_no") == 1).select("doc_id", "item_id")
