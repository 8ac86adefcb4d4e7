"""Languages of documents and of their mixed-language segments.

Cross-parsing: a text is cut greedily into the longest phrases that occur in
the reference text of a language, found by walking that language's suffix
automaton; the language that needs the fewest phrases per letter wins.
Candidates are the languages whose labelled text is written in the text's
script. A text is parsed even where one language alone uses its script: how far
its phrases are from those of that language then gives the confidence.

The reference texts come from labelled documents: a sample, bounded per
language, spread by a hash over all documents with that label, whose
sentences are kept where a classifier trained on the rest of the sample agrees
with the label, so that wrong labels and mixed documents don't leak in.

A document is parsed in all candidates at once; one that falls behind is left
where it does. Sentences that the document's main language explains throughout
are settled by that; all others are classified one by one, and those without
enough letters take the language of their neighbours. A document's language is that of most of its
letters. All documents are classified, whole texts. The confidence of a
sentence is its lead over the second language, in parts of the lead at which
that one is no longer followed; of a segment, the mean over its letters.

Edge cases: null and blank texts get no row; a text without letters gets its
label's language, or `und`, with confidence 0; an empty table gives an empty
result; repeated rows are classified each.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.functions.arrowmap import map_rows, spread
from dossierflow.llm.sentences import sentence_spans

SEGMENT_SCHEMA = "doc_id long, label string, doc_lang string, doc_confidence double, n_segments int, seg_no int, seg_start int, seg_end int, seg_lang string, seg_confidence double"

#: Notations of the languages' labels (fixed values: ISO 639 codes and names).
NOTATIONS = {
    "en": "en eng english anglais englisch",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
    "it": "it ita italian italiano",
    "pt": "pt por portuguese português portugues",
    "nl": "nl nld dut dutch nederlands",
    "ru": "ru rus russian русский",
    "el": "el ell gre gr greek ελληνικά",
    "ja": "ja jpn jp japanese 日本語",
    "zh": "zh zho chi cn chinese 中文",
    "th": "th tha thai ไทย",
    "hi": "hi hin hindi हिन्दी",
}
_RANGES = {"latin": "A-Za-zÀ-ÖØ-öø-ɏ", "cyrillic": "Ѐ-ԯ", "greek": "Ͱ-Ͽἀ-῿", "kana": "ぁ-ゖァ-ヺー", "han": "一-鿿㐀-䶿", "thai": "ก-๎", "devanagari": "ऀ-ॿ"}
_SCRIPT = {k: re.compile(f"[{r}]") for k, r in _RANGES.items()}
#: A character of these scripts stands for so many letters of an alphabet.
_WEIGHT = {"kana": 2.5, "han": 2.5}
#: Share of a language's letters from which a script beside its main one counts as its own.
MIN_SHARE = 0.2

#: Bounds of the sample: documents and letters per language, letters of reference text, and the longest text it takes.
SAMPLE_DOCS, SAMPLE_LETTERS, REFERENCE_LETTERS, SAMPLE_TEXT = 250, 150_000, 30_000, 20_000
MIN_LETTERS = 8
#: A sentence goes to its document's main language if that needs at most so many times the fewest phrases.
NEAR = 1.3
FAR = 1.4
#: Grams of a stretch looked at on its own when the sample is cleaned, and how much better (in nats) another language may explain it.
STRETCH, MARGIN = 24, 25.0
#: Letters that each side of a cut inside a sentence needs, and phrases per letter from which one is looked for.
MIN_PART, ODD_RATE = 20, 0.13
#: Characters looked at on either side of a cut, and the share of the phrases that a cut may leave.
CONTEXT, MIN_GAIN = 400, 0.7
#: Phrases that a change of language inside a sentence must save to be tried.
CHANGE = 2
#: Letters between two comparisons of the languages of a document, and phrases beyond FAR times the fewest by which one may be behind.
STEP, SLACK = 32, 1
#: Stands between the pieces of a sentence while their letters are taken out.
_CUT = "\x01"

_MARKUP = re.compile(r"</?[A-Za-z!][^<>]*>|&[a-zA-Z]{2,8};")
_BLOCK_TAG = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|blockquote)\b", re.IGNORECASE)
_BREAK = re.compile(r"(?<=\w)-\s*\n\s*(?=\w)")
_CODE = re.compile(r"\b[A-Z]{2,4}\d? (?=\d)|https?://\S+|(?<![A-Za-z0-9.,()/:%+\-])[A-Za-z.,()/:%+\-]*[0-9][A-Za-z0-9.,()/:%+\-]*")
#: Places where a sentence may begin unmarked: before a capital or a letter of a script without case.
_TURN = re.compile(r"\s+(?=[^\W\d_a-zß-öø-ÿα-ωά-ώа-яё])|\s+(?=[\"“„«¿¡(\d])|(?<=[ぁ-ヺ一-鿿ก-๎])\s*(?=[A-Z])")
_LIST_NUMBER = re.compile(r"\(?\d{1,3}[.)]\s")
_ACCENTS = re.compile("[\u0300-\u036f]+")
_INDIC = re.compile("[\u0900-\u0e7f]")
_NON_LETTER_INDIC = re.compile("[^\\w\u0900-\u0e7f]+|[\\d_]+")
_FOREIGN = re.compile("[\u0370-\u052f\u0900-\u097f\u0e00-\u0e7f\u1f00-\u1fff\u3040-\u30ff\u3400-\u9fff]")
_NON_LETTER = re.compile(r"[\W\d_]+")
_DIGIT = re.compile(r"\d")
_ASCII = {i: chr(i).lower() if chr(i).isalpha() or i == 1 else " " for i in range(128)}


def label_language(c: Column) -> Column:
    """Two-letter code that a label names, or null."""
    pairs = [x for code, words in NOTATIONS.items() for w in words.split() for x in (F.lit(w), F.lit(code))]
    base = F.element_at(F.split(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), "[-_]"), 1)
    return F.try_element_at(F.create_map(*pairs), base)


def without_markup(text: str) -> str:
    """The text with tags blanked, every character in its place; a block's tag stands for a blank line."""
    if "<" not in text:
        return text
    return _MARKUP.sub(lambda m: ("\n\n" if len(m.group()) > 2 and _BLOCK_TAG.match(m.group()) else "").ljust(len(m.group())), text)


def plain(text: str) -> str:
    """Letters of a text as parsed: markup, codes and digits out, accents folded, words one space apart."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    if "-" in text and "\n" in text:
        text = _BREAK.sub("", text)
    # every code holds a digit or an address
    if _DIGIT.search(text) or "http" in text:
        text = _CODE.sub(" ", text)
    if text.isascii():
        return " ".join(text.translate(_ASCII).replace(_CUT, " ").split())
    folded = _ACCENTS.sub("", unicodedata.normalize("NFD", text)).casefold()
    return " ".join((_NON_LETTER_INDIC if _INDIC.search(folded) else _NON_LETTER).sub(" ", folded).split())


def plain_pieces(pieces: list[str]) -> list[str]:
    """`plain` of the pieces of a sentence."""
    text = _CUT.join(pieces)
    if len(pieces) == 1 or not text.isascii() or text.count(_CUT) >= len(pieces) or "<" in text or "&" in text:
        return [plain(p) for p in pieces]
    if "-" in text and "\n" in text:
        text = _BREAK.sub("", text)
    if _DIGIT.search(text) or "http" in text:
        text = _CODE.sub(" ", text)
    out = [" ".join(p.split()) for p in text.translate(_ASCII).split(_CUT)]
    return out if len(out) == len(pieces) else [plain(p) for p in pieces]


def script_of(text: str) -> tuple[str, float]:
    """Script of most letters and its share; kana makes a han text Japanese."""
    if text.isascii():
        return ("latin", 1.0) if _SCRIPT["latin"].search(text) else ("", 0.0)
    if not _FOREIGN.search(text):
        return ("latin", 1.0) if _SCRIPT["latin"].search(text) else ("", 0.0)
    n = {k: len(p.findall(text)) * _WEIGHT.get(k, 1.0) for k, p in _SCRIPT.items()}
    if n["kana"] >= 0.05 * n["han"] and n["kana"] > 0 and n["kana"] + n["han"] > n["latin"] * 0.25:
        return "kana", (n["kana"] + n["han"]) / sum(n.values())
    if n["han"] > n["latin"] * 0.25 and n["han"] > 0:
        return "han", n["han"] / sum(n.values())
    # names and codes in Latin letters stand in texts of every script
    best = max((k for k in n if k != "latin"), key=lambda k: n[k])
    total = sum(n.values())
    if not total:
        return "", 0.0
    if n[best] > 0.4 * n["latin"]:
        return best, n[best] / total
    return "latin", n["latin"] / total


class SuffixAutomaton:
    """All substrings of a text; only transitions are kept after building."""

    __slots__ = ("root",)

    def __init__(self, text: str):
        nxt: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        # states point at each other, so that a step is one lookup
        for d in nxt:
            for c, to in d.items():
                d[c] = nxt[to]
        self.root = nxt[0]

    def phrases(self, text: str, most: int = 1 << 60) -> int:
        """Greedy longest phrases of `text`, an unknown character being one of its own; stops beyond `most`."""
        root = at = self.root
        count = 0
        for c in text:
            to = at.get(c)
            if to is None:
                count += 1
                if count > most:
                    return count
                if at is not root:
                    to = root.get(c)
                    if to is None:
                        count += 1
                        to = root
                else:
                    to = root
            at = to
        return count + (at is not root)

    def walk(self, at: dict, text: str) -> tuple[dict, int]:
        """The state behind `text` from the state `at`, and the phrases completed on the way."""
        root, count = self.root, 0
        for c in text:
            to = at.get(c)
            if to is None:
                count += at is not root
                to = root.get(c)
                if to is None:
                    count += 1
                    to = root
            at = to
        return at, count

    def ends(self, pieces: list[str]) -> list[int]:
        """Phrases completed before the first piece and by the end of each, in one walk over all."""
        root, count, out = self.root, 0, [0]
        at = root.get(" ", root)
        for piece in pieces:
            for c in f"{piece} " if piece else "":
                to = at.get(c)
                if to is None:
                    count += at is not root
                    to = root.get(c)
                    if to is None:
                        count += 1
                        to = root
                at = to
            out.append(count)
        return out


@dataclass
class LanguageModel:
    """Reference text by language, the languages of each script, and by language the phrases per letter of its own text and of text that is none.

    Automata are built once per process.
    """

    references: dict[str, str]
    scripts: dict[str, tuple[str, ...]]
    rates: dict[str, tuple[float, float]]

    def automata(self) -> dict[str, SuffixAutomaton]:
        key = hashlib.sha1(repr(sorted(self.references.items())).encode()).hexdigest()
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = {k: SuffixAutomaton(v) for k, v in self.references.items()}
        return _BUILT[key]


_BUILT: dict[str, dict[str, SuffixAutomaton]] = {}


class Classifier:
    def __init__(self, model: LanguageModel):
        self.model, self.automata, self.hint = model, model.automata(), None

    def scores(self, text: str) -> tuple[dict[str, float], int]:
        """Phrases per letter by candidate language, and the letters they stand for; {} if there are too few."""
        script, _ = script_of(text)
        names = self.model.scripts.get(script, ())
        if not names:
            return {}, 0
        letters = plain(text)
        size = int(len(letters) * _WEIGHT.get(script, 1.0))
        if size < MIN_LETTERS:
            return {}, 0
        padded, best, counts = f" {letters} ", None, {}
        # a language that needs FAR times the fewest phrases so far is not followed further
        for x in sorted(names, key=lambda x: x != self.hint):
            n = self.automata[x].phrases(padded, 1 << 60 if best is None else FAR * best + 1)
            best = n if best is None else min(best, n)
            counts[x] = n / size
        self.hint = min(counts, key=counts.get)
        return counts, size

    def settled(self, text: str, spans: list[tuple[int, int]], hint: str | None) -> dict[int, tuple[dict[str, float], int]]:
        """The sentences (by number) that the document's main language explains throughout, with their scores.

        All sentences in the script of most letters are parsed as one stream,
        in every candidate. A language is left as soon as it needs FAR times
        the phrases of the best one, and SLACK more, up to the same place. A
        sentence is settled if it has enough letters, and neither it nor a
        stretch of it between turns is odd in the main language.
        """
        parts, weight = [], {}
        for k, (a, b) in enumerate(spans):
            sentence = text[a:b]
            script, _ = script_of(sentence)
            if script not in self.model.scripts:
                continue
            pieces = plain_pieces([sentence[i:j] for i, j in zip(*self._turns(sentence))])
            size = sum(map(len, pieces))
            weight[script] = weight.get(script, 0) + size
            parts.append((k, script, pieces, size))
        if not weight:
            return {}
        script = max(weight, key=weight.get)
        alone = len(self.model.scripts[script]) == 1
        parts = [p for p in parts if p[1] == script]
        stream, at, marks = [], 0, []  # marks: where pieces end in the stream
        for _, _, pieces, _ in parts:
            for p in pieces:
                if p:
                    stream.append(p)
                    at += len(p) + 1
                marks.append(at)
        stream = "".join(f"{p} " for p in stream)
        steps = sorted({*marks, *range(STEP, len(stream), STEP), len(stream)} - {0})
        names, at = list(self.model.scripts[script]), min(1, len(steps))
        # the start of the text tells which language is followed first, and which are left at once
        begun = {x: self._follow(x, stream, steps[:at]) for x in names}
        names.sort(key=lambda x: begun[x][1][-1:])
        main, least, second = None, None, None
        for x in names:
            sums = self._follow(x, stream, steps, begun[x], least)[1]
            if len(sums) < len(steps):
                continue
            if least is None or sums[-1] < least[-1]:
                main, least, second = x, sums, main and (main, least[-1])
            elif second is None or sums[-1] < second[1]:
                second = x, sums[-1]
        # where another language is near, every sentence is looked at
        if second and second[1] < NEAR * least[-1]:
            return {}
        sums = {0: 0, **dict(zip(steps, least))}
        lead = second[1] / sums[len(stream)] if second and sums.get(len(stream)) else FAR
        factor, out, m = _WEIGHT.get(script, 1.0), {}, 0
        for k, _, pieces, size in parts:
            ends = [marks[m - 1] if m else 0, *marks[m : m + len(pieces)]]
            m += len(pieces)
            if int(size * factor) < 2 * MIN_PART:
                continue
            counts = [sums[e] for e in ends]
            rate = (counts[-1] - counts[0]) / (size * factor)
            if _mixed_scripts(text[spans[k][0] : spans[k][1]]) or not alone and (rate > ODD_RATE or _odd(counts, [0, *accumulate(factor * len(p) for p in pieces)])):
                continue
            out[k] = {main: rate, **({second[0]: rate * lead} if second else {x: rate * FAR for x in self.model.scripts[script] if x != main})}, int(size * factor)
        return out

    def _follow(self, name: str, stream: str, steps: list[int], begun: tuple[dict, list[int]] | None = None, least: list[int] | None = None) -> tuple[dict, list[int]]:
        """The parse's state and its phrases up to each step; fewer than all steps if the language falls behind `least`."""
        automaton = self.automata[name]
        state, sums = (begun[0], list(begun[1])) if begun else (automaton.root.get(" ", automaton.root), [])
        n, i = (sums[-1], steps[len(sums) - 1]) if sums else (0, 0)
        if least is not None and sums and n > FAR * least[len(sums) - 1] + SLACK:
            return state, sums[:-1]
        for m in range(len(sums), len(steps)):
            state, more = automaton.walk(state, stream[i : steps[m]])
            i, n = steps[m], n + more
            if least is not None and n > FAR * least[m] + SLACK:
                break
            sums.append(n)
        return state, sums

    def _turns(self, part: str) -> tuple[list[int], list[int]]:
        """Starts and stops of the stretches of a sentence between places where another may begin unmarked."""
        coded = "http" in part or _DIGIT.search(part)
        turns = [m.span() for m in _TURN.finditer(part) if not (coded and self._is_code(part, m.end()))]
        return [0, *(j for _, j in turns)], [*(i for i, _ in turns), len(part)]

    def refined(self, text: str, a: int, b: int) -> list[tuple[int, int, dict[str, float], int]]:
        """The span with its scores, cut where sentences of two languages follow each other without a mark."""
        out, todo = [], [(a, b)]
        while todo:
            a, b = todo.pop()
            counts, size = self.scores(text[a:b])
            turn = self._turn(text[a:b], counts, size) if counts and size >= 2 * MIN_PART else None
            if turn is None:
                cuts = self._changes(text[a:b], counts) if len(counts) > 1 and size >= 2 * MIN_PART else []
                if not cuts:
                    out.append((a, b, counts, size))
                for i, j in zip([0, *(j for _, j in cuts)], [*(i for i, _ in cuts), b - a]) if cuts else ():
                    out.append((a + i, a + j, *self.scores(text[a + i : a + j])))
            else:
                todo += [(a + turn[1], b), (a, a + turn[0])]
        return out

    def _turn(self, part: str, counts: dict[str, float], size: int) -> tuple[int, int] | None:
        """End and start of the languages' sentences at the best place to cut, if the part is odd enough to hold one.

        A place is judged by up to CONTEXT characters on either side.
        """
        if (len(counts) == 1 or min(counts.values()) <= ODD_RATE) and not _mixed_scripts(part):
            return None
        best = None
        for m in _TURN.finditer(part):
            i, j = m.span()
            if self._is_code(part, j):
                continue
            lo, hi = max(0, i - CONTEXT), min(len(part), j + CONTEXT)
            left, n = self.scores(part[lo:i])
            right, k = self.scores(part[j:hi])
            if n < MIN_PART or k < MIN_PART or not left or not right or min(left, key=left.get) == min(right, key=right.get):
                continue
            whole = self._cost(counts, size) if hi - lo == len(part) else self._cost(*self.scores(part[lo:hi]))
            ratio = (self._cost(left, n) + self._cost(right, k)) / whole
            if ratio <= MIN_GAIN and (best is None or ratio < best[0]):
                best = (ratio, i, j)
        return best and best[1:]

    def _changes(self, part: str, counts: dict[str, float]) -> list[tuple[int, int]]:
        """Ends and starts around sentences of another language, however much text of the main one surrounds them.

        The cheapest parsing of the part whose language may change at any turn
        names the stretches. A cut between two is judged by as much text on
        either side as the shorter of them has.
        """
        main = min(counts, key=counts.get)
        starts, stops = self._turns(part)
        if len(starts) == 1:
            return []
        pieces = [plain(part[i:j]) for i, j in zip(starts, stops)]
        own = self.automata[main].ends(pieces)
        if not _odd(own, [0, *accumulate(map(len, pieces))]):
            return []
        names = list(counts)
        walked = [own if x == main else self.automata[x].ends(pieces) for x in names]
        least, back = [0.0] * len(names), []
        for n in range(len(pieces)):
            best = min(range(len(names)), key=least.__getitem__)
            back.append([x if v <= least[best] + CHANGE else best for x, v in enumerate(least)])
            least = [least[y] + CHANGE * (y != x) + walked[x][n + 1] - walked[x][n] for x, y in enumerate(back[-1])]
        x, edges = min(range(len(names)), key=least.__getitem__), [len(pieces)]
        for n in range(len(pieces) - 1, -1, -1):
            if back[n][x] != x and n:
                edges.append(n)
            x = back[n][x]
        edges = [0, *reversed(edges)]
        cuts = []
        for a, n, b in zip(edges, edges[1:], edges[2:]):
            i, j = stops[n - 1], starts[n]
            near = min(CONTEXT, i - starts[a], stops[b - 1] - j)
            (left, k), (right, m) = self.scores(part[i - near : i]), self.scores(part[j : j + near])
            if k < MIN_PART or m < MIN_PART or min(left, key=left.get) == min(right, key=right.get):
                continue
            if self._cost(left, k) + self._cost(right, m) <= MIN_GAIN * self._cost(*self.scores(part[i - near : j + near])):
                cuts.append((i, j))
        return cuts

    @staticmethod
    def _is_code(part: str, at: int) -> bool:
        code = _CODE.match(part, at)
        return bool(code) and not _LIST_NUMBER.match(part, at) and code.end() > at + 2

    def _likeness(self, name: str, rate: float) -> float:
        """Confidence where a script has one language only: 1 for its usual phrases per letter, 0 for those of text that is none."""
        own, none = self.model.rates[name]
        return min(1.0, max(0.0, (none - rate) / (none - own))) if none > own else 0.0

    @staticmethod
    def _cost(counts: dict[str, float], size: int) -> float:
        return max(min(counts.values()), 0.01) * size

    def segments(self, text: str, hint: str | None = None) -> list[tuple[int, int, str | None, float, int]]:
        """Runs of sentences in one language: (start, end, language, confidence, letters).

        A sentence that the document's main language, or a neighbour's, explains
        nearly as well as the best one belongs to that language. `hint` is the
        language tried first.
        """
        text = without_markup(text)
        spans = sentence_spans(text)
        known = self.settled(text, spans, hint)
        self.hint = None
        scored = [x for k, (a, b) in enumerate(spans) for x in ([(a, b, *known[k])] if k in known else self.refined(text, a, b))]
        weight: dict[str, int] = {}
        for _, _, counts, size in scored:
            if counts:
                best = min(counts, key=counts.get)
                weight[best] = weight.get(best, 0) + size
        main = max(weight, key=weight.get) if weight else None
        best_of = [min(c, key=c.get) if c else None for _, _, c, _ in scored]
        runs: list[list] = []
        for k, (a, b, counts, w) in enumerate(scored):
            if not counts:
                if runs:
                    runs[-1][1] = b
                else:
                    runs.append([a, b, None, 0.0, 0])
                continue
            name = best_of[k]
            around = (main, runs[-1][2] if runs else None, best_of[k + 1] if k + 1 < len(scored) else None)
            if name != main:
                name = next((x for x in around if x in counts and counts[x] <= NEAR * counts[name]), name)
            second = min((c for x, c in counts.items() if x != name), default=None)
            conf = self._likeness(name, counts[name]) if second is None else min(1.0, max(0.0, (second - counts[name]) / ((FAR - 1) * counts[name]))) if counts[name] else 1.0
            if runs and runs[-1][2] in (name, None):
                r = runs[-1]
                r[3] = (r[3] * r[4] + conf * w) / (r[4] + w)
                r[1], r[2], r[4] = b, name, r[4] + w
            else:
                runs.append([a, b, name, conf, w])
        return [tuple(r) for r in runs]


def _mixed_scripts(part: str) -> bool:
    """Whether two scripts have letters enough for a sentence each."""
    if part.isascii() or not _FOREIGN.search(part):
        return False
    return len({"han" if k == "kana" else k for k, p in _SCRIPT.items() if len(p.findall(part)) * _WEIGHT.get(k, 1.0) >= MIN_PART}) > 1


def _odd(counts: list[int], sizes: list[float]) -> bool:
    """Whether some stretch of MIN_PART letters or a little more needs more than ODD_RATE phrases a letter; both lists are running sums."""
    k = 0
    for n in range(1, len(sizes)):
        while sizes[n] - sizes[k + 1] >= MIN_PART:
            k += 1
        if sizes[n] - sizes[k] >= MIN_PART and counts[n] - counts[k] > ODD_RATE * (sizes[n] - sizes[k]):
            return True
    return False


def _grams(s: str) -> list[str]:
    s = f" {s} "
    return [s[i : i + 4] for i in range(len(s) - 3)]


def clean_sample(rows: list[tuple[str, str]], rounds: int = 4) -> dict[str, list[str]]:
    """Sentences by language from labelled texts, without those that another language explains better."""
    main = {x: max(own, key=own.get) for x, own in sample_scripts(rows).items()}
    sentences: list[tuple[str, str]] = []
    for lang, text in rows:
        for a, b in sentence_spans(text):
            s = text[a:b]
            if script_of(s)[0] == main.get(lang) and len(p := plain(s)) >= MIN_LETTERS:
                sentences.append((lang, p))
    names = sorted({x for x, _ in sentences})
    # a sentence found under several labels belongs to the one that has it most often for its size
    size_of = Counter(x for x, _ in sentences)
    often = Counter(sentences)
    owner: dict[str, str] = {}
    for (x, s), n in sorted(often.items()):
        if s not in owner or n / size_of[x] > often[owner[s], s] / size_of[owner[s]]:
            owner[s] = x
    kept = [(x, s) for s, x in owner.items()]
    groups: dict[str, list[str]] = {}
    for x in names:
        groups.setdefault(main[x], []).append(x)
    return _by_language(names, [k for group in groups.values() for k in _consistent([(x, s) for x, s in kept if x in group], often, group, rounds)])


def sample_scripts(rows: list[tuple[str, str]]) -> dict[str, dict[str, float]]:
    """Letters by language and script of the sentences' scripts."""
    out: dict[str, dict[str, float]] = {}
    for lang, text in rows:
        for a, b in sentence_spans(text):
            if script := script_of(text[a:b])[0]:
                own = out.setdefault(lang, {})
                own[script] = own.get(script, 0) + b - a
    return out


def candidate_scripts(references: dict[str, str]) -> dict[str, tuple[str, ...]]:
    """Languages by script: a language's main script, and any other that has MIN_SHARE of its reference's letters."""
    shares: dict[str, list[tuple[float, str]]] = {}
    for x, text in references.items():
        n = {k: len(p.findall(text)) for k, p in _SCRIPT.items()}
        total = sum(n.values())
        for k in n:
            # kana stands for any text that holds some
            if total and (n[k] >= MIN_SHARE * total or k == "kana" and n[k] >= 0.05 * total):
                shares.setdefault(k, []).append((-round(n[k] / total, 1), x))
    return {k: tuple(x for _, x in sorted(own)) for k, own in shares.items()}


def phrase_rates(references: dict[str, str]) -> dict[str, tuple[float, float]]:
    """By language the phrases per letter of one half of its text in the other, and of the same letters read backwards."""
    out = {}
    for x, text in references.items():
        half = len(text) // 2
        first, rest = SuffixAutomaton(text[:half]), text[half:]
        size = max(1.0, len(rest) * max((_WEIGHT.get(k, 1.0) for k, p in _SCRIPT.items() if p.search(rest)), default=1.0))
        out[x] = first.phrases(rest) / size, first.phrases(rest[::-1]) / size
    return out


def _consistent(kept: list[tuple[str, str]], often: Counter, names: list[str], rounds: int) -> list[tuple[str, str]]:
    """Sentences that no other language's four-letter grams explain better; repeated, as the counts get cleaner.

    A stretch of a sentence that another language explains much better drops it
    too: it may be two sentences with a lost mark between them. One occurrence of a sentence doesn't speak for its own label, and an unseen
    gram costs the same in every language.
    """
    if len(names) < 2 or not kept:
        return kept
    number: dict[str, int] = {}
    parts = [np.array([number.setdefault(g, len(number)) for g in _grams(s)]) for _, s in kept]
    label = np.array([names.index(x) for x, _ in kept])
    times = np.array([often[k] for k in kept], dtype=float)
    alive = np.ones(len(kept), bool)
    for _ in range(rounds):
        who = np.flatnonzero(alive)
        flat = np.concatenate([parts[i] for i in who])
        sizes = np.array([len(parts[i]) for i in who])
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        # stretches of STRETCH grams, within sentences
        cuts = np.unique(np.r_[starts, np.concatenate([np.arange(a, a + n - STRETCH // 2, STRETCH) for a, n in zip(starts, sizes)] or [[]])]).astype(int)
        owner = np.searchsorted(starts, cuts, side="right") - 1
        parts_of = np.empty((len(names), len(cuts)))
        of, weight = np.repeat(label[who], sizes), np.repeat(times[who], sizes)
        scores = np.empty((len(names), len(who)))
        for x in range(len(names)):
            c = np.bincount(flat[of == x], weights=weight[of == x], minlength=len(number))
            n = c.sum() + 1
            every, own = np.log(c / n + 1e-5), np.log(np.maximum(c - 1, 0) / n + 1e-5)
            scores[x] = np.where(label[who] == x, np.add.reduceat(own[flat], starts) + 1e-9, np.add.reduceat(every[flat], starts))
            parts_of[x] = np.where(label[who][owner] == x, np.add.reduceat(own[flat], cuts), np.add.reduceat(every[flat], cuts))
        left = scores.argmax(axis=0) == label[who]
        foreign = parts_of.max(axis=0) - parts_of[label[who][owner], np.arange(len(cuts))] > MARGIN
        left &= np.bincount(owner[foreign], minlength=len(who)) == 0
        if left.all():
            break
        alive[who[~left]] = False
    return [k for k, a in zip(kept, alive) if a]


def _by_language(names: list[str], kept: list[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {x: [] for x in names}
    for x, s in kept:
        out[x].append(s)
    return out


def train(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_letters: int = SAMPLE_LETTERS, reference_letters: int = REFERENCE_LETTERS) -> LanguageModel:
    """Fits the reference texts on a sample of at most about `sample_docs` documents per language.

    Counts by label cover all documents; the share taken of each language
    follows from them, and a hash of the id decides which documents.
    """
    labelled = documents.select("doc_id", "text", label_language(F.col("lang")).alias("l")).where("l is not null and text is not null")
    counts = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel({}, {}, {})
    take = F.lit(0.0)
    for name, n in counts.items():
        take = F.when(F.col("l") == name, min(1.0, sample_docs / n)).otherwise(take)
    hashed = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1_000_000))
    sample = labelled.where(hashed < take * 1_000_000).where(F.char_length("text") <= SAMPLE_TEXT).select("l", "text", "doc_id")
    got: dict[str, int] = {}
    rows = []
    for r in sorted(sample.limit(len(counts) * sample_docs * 2).collect(), key=lambda r: (r["l"], r["doc_id"])):
        if got.get(r["l"], 0) < sample_letters:
            rows.append((r["l"], r["text"]))
            got[r["l"]] = got.get(r["l"], 0) + len(r["text"])
    return build_model(clean_sample(rows), reference_letters)


def build_model(sentences: dict[str, list[str]], reference_letters: int = REFERENCE_LETTERS) -> LanguageModel:
    """Reference texts of up to `reference_letters`, in an order given by a hash.

    A sentence that brings hardly anything new is left out, so that the
    reference covers the language rather than its commonest phrases.
    """
    references = {}
    for name, own in sentences.items():
        text, size, known = [], 0, set()
        for s in sorted(own, key=lambda s: hashlib.sha1(s.encode()).digest()):
            grams = set(_grams(s))
            if len(grams - known) < 0.1 * len(grams):
                continue
            known |= grams
            text.append(s)
            size += len(s)
            if size >= reference_letters:
                break
        if text:
            references[name] = " " + "  ".join(text) + " "
    return language_model(references)


def language_model(references: dict[str, str]) -> LanguageModel:
    return LanguageModel(references, candidate_scripts(references), phrase_rates(references))


def classify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per segment of every document, with the document's language; see SEGMENT_SCHEMA."""

    def rows(c: Classifier, doc_id: int, label: str | None, text: str) -> Iterator[tuple]:
        segments = c.segments(text, label)
        known = [s for s in segments if s[2]]
        if not known:
            yield doc_id, label, label or "und", 0.0, 1, 1, 0, len(text), label or "und", 0.0
            return
        weight: dict[str, float] = {}
        for s in known:
            weight[s[2]] = weight.get(s[2], 0) + s[4]
        main = max(weight, key=weight.get)
        conf = sum(s[3] * s[4] for s in known if s[2] == main) / weight[main]
        for k, (a, b, name, seg_conf, _) in enumerate(known, 1):
            yield doc_id, label, main, conf, len(known), k, a, b, name, seg_conf

    packed = spread(documents).select(F.col("doc_id").cast("long"), label_language(F.col("lang")).alias("label"), "text").where(F.col("text").isNotNull() & F.col("text").rlike(r"(?U)\S"))
    return map_rows(packed, rows, SEGMENT_SCHEMA, lambda: Classifier(model))


def mislabelled(segments: DataFrame) -> DataFrame:
    """(doc_id, seg_start, seg_lang): the runs of mixed documents, and of the others those with a missing or wrong label."""
    mixed = F.col("n_segments") > 1
    wanted = segments.where(mixed | F.col("label").isNull() | (F.col("label") != F.col("doc_lang")))
    return wanted.select("doc_id", F.when(mixed, F.col("seg_start")).otherwise(0).alias("seg_start"), F.when(mixed, F.col("seg_lang")).otherwise(F.col("doc_lang")).alias("seg_lang"))
