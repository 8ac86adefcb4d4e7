"""Sentence boundaries over many languages and scripts.

A pushdown automaton walks the marks of a text: list marks, end marks,
quotation marks, brackets and, in Thai, spaces. At the bottom of its stack are
the list levels that are open, each with the kind and number of its last mark:
the first mark of a kind opens a level, the next number goes on with it, and a
mark of an outer level closes those inside. Above them are the quotations and
brackets that are open and do close within the paragraph; an end mark counts
only while there are none, or when the quotation it stands in closes and the
text goes on like a new sentence. List marks at a sentence's start belong to
it; one in order starts a sentence even where its text is in lower case. Words
before a full stop are looked up in a trie of abbreviations, read backwards.

Offsets are in code points. Edge cases: null and blank texts give no sentence;
a text without marks is one sentence; a blank line always ends one; quotations
that never close are ignored; an empty table gives an empty table; repeated
rows give repeated sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.functions.arrowmap import map_rows, spread

SPAN_SCHEMA = "src_table string, row_id long, start_char int, end_char int"

#: Abbreviations that don't end a sentence (fixed values, written without their last stop and without spaces).
NONFINAL = """
approx cf e.g i.e viz vs incl excl resp fig figs no nos vol vols p pp sec sect secs ch chap para paras app rev ref refs st dr mr mrs ms prof dept eq ed eds ext tel op cit cl subpt amdt
z.b d.h u.u i.d.r i.a z.t o.g s vgl abb tab gem art abs ziff nr nrn kap anh bzw bspw evtl ggf inkl exkl mind max sog hr bzgl lt zzgl abt anm aufl bd hrsg allg einschl ca
p.ex ex env art arts n v chap ann al av m mme mlle réf éd
p.ej ej aprox núm núms pág págs párr sr sra srta ap apdo
ad.es es cfr artt pag pagg sig dott ing cap lett
bijv o.a afb blz d.w.z m.b.t t.o.v i.p.v dhr mevr m.n
т.е т.к см рис ст п пп гл ок стр табл напр разд прил абз ул им
π.χ βλ σχ άρθ δηλ σελ παρ κεφ αρ εικ πίν
""".split()
#: Abbreviations that end a sentence if the next word starts one (fixed values).
EITHER = "etc usw ecc enz u.s u.k u.n e.u a.m p.m ltd inc co corp ff jr o.ä u.ä u.a u.dgl т.д т.п др пр ч κ.λπ κ.ά".split()
#: Abbreviations that need a number behind them, being words as well (fixed values).
NUMBERED = frozenset("no nos art ex al es op ed ch app cap max co lt st ing m n p s v п ст".split())

#: Words before a German ordinal number (fixed values).
ORDINAL_BEFORE = frozenset("am im zum vom beim dem den der des das die ab bis seit jeden jedem jeder dieser diesem".split())

OPENERS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "“": "”“", "„": "“”", "«": "»", "»": "«", "‹": "›", "「": "」", "『": "』", "‘": "’", "‚": "‘’", '"': '"'}
CLOSERS = frozenset(")]}）】”“»«›」』’‘\"")
BRACKET_CLOSERS = frozenset(")]}）】")
_CJK_MARKS = "。！？｡"
_EVENT = re.compile("[.!?…]+|[。！？｡।॥؟۔]+|[;;]|[\"“”„«»‹›「」『』‘’‚()\\[\\]{}（）【】]|(?<=[ก-ฺเ-๎])\\s+(?=[ก-ฮเ-ๆ])")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*|\r\n[^\S\n]*\r\n\s*|[ \f]\s*")
_WS = re.compile(r"\s*")
_LIST_ONLY = re.compile(r"^\W*(?:[^\x00-\x7f]\s+)?[(]?(?:\d{1,3}|[^\W\d_]|[ivxlcIVXLC]{1,5})[.)]*$")
_LIST_MARK = re.compile(r"\(?(?:\d{1,3}|[a-zA-Z]|[ivxlc]{1,5})[.)]\s")
_PAREN_MARK = re.compile(r"\((?:\d{1,3}|[a-z]|[ivxlc]{1,5})\)\s")
_LAST_WORD = re.compile(r"(\S+)\s+\S*$")
_WORD = re.compile(r"[^\W\d_]+")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_CJK_CONTINUES = "，、；：,.;:とのをがにはもでやへなだ。！？）)"


_MARK = re.compile(r"\(?(\d{1,3}|[a-zA-Z]|[ivxlc]{2,5}|[IVXLC]{2,5})([.)])\s")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def roman(numeral: str) -> int | None:
    """Value of a lower-case roman numeral, or null if it is none."""
    values = [_ROMAN.get(c, 0) for c in numeral]
    n = sum(-v if v < max(values[i + 1 :], default=0) else v for i, v in enumerate(values))
    tens, ones = divmod(n, 10)
    made = ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc")[tens] + ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")[ones] if 0 < n < 100 else ""
    return n if made == numeral else None


class Levels:
    """The open list levels: (kind, number) of the last mark of each, outermost first."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []

    @staticmethod
    def readings(mark: re.Match) -> list[tuple[str, int]]:
        """What a mark may stand for: its number as a digit, a letter or a roman numeral, by its closing sign and case."""
        body, sign = mark.group(1), mark.group(2)
        if body.isdigit():
            return [(f"1{sign}", int(body))]
        case = "A" if body.isupper() else "a"
        value = roman(body.lower())
        out = [(f"{case}{sign}", ord(body.lower()) - 96)] if len(body) == 1 else []
        return out + ([(f"{'I' if case == 'A' else 'i'}{sign}", value)] if value else [])

    def place(self, mark: re.Match) -> tuple[int, tuple[str, int]] | None:
        """Depth and reading at which a mark goes on with an open level, the innermost first, or opens one; None if it does neither."""
        read = self.readings(mark)
        for depth in range(len(self.stack) - 1, -1, -1):
            kind, n = self.stack[depth]
            if (kind, n + 1) in read:
                return depth, (kind, n + 1)
        first = next((r for r in read if r[1] == 1), None)
        # a kind that is open already starts anew at its level, so that there are no more levels than kinds
        return (next((d for d, (kind, _) in enumerate(self.stack) if kind == first[0]), len(self.stack)), first) if first else None

    def enter(self, mark: re.Match | None) -> None:
        """Takes a mark at a sentence's start: levels inside its own are closed."""
        at = mark and self.place(mark)
        if at:
            del self.stack[at[0] :]
            self.stack.append(at[1])

    def goes_on(self, mark: re.Match | None) -> bool:
        """Whether a mark is the next of an open level."""
        at = mark and self.place(mark)
        return bool(at) and at[1][1] > 1


def _trie() -> dict:
    root: dict = {}
    for kind, words in ((1, NONFINAL), (2, EITHER)):
        for w in words:
            at = root
            for c in reversed(w):
                at = at.setdefault(c, {})
            at[""] = (kind, w)
    return root


_TRIE = _trie()


def abbreviation(text: str, start: int, stop: int) -> tuple[int, str]:
    """(kind, entry) of the longest abbreviation that ends before the full stop at `stop`."""
    at, i, best = _TRIE, stop - 1, (0, "")
    while i >= start:
        c = text[i]
        if c.isspace():
            j = i
            while j > start and text[j].isspace():
                j -= 1
            if text[j] != ".":
                break
            i = j
            c = "."
        low = c.lower()
        nxt = at.get(low)
        if nxt is None:
            break
        at = nxt
        if "" in at and (i == start or not text[i - 1].isalnum()):
            best = at[""]
        i -= 1
    return best


def _caps(word: str) -> bool:
    return len(word) > 1 and word.isupper()


def _all_caps(text: str) -> bool:
    return text.isupper() and sum(map(str.isalpha, text)) >= 4


def _starts_sentence(text: str, k: int, caps_follow_ok: bool, s: int, i: int, levels: Levels) -> bool:
    """Whether a new sentence can start at k; the one before runs from s to i."""
    c = text[k]
    if c.islower():
        return bool(_LIST_MARK.match(text, k)) and len(text) > k + 2 and (text[k + 1] == ")" or levels.goes_on(_MARK.match(text, k)))
    if c.isalpha():
        if not caps_follow_ok and c.isupper():
            m = _WORD.match(text, k)
            if m and _caps(m.group()) and _all_caps(text[s:i]):
                return False
        return True
    if c.isdigit() or c in "¿¡\"“„«‘‚「『‹[【•‣▪●":
        return True
    if c == "(" or c == "（":
        return bool(_PAREN_MARK.match(text, k)) or (k + 1 < len(text) and not text[k + 1].islower())
    if c in "–—-*":
        return k + 2 < len(text) and text[k + 1].isspace() and not text[k + 2].islower()
    return False


def _full_stop(text: str, s: int, i: int, j: int, k: int, levels: Levels) -> bool:
    """Whether the single full stop at i ends the sentence begun at s; the next text is at k."""
    before, c = text[i - 1] if i > s else " ", text[k]
    kind, entry = abbreviation(text, s, i)
    if kind == 1 and len(entry) == 1:
        # "5 s." or "7 p." is a unit, and a capital is an initial
        m = _LAST_WORD.search(text, max(s, i - 12), i)
        if m and m.group(1)[-1:].isdigit():
            kind = 0
    if kind == 1 and entry in NUMBERED and not c.isdigit() and (k == j or entry in ("no", "nos", "al", "op", "lt", "max", "co")):
        kind = 0
    if k == j:
        nxt = text[k + 1] if k + 1 < len(text) else " "
        if kind == 1:
            return False
        if c.isupper():
            if nxt.islower() or nxt.isspace() or nxt in "’'":
                return (before.islower() or before.isdigit() or before in ")%°”»\"]" or (kind == 2 and nxt.islower())) and (nxt.islower() or before.islower() or before.isdigit())
            word = _WORD.match(text, k)
            prev = re.search(r"[^\W\d_]+$", text[max(s, i - 30) : i])
            return bool(before.isupper() and prev and len(prev.group()) > 2 and text[max(s, i - len(prev.group()) - 1)] in " \n(" and word and (word.end() >= len(text) or text[word.end()].isspace()))
        if c.isdigit():
            return bool(before.islower() and kind == 0 and re.search(r"(?:^|[\s(])[^\W\d_]{2,}$", text[max(s, i - 30) : i]))
        if c in "\"“„«¿¡‘「":
            return not before.isspace() and k + 1 < len(text) and (text[k + 1].isupper() or text[k + 1].isspace() and c == "«")
        if c in "(":
            return bool(_PAREN_MARK.match(text, k))
        if c.isalpha() and not c.islower():
            return not before.isdigit()
        return False
    if before.isspace():
        return False
    if i - s < 12 and _LIST_ONLY.match(text[s:i]):
        return False
    if not _starts_sentence(text, k, kind != 2, s, i, levels):
        return False
    if kind == 1:
        return False
    if c.isalpha() and text[k + 1 : k + 2] == "." and before.isalpha() and (i - 1 == s or not text[i - 2].isalnum()):
        return False  # the first letter of an abbreviation of several (u. U.)
    if kind == 2:
        return True
    if before.isupper() and (i - 1 == s or not (text[i - 2].isalnum() or text[i - 2] in "’'")):
        # a single capital: an initial, unless it names a part (Sect. B.)
        m = _LAST_WORD.search(text, max(s, i - 24), i)
        return not m or m.group(1)[-1:] not in ".," and len(m.group(1)) > 2 and m.group(1)[0].isupper() is False
    if before.isdigit() and c.isalpha():
        m = re.search(r"(?:^|\s)(\S+)\s+(\d{1,3})$", text[max(s, i - 20) : i])
        if m and m.group(1).lower() in ORDINAL_BEFORE:
            return False
    return True


def paragraph_spans(text: str, a: int, b: int, levels: Levels) -> Iterator[tuple[int, int]]:
    s = _WS.match(text, a, b).end()
    levels.enter(_MARK.match(text, s, b))
    stack: list[tuple[str, int]] = []  # (closers, position of the opener)
    absent: set[str] = set()  # closers that don't come any more in this paragraph
    at = s
    while at < b:
        m = _EVENT.search(text, at, b)
        if not m:
            break
        i, j = m.span()
        at, c, end = j, text[i], -1
        if c.isspace():
            if not stack:
                end = i
        elif c in ".!?…。！？｡।॥؟۔;;":
            if stack:
                continue
            k = _WS.match(text, j, b).end()
            if k >= b:
                end = j
            elif c in ";;":
                if i > s and _GREEK.match(text[i - 1]) and (text[k].isupper() or text[k].isdigit() or text[k] in "«“\"¿(" and not text[k + 1 : k + 2].islower()):
                    end = j
            elif c in "。！？｡।॥؟۔":
                end = j
            elif "!" in m.group() or "?" in m.group():
                n = text[k]
                if k > j:
                    if _starts_sentence(text, k, True, s, i, levels):
                        end = j
                elif n.isupper() or n in "¿¡\"“„«‘「『(" or (n.isalpha() and not n.islower()):
                    end = j
            elif j - i > 1 or c == "…":
                if k > j and _starts_sentence(text, k, False, s, i, levels) and not text[k].isdigit():
                    end = j
            elif _full_stop(text, s, i, j, k, levels):
                end = j
        else:
            if stack and c in stack[-1][0] and not (c in "’‘" and j < b and text[j].isalnum()):
                opened = stack.pop()[1]
            elif c in ")]}）】»”」』›" and any(c in x[0] for x in stack):
                while c not in stack[-1][0]:
                    stack.pop()
                opened = stack.pop()[1]
            else:
                closes = OPENERS.get(c)
                if closes and not (c in "‘‚" and i > a and text[i - 1].isalnum()):
                    for x in closes:
                        if x not in absent:
                            if text.find(x, j, b) >= 0:
                                stack.append((closes, i))
                                break
                            absent.add(x)
                continue
            if stack:
                continue
            # the outermost quotation or bracket has closed
            p = i - 1
            while p > opened and text[p].isspace():
                p -= 1
            if p <= opened or text[p] not in ".!?…。！？｡।॥;;":
                continue
            k = _WS.match(text, j, b).end()
            if k >= b:
                end = j
            elif c in BRACKET_CLOSERS:
                if opened == s and k > j and _starts_sentence(text, k, False, s, i, levels):
                    end = j
            elif text[p] in _CJK_MARKS:
                if k > j or text[k] not in _CJK_CONTINUES:
                    end = j
            elif _starts_sentence(text, k, False, s, i, levels) and not (k == j and not text[k].isupper()):
                end = j
        if end >= 0:
            if end > s:
                yield s, end
            s = at = _WS.match(text, end, b).end()
            levels.enter(_MARK.match(text, s, b))
            stack = []
    e = b
    while e > s and text[e - 1].isspace():
        e -= 1
    if e > s:
        yield s, e


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence, without white space at the ends."""
    if not text or text.isspace():
        return []
    out, a, levels = [], 0, Levels()
    for m in _BLANK_LINE.finditer(text):
        out.extend(paragraph_spans(text, a, m.start(), levels))
        a = m.end()
    out.extend(paragraph_spans(text, a, len(text), levels))
    return out


def split_sentences(df: DataFrame) -> DataFrame:
    """Every sentence of (src_table, row_id, text)."""

    def rows(src: str, rid: int, text: str | None) -> Iterator[tuple]:
        for a, b in sentence_spans(text):
            yield src, rid, a, b

    return map_rows(spread(df).select("src_table", F.col("row_id").cast("long"), "text").where(F.col("text").isNotNull()), rows, SPAN_SCHEMA)
