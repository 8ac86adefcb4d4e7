"""Similarity metrics from their published definitions, in Arrow batches.

Each takes a candidate and a reference; null or blank on either side gives null.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.functions.arrowmap import map_rows, spread

METRICS = ("rouge1", "rouge2", "rougeL", "bleu", "similarity_ratio", "word_error_rate", "sequence_ratio")
LOWER_IS_BETTER = frozenset({"levenshtein_distance", "word_error_rate"})

_TOKEN = re.compile(r"[a-z0-9]+")
_PUNCT = re.compile(r"\w+|[^\w\s]")


class PorterStemmer:
    """The suffix-stripping algorithm of 1980, as published."""

    _VOWELS = "aeiou"
    _STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
    _STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
    _STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")

    def _vowel(self, w: str, i: int) -> bool:
        return w[i] in self._VOWELS or (w[i] == "y" and i > 0 and not self._vowel(w, i - 1))

    def _measure(self, w: str) -> int:
        kinds = "".join("v" if self._vowel(w, i) else "c" for i in range(len(w)))
        return len(re.findall("v+c+", kinds))

    def _has_vowel(self, w: str) -> bool:
        return any(self._vowel(w, i) for i in range(len(w)))

    def _double(self, w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and not self._vowel(w, len(w) - 1)

    def _cvc(self, w: str) -> bool:
        n = len(w)
        return n > 2 and not self._vowel(w, n - 1) and self._vowel(w, n - 2) and not self._vowel(w, n - 3) and w[-1] not in "wxy"

    def stem(self, w: str) -> str:
        if len(w) <= 2:
            return w
        if w.endswith("sses") or w.endswith("ies"):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            if self._measure(w[:-3]) > 0:
                w = w[:-1]
        else:
            for end in ("ed", "ing"):
                if w.endswith(end) and self._has_vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif self._double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif self._measure(w) == 1 and self._cvc(w):
                        w += "e"
                    break
        if w.endswith("y") and self._has_vowel(w[:-1]):
            w = w[:-1] + "i"
        for table in (self._STEP2, self._STEP3):
            for end, to in table:
                if w.endswith(end):
                    if self._measure(w[: -len(end)]) > 0:
                        w = w[: -len(end)] + to
                    break
        for end in self._STEP4:
            if w.endswith(end):
                if self._measure(w[: -len(end)]) > 1:
                    w = w[: -len(end)]
                break
        else:
            if w.endswith("ion") and len(w) > 3 and w[-4] in "st" and self._measure(w[:-3]) > 1:
                w = w[:-3]
        if w.endswith("e"):
            m = self._measure(w[:-1])
            if m > 1 or (m == 1 and not self._cvc(w[:-1])):
                w = w[:-1]
        if w.endswith("ll") and self._measure(w) > 1:
            w = w[:-1]
        return w


_STEMS: dict[str, str] = {}
_STEMMER = PorterStemmer()


def rouge_tokens(text: str) -> list[str]:
    out = []
    for w in _TOKEN.findall(text.lower()):
        if len(w) > 3:
            if w not in _STEMS:
                if len(_STEMS) > 200_000:
                    _STEMS.clear()
                _STEMS[w] = _STEMMER.stem(w)
            w = _STEMS[w]
        out.append(w)
    return out


def _f1(hit: int, a: int, b: int) -> float:
    if not hit or not a or not b:
        return 0.0
    p, r = hit / a, hit / b
    return 2 * p * r / (p + r)


def rouge_n(candidate: list[str], reference: list[str], n: int) -> float:
    c = Counter(tuple(candidate[i : i + n]) for i in range(len(candidate) - n + 1))
    r = Counter(tuple(reference[i : i + n]) for i in range(len(reference) - n + 1))
    return _f1(sum((c & r).values()), sum(c.values()), sum(r.values()))


def lcs_length(a, b) -> int:
    """Longest common subsequence, bit-parallel over the first sequence."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    v = (1 << len(a)) - 1
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & ((1 << len(a)) - 1)
    return len(a) - v.bit_count()


def rouge_l(candidate: list[str], reference: list[str]) -> float:
    return _f1(lcs_length(candidate, reference), len(candidate), len(reference))


def bleu(candidate: str, reference: str, epsilon: float = 0.1) -> float:
    """BLEU-4 of lower-case tokens; zero counts are smoothed by epsilon."""
    c, r = _PUNCT.findall(candidate.lower()), _PUNCT.findall(reference.lower())
    if not c or not r:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        cn = Counter(tuple(c[i : i + n]) for i in range(len(c) - n + 1))
        rn = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
        total, hit = max(1, sum(cn.values())), sum((cn & rn).values())
        if n == 1 and not hit:
            return 0.0
        logs += math.log((hit or epsilon) / total) / 4
    return (1.0 if len(c) > len(r) else math.exp(1 - len(r) / len(c))) * math.exp(logs)


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS / (|a| + |b|)."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def word_errors(candidate: str, reference: str) -> tuple[float, int, int, int]:
    """(rate, substitutions, insertions, deletions) of the cheapest word alignment."""
    c, r = candidate.split(), reference.split()
    prev = [(j, 0, j, 0) for j in range(len(c) + 1)]
    for i, w in enumerate(r, 1):
        cur = [(i, 0, 0, i)]
        for j, x in enumerate(c, 1):
            d, s, n, e = prev[j - 1]
            options = [(d, s, n, e) if w == x else (d + 1, s + 1, n, e)]
            d, s, n, e = cur[j - 1]
            options.append((d + 1, s, n + 1, e))
            d, s, n, e = prev[j]
            options.append((d + 1, s, n, e + 1))
            cur.append(min(options, key=lambda t: t[0]))
        prev = cur
    d, s, n, e = prev[-1]
    return d / max(len(r), 1), s, n, e


def sequence_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


SCORE_SCHEMA = "pair_id long, rouge1 double, rouge2 double, rougeL double, bleu double, similarity_ratio double, word_error_rate double, substitutions int, insertions int, deletions int, sequence_ratio double"


def score_pairs(pairs: DataFrame, wanted: tuple[str, ...] = METRICS, id_type: str = "long") -> DataFrame:
    """Scores of (pair_id, candidate, reference); metrics not wanted stay null."""
    want = frozenset(wanted)

    def rows(pid, c: str | None, r: str | None) -> Iterator[tuple]:
        if not c or not r or not c.strip() or not r.strip():
            yield (pid, *[None] * 10)
            return
        ct, rt = (rouge_tokens(c), rouge_tokens(r)) if want & {"rouge1", "rouge2", "rougeL"} else ([], [])
        wer = word_errors(c, r) if "word_error_rate" in want else (None,) * 4
        yield (pid, rouge_n(ct, rt, 1) if "rouge1" in want else None, rouge_n(ct, rt, 2) if "rouge2" in want else None, rouge_l(ct, rt) if "rougeL" in want else None, bleu(c, r) if "bleu" in want else None, indel_ratio(c, r) if "similarity_ratio" in want else None, *wer, sequence_ratio(c, r) if "sequence_ratio" in want else None)

    return map_rows(spread(pairs).select(F.col("pair_id").cast(id_type), "candidate", "reference"), rows, SCORE_SCHEMA.replace("pair_id long", f"pair_id {id_type}"))
