"""SQL snippets of the text primitives, for the queries' SQL twins (RE2 syntax, no lookarounds)."""

from __future__ import annotations

from dossierflow.functions import text as X

#: Unicode white space as a class of the SQL engine's regular expressions.
WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(WS + '+')}, ' ', 'g'))"


def ustrip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def squash(x: str) -> str:
    return f"lower(regexp_replace({x}, {q(WS + '+')}, '', 'g'))"


def casefold(x: str) -> str:
    return f"lower(replace(replace({x}, 'ß', 'ss'), 'ẞ', 'ss'))"


def norm_heading(x: str) -> str:
    return casefold(f"trim({collapse(f'coalesce({x}, {q('')})')}, {q(X.HEADING_TRIM)})")


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def numbered(x: str) -> str:
    t = ustrip(f"coalesce({x}, '')")
    return f"({t} <> '' AND NOT {matches(t, X.DATE)} AND ({' OR '.join(matches(t, p) for p in (X.DESIGNATOR, X.CODE, X.NUMBERED_TITLE, X.MARKER))}))"


def toc_title(x: str) -> str:
    return matches(f"coalesce({x}, '')", X.TOC_TITLE)


def plausible(x: str) -> str:
    t = ustrip(f"coalesce({x}, '')")
    bare = f"trim({t}, {q(' .·•_-')})"
    return f"({t} <> '' AND NOT {toc_title(t)} AND ({numbered(t)} OR (NOT ({matches(bare, r'^[0-9\s./\-]+$')} OR {matches(bare, r'(?i)^page\s+\d+')}) AND length({bare}) BETWEEN 3 AND 160)))"


def clean_cell(x: str) -> str:
    t = collapse(f"coalesce({x}, '')")
    return f"CASE WHEN lower({t}) IN ('', 'nan', 'none', 'null', '-', '—') THEN '' ELSE {t} END"


PAGE = "TRY_CAST(nullif(regexp_extract(page, '[0-9]+'), '') AS INTEGER)"

#: Chunks of the sections table.
CHUNKS = f"""chunks AS (
  SELECT doc_uuid, ordinal AS pos, id, {ustrip("coalesce(heading, '')")} AS heading, coalesce(text, '') AS text,
         coalesce(list_transform(json_extract_string(labels_json, '$[*]'), lambda x: lower(x)), []) AS labels, {PAGE} AS page, labels_json, decision
  FROM sections)"""
