"""Token counts with a public tokenizer read from a rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.functions.arrowmap import map_rows, spread

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The published splitting pattern of byte-level BPE vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_CACHE: dict[str, object] = {}


def encoding(path: str = DEFAULT_RANKS):
    if path not in _CACHE:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CACHE[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _CACHE[path]


def with_token_counts(df: DataFrame, id_col: str, text_col: str, carried: str, path: str = DEFAULT_RANKS) -> DataFrame:
    """(id, carried, n_tokens) of each row; a null text has 0 tokens."""

    def rows(enc, rid: int, kept: str, text: str | None) -> Iterator[tuple]:
        yield rid, kept, len(enc.encode_ordinary(text)) if text else 0

    packed = spread(df).select(F.col(id_col).cast("long"), F.col(carried).cast("string"), text_col)
    return map_rows(packed, rows, "doc_id long, source string, n_tokens long", lambda: encoding(path))
