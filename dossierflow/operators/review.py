"""The review of a document's chunks from contents to sections: one chain over the operators of triage and merging.

Edge cases are those of its parts: an empty table gives empty results, a null
document is a document of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from dossierflow.operators import merge as M
from dossierflow.operators import triage as G
from dossierflow.operators.toc import MATCH_RATIO
from dossierflow.session import materialise
from dossierflow.sources.sinks import review_payload


@dataclass
class Review:
    """Decisions of all chunks, the sections made of them, the session history and the payload's rows."""

    decisions: DataFrame
    sections: DataFrame
    history: DataFrame
    payload: DataFrame


def review(chunks: DataFrame, entries: DataFrame | None = None, toc_pages: DataFrame | None = None, ratio: float | None = MATCH_RATIO) -> Review:
    """Triage of chunks (against contents entries where given), accepted as proposed, and the sections built.

    Keys and flags, and then the decisions, are written once to the checkpoint
    folder; all later steps read those.
    """
    marks = materialise(G.marked(chunks).drop("text"))
    valid = G.valid_headings(marks) if entries is None else entries
    decided = materialise(G.triage(marks, valid, G.boilerplate(marks), toc_pages, ratio))
    texts = chunks.select("id", "text")
    accepted = decided.drop("heading").withColumnRenamed("heading_out", "heading").join(texts, "id")
    sections = M.merged_sections(accepted)
    history = M.history(decided)
    return Review(decided, sections, history, review_payload(sections, history))
