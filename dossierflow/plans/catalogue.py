"""All registries of the core."""

from __future__ import annotations

from dossierflow.plans.curation import curation
from dossierflow.plans.documents import documents
from dossierflow.plans.evaluation import evaluation
from dossierflow.plans.layouts import layouts
from dossierflow.plans.problems import problems
from dossierflow.plans.registry import Registry


def registries() -> list[Registry]:
    return [problems, curation, evaluation, documents, layouts]
