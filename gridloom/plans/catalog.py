"""All query registries of the core."""

from __future__ import annotations

from gridloom.plans import graphs, integrity, metadata, retrieval, runs, states, texts
from gridloom.plans.registry import Registry

FLAGSHIP = "metrics_at_ks"


def registries() -> list[Registry]:
    return [retrieval.queries, texts.queries, metadata.queries, graphs.queries, runs.queries, states.queries, integrity.queries]
