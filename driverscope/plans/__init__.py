"""Whole queries: index, chunk features, reports, and the registered catalogue."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "chunk_queries",
    "index_queries",
    "score_queries",
    "motion_queries",
    "clip_queries",
    "file_queries",
    "study_queries",
]


def load_catalogue():
    """Import every module that registers queries; returns (queries, sql)."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    catalogue = import_module(f"{__name__}.catalogue")
    return catalogue.QUERIES, catalogue.ORACLES
