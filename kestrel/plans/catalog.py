"""Import every query module so that the registry is complete."""

from __future__ import annotations

import importlib

from .registry import ORACLE, QUERIES

_MODULES = ["q_posts", "q_sampling", "q_encode_metrics", "q_text", "q_words", "q_models", "q_streaming"]


def _load():
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLE)
