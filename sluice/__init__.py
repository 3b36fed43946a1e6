"""Sluice: raw web pages and document files to clean, dated, budget-fitted text, as Spark jobs."""

from __future__ import annotations

from importlib import import_module

#: Public names and where they stand; each is imported when it is first asked for.
_NAMES = {
    "html_text": "functions.html", "read_page": "functions.html", "DateProfile": "functions.dates", "date_from_text": "functions.dates", "date_from_url": "functions.dates",
    "TruncationProfile": "functions.truncate", "truncate": "functions.truncate", "analyse": "operators.analysis", "candidates": "operators.probe", "harvest": "operators.fleet", "remember": "operators.fleet",
    "fold_memory": "operators.runs", "rank_calls": "operators.sniff", "Adapter": "sources.adapters", "ConfigError": "sources.adapters", "available_sources": "sources.adapters",
    "open_source": "sources.adapters", "register_source": "sources.adapters", "read_files": "sources.files", "read_recipes": "sources.files", "recipe_json": "sources.files", "write_documents": "sources.files",
}
__all__ = sorted(_NAMES)


def __getattr__(name: str):
    if name in _NAMES:
        return getattr(import_module(f"sluice.{_NAMES[name]}"), name)
    raise AttributeError(f"module 'sluice' has no attribute {name!r}")
