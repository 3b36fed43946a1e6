"""Connectors as Python data sources, their registry, and files."""

from sluice.sources.adapters import available_sources, open_source, register_all, register_source, source_class

__all__ = ["available_sources", "open_source", "register_all", "register_source", "source_class"]
