"""All queries of the engine, by name."""

from . import queries_files, queries_headers, queries_models, queries_overlaps, queries_records, queries_reports, queries_sequences, queries_templates  # noqa: F401  (they register themselves)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
