"""All queries of the engine's own operators."""

from . import catalog_flow, catalog_graph, catalog_state, catalog_store, catalog_text  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
