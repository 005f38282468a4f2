"""Table sources: domain tables derived from the test tables, or read back
from a materialized Parquet warehouse."""

from . import layout
from .catalog import Catalog, materialize

__all__ = ["Catalog", "layout", "materialize"]
