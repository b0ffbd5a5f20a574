"""Every registered query of the library."""

from . import graph_queries, load_queries, report_queries, scope_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
