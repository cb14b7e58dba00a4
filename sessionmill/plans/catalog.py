"""All registered queries."""
from . import activity_queries, browse_queries, session_queries, source_queries, stream_queries, usage_queries, wiring_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
