"""All registered queries of the library's own operators."""

from . import activity_queries, catalog_queries, digest_queries, more_queries, retrieval_queries, stream_queries, text_queries, turn_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
