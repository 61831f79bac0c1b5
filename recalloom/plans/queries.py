"""All named queries."""

from . import evaluation_queries, retrieval_queries, segmentation_queries, text_queries  # noqa: F401
from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
