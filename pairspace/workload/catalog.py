"""Importing this module registers every query."""

from . import (  # noqa: F401
    analogy_queries,
    cluster_queries,
    feature_queries,
    source_queries,
    text_queries,
    vector_queries,
)
