"""Registered queries and their SQL, gathered from the query modules."""

from __future__ import annotations

from quillon.queries import clean_features, score_rank, sources_vectors  # noqa: F401 - they register
from quillon.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    """The recommendation page over the large catalogue."""
    return QUERIES["w2_recommend_page"](spark, sf_dir)
