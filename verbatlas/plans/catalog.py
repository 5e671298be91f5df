"""All registered queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import change_queries, corpus_queries, cql_queries, lexicon_queries, spelling_queries, store_queries, text_queries, thesaurus_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concordance lines of a two-token query."""
    return QUERIES["kwic_span"](spark, sf_dir)
