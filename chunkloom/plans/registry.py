"""Registered queries, their SQL, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkloom.plans.oracles import ORACLES
from chunkloom.plans.queries import QUERIES, retrieval

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid chunks of documents, and the four best of them for each benchmark item."""
    return retrieval(spark, sf_dir)
