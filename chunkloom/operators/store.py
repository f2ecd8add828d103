"""Stored chunks with their vectors: what a vector index over an exact scan is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.config import Settings
from chunkloom.functions import vectors as vx


def embedded(chunks: DataFrame, encoder: vx.Encoder = vx.LETTERS, text_column: str = "text") -> DataFrame:
    """chunks with vector; null text has none."""
    return chunks.withColumn("vector", vx.encoded(F.col(text_column), encoder))


def save(chunks: DataFrame, path: str | None = None, mode: str = "overwrite", settings: Settings = Settings()) -> DataFrame:
    """Writes chunks, with or without vectors, as Parquet and returns the table. Without a path they go to the settings' vector store.

    mode "append" adds to what is there. Embedding happens here, once, and never again when the table is read.
    """
    path = path or settings.vector_store_dir
    chunks.write.mode(mode).parquet(path)
    return load(chunks.sparkSession, path)


def load(spark: SparkSession, path: str | None = None, settings: Settings = Settings()) -> DataFrame:
    return spark.read.parquet(path or settings.vector_store_dir)
