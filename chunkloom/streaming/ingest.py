"""Continuous ingestion: new files of a folder through the same gates, extraction and chunking as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chunkloom.operators import ingest
from chunkloom.operators.chunk import token_chunks
from chunkloom.sources import blobs
from chunkloom.sources.extract import extracted

Chunker = Callable[[DataFrame], DataFrame]


def pages_and_chunks(files: DataFrame, chunker: Chunker = token_chunks, kept: Callable[[DataFrame], DataFrame] = lambda found: found) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, chunks, rejected) of files (path, length, content).

    rejected has path and error: files turned away at the gates, files that could not be read, and single
    pages that could not. kept may store what was extracted, which all three are made of.
    """
    accepted, rejected = ingest.quarantined(ingest.gated(files))
    found = kept(extracted(accepted))
    pages = found.where("error IS NULL").select("path", "page", F.col("page_content").alias("text"))
    failed = rejected.select("path", "error").unionByName(found.where("error IS NOT NULL").select("path", "error"))
    return pages, chunker(pages), failed


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(blobs.SCHEMA).option("recursiveFileLookup", "true").load(path)


def ingest_stream(spark: SparkSession, path: str, sink: str, checkpoint: str, chunker: Chunker = token_chunks, once: bool = True) -> StreamingQuery:
    """Writes extracted, pages, chunks and rejected under sink, a folder for each batch, overwritten when a batch is run again.

    Files are read and extracted once; the other tables are made of what was extracted.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        def put(table: DataFrame, name: str) -> DataFrame:
            at = f"{sink}/{name}/batch={batch_id}"
            table.write.mode("overwrite").parquet(at)
            return batch.sparkSession.read.schema(table.schema).parquet(at)

        for name, table in zip(("pages", "chunks", "rejected"), pages_and_chunks(batch, chunker, lambda found: put(found, "extracted"))):
            put(table, name)

    writer = stream_files(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
