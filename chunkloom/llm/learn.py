"""Fitting on a bounded number of labelled rows, and scoring every text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm._shared import held_out, map_arrow, slices


#: The fit task takes no more UTF-8 bytes of text than this, in the order of a hash of ids; a text that does not fit is left out.
TRAIN_BYTES = 96 << 20


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, kind: str = "int", allowed: tuple | None = (0, 1)) -> DataFrame:
    """(doc_id, text, label) of about rows labelled documents that are not held out.

    Rows without a label, an id or a text are left out, and so are labels that are not allowed. An id
    counts once for each of its labels, with one of its texts (that of the least hash), however many rows
    repeat it. The labels kept are a bounded number, so they are broadcast against the documents.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast(kind).alias("label"))
    if allowed is not None:
        known = known.where(F.col("label").isin(*allowed))
    known = known.distinct()
    share = min(1.0, rows / max(1, known.count()))
    kept = known.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) < int(share * (1 << 30)))
    met = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(kept), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")


def fit_in_one_task(rows: DataFrame, fit: Callable[[list, list], bytes], most_bytes: int = TRAIN_BYTES) -> bytes:
    """fit(texts, labels) -> bytes, run by one executor task on bounded rows and bytes; the driver only gets the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, left = [], most_bytes
        for batch in batches:
            for i, text, label in zip(*(c.to_pylist() for c in batch.columns)):
                size = len(text.encode())
                if size <= left:
                    left -= size
                    got.append((i, text, label))
        got.sort()
        yield pa.RecordBatch.from_arrays([pa.array([fit([t for _, t, _ in got], [y for _, _, y in got])], pa.binary())], names=["model"])

    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit("order")), "doc_id", "label")
    found = map_arrow(ordered, run, "model binary").collect()
    return bytes(found[0][0]) if found else fit([], [])


def score_texts(docs: DataFrame, model: bytes, make: Callable) -> DataFrame:
    """doc_id, held_out and score of every row; null text scores as empty. make(model bytes) gives the scorer."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make(shared.value)
        for batch in batches:
            for piece in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(np.asarray(scorer.scores(piece.column(1).to_pylist()), np.float64))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double")
