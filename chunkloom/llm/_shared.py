"""Helpers that several training-data operators use."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chunkloom.shared import shared_dir, written

__all__ = ["documents", "free_names", "held_out", "map_arrow", "release_memory", "shared_dir", "slices", "written"]

#: Rows of labelled data with this remainder of crc32(doc_id) mod 4 are held out of training.
HELD_OUT_REMAINDER = 2
SLICE_BYTES = 4 << 20


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER, F.lit(True))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """names, each lengthened until no column of df has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow; a task hands its memory back, as Python workers outlive tasks.

    Spark bounds a batch by its bytes as well as its rows, so no setting of the caller's session is
    changed; slices() cuts what arrives further.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(wrapped, schema)


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library that most systems have
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, size_column: str | None, limit: int = SLICE_BYTES) -> Iterable[pa.RecordBatch]:
    if batch.num_rows == 0:
        return
    if size_column is None:
        yield batch
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(size_column))), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start)
