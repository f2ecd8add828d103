"""Files as rows (path, modificationTime, length, content) of Spark's binaryFile source."""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.error import HTTPError
from urllib.request import urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import text as tx
from chunkloom.operators.ingest import MAX_BYTES

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def files(spark: SparkSession, path: str, max_bytes: int | None = MAX_BYTES, recursive: bool = True) -> DataFrame:
    """Files under a path on any Hadoop file system. The size limit is pushed into the scan, so larger
    files are never read; content is read only if it is selected. A read that fails is tried again by the
    file system's client, and its task by Spark (spark.task.maxFailures)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found if max_bytes is None else found.where(F.col("length") <= max_bytes)


def listing(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Paths, sizes and MIME types, without reading contents."""
    return files(spark, path, max_bytes).select("path", "length", tx.mime_type(F.col("path")).alias("mime_type"))


def from_data(spark: SparkSession, rows: list[tuple[str | None, bytes | str]]) -> DataFrame:
    """In-memory blobs (path or null, bytes or text)."""
    made = [(p, None, len(b), bytearray(b)) for p, b in ((p, d.encode() if isinstance(d, str) else d) for p, d in rows)]
    return spark.createDataFrame(made, SCHEMA)


def valid(blob_path: Column, content: Column) -> Column:
    """A blob needs a path or content that is not null."""
    return blob_path.isNotNull() | content.isNotNull()


def as_text(content: Column, encoding: str = "UTF-8") -> Column:
    return F.decode(content, encoding)


def as_bytes(value: Column, encoding: str = "UTF-8") -> Column:
    return F.encode(value, encoding)


def _fetched(url: str, timeout: float) -> bytes:
    try:
        with urlopen(url, timeout=timeout) as answer:
            if answer.status != 200:
                raise ValueError(f"{url}: status {answer.status}")
            return answer.read()
    except HTTPError as problem:
        raise ValueError(f"{url}: status {problem.code}") from problem


def resolved(path: str, allow_web: bool = False, timeout: float = 30.0) -> tuple[str, bytes | None]:
    """(source, content) of a path or address named by a user: ~ is expanded; a file is only named, an address fetched.

    The source of an address is the address itself. Web access is off unless allowed; what is neither a
    file nor an address is a ValueError.
    """
    local = os.path.expanduser(path)
    if os.path.isfile(local):
        return local, None
    if not re.match("https?://[^/?#]+", path):
        raise ValueError(f"neither a file nor an address: {path}")
    if not allow_web:
        raise ValueError(f"web sources are off: {path}")
    return path, _fetched(path, timeout)


@contextmanager
def opened(path: str | None = None, data: bytes | str | None = None, allow_web: bool = False) -> Iterator[io.BufferedIOBase]:
    """A blob as a stream: its bytes, or its file, or what its address gives. Text has no stream."""
    if isinstance(data, str):
        raise NotImplementedError("text has no byte stream; encode it first")
    if data is None and path is None:
        raise ValueError("a blob needs data or a path")
    if data is None:
        path, data = resolved(path, allow_web)
    stream = io.BytesIO(data) if data is not None else open(path, "rb")
    try:
        yield stream
    finally:
        stream.close()
