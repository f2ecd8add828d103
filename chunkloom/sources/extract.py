"""Extraction of files to pages: a registry of extractors by extension, run over Arrow batches of contents."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions import text as tx

#: From a file's bytes to its pages in order: (page text, images), or what went wrong with a page.
Extractor = Callable[[bytes], Iterable[tuple[str, int] | Exception]]
PAGES = "path string, page int, page_content string, images int, error string"
#: Characters of page text that are passed on at once.
BATCH_CHARS = 4 << 20


def pdf_extractor(engine: str = "own") -> Extractor:
    """Extracts PDF pages with a named engine, see sources.pdf.pages."""

    def pages(content: bytes) -> Iterable[tuple[str, int] | Exception]:
        from chunkloom.sources import pdf

        return pdf.pages(content, engine)

    return pages


def _docx(content: bytes) -> list[tuple[str, int]]:
    from chunkloom.sources import docx

    return [(docx.to_markdown(content), 0)]


EXTRACTORS: dict[str, Extractor] = {".pdf": pdf_extractor(), ".docx": _docx}


def _file_rows(path: str, extractor: Extractor | None, extension: str, content: bytes) -> Iterator[tuple]:
    try:
        if extractor is None:
            raise ValueError(f"no extractor for {extension or 'files without an extension'}")
        for i, page in enumerate(extractor(content)):
            yield (path, i, None, None, f"{type(page).__name__}: {page}") if isinstance(page, Exception) else (path, i, *page, None)
    except Exception as problem:  # isolates a broken file from the rest of the batch
        yield path, None, None, None, f"{type(problem).__name__}: {problem}"


def extracted(files: DataFrame, extractors: dict[str, Extractor] | None = None, image_marker: str = "[image]") -> DataFrame:
    """files (path, content) to pages: path, page from 0, page_content, images, error.

    A page that cannot be read is a row with its error, beside its file's other pages; a file that cannot
    be is one row with its error and no page. Neither fails the job. Each file is read whole by one task,
    so gate on size first.
    """
    known = EXTRACTORS if extractors is None else extractors
    names = [c.split()[0] for c in PAGES.split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path, extension, content in zip(*(batch.column(i) for i in range(3))):
                for row in _file_rows(path.as_py(), known.get(extension.as_py()), extension.as_py(), content.as_py() or b""):
                    rows.append(row)
                    held += len(row[2] or "")
                    if held >= BATCH_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    pages = files.select("path", tx.suffix(F.col("path")).alias("extension"), "content").mapInArrow(run, PAGES)
    return pages.withColumn("page_content", F.when(F.col("error").isNull(), tx.with_image_markers(F.col("page_content"), F.coalesce("images", F.lit(0)), image_marker)))
