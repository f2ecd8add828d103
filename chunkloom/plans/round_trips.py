"""Files made from rows, for round trips through the extractors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.sources import docx, pdf
from chunkloom.sources.extract import extracted


@F.pandas_udf(T.BinaryType())
def _docx(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: docx.build(t.split("\n")))


@F.pandas_udf(T.BinaryType())
def _pdf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: pdf.build([t]))


def docx_pages(docs: DataFrame) -> DataFrame:
    """doc_id, page and text of documents that went through DOCX files."""
    files = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), _docx(F.coalesce("text", F.lit(""))).alias("content"))
    return _pages(extracted(files), ".docx")


def pdf_pages(docs: DataFrame) -> DataFrame:
    files = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), _pdf(F.coalesce("text", F.lit(""))).alias("content"))
    return _pages(extracted(files), ".pdf")


def _pages(pages: DataFrame, suffix: str) -> DataFrame:
    return pages.select(F.replace("path", F.lit(suffix), F.lit("")).cast("long").alias("doc_id"), F.col("page").cast("long").alias("page"), F.col("page_content").alias("text"), "error")
