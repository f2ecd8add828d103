"""Queries of the training-data operators, and the SQL that DuckDB runs against them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chunkloom.llm import op1_pages, op5_winnowing
from chunkloom.llm.op2_crf import op2_crf
from chunkloom.llm.op3_pii import op3_pii
from chunkloom.llm.op4_jpeg import op4_jpeg
from chunkloom.llm.op6_toxicity import op6_toxicity
from chunkloom.llm.op7_wavelet import op7_wavelet
from chunkloom.llm.op8_quality import op8_quality
from chunkloom.llm.op9_simhash import op9_simhash
from chunkloom.llm.op10_packing import op10_packing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pages": op1_pages.op1_pages,
    "op2_crf": op2_crf,
    "op3_pii": op3_pii,
    "op4_jpeg": op4_jpeg,
    "op5_winnowing": op5_winnowing.op5_winnowing,
    "op6_toxicity": op6_toxicity,
    "op7_wavelet": op7_wavelet,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {
    "op1_pages": op1_pages.ORACLE,
    "op5_winnowing": op5_winnowing.ORACLE,
}
