"""A training-data pipeline over documents: each stage reads the Parquet that the one before it wrote.

Every stage judges rows, not ids: rows that repeat an id, or have none, are told apart by their texts, and
extra columns stay. A null text goes with the language stage, as it has no letter; a stage by itself treats
it as its docstring says. Stages of an empty table give an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chunkloom.llm import op2_crf, op3_pii, op5_winnowing, op9_simhash, op10_packing
from chunkloom.llm._shared import written

#: A document goes if its words' mean marginal for its best language is lower, or if it has no letter.
LEAST_LANGUAGE_SCORE = 0.3
#: It also goes if its words, without their neighbours, are less sure of any learned language. 0 is 1/labels; the least of
#: held-out labelled rows (samples of sf0.001, sf0.01, check_s, check_h) is 0.26, unlearned scripts have up to 0.12.
LEAST_EVIDENCE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the conditional random field can tell. Null and letterless texts go, and so
    does everything where no row has a language to learn from; repeated rows stay or go together."""
    return op2_crf.keep_languages(docs, op2_crf.train(docs), LEAST_LANGUAGE_SCORE, least_evidence=LEAST_EVIDENCE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near-duplicates, whatever ids the others have. Null and
    wordless texts are one group; different texts under one id, or under none, are different documents."""
    return op9_simhash.drop_near_duplicates(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold too much of benchmark items. Null texts hold nothing and stay; equal rows stay or go together."""
    return op5_winnowing.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text by its kind. Every row stays, null texts as they are; equal texts give equal texts."""
    return op3_pii.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and the sequences they are packed into. Null texts are documents of their end id alone; rows
    of one id are different documents."""
    return op10_packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Models, graphs and packing have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
