"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for all operators."""

import pytest
from pyspark.sql import functions as F

from chunkloom.llm import op1_pages, op2_crf, op3_pii, op4_jpeg, op5_winnowing, op6_toxicity, op7_wavelet, op8_quality, op9_simhash, op10_packing

LONG = " ".join(f"word{i % 977} mail{i}@x.org" if i % 500 == 0 else f"word{i % 977}" for i in range(60_000))
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "A b"), (4, "A b"), (None, "x y z w"), (None, None), (5, LONG), (6, "é ß 日本 \x00 😀 \x85"), (7, "a" * 50_000), (8, "7" * 30_000), (9, "<|endoftext|> 1.2.3.4 +1 234 567 8901")]
#: Names that operators use for columns of their own.
CLASHES = ["fp", "text_key", "n_words", "spans", "media", "score", "held_out", "key", "pos", "value", "mask", "row_id", "part", "label", "component_id", "_doc"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 10)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "word1 word2 word3"), (1, "word1 word2 word3"), (2, None), (3, ""), (None, "A b"), (4, " ".join(f"word{i}" for i in range(5, 40)))], "item_id long, text string")


def test_every_operator_keeps_every_row(docs, labels, items):
    runs = {
        "op2": lambda d: op2_crf.languages(d, op2_crf.train(d)), "op3": lambda d: op3_pii.personal_data(d), "op4": lambda d: op4_jpeg.features(op4_jpeg.store(d)),
        "op5": lambda d: op5_winnowing.contamination(d, items), "op6": lambda d: op6_toxicity.toxicity(d, labels), "op7": lambda d: op7_wavelet.read_documents(op7_wavelet.write_shards(d)),
        "op8": lambda d: op8_quality.quality(d, labels), "op9": lambda d: op9_simhash.near_duplicates(d),
    }
    for name, run in runs.items():
        got = run(docs).collect()
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == sorted(-1 if i is None else i for i, _ in ROWS), name
        assert run(docs.limit(0)).count() == 0, name
    pieces = op10_packing.pack(docs).collect()
    assert sum(r.start == 0 for r in pieces) == len(ROWS)
    assert op10_packing.pack(docs.limit(0)).count() == 0


def test_filters_keep_columns(docs, items):
    for kept in (op9_simhash.drop_near_duplicates(docs), op5_winnowing.decontaminate(docs, items), op3_pii.redact(docs), op2_crf.keep_languages(docs, op2_crf.train(docs), 0.0)):
        assert set(kept.columns) == set(docs.columns)
        assert kept.where("fp <> 'clash'").count() == 0
        kept.collect()


def test_empty_labels_and_items(spark, docs, labels, items):
    assert {r.score for r in op8_quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert {round(r.score, 6) for r in op6_toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert op5_winnowing.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert {r.lang_pred for r in op2_crf.languages(docs, op2_crf.train(docs.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


def test_pages(spark):
    rows = [(1, None, None), (1, None, None), (None, "http://h/a", "<p>x"), (2, "http://h/a", ""), (3, "nonsense", "<div>" * 5000 + "t"), (4, "http://h/b", "<p>" + "y " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "rank": F.lit(2), "hashes": F.lit(3)})
    got = sorted((r.text, r.n_chars) for r in op1_pages.main_text(pages).collect())
    assert got == sorted([("", 0), ("", 0), ("x", 1), ("", 0), ("t", 1), (("y " * 100_000).strip(), 199_999)])
    assert op1_pages.main_text(pages.limit(0)).count() == 0


def test_session_settings_stay(spark, docs, labels, items):
    settings = lambda: {r.key: r.value for r in spark.sql("SET").collect()}
    before = settings()
    op9_simhash.drop_near_duplicates(docs).count()
    op8_quality.quality(docs, labels).count()
    op5_winnowing.decontaminate(docs, items).count()
    op10_packing.pack(docs).count()
    assert settings() == before


def test_ties_and_repeated_rows_get_equal_values(docs, labels, items):
    """The two rows (4, "A b") are alike in whatever an operator makes of them."""
    for found in (op2_crf.languages(docs, op2_crf.train(docs)), op4_jpeg.stored_features(docs), op5_winnowing.contamination(docs, items).drop(*CLASHES), op6_toxicity.toxicity(docs, labels), op8_quality.quality(docs, labels), op9_simhash.near_duplicates(docs)):
        rows = found.where("doc_id = 4").collect()
        assert len(rows) == 2 and rows[0] == rows[1]
    tokens = [(r.n_tokens, r.ids_crc32) for r in op7_wavelet.read_documents(op7_wavelet.write_shards(docs)).where("doc_id = 4").collect()]
    assert len(tokens) == 2 and tokens[0] == tokens[1]
