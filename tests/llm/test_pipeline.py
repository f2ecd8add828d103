import re

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, sf):
    from test_op3_pii import PATTERNS, valid
    from test_op5_winnowing import brute
    from test_op9_simhash import classes, simhash

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, frames = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        frames[name] = {r.doc_id: r for r in rows} if name != "packing" else rows
        if name != "packing":
            assert set(docs.columns) == set(columns) and len(frames[name]) == len(rows)
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert frames["language"].keys() == before.keys()
    ids = sorted(before)
    values = np.array([simhash(before[i]) for i in ids], np.uint64)
    linked = [(i, int(j)) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 2)]
    assert set(frames["near_duplicates"]) == {ids[k] for k in classes(len(ids), linked)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    judged = {r[0]: r[-1] for r in brute([(i, r.text) for i, r in frames["near_duplicates"].items()], items, 13)}
    assert set(frames["decontamination"]) == {i for i, bad in judged.items() if not bad}
    assert frames["personal_data"].keys() == frames["decontamination"].keys()
    for i, r in frames["personal_data"].items():
        assert r.n_chars == len(r.text)
        assert not [m[0] for kind, p in PATTERNS.items() for m in re.finditer(p, r.text) if valid(kind, m[0])]
        if not re.search(r"[0-9@]", before[i]):
            assert r.text == before[i]
    assert {r.doc_id for r in frames["packing"]} == set(frames["personal_data"])


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_unlearned_scripts_go(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    strange = ["Это простой текст на русском языке, который никто не изучал", "Αυτό είναι ένα απλό κείμενο στα ελληνικά", "这是一个没有学过的语言的文本 应该被拒绝", "*** ### 12 {} ;;"]
    more = [docs.limit(1).withColumns({"doc_id": F.lit(-1 - i).cast(docs.schema["doc_id"].dataType), "text": F.lit(t), "lang": F.lit(None).cast("string")}) for i, t in enumerate(strange)]
    mixed = docs
    for row in more:
        mixed = mixed.unionByName(row)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, mixed, sf).collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_rows_that_share_or_lack_an_id(spark, sf):
    """Through all stages rows are told apart by their texts: nothing is lost that no rule drops, and copies go whatever their ids."""
    from pyspark.sql import functions as F
    from test_op9_simhash import classes, simhash

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    source = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    # A third without an id, a third with one id, and some rows twice.
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, 7).otherwise(F.col("doc_id")).cast(docs.schema["doc_id"].dataType))
    odd = odd.unionByName(odd.where("n_chars % 5 = 0")).withColumn("_fp", F.lit("extra"))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_duplicates"](spark, odd, sf)
    texts = [t for _, t in source]
    values = np.array([simhash(t) for t in texts], np.uint64)
    linked = [(i, int(j)) for i in range(len(texts)) for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 2)]
    group = dict(zip(texts, classes(len(texts), linked)))
    rows = kept.collect()
    assert sorted(group[r.text] for r in rows) == sorted(set(group.values())) and kept.columns == odd.columns
    clean = stages["decontamination"](spark, kept, sf)
    redacted = stages["personal_data"](spark, clean, sf)
    assert redacted.count() == clean.count() and {r.n_chars == len(r.text) for r in redacted.collect()} == {True}
    pieces = stages["packing"](spark, redacted, sf)
    assert pieces.where("start = 0").count() == clean.count()
    nulls = docs.limit(4).withColumn("text", F.lit(None).cast("string"))
    for name, expected in (("language", 0), ("near_duplicates", 1), ("decontamination", 4), ("personal_data", 4)):
        assert stages[name](spark, nulls, sf).count() == expected, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
