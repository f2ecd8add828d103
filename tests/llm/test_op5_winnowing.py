import hashlib
import random
import re

import pytest

from chunkloom.llm import op5_winnowing
from oracle import connect, differences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n):
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item_id, item in items:
            iw = words(item)
            size = min(n, len(iw))
            windows = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if iw else set()
            for i in range(len(own) - size + 1 if windows else 0):
                if tuple(own[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found.add(str(item_id))
        out.append((doc_id, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out)


@pytest.mark.parametrize(("n", "alphabet", "broadcast_bytes"), [(13, 2, 10**9), (13, 3, 0), (6, 4, 10**9), (4, 3, 10**9)])
def test_equals_brute_force(spark, n, alphabet, broadcast_bytes):
    """Few distinct words make ties, repeats and overlapping hits; items run from empty to longer than a window."""
    rng = random.Random(n * alphabet)
    text = lambda most: " ".join(rng.choice(["A", "b", "É", "c9"][:alphabet]) for _ in range(rng.randint(0, most)))
    items = [(i, text(30)) for i in range(12)] + [(50, None), (51, "")]
    docs = [(i, text(60)) for i in range(60)] + [(100, None), (101, f"x {items[0][1]} y {items[1][1]}")]
    found = op5_winnowing.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), n, broadcast_bytes=broadcast_bytes)
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect())
    assert got == brute(docs, items, n)


def test_equal_items_are_one_row_of_the_join(spark):
    """A third of the benchmark repeats one item: fingerprints of it are matched once, all its ids are listed."""
    passage = " ".join(f"p{i}" for i in range(30))
    items = [(i, passage) for i in range(300)] + [(1000 + i, " ".join(f"q{i}x{j}" for j in range(20))) for i in range(600)] + [(None, passage)]
    docs = [(1, f"x {passage} y"), (1, "other"), (2, passage), (None, passage)]
    rows = op5_winnowing.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(r.n_items for r in rows) == [0, 300, 300, 300] and sorted(r.n_hit for r in rows) == [0, 30, 30, 30]


def test_one_scan_for_all_lengths(spark, sf):
    """Short items of many lengths are probed in the pass over the documents that long ones need anyway."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in range(1, 20)], "item_id long, text string")
    plan = op5_winnowing.contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [doc_id") <= 2 and "Python" not in plan and "Arrow" not in plan


def test_query_equals_sql(spark, sf, tmp_path):
    only_sql, only_spark, expected, got = differences(spark, connect(sf), op5_winnowing.op5_winnowing, op5_winnowing.ORACLE, sf, tmp_path / "out")
    assert (only_sql, only_spark) == (0, 0) and expected == got


def test_decontaminate(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    bad = {r.doc_id for r in op5_winnowing.op5_winnowing(spark, sf).where("contaminated").collect()}
    for rows in (0, 10**6):
        kept = {r.doc_id for r in op5_winnowing.decontaminate(docs, items, broadcast_rows=rows).collect()}
        assert bad and kept == {r.doc_id for r in docs.collect()} - bad


def test_native_plan(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plan = op5_winnowing.contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
