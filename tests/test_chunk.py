import random
import re

import numpy as np
import pytest

from chunkloom.functions import text as tx
from chunkloom.functions import vectors as vx
from chunkloom.operators import chunk
from pyspark.sql import functions as F

SPACES = ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", " "]


def texts(n, seed=5):
    rng = random.Random(seed)
    parts = ["a", "bb ccc", "。", "！", "…", "?", "!", ".", "你好", "😀", "x\ty", *SPACES]
    return ["", " ", "。。！", "\n\n", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n))]


def test_sentences_equal_a_loop(spark):
    found = texts(200)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(found)], "i int, t string")
    for pattern in (tx.SENTENCE_CJK, tx.SENTENCE_LATIN):
        got = {r.i: r.s for r in df.select("i", tx.sentences(F.col("t"), pattern).alias("s")).collect()}
        for i, t in enumerate(found):
            assert got[i] == [s.strip() for s in re.findall(pattern, t) if s.strip()]


def test_strip_equals_python(spark):
    found = [a + "x y" + b for a in SPACES for b in SPACES] + SPACES + ["​x", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(found)], "i int, t string")
    for r in df.select("i", tx.strip(F.col("t")).alias("s")).collect():
        assert r.s == found[r.i].strip()


@pytest.mark.parametrize(("size", "overlap"), [(5, 0), (5, 2), (3, 2), (1, 0), (100, 10)])
def test_token_chunks_equal_a_loop(spark, size, overlap):
    found = [" ".join(f"w{k}" for k in range(n)) for n in (0, 1, 2, 3, 4, 5, 6, 7, 20, 101)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(found)], "doc_id int, text string")
    got = {}
    for r in chunk.token_chunks(df, size, overlap).orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(r.doc_id, []).append(r.text.split())
        assert r.n_tokens == len(r.text.split())
    for i, t in enumerate(found):
        words, expected, start = t.split(), [], 0
        while words:
            expected.append(words[start : start + size])
            if start + size >= len(words):
                break
            start += size - overlap
        assert got.get(i, []) == expected
        if not overlap:
            assert sum(got.get(i, []), []) == words


def test_pack_bounds_invariants():
    rng = random.Random(1)
    for _ in range(500):
        counts = [rng.randint(0, 12) for _ in range(rng.randint(0, 30))]
        size, overlap = rng.randint(1, 20), rng.randint(0, 10)
        bounds = chunk.pack_bounds(counts, size, overlap)
        assert bool(bounds) == bool(counts)
        covered = set()
        for s, e in bounds:
            assert s < e and (sum(counts[s:e]) <= size or e - s == 1 or sum(counts[s : e - 1]) == 0 or e - s == 1)
            covered.update(range(s, e))
        assert covered == set(range(len(counts)))
        for (s, e), (s2, _) in zip(bounds, bounds[1:]):
            assert s < s2 <= e and sum(counts[s2:e]) <= overlap


def test_splitters_on_edges(spark):
    df = spark.createDataFrame([(0, None, "k"), (1, "", "k"), (2, "One.", "k"), (3, "One. Two!", "k"), (4, "word " * 700 + ".", "k")], "doc_id int, text string, kept string")
    sizes = {}
    for name, split in (("token", chunk.token_chunks), ("pack", chunk.sentence_pack), ("window", chunk.sentence_window), ("semantic", chunk.semantic_split), ("hybrid", chunk.hybrid_split)):
        rows = split(df).collect()
        assert all(r.kept == "k" for r in rows)
        sizes[name] = [sum(r.doc_id == i for r in rows) for i in range(5)]
    assert sizes["token"] == [0, 0, 1, 1, 2]
    assert sizes["pack"] == [0, 0, 1, 1, 1]
    assert sizes["window"] == [0, 0, 1, 2, 1]
    assert sizes["semantic"][:3] == [0, 0, 1]
    assert sizes["hybrid"][4] == 1


def test_window_contains_its_core(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(20)
    assert chunk.sentence_window(df, 2).where(~F.contains("window", F.col("original_text"))).count() == 0


def test_hybrid_has_at_least_the_semantic_chunks(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    parts = chunk.hybrid_split(df, 100, secondary=chunk.Packed(60, 10))
    assert parts.select("doc_id", "parent_idx").distinct().count() == chunk.semantic_split(df).count()
    assert parts.groupBy("doc_id").agg((F.max("chunk_idx") + 1 == F.count("*")).alias("ok")).where("NOT ok").count() == 0


def test_narrow_plans_do_not_shuffle(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for split in (chunk.token_chunks, chunk.sentence_pack, chunk.sentence_window, chunk.semantic_split, chunk.hybrid_split):
        assert "Exchange" not in split(df)._jdf.queryExecution().executedPlan().toString()


def lengths(batch):
    return [[float(len(t)), 1.0] for t in batch]


def test_model_batches_and_retries(spark):
    import pyarrow as pa

    calls, failures = [], [1, 1]

    def call(batch):
        calls.append(len(batch))
        if failures:
            failures.pop()
            raise OSError("busy")
        return lengths(batch)

    assert vx.Model(call, batch_size=2, delay=0).encode(pa.array(["Aa", "Bbbb", "C"])).tolist() == [[2.0, 1.0], [4.0, 1.0], [1.0, 1.0]]
    assert calls == [2, 2, 2, 1]
    with pytest.raises(OSError, match="busy"):
        vx.Model(lambda batch: (_ for _ in ()).throw(OSError("busy")), tries=2, delay=0).encode(pa.array(["x"]))
    df = spark.createDataFrame([(0, "Aa"), (1, None), (2, "")], "doc_id int, text string")
    assert {r.doc_id: r.v for r in df.select("doc_id", vx.encoded(F.col("text"), vx.Model(lengths)).alias("v")).collect()} == {0: [2.0, 1.0], 1: None, 2: [0.0, 1.0]}


def semantic(sents, call, percentile, buffer):
    """Chunks by a plain loop."""
    groups = [" ".join(sents[max(0, i - buffer) : i + buffer + 1]) for i in range(len(sents))]
    v = np.array(call(groups), float).reshape(len(sents), -1)
    d = [round(1 - float(a @ b) / float(np.sqrt(a @ a) * np.sqrt(b @ b)), 9) for a, b in zip(v, v[1:])]
    line = round(float(np.percentile(d, percentile)), 9) if d else 0
    out, now = [], []
    for i, s in enumerate(sents):
        now.append(s)
        if i + 1 == len(sents) or d[i] > line:
            out.append(" ".join(now))
            now = []
    return out


@pytest.mark.parametrize("buffer", [0, 1, 2])
def test_semantic_split_with_a_model(spark, buffer):
    """Any Python function can be the model: in semantic and hybrid splits and in the plotted series."""
    rng = random.Random(buffer)
    docs = [[f"{'w' * rng.randint(1, 9)} {k}." for k in range(rng.randint(1, 12))] for _ in range(25)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)] + [(99, None)], "doc_id int, text string")
    got = {}
    for r in chunk.semantic_split(df, 60, buffer, vx.Model(lengths, batch_size=3)).orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {i: semantic(d, lengths, 60, buffer) for i, d in enumerate(docs)}
    hybrid = chunk.hybrid_split(df, 4, primary=chunk.Semantic(60, buffer, vx.Model(lengths)), secondary=chunk.Packed(4, 0))
    assert hybrid.agg(F.max("n_tokens")).first()[0] <= 4 and hybrid.select("doc_id", "parent_idx").distinct().count() == sum(map(len, got.values()))
    assert chunk.adjacent_similarity(df, encoder=vx.Model(lengths)).count() == sum(len(d) - 1 for d in docs)


def test_additive_windows_equal_joined_ones(spark, sf):
    """Letter counts of windows, summed, give the chunks that joined and re-read windows give."""
    joined = vx.LetterCounts(additive=False)
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert chunk.semantic_split(df).exceptAll(chunk.semantic_split(df, encoder=joined)).count() == 0


def test_tokenizers_and_sentences_are_parameters(spark):
    text = "你好世界，再见。" * 40
    df = spark.createDataFrame([(0, text), (1, "a-b c. d e f?")], "doc_id int, text string")
    settings = {"sentences": tx.SENTENCE_CJK, "tokenizer": tx.WORD_CJK, "separator": ""}
    whole = chunk.hybrid_split(df.where("doc_id = 0"), 20, secondary=chunk.Packed(20, 0)).collect()
    assert [r.n_tokens for r in whole] == [1]  # without spaces everything is one token
    cut = chunk.hybrid_split(df.where("doc_id = 0"), 20, secondary=chunk.Packed(20, 0), **settings).orderBy("chunk_idx").collect()
    assert "".join(r.text for r in cut) == text and max(r.n_tokens for r in cut) <= 20 and len(cut) > 10
    by_function = chunk.split(df.where("doc_id = 1"), chunk.Packed(3, 0), tokenizer=lambda s: s.replace("-", " ").split()).collect()
    assert [(r.text, r.n_tokens) for r in by_function] == [("a-b c.", 3), ("d e f?", 3)]
    lines = chunk.split(df.where("doc_id = 1"), chunk.Packed(1, 0), sentences=lambda t: F.split(t, " ")).collect()
    assert [r.text for r in lines] == ["a-b", "c.", "d", "e", "f?"]
    windows = chunk.sentence_window(df.where("doc_id = 1"), 1, tokenizer=list).collect()
    assert [r.n_tokens for r in windows] == [6, 6]


class EveryOther:
    """A splitter of one's own: chunks of two sentences."""

    def runs(self, batch):
        return [[(k, min(k + 2, n)) for k in range(0, n, 2)] for n in (batch.ends - batch.starts).tolist()]


def test_splitters_of_ones_own(spark):
    df = spark.createDataFrame([(0, "A. B b b. C. D."), (1, "")], "doc_id int, text string")
    assert [r.text for r in chunk.split(df, EveryOther()).collect()] == ["A. B b b.", "C. D."]
    rows = chunk.hybrid_split(df, 3, primary=EveryOther(), secondary=chunk.Packed(1, 0)).collect()
    assert [(r.text, r.parent_idx, r.sub_idx) for r in rows] == [("A.", 0, 0), ("B b b.", 0, 1), ("C. D.", 1, 0)]
