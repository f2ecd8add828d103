import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkloom.llm import op7_wavelet, op10_packing
from chunkloom.llm.op7_wavelet import Shard, build_shard
from chunkloom.llm.op10_packing import first_fit_decreasing
from chunkloom.llm.tokenize import BulkTokenizer

PARTS = ["a", "B", "é", "é", " ", "  ", "\n", "\t", "\r\n", "1", "23", "'s", "'", "!", "?!", "<|endoftext|>", "　", "\xa0", "\x1c", "\x85", "日本", "σΣ", "ΑΣ ", "İ", "́", "😀", "_", "-", "'ll", "​", "ß", "x" * 70, "÷", "×", "Éa", ",", "“", " É", "|", "foo", "\0", "\0\0"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name):
    rng = random.Random(1)
    texts = [None, "", *("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(6000))]
    encoder = BulkTokenizer(public_tokenizers.path(name), memo_entries=300)
    expected = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    array = pa.array(texts, pa.string())
    for a in range(0, len(texts), 700):
        tokens, at = encoder.encode(array.slice(a, 700))
        assert [tokens[p:q].tolist() for p, q in zip(at, at[1:])] == expected[a : a + 700]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_nul_at_every_place_of_a_chunk(name):
    encoder = BulkTokenizer(public_tokenizers.path(name))
    words = ["abc", "a", "", "é", " abc", "x" * 70]
    texts = [w[:i] + "\0" * n + w[i:] for w in words for i in range(min(len(w), 6) + 1) for n in (0, 1, 2, 3)] + ["abc\0 abc", "abc abc\0\0", "\0 \0\0"]
    tokens, at = encoder.encode(pa.array(texts))
    for text, p, q in zip(texts, at, at[1:]):
        assert tokens[p:q].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text
        alone, _ = encoder.encode(pa.array([text]))
        assert alone.tolist() == tokens[p:q].tolist()


def test_equal_hashes_of_unequal_chunks_change_nothing(monkeypatch):
    """With hashes that say nothing, chunks of every length still get their own ids."""
    from chunkloom.llm import tokenize

    rng = random.Random(6)
    texts = [" ".join(rng.choice(["cat", "dog\0", "x" * 17 + "a", "x" * 17 + "b", "yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy" * 2 + "z" * rng.randint(0, 3), "abcdefgh", "abcdefghi"]) for _ in range(40)) for _ in range(30)]
    encoder = BulkTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    expected = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for multipliers in (tokenize._MULTIPLIERS, np.zeros_like(tokenize._MULTIPLIERS)):
        monkeypatch.setattr(tokenize, "_MULTIPLIERS", multipliers)
        tokens, at = encoder.encode(pa.array(texts))
        assert [tokens[p:q].tolist() for p, q in zip(at, at[1:])] == expected


@pytest.mark.parametrize("n", [0, 1, 5, 100, 5000, 70_000])
def test_shard(n):
    rng = np.random.default_rng(n)
    tokens = np.minimum(rng.zipf(1.3, n), 49_000).astype("<u4")
    shard = Shard(build_shard(tokens, [1, None, 7], [n, 0, 0]))
    assert (shard.tokens() == tokens).all() and shard.doc_ids == [1, None, 7] and shard.lengths.tolist() == [n, 0, 0]
    for i in rng.integers(0, n, 25).tolist() if n else []:
        token = int(tokens[i])
        places = np.flatnonzero(tokens == token)
        assert shard.access(i) == token and shard.rank(token, i) == (tokens[:i] == token).sum() and shard.count(token) == len(places)
        assert shard.select(token, len(places) // 2) == places[len(places) // 2]
    if n == 5000:
        assert shard.locate(int(tokens[7])) == np.flatnonzero(tokens == tokens[7]).tolist()
    assert shard.count(999_999) == 0 and shard.locate(999_999) == []
    with pytest.raises(IndexError):
        shard.access(n)


def test_shard_query(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in op7_wavelet.op7_wavelet(spark, sf).collect()}
    start = 0
    for d in docs:
        ids = np.array([*library.encode(d.text, add_special_tokens=False).ids, 2], "<u4")
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    small = op7_wavelet.read_documents(op7_wavelet.write_shards(spark.read.parquet(f"{sf}/documents.parquet").repartition(5), shard_tokens=500))
    assert {r.doc_id: (r.start, r.ids_crc32) for r in small.collect()} == {i: (r.start, r.ids_crc32) for i, r in got.items()}


def test_rows_without_an_id_are_spread_over_tasks(spark):
    """Starts are gapless, texts whole, and no task has all rows of one id, however alike the rows are."""
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("t "), F.col("id"))).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so small a table is one task
    try:
        shards = op7_wavelet.write_shards(docs, shard_tokens=2000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = {r.part: r.n for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    assert len(parts) >= 3 and max(parts.values()) < 0.6 * sum(parts.values())
    rows = sorted((r.start, r.n_tokens) for r in op7_wavelet.read_documents(shards).collect())
    assert len(rows) == 20_000 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:]))


def test_packing_partitions_do_not_grow_with_the_table(spark):
    """As many tasks as shuffle partitions at most, rows dealt evenly, whatever they have in common."""
    docs = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    packed = op10_packing.pack(docs, group_docs=10)
    rows = packed.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(rows) == 4 and max(r["count"] for r in rows) < 2400 and packed.rdd.getNumPartitions() <= 4
    assert op10_packing.pack(docs, group_docs=10_000).rdd.getNumPartitions() == 1


def test_first_fit_decreasing_equals_a_scan():
    rng = random.Random(3)
    for _ in range(300):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(0, 60))]
        bins, expected = [], [None] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            k = next((k for k, used in enumerate(bins) if used + lengths[i] <= 20), len(bins))
            if k == len(bins):
                bins.append(0)
            expected[i] = (k, bins[k])
            bins[k] += lengths[i]
        assert first_fit_decreasing(lengths, 20) == expected


@pytest.mark.parametrize("group_docs", [7, 4096])
def test_packing(spark, sf, group_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id: np.array([*library.encode(r.text, add_special_tokens=False).ids, 0], "<u4") for r in docs.collect()}
    rows = op10_packing.pack(docs, group_docs=group_docs).collect()
    upto, room = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == upto.get(r.doc_id, 0) and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        upto[r.doc_id] = r.start + r.length
    assert upto == {i: len(x) for i, x in ids.items()}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == room.get(r.sequence_id, 0)
        room[r.sequence_id] = r.offset + r.length
    assert max(room.values()) <= 1024
    if group_docs == 4096:
        assert sum(room.values()) / (1024 * len(room)) > 0.97
