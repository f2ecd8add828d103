import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chunkloom.llm import components, op9_simhash
from chunkloom.llm.op9_simhash import fingerprints, split_bits, trie_links


def simhash(text):
    own = [w for w in re.split(rb"[\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if w]
    grams = [b" ".join(own[i : i + 3]) for i in range(len(own) - 2)] if len(own) >= 3 else [b" ".join(own)] if own else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near(values, groups, bits):
    return [(i, j) for i in range(len(values)) for j in range(i) if groups[i] == groups[j] and bin(int(values[i]) ^ int(values[j])).count("1") <= bits]


def clustered(rng, n):
    base = rng.integers(0, 2**63, 5, dtype=np.uint64) * np.uint64(2)
    v = base[rng.integers(0, 5, n)]
    for _ in range(int(rng.integers(0, 5))):
        v = v ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return v


def test_fingerprints(spark, sf):
    found = [None, "", " \n", "a", "A b", "x y z", "É é É", *[r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()], "q " * 2000]
    assert fingerprints(found).tolist() == [simhash(t) for t in found]


@pytest.mark.parametrize(("block", "long"), [(7, 1 << 20), (7, 10), (1 << 16, 0)])
def test_long_texts_are_counted_in_blocks(monkeypatch, block, long):
    rng = random.Random(block + long)
    found = [None, "", "\n ", *(" ".join(rng.choice(["a", "Bc", "é", "x\ty"]) for _ in range(rng.randint(0, 40))) for _ in range(60))]
    monkeypatch.setattr(op9_simhash, "BLOCK_HASHES", block)
    monkeypatch.setattr(op9_simhash, "LONG_BYTES", long)
    assert fingerprints(found).tolist() == [simhash(t) for t in found]


@pytest.mark.parametrize("frontier", [3, 1 << 20])
def test_trie_equals_all_pairs(monkeypatch, frontier):
    monkeypatch.setattr(op9_simhash, "FRONTIER", frontier)
    rng = np.random.default_rng(3)
    for _ in range(25):
        n = int(rng.integers(1, 100))
        rows = sorted(set(zip(rng.integers(0, 3, n).tolist(), clustered(rng, n).tolist())))
        groups, values = np.array([g for g, _ in rows]), np.array([v for _, v in rows], np.uint64)
        for bits in (0, 1, 2, 3):
            assert trie_links(values, groups, bits).tolist() == classes(len(rows), near(values, groups, bits))


def test_split_bits():
    parts = split_bits((1 << 64) - 1, 3)
    assert sum(parts) == (1 << 64) - 1 and [bin(p).count("1") for p in parts] == [21, 21, 22]


@pytest.mark.parametrize("group_rows", [100, 100_000])
def test_links_equal_all_pairs(spark, group_rows):
    """600 values agree on a whole block, which the lesser limit splits further; no link may be lost."""
    rng = np.random.default_rng(7)
    some = rng.integers(0, 2**43, 600, dtype=np.uint64) << np.uint64(21) | np.uint64(12345)
    flips = [np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64) for _ in range(2)]
    unsigned = np.unique(np.concatenate([some, some[:200] ^ flips[0], some[100:300] ^ flips[0] ^ flips[1], np.array([0, 1, 3], np.uint64)]))
    values = unsigned.view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    root = {r.u: r.v for r in components.connected(op9_simhash.links(df, 2, group_rows)).collect()}
    linked = [(i, int(j)) for i in range(len(unsigned)) for j in np.flatnonzero(np.bitwise_count(unsigned[:i] ^ unsigned[i]) <= 2)]
    expected, got = {}, {}
    for v, c in zip(values, classes(len(values), linked)):
        expected.setdefault(c, set()).add(v)
        got.setdefault(root.get(v, v), set()).add(v)
    assert len(linked) > 200 and sorted(map(sorted, expected.values())) == sorted(map(sorted, got.values()))


@pytest.mark.parametrize("group_rows", [350, 100])
def test_links_where_masks_meet_again(spark, group_rows):
    """On the third split bits 0-43 are reached from two masks; both are hot here, and pairs that differ beyond 43 must not be lost."""
    rng = np.random.default_rng(11)
    some = rng.integers(0, 2**63, 610, dtype=np.uint64) << np.uint64(1)

    def agree(part, *runs):
        mask = np.uint64(sum(1 << b for lo, hi in runs for b in range(lo, hi + 1)))
        return part & ~mask | np.uint64(0x123456789ABCDEF0) & mask

    shared, first, second = agree(some[:150], (0, 43)), agree(some[150:380], (0, 34)), agree(some[380:], (0, 13), (21, 41))
    pairs = shared[:40] ^ (np.uint64(1) << np.uint64(45)) ^ (np.uint64(1) << np.uint64(60))
    unsigned = np.unique(np.concatenate([shared, first, second, pairs]))
    values = unsigned.view(np.int64).tolist()
    root = {r.u: r.v for r in components.connected(op9_simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 2, group_rows)).collect()}
    linked = [(i, int(j)) for i in range(len(unsigned)) for j in np.flatnonzero(np.bitwise_count(unsigned[:i] ^ unsigned[i]) <= 2)]
    expected, got = {}, {}
    for v, c in zip(values, classes(len(values), linked)):
        expected.setdefault(c, set()).add(v)
        got.setdefault(root.get(v, v), set()).add(v)
    assert len(linked) >= 40 and sorted(map(sorted, expected.values())) == sorted(map(sorted, got.values()))


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(150)] + [(7, 7)]
    got = {r.u: r.v for r in components.connected(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    nodes = sorted({x for e in edges for x in e})
    root = classes(len(nodes), [(nodes.index(a), nodes.index(b)) for a, b in edges])
    assert all(got.get(v, v) == nodes[root[i]] for i, v in enumerate(nodes))
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted(op9_simhash.op9_simhash(spark, sf).collect(), key=lambda r: r.doc_id)
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(int(r.fingerprint, 16) == simhash(source[r.doc_id]) for r in rows[:100])
    values = np.array([int(r.fingerprint, 16) for r in rows], np.uint64)
    linked = [(i, int(j)) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 2)]
    assert [r.component_id for r in rows] == [rows[k].doc_id for k in classes(len(rows), linked)]


def test_one_of_each_group_stays(spark):
    rows = [(3, "one two three four"), (1, "one two three four"), (1, "one two three four"), (9, "ONE two three four"), (5, "quite another text here"), (None, "one two three four"), (None, "lonely row of words"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1))
    kept = sorted((-1 if r.doc_id is None else r.doc_id) for r in op9_simhash.drop_near_duplicates(docs).collect())
    assert kept == [-1, 1, 5, 7]


def test_groups_are_told_apart_by_text(spark):
    """Different texts without an id, or under one id, all stay; of a mixed group the named row does."""
    rows = [(None, "a lonely row of words"), (None, "quite another text here"), (None, "a lonely row of words"), (1, "one two three four"), (2, "one two three four"), (2, "a text of its own")]
    rows += [(None, "five six seven eight"), (3, "five six seven eight"), (3, "the unique second text"), (3, "the unique second text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in op9_simhash.drop_near_duplicates(docs).collect()), key=str)
    expected = [(None, "a lonely row of words"), (None, "quite another text here"), (1, "one two three four"), (2, "a text of its own"), (3, "five six seven eight"), (3, "the unique second text")]
    assert kept == sorted(expected, key=str)
    shuffled = sorted(((r.doc_id, r.text) for r in op9_simhash.drop_near_duplicates(docs, broadcast_rows=0).collect()), key=str)
    assert shuffled == kept


def test_hot_fingerprints_keep_every_row(spark):
    """A third of all rows empty, a third copies: the same classes whether these are met by a broadcast or not."""
    rows = [(i if i % 5 else None, ["", "one two three four", f"row {i} alone in the table {i * 7}"][i % 3]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hot, cold = (sorted(((r.doc_id, r.fp, r.component_id) for r in op9_simhash.near_duplicates(docs, hot_rows=n).collect()), key=str) for n in (50, 10_000))
    assert hot == cold and len(hot) == 900
    kept = op9_simhash.drop_near_duplicates(docs).collect()
    assert len(kept) == len({r.component_id if r.component_id is not None else -r.fp for r in op9_simhash.near_duplicates(docs).collect()})
