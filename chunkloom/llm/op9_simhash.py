"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are split in max_bits + 1 blocks of bits: two that differ in at most max_bits bits agree
on a block, so each link lies in at least one group of equal (block mask, block value). Each group is
a binary trie over its sorted fingerprints, and pairs of its nodes are traversed together, level by
level: the bits in which the two sides differ are added up and a pair is pruned as soon as they
exceed the budget. Groups that are too large for a task's memory are split further by the same
argument on their remaining bits, exactly and without a cap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice, tee

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from chunkloom.llm._shared import documents, free_names, map_arrow, slices, written
from chunkloom.llm.components import connected

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Distinct fingerprints of one group that a task traverses at once; larger groups are split.
GROUP_ROWS = 100_000
#: Node pairs held at once.
FRONTIER = 1 << 20
#: Shingle hashes whose bits are counted at once; and UTF-8 bytes of a text from which its words are no longer listed.
BLOCK_HASHES, LONG_BYTES = 1 << 16, 4 << 20
#: Documents of one fingerprint from which their class is broadcast: such fingerprints number at most the rows through this.
HOT_ROWS = 20_000
#: Rows to drop, one long each, are broadcast up to so many.
BROADCAST_ROWS = 500_000

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def _shingles(text: str, shingle_words: int) -> Iterator[tuple[bytes, ...]]:
    raw = text.encode().lower()
    if len(raw) > LONG_BYTES:  # words one by one: a list of them takes many times the text
        ways = tee((m[0] for m in _WORD.finditer(raw)), shingle_words)
        first = tuple(islice((m[0] for m in _WORD.finditer(raw)), shingle_words))
        return zip(*(islice(way, k, None) for k, way in enumerate(ways))) if len(first) >= shingle_words else iter([first] if first else [])
    words = raw.split()
    return zip(*(words[k:] for k in range(shingle_words))) if len(words) >= shingle_words else iter([words] if words else [])


def fingerprints(texts: list[str | None], shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit SimHash of each text, as uint64: the majority of the XXH64 of its word shingles, repeats counted.

    Bits are counted for a block of hashes at a time, so memory follows the block and not the longest text.
    """
    from xxhash import xxh64_intdigest

    counts, ones = np.zeros(len(texts), np.int64), np.zeros((len(texts), 64), np.int64)
    hashes: list[int] = []
    owners: list[int] = []
    sizes: list[int] = []

    def count() -> None:
        # Each hash becomes 64 bytes of 0 or 1, summed as 8 words of 8 lanes; a lane holds up to 255.
        lanes = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        starts = np.cumsum([0, *sizes[:-1]])
        pieces = [np.arange(a, a + n, 255) for a, n in zip(starts.tolist(), sizes)]
        sums = np.add.reduceat(lanes, np.concatenate(pieces), axis=0).view(np.uint8).astype(np.int64)
        np.add.at(ones, owners, np.add.reduceat(sums, np.cumsum([0, *(len(p) for p in pieces[:-1])]), axis=0))
        np.add.at(counts, owners, sizes)
        hashes.clear(), owners.clear(), sizes.clear()

    for i, text in enumerate(texts):
        grams = _shingles(text, shingle_words) if text else iter(())
        while part := [xxh64_intdigest(b" ".join(g), SEED) for g in islice(grams, BLOCK_HASHES)]:
            hashes += part
            owners.append(i)
            sizes.append(len(part))
            if len(hashes) >= BLOCK_HASHES:
                count()
    if hashes:
        count()
    return np.packbits((2 * ones > counts[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_table(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long). Null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(fingerprints(piece.column(1).to_pylist(), shingle_words).view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


def split_bits(mask: int, parts: int) -> list[int]:
    """Masks of parts disjoint runs of the set bits of mask, together all of them."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in bits[len(bits) * i // parts : len(bits) * (i + 1) // parts]) for i in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Forest:
    """Components of rows seen so far; joins arrays of links at once."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
            self.root = root


def trie_links(values: np.ndarray, groups: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """values: distinct uint64 in a group, ascending by (group, value). The component root's index for each row.

    A node is a range of rows with a common prefix. All node pairs of a level are advanced together:
    (A, B) becomes the pairs of their children, with one error more where the next bit differs.
    """
    n = len(values)
    forest = _Forest(n)
    if n < 2:
        return forest.root
    borders = np.concatenate([[0], np.flatnonzero(groups[1:] != groups[:-1]) + 1, [n]])
    prefix: dict[int, np.ndarray] = {}

    def ones(level: int) -> np.ndarray:
        if level not in prefix:
            prefix[level] = np.concatenate([[0], np.cumsum((values >> np.uint64(level)) & np.uint64(1), dtype=np.int64)]).astype(np.int32)
        return prefix[level]

    lo, hi = borders[:-1].astype(np.int32), borders[1:].astype(np.int32)
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    stack = [(63, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        level, alo, ahi, blo, bhi, err = stack.pop()
        if not len(alo):
            continue
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(level, *(x[:half] for x in (alo, ahi, blo, bhi, err))), (level, *(x[half:] for x in (alo, ahi, blo, bhi, err)))]
            continue
        leaves = (ahi - alo == 1) & (bhi - blo == 1)
        if leaves.any():
            i, j = alo[leaves], blo[leaves]
            near = (np.bitwise_count(values[i] ^ values[j]) <= max_bits) & (i != j)
            forest.join(i[near], j[near])
            rest = ~leaves
            alo, ahi, blo, bhi, err = alo[rest], ahi[rest], blo[rest], bhi[rest], err[rest]
        if level < 0 or not len(alo):
            continue
        p = ones(level)
        amid, bmid = ahi - (p[ahi] - p[alo]), bhi - (p[bhi] - p[blo])
        own = alo == blo  # ranges of one level are equal or disjoint
        parts = [
            (alo, amid, blo, bmid, err),
            (amid, ahi, bmid, bhi, err),
            (alo, amid, bmid, bhi, err + np.int8(1)),
            tuple(x[~own] for x in (amid, ahi, blo, bmid, err + np.int8(1))),  # a node against itself crosses once
        ]
        merged = [np.concatenate(x) for x in zip(*parts)]
        keep = (merged[1] > merged[0]) & (merged[3] > merged[2]) & (merged[4] <= max_bits)
        keep &= ~((merged[0] == merged[2]) & (merged[1] - merged[0] == 1))
        stack.append((level - 1, *(x[keep] for x in merged)))
    return forest.root


def _trie_task(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def links(block: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((block[:, 2].view(np.uint64), block[:, 1], block[:, 0]))
            block = block[order]
            new = np.concatenate([[False], (block[1:, :2] != block[:-1, :2]).any(1)])
            values = np.ascontiguousarray(block[:, 2]).view(np.uint64)
            root = trie_links(values, np.cumsum(new), max_bits)
            member = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(block[member, 2]), pa.array(block[root[member], 2])], names=["u", "v"])

        for batch in batches:
            held.append(np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]).astype(np.int64))
            rows += batch.num_rows
            if rows >= GROUP_ROWS:
                block = np.concatenate(held)
                last = len(block) - 1  # rows come sorted by group: the last one may go on
                whole = int(np.flatnonzero((block[:, :2] != block[last, :2]).any(1))[-1]) + 1 if (block[0, :2] != block[last, :2]).any() else 0
                if whole:
                    yield links(block[:whole])
                held, rows = [block[whole:]], len(block) - whole
        if rows:
            yield links(np.concatenate(held))

    return run


def links(values: DataFrame, max_bits: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """values: distinct longs (fp). Links (u, v) that join all values within max_bits of each other:
    of each group's links a spanning forest, so the count never exceeds the rows of the groups."""
    full = (1 << 64) - 1
    children = {0: split_bits(full, max_bits + 1)}
    rows = values.select(F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("value"), "fp")
    found = None
    while True:
        below = {m: [m | part for part in split_bits(full & ~m, max_bits + 1)] for m in children} if 0 not in children else {0: children[0]}
        masks = F.create_map(*[x for m, subs in below.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in subs]))])
        rows = rows.select(F.explode(F.element_at(masks, F.col("mask"))).alias("mask"), "fp").select("mask", F.expr("fp & mask").alias("value"), "fp")
        unions = [s for subs in below.values() for s in subs]
        if len(set(unions)) < len(unions):
            # Different masks can grow to the same one, which then has each value once for each of them.
            rows = rows.distinct()
        fixed = min(bin(s).count("1") for s in unions)
        hot = rows.groupBy("mask", "value").count().where(F.col("count") > group_rows).select("mask", "value")
        # Once the free bits allow no more than group_rows values a group, none can be larger.
        hot = written(hot, "hot") if 1 << (64 - fixed) > group_rows else None
        again = hot is not None and not hot.isEmpty()
        now = rows.join(hot, ["mask", "value"], "left_anti") if again else rows
        got = now.repartition("mask", "value").sortWithinPartitions("mask", "value").select("mask", "value", "fp").mapInArrow(_trie_task(max_bits), "u long, v long")
        found = got if found is None else found.unionByName(got)
        if not again:
            return found
        rows = rows.join(hot, ["mask", "value"], "left_semi")
        children = {s: [] for s in unions}


def _rooted(values: DataFrame, max_bits: int, group_rows: int) -> DataFrame:
    """values: distinct fp and other columns, which stay. Adds root, the least fp of the component."""
    stars = connected(links(values.select("fp"), max_bits, group_rows))
    return values.join(stars.withColumnsRenamed({"u": "fp", "v": "root"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS, group_rows: int = GROUP_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the least doc_id reachable over links of at most max_bits bits.

    Every row of docs gives one row, repeated ids too. Null ids are never a component's id unless it
    has no other. An empty table gives an empty result; other columns are ignored. Fingerprints that very
    many rows share (copies, empty texts) meet their class by a broadcast, so they fill no task.
    """
    table = written(fingerprint_table(docs, shingle_words), "fingerprints")
    distinct = written(table.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")), "distinct")
    rooted = written(_rooted(distinct, max_bits, group_rows), "rooted")
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id", "n")
    hot = F.broadcast(written(classes.where(F.col("n") > hot_rows).select("fp", "component_id"), "hot_classes"))
    cold = table.join(hot.select("fp"), "fp", "left_anti").join(classes.select("fp", "component_id"), "fp")
    return cold.unionByName(table.join(hot, "fp")).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS, group_rows: int = GROUP_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row of docs for each group of near-duplicates: that with the least doc_id, then the least hash of its text.

    Groups are told apart by their texts alone: rows that share an id, or have none, and hold different
    texts are different documents. A row without an id stays only if its group has no named one. Null and
    wordless texts are one group. An empty table gives an empty result.
    """
    key, text_key, at, fp = free_names(docs, "_key", "_text_key", "_at", "_fp")
    sources = docs.select("*", F.col("doc_id").cast("long").alias(key), F.xxhash64("text").alias(text_key), F.monotonically_increasing_id().alias(at), F.col("text").cast("string").alias(fp))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, fp, 1 << 20):
                found = fingerprints(piece.column(piece.num_columns - 1).to_pylist(), shingle_words).view(np.int64)
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(found)], names=piece.schema.names)

    # Written with a number of its own, each row is found again by it, whatever its id and text.
    table = written(map_arrow(sources, run, StructType([*sources.schema.fields[:-1], StructField(fp, LongType())])), "fingerprints")
    rows = table.select(F.col(fp).alias("fp"), F.struct(F.col(key).isNull().alias("unnamed"), F.col(key).alias("doc_id"), F.col(text_key).alias("text_key"), F.col(at).alias("at")).alias("best"))
    distinct = written(rows.groupBy("fp").agg(F.min("best").alias("best")), "distinct")
    kept = written(_rooted(distinct, max_bits, group_rows).groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.at").alias(at)), "kept")
    lost = written(table.select(at).join(kept, at, "left_anti"), "lost")
    # Texts only move if the rows to drop are too many to be broadcast.
    left = table.join(F.broadcast(lost), at, "left_anti") if lost.count() <= broadcast_rows else table.join(kept, at, "left_semi")
    return left.select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
