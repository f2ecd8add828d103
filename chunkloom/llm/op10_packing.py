"""Packing by first-fit decreasing over a tournament tree of bin capacities.

Documents are encoded where they are read; only piece lengths and checksums travel on. They are
dealt by a seeded hash of what they are and where they were read, so a hot source, id or text cannot
fill one task. A task cuts what it gets into groups of at most group_docs documents and packs each
on its own: pieces in falling length go to the leftmost open sequence with room, found by descending
a tree whose inner nodes hold the largest room below them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm._shared import documents, map_arrow, slices
from chunkloom.llm.tokenize import bulk_tokenizer

SEQUENCE_TOKENS = 1024
END_ID = 0
GROUP_DOCS = 4096
SEED = 17
#: Chunks remembered by a worker, and with them its memory; see tokenize.
MEMO_ENTRIES = 120_000


class CapacityTree:
    """A tournament tree over the rooms of bins 0, 1, ...; grows by doubling."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.size, self.room = capacity, 1, [0, capacity]

    def place(self, length: int) -> tuple[int, int]:
        """Puts a piece into the leftmost bin with room; returns the bin and the piece's offset there."""
        room = self.room
        if room[1] < length:
            self._double()
            room = self.room
        node = 1
        while node < self.size:
            node *= 2
            if room[node] < length:
                node += 1
        place, offset = node - self.size, self.capacity - room[node]
        room[node] -= length
        node //= 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
        return place, offset

    def _double(self) -> None:
        leaves = self.room[self.size :] + [self.capacity] * self.size
        self.size *= 2
        self.room = [0] * self.size + leaves
        for node in range(self.size - 1, 0, -1):
            self.room[node] = max(self.room[2 * node], self.room[2 * node + 1])


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each piece; no length may exceed capacity. Equal lengths keep their order."""
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    tree, full = CapacityTree(capacity), 0
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    while full < len(order) and lengths[order[full]] == capacity:  # a full piece always opens the next bin
        out[order[full]] = (full, 0)
        full += 1
    for i in order[full:]:
        place, offset = tree.place(lengths[i])
        out[i] = (full + place, offset)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode_lengths(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Per document: doc_id, doc_tokens and the checksums of its consecutive pieces of at most capacity ids."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bulk_tokenizer(vocabulary, MEMO_ENTRIES)
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                tokens, at = encoder.encode(piece.column(1))
                raw = [tokens[a:b].tobytes() + end for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                crc = [[zlib.crc32(x[i : i + 4 * capacity]) for i in range(0, len(x), 4 * capacity)] for x in raw]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array(crc, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "crc"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, doc_tokens long, crc array<long>")


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = SEQUENCE_TOKENS, group_docs: int = GROUP_DOCS, seed: int = SEED) -> DataFrame:
    """One row a piece with its sequence and offset. Null text is an empty document (its end id alone);
    null and repeated ids are packed like any other row; an empty table gives no rows.

    Tasks are as many as the session's shuffle partitions, fewer where the groups are fewer: what a task
    packs grows with the input, group after group, and the number of partitions does not. Which documents
    meet in a group depends on the seed and on how the table is split; rows alike in id and tokens are
    interchangeable. Pieces of equal length keep the order in which their task got them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, held, rows
            table = pa.Table.from_batches(held)
            ids, tokens, crcs = (table.column(i).to_pylist() for i in range(3))
            pieces = [(d, k * capacity, min(capacity, n - k * capacity), c, n) for d, n, crc in zip(ids, tokens, crcs) for k, c in enumerate(crc)]
            placed = first_fit_decreasing([p[2] for p in pieces], capacity)
            columns = [*zip(*pieces), [base + b for b, _ in placed], [o for _, o in placed]]
            base += 1 + max(b for b, _ in placed)
            held, rows = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, group_docs - rows)
                held.append(part)
                rows += part.num_rows
                at += part.num_rows
                if rows == group_docs:
                    yield flush()
        if rows:
            yield flush()

    groups = max(1, -(-docs.select(F.lit(1)).count() // group_docs))
    tasks = min(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    encoded = encode_lengths(docs, vocabulary, end_id, capacity)
    dealt = encoded.repartition(tasks, F.xxhash64(F.lit(seed), "doc_id", "doc_tokens", "crc", F.monotonically_increasing_id()))
    return map_arrow(dealt, run, PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
