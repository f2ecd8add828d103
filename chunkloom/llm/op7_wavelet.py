"""Token shards as wavelet matrices.

A shard is one compressed file of consecutive documents' token ids. Ids are mapped to a dense
alphabet and kept as bit-planes, highest bit first; each plane is the stable split of the one above
by its bit, with a rank directory. That gives access, rank, select, counts and occurrence lookup
straight from the file's bytes, without unpacking it.

Shards are rows of a Parquet table (part, seq, start_in_part, n_tokens, shard), so that Spark's own
committer writes them on any file system and a lost executor only costs its task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.llm._shared import documents, map_arrow, slices, written
from chunkloom.llm.tokenize import bulk_tokenizer

SHARD_TOKENS = 1 << 19
END_ID = 2
#: Chunks remembered by a worker, and with them its memory; see tokenize.
MEMO_ENTRIES = 700_000
MAGIC = b"CLWM1\0\0\0"
#: Bits between two entries of a plane's rank directory.
RANK_STEP = 4096

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _packed(raw: bytes) -> bytes:
    body = zlib.compress(raw, 6)
    return struct.pack("<I", len(body)) + body


def build_shard(tokens: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of a shard: tokens of all its documents in order, with the documents' ids and token counts."""
    count = np.bincount(tokens) if len(tokens) else np.zeros(0, np.int64)
    alphabet = np.flatnonzero(count).astype("<u4")
    to_dense = np.zeros(len(count), np.uint32 if len(alphabet) > 1 << 16 else np.uint16)
    to_dense[alphabet] = np.arange(len(alphabet))
    level = to_dense[tokens] if len(tokens) else to_dense[:0]
    planes = max(1, int(max(0, len(alphabet) - 1)).bit_length())
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    out = [MAGIC, struct.pack("<QIIB", len(tokens), len(doc_ids), len(alphabet), planes)]
    out += [_packed(alphabet.tobytes()), _packed(ids.tobytes() + bytes(d is None for d in doc_ids)), _packed(np.array(lengths, "<u4").tobytes())]
    for k in reversed(range(planes)):
        bit = (level & (1 << k)) != 0
        bits = np.packbits(bit)
        low = level[~bit]
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(_ONES[bits], np.arange(0, len(bits), RANK_STEP // 8), dtype=np.uint32))]) if len(bits) else np.zeros(1)
        out += [struct.pack("<QI", len(low), len(ranks)), ranks.astype("<u4").tobytes(), bits.tobytes()]
        level = np.concatenate([low, level[bit]])
    return b"".join(out)


class Shard:
    """Reads a shard's bytes. Positions count the shard's tokens from 0."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.n, docs, sigma, self.planes = struct.unpack_from("<QIIB", raw, 8)
        at = 8 + struct.calcsize("<QIIB")

        def section() -> bytes:
            nonlocal at
            (size,) = struct.unpack_from("<I", raw, at)
            at += 4 + size
            return zlib.decompress(raw[at - size : at])

        self.alphabet = np.frombuffer(section(), "<u4")
        ids = section()
        self.doc_ids = [None if gone else int(d) for d, gone in zip(np.frombuffer(ids, "<i8", docs), ids[8 * docs :])]
        self.lengths = np.frombuffer(section(), "<u4")
        self.bits, self.ranks, self.zeros = [], [], []
        for _ in range(self.planes):
            zeros, m = struct.unpack_from("<QI", raw, at)
            at += 12
            self.zeros.append(zeros)
            self.ranks.append(np.frombuffer(raw, "<u4", m, at))
            at += 4 * m
            size = (self.n + 7) // 8
            self.bits.append(np.frombuffer(raw, np.uint8, size, at))
            at += size

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // RANK_STEP
        lo, hi = block * RANK_STEP // 8, i // 8
        total = int(self.ranks[plane][block]) + int(_ONES[self.bits[plane][lo:hi]].sum())
        return total + (int(_ONES[self.bits[plane][hi] >> (8 - i % 8)]) if i % 8 else 0)

    def access(self, i: int) -> int:
        """The token id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.planes):
            bit = int(self.bits[p][i // 8]) >> (7 - i % 8) & 1
            ones = self._ones(p, i)
            i = self.zeros[p] + ones if bit else i - ones
            value = value << 1 | bit
        return int(self.alphabet[value])

    def _symbol(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def _run(self, symbol: int, i: int) -> tuple[int, int]:
        """Where, below the last plane, the symbol's occurrences among the first i tokens lie."""
        lo, hi = 0, i
        for p in range(self.planes):
            a, b = self._ones(p, lo), self._ones(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if symbol >> (self.planes - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often a token id occurs among the first i tokens."""
        symbol = self._symbol(token)
        if symbol is None:
            return 0
        lo, hi = self._run(symbol, min(i, self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """The position of occurrence j (from 0) of a token id."""
        symbol = self._symbol(token)
        if symbol is None or not 0 <= j < self.count(token):
            raise IndexError(j)
        i = self._run(symbol, 0)[0] + j
        for p in reversed(range(self.planes)):
            one = symbol >> (self.planes - 1 - p) & 1
            i = self._select_bit(p, one, i - self.zeros[p] if one else i)
        return i

    def _select_bit(self, plane: int, one: int, j: int) -> int:
        ranks = self.ranks[plane].astype(np.int64)
        before = ranks if one else np.arange(len(ranks)) * RANK_STEP - ranks
        block = int(np.searchsorted(before[:-1], j, "right")) - 1
        lo = block * RANK_STEP
        found = np.flatnonzero(np.unpackbits(self.bits[plane][lo // 8 : (lo + RANK_STEP) // 8]) == one)
        return lo + int(found[j - int(before[block])])

    def locate(self, token: int) -> list[int]:
        """All positions of a token id, ascending."""
        return [self.select(token, j) for j in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All token ids, rebuilt from the deepest plane up."""
        kind = np.uint32 if len(self.alphabet) > 1 << 16 else np.uint16
        level = np.zeros(self.n, kind)
        for p in reversed(range(self.planes)):
            bit = np.unpackbits(self.bits[p], count=self.n).view(bool)
            above = np.empty(self.n, kind)
            above[~bit] = level[: self.zeros[p]]
            above[bit] = level[self.zeros[p] :] | kind(1 << (self.planes - 1 - p))
            level = above
        return self.alphabet[level] if self.n else self.alphabet[:0]


def write_shards(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes documents in ascending doc_id order and writes them as shards; returns the written table.

    Null ids come first, null text is empty, documents of one id are ordered by a hash of their text,
    and by the text where hashes meet. A range partitioning on id, hash and place of reading orders
    shards across tasks, so rows that share an id, or have none, are spread over as many tasks as their
    number asks for. A task holds one shard at a time, and a document longer than shard_tokens is a
    shard of its own. An empty table gives no shards.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bulk_tokenizer(vocabulary, MEMO_ENTRIES)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        encoded: list[np.ndarray] = []
        lengths: list[int] = []
        held = 0
        end = np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            nonlocal seq, start, ids, encoded, lengths, held
            total = held
            out = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int64()), (start, pa.int64()), (total, pa.int64()), (build_shard(np.concatenate(encoded), ids, lengths), pa.binary()))], names=["part", "seq", "start_in_part", "n_tokens", "shard"])
            seq, start, ids, encoded, lengths, held = seq + 1, start + total, [], [], [], 0
            return out

        for batch in batches:
            for piece in slices(batch, "text"):
                tokens, at = encoder.encode(piece.column(1))
                for doc_id, a, b in zip(piece.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    if held and held + b - a + 1 > shard_tokens:
                        yield flush()
                    ids.append(doc_id)
                    encoded += [tokens[a:b], end]
                    lengths.append(b - a + 1)
                    held += b - a + 1
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"key": F.xxhash64("text"), "read_at": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange("doc_id", "key", "read_at").sortWithinPartitions("doc_id", "key", "text").select("doc_id", "text")
    return written(map_arrow(ordered, run, "part int, seq long, start_in_part long, n_tokens long, shard binary"), "shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, read back from shards: doc_id, start, n_tokens, ids_crc32 over the ids as uint32."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for each task that wrote shards: small whatever the input, so one window over them is safe.
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(raw.as_py())
                ends = np.cumsum(shard.lengths, dtype=np.int64)
                view = memoryview(shard.tokens().astype("<u4").tobytes())
                starts = ends - shard.lengths
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + first, pa.int64()), pa.array(shard.lengths.astype(np.int64), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = shards.join(F.broadcast(before), "part").select((F.col("before") + F.col("start_in_part")).alias("first"), "shard")
    return map_arrow(placed, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(documents(spark, sf_dir)))
