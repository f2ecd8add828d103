"""Chunking: one document row to many chunk rows. All of it is narrow; nothing shuffles.

A document's sentences or tokens stay one array until the last step, so neighbours need no window.
Every splitter keeps the other columns of its input, and adds chunk_idx, n_tokens and text.

Splitters over sentences are objects that find runs of them, for a batch of documents at a time, in one
Arrow function; sentences are cut, counted and joined in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions import text as tx
from chunkloom.functions import vectors as vx
from chunkloom.functions.arrays import let
from chunkloom.functions.arrays import percentile as percentile_of

#: A pattern whose matches are tokens, matched in the JVM, or a function from a text to its tokens.
Tokenizer = str | Callable[[str], Sequence]
#: A pattern whose stripped matches are sentences, or a function from the text column to an array of them.
SentenceSplitter = str | Callable[[Column], Column]


def _rows(df: DataFrame, chunks: Column, id_columns: list[str]) -> DataFrame:
    """chunks: an array of struct(n_tokens, text, ...) to rows numbered from 0."""
    # The outer form keeps the optimizer from computing the chunks once more to filter empty ones.
    exploded = df.select(*id_columns, F.posexplode_outer(chunks).alias("chunk_idx", "c")).where("chunk_idx IS NOT NULL")
    return exploded.select(*id_columns, F.col("chunk_idx").cast("long").alias("chunk_idx"), "c.*")


def _others(df: DataFrame, text_column: str) -> list[str]:
    return [c for c in df.columns if c != text_column and c not in ("chunk_idx", "n_tokens", "text")]


def token_chunks(df: DataFrame, size: int = 500, overlap: int = 100, text_column: str = "text", pattern: str = tx.WORD) -> DataFrame:
    """Runs of size tokens, each sharing overlap with the one before, joined by spaces. Text without tokens has no chunk."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    words = tx.tokens(F.coalesce(F.col(text_column), F.lit("")), pattern)
    n = F.size("_words")
    last = F.greatest(F.ceil((n - overlap) / F.lit(step)).cast("int") - 1, F.lit(0))
    starts = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda i: F.slice("_words", i * step + 1, F.lit(size)))
    keep = _others(df, text_column)
    chunks = F.transform(pieces, lambda p: F.struct(F.size(p).cast("long").alias("n_tokens"), F.array_join(p, " ").alias("text")))
    return _rows(df.withColumn("_words", words), chunks, keep)


def pack_bounds(counts: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy runs [s, e) of sentences by their token counts.

    A run ends before the sentence that would make it exceed size. The next one starts at the earliest
    later sentence that repeats at most overlap tokens and still leaves room for the sentence to come.
    A sentence larger than size is a run of its own.
    """
    upto = [0]
    for c in counts:
        upto.append(upto[-1] + c)
    out, s = [], 0
    for i in range(len(counts)):
        if i > s and upto[i + 1] - upto[s] > size:
            out.append((s, i))
            s += 1
            while s < i and (upto[i] - upto[s] > overlap or upto[i + 1] - upto[s] > size):
                s += 1
    if counts:
        out.append((s, len(counts)))
    return out


@dataclass(frozen=True)
class Batch:
    """Sentences of many documents, end to end, with their token counts; starts and ends bound the documents."""

    texts: pa.Array
    counts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class Splitter(Protocol):
    """Finds the runs [s, e) of sentences, counted from the document's first, that become its chunks."""

    def runs(self, batch: Batch) -> list[list[tuple[int, int]]]: ...


@dataclass(frozen=True)
class Packed:
    """Whole sentences packed up to size tokens, repeating up to overlap tokens of whole sentences."""

    size: int = 512
    overlap: int = 100

    def runs(self, batch: Batch) -> list[list[tuple[int, int]]]:
        counts = batch.counts.tolist()
        return [pack_bounds(counts[a:b], self.size, self.overlap) for a, b in zip(batch.starts.tolist(), batch.ends.tolist())]


@dataclass(frozen=True)
class Semantic:
    """Breaks after a sentence whose distance to the next exceeds the percentile of the document's distances.

    Sentences are encoded with buffer_size neighbours on both sides. A distance to or from a zero vector is
    unknown: it never breaks and has no part in the percentile.
    """

    percentile: float = 95
    buffer_size: int = 1
    encoder: vx.Encoder = vx.LETTERS
    separator: str = " "

    def runs(self, batch: Batch) -> list[list[tuple[int, int]]]:
        distances = vx.rounded(1.0 - vx.neighbour_cosines(batch.texts, batch.starts, batch.ends, self.encoder, self.buffer_size, self.separator), 9)
        out = []
        for a, b in zip(batch.starts.tolist(), batch.ends.tolist()):
            own = distances[a : max(a, b - 1)]
            known = np.sort(own[~np.isnan(own)])
            cuts = [0, b - a]
            if len(known):
                at = self.percentile / 100 * (len(known) - 1)
                low, high = known[int(np.floor(at))], known[int(np.ceil(at))]
                line = vx.rounded(low + (high - low) * (at - np.floor(at)), 9)
                cuts[1:1] = (np.flatnonzero(own > line) + 1).tolist()
            out.append([(s, e) for s, e in zip(cuts, cuts[1:]) if e > s])
        return out


def _batch(sents: pa.Array, counts: pa.Array) -> Batch:
    # Neither array nor any of its lists is null.
    offsets = np.asarray(sents.offsets, np.int64) - sents.offsets[0].as_py()
    return Batch(sents.flatten().cast(pa.string()), np.asarray(counts.flatten(), np.int64), offsets[:-1], offsets[1:])


def _bounds(splitter: Splitter) -> Column:
    """The runs of a splitter over _sents and _counts."""

    @F.arrow_udf("array<struct<s: int, e: int>>")
    def bounds(sents: pa.Array, counts: pa.Array) -> pa.Array:
        found = splitter.runs(_batch(sents, counts))
        return pa.array([[{"s": s, "e": e} for s, e in own] for own in found], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))

    return bounds("_sents", "_counts")


def with_sentences(df: DataFrame, text_column: str = "text", sentences: SentenceSplitter = tx.SENTENCE_LATIN, tokenizer: Tokenizer = tx.WORD) -> DataFrame:
    """Adds _sents, the sentences, and _counts, their token counts."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    split = df.withColumn("_sents", F.coalesce(sentences(text), F.array().cast("array<string>")) if callable(sentences) else tx.sentences(text, sentences))
    if not callable(tokenizer):
        return split.withColumn("_counts", F.transform("_sents", lambda s: tx.token_count(s, tokenizer)))

    @F.arrow_udf("array<int>")
    def counts(sents: pa.Array) -> pa.Array:
        return pa.array([[len(tokenizer(s)) for s in own] for own in sents.to_pylist()], pa.list_(pa.int32()))

    return split.withColumn("_counts", counts("_sents"))


def _slices(bounds: str, separator: str) -> Column:
    """Chunks of the runs of sentences in a column of bounds."""

    def cut(d: Column) -> Column:
        def piece(run: Column) -> Column:
            counts, sents = (F.slice(d[name], run["s"] + 1, run["e"] - run["s"]) for name in ("counts", "sents"))
            return F.struct(F.aggregate(counts, F.lit(0), lambda total, x: total + x).cast("long").alias("n_tokens"), F.array_join(sents, separator).alias("text"))

        return F.transform(d["bounds"], piece)

    return let(F.struct(F.col("_counts").alias("counts"), F.col("_sents").alias("sents"), F.col(bounds).alias("bounds")), cut)


def split(df: DataFrame, splitter: Splitter, text_column: str = "text", sentences: SentenceSplitter = tx.SENTENCE_LATIN, tokenizer: Tokenizer = tx.WORD, separator: str = " ") -> DataFrame:
    """The chunks that a splitter finds. A document without sentences has none."""
    keep = _others(df, text_column)
    cut = with_sentences(df, text_column, sentences, tokenizer).withColumn("_bounds", _bounds(splitter))
    return _rows(cut, _slices("_bounds", separator), keep)


def sentence_pack(df: DataFrame, size: int = 512, overlap: int = 100, **settings) -> DataFrame:
    """Whole sentences packed up to size tokens, repeating up to overlap tokens of whole sentences; settings as for split."""
    return split(df, Packed(size, overlap), **settings)


def sentence_window(df: DataFrame, window: int = 3, text_column: str = "text", sentences: SentenceSplitter = tx.SENTENCE_LATIN, tokenizer: Tokenizer = tx.WORD, separator: str = " ") -> DataFrame:
    """One row a sentence, with its window of neighbours on both sides, clipped at the document's ends."""
    keep = _others(df, text_column)

    def nodes(own: Column) -> Column:
        sents = own["sents"]

        def node(s: Column, i: Column) -> Column:
            first = F.greatest(i - window, F.lit(0))
            around = F.slice(sents, first + 1, F.least(i + window + 1, F.size(sents)) - first)
            return F.struct(F.get(own["counts"], i).cast("long").alias("n_tokens"), s.alias("text"), s.alias("original_text"), F.array_join(around, separator).alias("window"))

        return F.transform(sents, node)

    cut = with_sentences(df, text_column, sentences, tokenizer)
    return _rows(cut, let(F.struct(F.col("_sents").alias("sents"), F.col("_counts").alias("counts")), nodes), keep)


def semantic_split(df: DataFrame, percentile: float = 95, buffer_size: int = 1, encoder: vx.Encoder = vx.LETTERS, separator: str = " ", **settings) -> DataFrame:
    """Chunks by meaning, see Semantic; settings as for split. A single sentence is one chunk."""
    return split(df, Semantic(percentile, buffer_size, encoder, separator), separator=separator, **settings)


def hybrid_split(df: DataFrame, max_tokens: int = 300, primary: Splitter = Semantic(), secondary: Splitter = Packed(256, 50), text_column: str = "text", sentences: SentenceSplitter = tx.SENTENCE_LATIN, tokenizer: Tokenizer = tx.WORD, separator: str = " ") -> DataFrame:
    """Chunks of the primary splitter of at most max_tokens stay; the secondary one splits larger ones anew, from their own sentences.

    For text without spaces give sentences, tokenizer and separator that suit it (text.SENTENCE_CJK,
    text.WORD_CJK, ""); the default tokenizer would count a sentence as one token. Adds parent_idx, the
    primary chunk, and sub_idx within it; chunk_idx keeps the parents' order.
    """
    keep = _others(df, text_column)
    names = ("s", "e", "parent_idx", "sub_idx")
    kind = pa.list_(pa.struct([*((n, pa.int32()) for n in names[:2]), *((n, pa.int64()) for n in names[2:])]))

    @F.arrow_udf("array<struct<s: int, e: int, parent_idx: bigint, sub_idx: bigint>>")
    def bounds(sents: pa.Array, counts: pa.Array) -> pa.Array:
        batch = _batch(sents, counts)
        first = primary.runs(batch)
        upto = np.concatenate([[0], np.cumsum(batch.counts)])
        spans = [(a + s, a + e) for a, own in zip(batch.starts.tolist(), first) for s, e in own]
        large = [(s, e) for s, e in spans if upto[e] - upto[s] > max_tokens]
        again = secondary.runs(Batch(batch.texts, batch.counts, *np.array(large, np.int64).reshape(-1, 2).T))
        cut = dict(zip(large, again))
        out = []
        for a, own in zip(batch.starts.tolist(), first):
            out.append([dict(zip(names, (s + x, s + y, parent, k))) for parent, (s, e) in enumerate(own) for k, (x, y) in enumerate(cut.get((a + s, a + e), [(0, e - s)]))])
        return pa.array(out, kind)

    packed = with_sentences(df, text_column, sentences, tokenizer).withColumn("_bounds", bounds("_sents", "_counts"))
    chunks = F.zip_with(_slices("_bounds", separator), F.col("_bounds"), lambda c, b: F.struct(b["parent_idx"].alias("parent_idx"), b["sub_idx"].alias("sub_idx"), c["n_tokens"].alias("n_tokens"), c["text"].alias("text")))
    return _rows(packed, chunks, keep)


def adjacent_similarity(df: DataFrame, percentile: float = 95, encoder: vx.Encoder = vx.LETTERS, text_column: str = "text", sentences: SentenceSplitter = tx.SENTENCE_LATIN) -> DataFrame:
    """The plotted series: similarity of each unbuffered sentence to the next, and the percentile of a document's similarities.

    That line is not the rule of semantic_split. Documents of fewer than two sentences have no rows.
    """
    keep = _others(df, text_column)

    @F.arrow_udf("array<double>")
    def similarities(sents: pa.Array) -> pa.Array:
        offsets = np.asarray(sents.offsets, np.int64) - sents.offsets[0].as_py()
        found = vx.rounded(vx.neighbour_cosines(sents.flatten().cast(pa.string()), offsets[:-1], offsets[1:], encoder), 9)
        return pa.array([[None if np.isnan(x) else x for x in found[a : b - 1].tolist()] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.list_(pa.float64()))

    several = with_sentences(df, text_column, sentences).where(F.size("_sents") >= 2)
    sims = several.withColumn("_sims", similarities("_sents"))
    line = sims.withColumn("threshold", F.round(percentile_of(F.col("_sims"), percentile / 100), 6))
    return line.select(*keep, "threshold", F.posexplode_outer("_sims").alias("pos", "similarity")).select(*keep, F.col("pos").cast("long").alias("pos"), "similarity", "threshold")


def overlap_preview(df: DataFrame, overlap: int, text_column: str = "text", sentences: SentenceSplitter = tx.SENTENCE_LATIN, size: int = 500) -> DataFrame:
    """The end of a document's first packed chunk and the start of its second, overlap characters each, stripped.

    Counts characters by a number of tokens, for display only. Documents of one chunk have no row.
    """
    keep = _others(df, text_column)
    packed = with_sentences(df, text_column, sentences).withColumn("_bounds", _bounds(Packed(size, overlap))).where(F.size("_bounds") > 1)
    first, second = F.get(_slices("_bounds", " "), F.lit(0))["text"], F.get(_slices("_bounds", " "), F.lit(1))["text"]
    return packed.select(*keep, tx.strip(F.right(first, F.lit(overlap))).alias("end_of_first"), tx.strip(F.left(second, F.lit(overlap))).alias("start_of_second"))
