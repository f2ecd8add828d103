"""Vector arithmetic as Column functions, and encoders from texts to vectors."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkloom.functions.arrays import let


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; vectors of unequal length give null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda v: F.try_divide(dot(v["a"], v["b"]), norm(v["a"]) * norm(v["b"])))


class Encoder(Protocol):
    """From texts without nulls to one vector each, as the rows of a matrix.

    additive: the vector of texts joined by white space is the sum of theirs, so windows of sentences need
    not be joined and read again.
    """

    additive: bool

    def encode(self, texts: pa.Array) -> np.ndarray: ...


@dataclass(frozen=True)
class LetterCounts:
    """A deterministic stand-in for a model: how often each letter a to z occurs, whatever its case."""

    additive: bool = True

    def encode(self, texts: pa.Array) -> np.ndarray:
        texts = pc.utf8_lower(texts).cast(pa.large_string())
        n = len(texts)
        if not n:
            return np.zeros((0, 26))
        offsets = np.frombuffer(texts.buffers()[1], "<i8", n + 1, 8 * texts.offset)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        letter = data - np.uint8(97)  # bytes below wrap round to large values
        at = np.flatnonzero(letter < 26)
        owner = np.repeat(np.arange(n), np.diff(offsets))[at]
        return np.bincount(owner * 26 + letter[at], minlength=26 * n).reshape(n, 26).astype(float)


LETTERS = LetterCounts()


@dataclass(frozen=True)
class Model:
    """An encoder from a function over lists of texts, called for batch_size texts at a time.

    A failing call is tried again after a delay; the last failure fails the task, which Spark retries.
    """

    call: Callable[[list[str]], Sequence[Sequence[float]]]
    batch_size: int = 10
    tries: int = 3
    delay: float = 36.0
    additive: bool = False

    def encode(self, texts: pa.Array) -> np.ndarray:
        flat, vectors = texts.to_pylist(), []
        for start in range(0, len(flat), self.batch_size):
            for left in reversed(range(self.tries)):
                try:
                    vectors += self.call(flat[start : start + self.batch_size])
                    break
                except Exception:
                    if not left:
                        raise
                    time.sleep(self.delay)
        return np.asarray(vectors, float).reshape(len(flat), -1)


def encoded(text: Column, encoder: Encoder = LETTERS) -> Column:
    """The vector of each text; null of a null one. Batches of texts travel as Arrow."""

    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        matrix = encoder.encode(texts.fill_null(""))
        if not len(texts):
            return pa.array([], pa.list_(pa.float64()))
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * matrix.shape[1], mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()))

    return vectors(text)


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """Half up, as SQL rounds."""
    return np.floor(values * 10.0**digits + 0.5) / 10.0**digits


def neighbour_cosines(texts: pa.Array, starts: np.ndarray, ends: np.ndarray, encoder: Encoder, buffer_size: int = 0, separator: str = " ") -> np.ndarray:
    """For each text, the cosine similarity of it and the next one, each joined with buffer_size texts on both sides.

    starts and ends bound the documents among the texts; windows end with them. Not a number where a text
    is the last of its document, or a vector is zero.
    """
    n = len(texts)
    first, last = (np.repeat(x, ends - starts) for x in (starts, ends))
    at = np.concatenate([np.arange(a, b) for a, b in zip(starts.tolist(), ends.tolist())]) if len(starts) else np.zeros(0, np.int64)
    low, high = np.maximum(at - buffer_size, first), np.minimum(at + buffer_size + 1, last)
    out = np.full(n, np.nan)
    if not len(at):
        return out
    if buffer_size and not encoder.additive:
        flat = texts.to_pylist()
        groups = encoder.encode(pa.array([separator.join(flat[a:b]) for a, b in zip(low.tolist(), high.tolist())], pa.string()))
    else:
        vectors = encoder.encode(texts)
        groups = vectors[at]
        if buffer_size:
            upto = np.concatenate([np.zeros((1, vectors.shape[1])), np.cumsum(vectors, axis=0)])
            groups = upto[high] - upto[low]
    pair = np.flatnonzero(at + 1 < last)
    a, b = groups[pair], groups[pair + 1]
    lengths = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    with np.errstate(invalid="ignore", divide="ignore"):
        out[at[pair]] = np.where(lengths > 0, (a * b).sum(1) / lengths, np.nan)
    return out
