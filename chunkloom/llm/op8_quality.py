"""Quality classifier: supervised subword embeddings.

A token has a learned vector, the mean of the hashed vectors of itself and its character n-grams; a
document is the mean of its tokens, and a softmax over the classes follows. Trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows, in one task. As the mean is linear,
scoring needs one number for each distinct token.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm._shared import documents
from chunkloom.llm.learn import fit_in_one_task, score_texts, training_rows
from chunkloom.llm.words import WordTable, feature_buckets

#: About so many labelled rows train the model: those with the least hash of their id.
TRAIN_ROWS = 6000
BITS, DIM, EPOCHS, RATE = 18, 8, 6, 0.5
SIZES = (2, 3, 4)
THRESHOLD = 0.7


#: Marks beside the words of a text: a word that repeats the one before it, and a word of a line that was there before.
SAME_WORD, SAME_LINE = "\x02word", "\x02line"


def tokens(text: str | None) -> list[str]:
    """Words between white space, and a mark for each repeated one."""
    words = text.split() if text else []
    marks = [SAME_WORD for a, b in zip(words, words[1:]) if a == b]
    if text and "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line in seen:
                marks += [SAME_LINE] * len(line.split())
            seen.add(line)
    return words + marks if marks else words


def document_features(texts: list[str], bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and their weights, which add up to 1."""
    out = []
    for text in texts:
        words, counts = np.unique(np.array(tokens(text), object), return_counts=True) if text.split() else ([], [])
        bucket, owner = feature_buckets(list(words), SIZES, bits)
        if not len(bucket):
            out.append((bucket, np.zeros(0, np.float32)))
            continue
        weight = (np.asarray(counts) / np.sum(counts) / np.bincount(owner))[owner]
        unique, inverse = np.unique(bucket, return_inverse=True)
        out.append((unique, np.bincount(inverse, weight).astype(np.float32)))
    return out


def learned(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vector of each bucket, the softmax's weights, and its biases. Labels are 0 or 1."""
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    found = document_features(texts)
    total = max(1, epochs * len(texts))
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            pace = rate * (1 - step / total)
            step += 1
            bucket, weight = found[i]
            hidden = weight @ vectors[bucket]
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= pace * np.outer(hidden, p)
            bias -= pace * 0.1 * p
            # A document's mean moves by the sum of many small weights; scale the step so that it does move.
            vectors[bucket] -= pace * (weight / max(float(weight @ weight), 1e-6) * 0.5)[:, None] * back if len(bucket) else 0
    return vectors, out, bias


def fit(texts: list[str], labels: list[int]) -> bytes:
    """Vectors and softmax folded into one weight a bucket, then the bias, as float32 bytes."""
    vectors, out, bias = learned(texts, labels)
    return np.append(vectors @ (out[:, 1] - out[:, 0]), bias[1] - bias[0]).astype("<f4").tobytes()


class Scorer:
    def __init__(self, model: bytes) -> None:
        weights = np.frombuffer(model, "<f4")
        self.bias, folded = float(weights[-1]), weights[:-1]

        def score(words: list[str]) -> np.ndarray:
            bucket, owner = feature_buckets(words, SIZES, BITS)
            return (np.bincount(owner, folded[bucket], len(words)) / np.maximum(np.bincount(owner, minlength=len(words)), 1))[:, None]

        self.table = WordTable(score)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        split = [tokens(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        rows = self.table.rows([w for words in split for w in words])[:, 0].astype(np.float64)
        sums = np.diff(np.concatenate([[0.0], np.cumsum(rows)])[np.concatenate([[0], np.cumsum(counts)])])
        return 1 / (1 + np.exp(-(sums / np.maximum(counts, 1) + self.bias)))


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs, repeated ids included.

    Labels other than 0 and 1 are left out of training. Without a usable label the score is 0.5
    throughout. Null and empty texts get the score of a text without words; equal texts get equal scores.
    """
    model = fit_in_one_task(training_rows(docs, labels, "quality", train_rows), fit)
    return score_texts(docs, model, Scorer).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
