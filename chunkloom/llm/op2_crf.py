"""Language identification of words by a linear-chain conditional random field.

Words are labelled with languages from affixes, character n-grams and a learned lexicon, and learned
transitions between neighbours; forward-backward gives each word's marginals, so code-switched text
gets a label where it switches. A document's language is the one with the largest sum of marginals.

Forward-backward runs over blocks of words side by side: transfer matrices of all blocks first, then
the vectors at block borders document by document, then the marginals within all blocks.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm._shared import documents, held_out, map_arrow, slices
from chunkloom.llm.learn import fit_in_one_task, training_rows
from chunkloom.llm.words import WordTable, feature_buckets

#: About so many rows with a language train the model; spliced into sequences of a fixed length for each.
TRAIN_ROWS = 4000
SEQUENCE_WORDS, SPLICES, EPOCHS, RATE = 48, 6, 3, 0.3
BITS, SIZES, AFFIXES = 18, (2, 3), (1, 2, 3)
#: A word is in a language's lexicon if it has at least this share of the word's training occurrences, and this many.
LEXICON_SHARE, LEXICON_COUNT = 0.9, 3
BLOCK = 32
UNKNOWN = "und"
#: Only so many languages are learned, those with most training rows: a model has 2 ** BITS weights for each.
MOST_LANGUAGES = 32

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters (of a Unicode category L) in lower case."""
    found = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    # The pattern also takes numerals such as fractions and Roman ones, which are no letters.
    return [part for w in found for part in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def transfer_marginals(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Marginals of each word by forward-backward. emission (words, labels) and transition (from, to) are
    positive weights; lengths are the words of each sequence, none of them 0."""
    labels = emission.shape[1]
    blocks_of = -(-lengths // BLOCK)
    first_word = np.cumsum(lengths) - lengths
    sequence = np.repeat(np.arange(len(lengths)), blocks_of)
    nth = np.arange(len(sequence)) - np.repeat(np.cumsum(blocks_of) - blocks_of, blocks_of)
    size = np.minimum(BLOCK, lengths[sequence] - nth * BLOCK)
    start = first_word[sequence] + nth * BLOCK
    order = np.argsort(-size, kind="stable")
    size, start = size[order], start[order]
    live = np.searchsorted(-size, -np.arange(BLOCK), "left")  # blocks longer than t, all in front
    n = len(size)
    opening = nth[order] == 0  # no transition leads to a sequence's first word
    matrix = np.broadcast_to(np.eye(labels, dtype=np.float32), (n, labels, labels)).copy()
    for t in range(BLOCK):
        k = int(live[t])
        if not k:
            break
        step = (matrix[:k].reshape(-1, labels) @ transition).reshape(k, labels, labels)
        if not t:
            step[opening[:k]] = np.eye(labels, dtype=np.float32)
        step = step * emission[start[:k] + t][:, None, :]
        matrix[:k] = step / step.max(axis=(1, 2), keepdims=True)
    # Vectors at borders: one step a block, for all sequences that still have one.
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    base = np.cumsum(blocks_of) - blocks_of
    by_blocks = np.argsort(-blocks_of, kind="stable")
    left = np.ones((n, labels), np.float32)
    right = np.ones((n, labels), np.float32)
    most = blocks_of[by_blocks]
    vector = np.full((len(lengths), labels), 1 / labels, np.float32)
    for b in range(int(most[0])):
        some = by_blocks[: int(np.searchsorted(-most, -b, "left"))]
        where = at[base[some] + b]
        left[where] = vector[some]
        moved = np.einsum("nij,ni->nj", matrix[where], vector[some])
        vector[some] = moved / moved.sum(1, keepdims=True)
    vector[:] = 1
    for b in range(int(most[0])):
        some = by_blocks[: int(np.searchsorted(-most, -b, "left"))]
        where = at[base[some] + blocks_of[some] - 1 - b]
        right[where] = vector[some]
        moved = np.einsum("nij,nj->ni", matrix[where], vector[some])
        vector[some] = moved / moved.sum(1, keepdims=True)
    forward = np.empty_like(emission)
    v = left
    for t in range(BLOCK):
        k = int(live[t])
        if not k:
            break
        moved = v[:k] @ transition
        if not t:
            moved[opening[:k]] = v[:k][opening[:k]]
        v = moved * emission[start[:k] + t]
        v /= v.sum(1, keepdims=True)
        forward[start[:k] + t] = v
    back = right
    for t in reversed(range(BLOCK)):
        k = int(live[t])
        if not k:
            continue
        i = start[:k] + t
        m = forward[i] * back[:k]
        moved = (emission[i] * back[:k]) @ transition.T
        back[:k] = moved / moved.sum(1, keepdims=True)
        forward[i] = m / m.sum(1, keepdims=True)
    return forward


def lexicon(sequences: list[list[str]], labels: list[int], n_labels: int) -> dict[str, int]:
    counts: dict[str, list[int]] = {}
    for own, label in zip(sequences, labels):
        for w in own:
            counts.setdefault(w, [0] * n_labels)[label] += 1
    return {w: int(np.argmax(c)) for w, c in counts.items() if max(c) >= max(LEXICON_COUNT, LEXICON_SHARE * sum(c))}


def fit(texts: list[str], languages: list[str]) -> bytes:
    """Learned weights by stochastic gradient descent on the conditional likelihood of spliced sequences.

    Documents name one language each, so switches are made: runs of words of random documents are
    joined, which is what the transitions learn from.
    """
    often = Counter(languages)
    names = sorted(sorted(often, key=lambda x: (-often[x], x))[:MOST_LANGUAGES])
    texts, languages = [t for t, x in zip(texts, languages) if x in names], [x for x in languages if x in names]
    label = [names.index(x) for x in languages]
    split = [words(t) for t in texts]
    usable = [i for i, w in enumerate(split) if w]
    n = max(1, len(names))
    lex = lexicon([split[i] for i in usable], [label[i] for i in usable], n)
    rng = np.random.default_rng(3)
    weights = np.zeros(((1 << BITS) + n, n), np.float32)
    squares = np.full_like(weights, 1e-2)
    trans, trans_squares = np.zeros((n, n)), np.full((n, n), 1e-2)
    batch, width = 64, SEQUENCE_WORDS
    for _ in range(EPOCHS if usable and len(names) > 1 else 0):
        order = rng.permutation(np.repeat(usable, max(1, SPLICES // 2)))
        for a in range(0, len(order), batch):
            rows, gold = [], []
            for i in order[a : a + batch]:
                own, tags = [], []
                while len(own) < width:
                    run = split[i]
                    length = min(int(rng.integers(4, width + 1)), len(run))
                    at = int(rng.integers(0, len(run) - length + 1))
                    own += run[at : at + length]
                    tags += [label[i]] * length
                    i = usable[int(rng.integers(len(usable)))]
                rows += own[:width]
                gold += tags[:width]
            index: dict[str, int] = {}
            inverse = np.array([index.setdefault(w, len(index)) for w in rows])
            bucket, owner = emission_features(list(index), lex)
            z = _sums(owner, weights[bucket], len(index))[inverse]
            z -= z.max(1, keepdims=True)
            marginal, expected = _chain(np.exp(z).reshape(-1, width, n), np.exp(trans))
            gold_at = np.array(gold).reshape(-1, width)
            error = marginal.reshape(-1, n).copy()
            error[np.arange(len(gold)), gold] -= 1
            by_word = _sums(inverse, error, len(index))
            touched, back = np.unique(bucket, return_inverse=True)
            step = (_sums(back, by_word[owner], len(touched)) / (len(gold) / 100)).astype(np.float32)
            squares[touched] += step * step
            weights[touched] -= RATE * step / np.sqrt(squares[touched])
            seen = np.bincount((gold_at[:, :-1] * n + gold_at[:, 1:]).ravel(), minlength=n * n).reshape(n, n)
            move = (expected - seen) / len(gold) * 100
            trans_squares += move * move
            trans -= RATE * move / np.sqrt(trans_squares)
    head = json.dumps({"names": names, "lexicon": lex}).encode()
    return len(head).to_bytes(8, "little") + head + trans.astype("<f8").tobytes() + weights.astype("<f4").tobytes()


def _sums(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows that share an index."""
    return np.stack([np.bincount(index, column, size) for column in rows.T], axis=1)


def _chain(emission: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of (sequence, word, label) and the expected count of each transition, over all sequences."""
    rows, width, n = emission.shape
    forward, back = np.empty_like(emission), np.ones_like(emission)
    v = np.full((rows, n), 1 / n)
    for t in range(width):
        v = (v @ transition if t else v) * emission[:, t]
        v /= v.sum(1, keepdims=True)
        forward[:, t] = v
    for t in range(width - 2, -1, -1):
        v = (emission[:, t + 1] * back[:, t + 1]) @ transition.T
        back[:, t] = v / v.sum(1, keepdims=True)
    marginal = forward * back
    marginal /= marginal.sum(2, keepdims=True)
    pair = forward[:, :-1, :, None] * transition * (emission[:, 1:] * back[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return marginal, pair.sum((0, 1))


def emission_features(distinct: list[str], lex: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    bucket, owner = feature_buckets(distinct, SIZES, BITS, prefixes=AFFIXES, suffixes=AFFIXES)
    known = [(i, lex[w]) for i, w in enumerate(distinct) if w in lex]
    return np.concatenate([bucket, np.array([(1 << BITS) + k for _, k in known], np.int64)]), np.concatenate([owner, np.array([i for i, _ in known], np.int64)])


class Tagger:
    def __init__(self, model: bytes) -> None:
        size = int.from_bytes(model[:8], "little")
        head = json.loads(model[8 : 8 + size])
        self.names, self.lex = head["names"], head["lexicon"]
        named = max(1, len(self.names))
        trans = np.frombuffer(model, "<f8", named * named, 8 + size).reshape(named, named)
        weights = np.frombuffer(model, "<f4", offset=8 + size + 8 * named * named).reshape(-1, named)
        self.transition = np.exp(trans - trans.max()).astype(np.float32)

        def score(new: list[str]) -> np.ndarray:
            out = np.zeros((len(new), named))
            for a in range(0, len(new), 20_000):
                part = new[a : a + 20_000]
                bucket, owner = emission_features(part, self.lex)
                for k in range(named):
                    out[a : a + len(part), k] = np.bincount(owner, weights[bucket, k], len(part))
            return np.exp(np.maximum(out - out.max(1, keepdims=True), -30)) if len(new) else out

        self.table = WordTable(score)

    def _weighed(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words of each text, their number, and the emission weights of all of them."""
        split = [words(t) for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        if not lengths.sum():
            return split, lengths, np.zeros((0, self.transition.shape[0]), np.float32)
        return split, lengths, self.table.rows([w for own in split for w in own])

    def tag(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words of each text, their number, and the marginals of all of them."""
        split, lengths, emission = self._weighed(texts)
        return split, lengths, transfer_marginals(emission, lengths[lengths > 0], self.transition) if len(emission) else emission

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        return self._labelled(*self._weighed(texts)[1:])

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and evidence: how sure a text's words are of some language each without their neighbours,
        on average, from 0 (as sure of one as of any) to 1. Transitions alone can make unknown words score high.
        With one language there is nothing to compare, and evidence is 1."""
        _, lengths, emission = self._weighed(texts)
        labels = self.transition.shape[0]
        columns = list(emission.T)
        sure = (reduce(np.maximum, columns) / reduce(np.add, columns) * labels - 1) / (labels - 1) if labels > 1 else np.ones(len(emission))
        borders = np.concatenate([[0], np.cumsum(lengths)])
        evidence = np.diff(np.concatenate([[0], np.cumsum(sure, dtype=np.float64)])[borders]) / np.maximum(lengths, 1)
        return *self._labelled(lengths, emission), evidence

    def _labelled(self, lengths: np.ndarray, emission: np.ndarray) -> tuple[list[str], np.ndarray]:
        marginal = transfer_marginals(emission, lengths[lengths > 0], self.transition) if len(emission) else emission
        borders = np.concatenate([[0], np.cumsum(lengths)])
        sums = np.diff(np.concatenate([np.zeros((1, marginal.shape[1])), np.cumsum(marginal, axis=0, dtype=np.float64)])[borders], axis=0)
        best = sums.argmax(1)
        score = np.clip(sums[np.arange(len(best)), best] / np.maximum(lengths, 1), 0, 1)
        empty = lengths == 0
        score[empty] = 0
        return [UNKNOWN if e or not self.names else self.names[b] for e, b in zip(empty.tolist(), best.tolist())], score


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> bytes:
    known = docs.select("doc_id", "lang").where("lang IS NOT NULL")
    return fit_in_one_task(training_rows(docs.select("doc_id", "text"), known, "lang", rows, "string", None), fit)


def languages(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, repeated ids included.

    Null texts and texts without a letter are `und` with score 0; so is all if nothing was learned. Of
    languages with equal sums the first by name is predicted. Languages beyond the MOST_LANGUAGES most
    frequent of the training rows are not learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                name, score = tagger.predict(piece.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(name, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_languages(docs: DataFrame, model: bytes, least_score: float, accepted: frozenset[str] | None = None, least_evidence: float = 0) -> DataFrame:
    """The rows of docs, all columns, whose language is known with at least this score and evidence (and is accepted, if a set is given).

    Each row is judged by its own text, so rows that repeat an id stay or go one by one, and rows without
    an id are treated like any other. Null texts and texts without a letter go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                name, score, evidence = tagger.judge(piece.column(piece.schema.get_field_index("text")).to_pylist())
                sure = (score >= least_score) & (evidence >= least_evidence)
                yield piece.filter(pa.array([n != UNKNOWN and s and (accepted is None or n in accepted) for n, s in zip(name, sure.tolist())], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


WORD_LABELS = "array<struct<word: string, lang: string, p: double>>"


def label_words(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and labels: each word of the text in order, its language and that label's marginal."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                split, _, marginal = tagger.tag(piece.column(1).to_pylist())
                best, at, out = marginal.argmax(1) if len(marginal) else [], 0, []
                for own in split:
                    out.append([{"word": w, "lang": tagger.names[best[at + i]] if tagger.names else UNKNOWN, "p": float(marginal[at + i, best[at + i]])} for i, w in enumerate(own)])
                    at += len(own)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(out, kind)], names=["doc_id", "labels"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, f"doc_id long, labels {WORD_LABELS}")


def op2_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return languages(docs, train(docs))
