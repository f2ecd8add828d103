"""Toxicity: a logistic classifier with counterfactual regularisation.

Features are words, their affixes and character n-grams, present or absent in a text; those that tell
the classes apart best are kept. Training swaps identity terms in labelled texts for others of their
list and penalises the squared change of the score, so that naming a group neutrally moves nothing.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm._shared import documents
from chunkloom.llm.learn import fit_in_one_task, score_texts, training_rows
from chunkloom.llm.words import feature_buckets

#: About so many labelled rows train the model: those with the least hash of their id.
TRAIN_ROWS = 8000
KEPT_FEATURES = 3000
EPOCHS, RATE, DECAY, FAIRNESS, KEEP = 12, 0.3, 1e-4, 0.5, 0.4
SIZES, PREFIXES = (4, 5), (3, 4, 5, 6, 7, 8)
BITS = 60
#: Training texts whose features are counted at once.
TALLY_TEXTS = 500
THRESHOLD = 0.3

#: Identity terms; a term is swapped for another of its line.
IDENTITY_TERMS = (
    "women men girls boys people children persons adults",
    "christians muslims jews hindus buddhists atheists catholics believers",
    "black white asian african european latino american indigenous",
    "gay straight lesbian bisexual transgender queer heterosexual",
    "immigrants refugees citizens foreigners natives migrants residents",
    "frauen männer mädchen jungen menschen kinder",
    "christen muslime juden hindus buddhisten gläubige",
    "femmes hommes filles garçons gens enfants",
    "chrétiens musulmans juifs hindous bouddhistes croyants",
    "mujeres hombres niñas niños personas gente",
    "cristianos musulmanes judíos hindúes budistas creyentes",
)

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _features(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return feature_buckets(distinct, SIZES, BITS, prefixes=PREFIXES)


def identity_swaps(terms: tuple[str, ...] = IDENTITY_TERMS) -> dict[str, list[str]]:
    lists = [line.split() for line in terms]
    return {term: sorted({t for other in lists if term in other for t in other if t != term}) for terms in lists for term in terms}


def choose(found: list[np.ndarray], labels: np.ndarray, most: int) -> np.ndarray:
    """The features whose presence tells the labels apart best, by the likelihood-ratio statistic; ascending."""
    features, pos, total = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    for a in range(0, len(found), TALLY_TEXTS):  # all at once would sort every occurrence of every feature
        part = found[a : a + TALLY_TEXTS]
        features, at = np.unique(np.concatenate([features, *part]), return_inverse=True)
        old = len(at) - sum(map(len, part))
        toxic = np.repeat(labels[a : a + TALLY_TEXTS], [len(f) for f in part])
        pos = np.bincount(at, np.concatenate([pos, toxic]), len(features))
        total = np.bincount(at, np.concatenate([total, np.ones(len(at) - old)]), len(features))
    n, n_pos = len(labels), labels.sum()
    gain = np.zeros(len(features))
    for seen, row, column in ((pos, total, n_pos), (total - pos, total, n - n_pos), (n_pos - pos, n - total, n_pos), (n - total - n_pos + pos, n - total, n - n_pos)):
        expected = np.maximum(row * column / n, 1e-12)
        gain += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / expected), 0)
    best = np.argsort(-gain, kind="stable")[:most]
    return np.sort(features[best[gain[best] > 3]])


def fit(texts: list[str], labels: list[int], terms: tuple[str, ...] = IDENTITY_TERMS, fairness: float = FAIRNESS) -> bytes:
    """Kept features (int64), their weights (float64) and the bias. Labels are 0 or 1; fairness weighs the penalty."""
    y = np.array(labels, float)
    distinct = [sorted(set(words(t))) for t in texts]
    found = [np.unique(_features(d)[0]) for d in distinct]
    kept = choose(found, y, KEPT_FEATURES) if texts else np.zeros(0, np.int64)

    def columns(features: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.isin(kept, features, assume_unique=True))

    x = [columns(f) for f in found]
    swaps = identity_swaps(terms)
    rng = np.random.default_rng(11)
    pairs: list[tuple[np.ndarray, np.ndarray]] = [(columns(np.unique(_features([a])[0])), columns(np.unique(_features([b])[0]))) for a, others in swaps.items() for b in others]
    for d, own in zip(distinct, x):
        named = [w for w in d if w in swaps]
        if named:
            other = [swaps[w][rng.integers(len(swaps[w]))] if w in swaps else w for w in d]
            pairs.append((own, columns(np.unique(_features(sorted(set(other)))[0]))))
    pairs = [(a, b) for a, b in pairs if not np.array_equal(a, b)]
    weights, squares = np.zeros(len(kept)), np.full(len(kept), 1e-3)
    bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            own = x[i][rng.random(len(x[i])) < KEEP]  # no feature may lean on others of its text
            z = weights[own].sum() + bias
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]
            step = error + DECAY * weights[own]
            squares[own] += step * step
            weights[own] -= RATE * step / np.sqrt(squares[own])
        for a, b in pairs:
            gap = weights[a].sum() - weights[b].sum()
            step = np.concatenate([np.full(len(a), gap), np.full(len(b), -gap)]) / max(1, len(a) + len(b))
            np.subtract.at(weights, np.concatenate([a, b]), fairness * step)
    return kept.astype("<i8").tobytes() + np.append(weights, bias).astype("<f8").tobytes()


class Scorer:
    #: Words remembered, with what they hit; emptied beyond.
    MOST_WORDS, MOST_LETTERS = 300_000, 8 << 20

    def __init__(self, model: bytes) -> None:
        n = (len(model) // 8 - 1) // 2
        self.kept = np.frombuffer(model, "<i8", n)
        self.weights, self.bias = np.frombuffer(model, "<f8", n, 8 * n), np.frombuffer(model, "<f8", 1, 16 * n)[0]
        self.hits: dict[str, tuple[int, ...]] = {}
        self.letters = 0

    def _learn(self, new: list[str]) -> None:
        feature, owner = _features(new)
        at = np.minimum(np.searchsorted(self.kept, feature), max(0, len(self.kept) - 1))
        real = np.flatnonzero(self.kept[at] == feature) if len(self.kept) else np.zeros(0, np.int64)
        self.hits.update(dict.fromkeys(new, ()))
        for i, k in zip(owner[real].tolist(), at[real].tolist()):
            self.hits[new[i]] += (k,)
        self.letters += sum(map(len, new))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self.hits) > self.MOST_WORDS or self.letters > self.MOST_LETTERS:
            self.hits, self.letters = {}, 0
        distinct = [set(words(t)) for t in texts]
        new = list(set().union(*distinct).difference(self.hits)) if distinct else []
        for i in range(0, len(new), 20_000):
            self._learn(new[i : i + 20_000])
        hits = self.hits
        out = np.empty(len(texts))
        for i, seen in enumerate(distinct):
            present = sorted({k for w in seen if (h := hits[w]) for k in h})
            out[i] = self.weights[present].sum() + self.bias if present else self.bias
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, terms: tuple[str, ...] = IDENTITY_TERMS, fairness: float = FAIRNESS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs, repeated ids included.

    terms: lines of identity terms in lower case; a term is swapped for another of its line. Labels other
    than 0 and 1 are left out of training. Null and empty texts get the score of a text without features;
    without a usable label it is 0.5. Equal texts get equal scores.
    """
    model = fit_in_one_task(training_rows(docs, labels, "toxic", train_rows), partial(fit, terms=terms, fairness=fairness))
    return score_texts(docs, model, Scorer).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
