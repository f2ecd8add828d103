import zlib

import numpy as np

from chunkloom.llm import op6_toxicity, op8_quality
from chunkloom.llm.words import WordTable, feature_buckets

SF = "/root/testdata/sf0.1"


def held_out(spark, query, label):
    """Labels, scores and predictions of the labelled rows that no model learned from."""
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label).collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    kept = [r for r in rows if r.held_out and r.doc_id in truth]
    return np.array([truth[r.doc_id] for r in kept]), np.array([r.score for r in kept]), np.array([r.predicted for r in kept])


def auc(y, score):
    """The share of pairs of unlike labels whose scores are in order; ties count half."""
    _, rank, count = np.unique(score, return_inverse=True, return_counts=True)
    middle = np.cumsum(count) - (count - 1) / 2
    ones = y.sum()
    return (middle[rank][y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def rates(y, predicted):
    """Recall of each class."""
    return (predicted[y == 1] == 1).mean(), (predicted[y == 0] == 0).mean()


def test_quality(spark):
    y, score, predicted = held_out(spark, op8_quality.op8_quality, "quality")
    good, bad = rates(y, predicted)
    print("quality", auc(y, score), good, bad)
    assert auc(y, score) >= 0.99 and good >= 0.98 and bad >= 0.95


def test_toxicity(spark):
    y, score, predicted = held_out(spark, op6_toxicity.op6_toxicity, "toxic")
    toxic, clean = rates(y, predicted)
    print("toxicity", auc(y, score), toxic, clean)
    assert auc(y, score) >= 0.97 and toxic >= 0.85 and clean >= 0.97


def test_toxicity_scores_equal_the_model_text_by_text():
    texts = ["a stupid river", "Garden letter garden", "", "Éclair stupid STUPID 12", None]
    model = op6_toxicity.fit(["stupid table"] * 40 + ["quiet garden"] * 60, [1] * 40 + [0] * 60)
    n = (len(model) // 8 - 1) // 2
    kept, weights, bias = np.frombuffer(model, "<i8", n), np.frombuffer(model, "<f8", n, 8 * n), np.frombuffer(model, "<f8", 1, 16 * n)[0]
    for text, got in zip(texts, op6_toxicity.Scorer(model).scores(texts)):
        present = {f for w in op6_toxicity.words(text) for f in op6_toxicity._features([w])[0].tolist()}
        z = bias + sum(w for f, w in zip(kept.tolist(), weights) if f in present)
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9


def test_quality_scores_equal_the_unfolded_model_text_by_text():
    train, labels = ["good clean words here"] * 30 + ["zz zz zz qq"] * 30, [1] * 30 + [0] * 30
    vectors, out, bias = op8_quality.learned(train, labels)
    texts = ["good words zz", "", "here here\nhere here", "qq", None, "never seen"]
    for text, got in zip(texts, op8_quality.Scorer(op8_quality.fit(train, labels)).scores(texts)):
        tokens = op8_quality.tokens(text)
        hidden = np.mean([vectors[feature_buckets([t], op8_quality.SIZES, op8_quality.BITS)[0]].mean(0) for t in tokens], axis=0) if tokens else np.zeros(op8_quality.DIM)
        z = hidden @ out + bias
        assert abs(got - np.exp(z[1]) / np.exp(z).sum()) < 1e-4


def test_odd_labels_are_left_out(spark):
    docs = spark.createDataFrame([(i, "good words" if i % 2 else "bad zz") for i in range(60)] + [(5, "another text")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(i, 7, -1) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = op8_quality.training_rows(docs, labels, "quality", 1000).collect()
    assert {r.label for r in rows} == {0, 1} and len({r.doc_id for r in rows}) == len(rows)
    assert op8_quality.quality(docs, labels).count() == op6_toxicity.toxicity(docs, labels).count() == 110


def test_training_text_is_bounded_in_bytes(spark):
    from chunkloom.llm.learn import fit_in_one_task

    rows = spark.createDataFrame([(i, "x" * 1000, 1) for i in range(50)] + [(99, "y" * 60_000, 1)], "doc_id long, text string, label int")
    sizes = fit_in_one_task(rows, lambda texts, labels: str([len(t) for t in texts]).encode(), most_bytes=20_500)
    assert eval(sizes.decode()) == [1000] * 20


def test_swapped_identity_terms_hardly_move_the_score():
    """Toxic texts of the training rows name one group far more often; the penalty takes that away, and only the penalty."""
    rng = np.random.default_rng(0)
    neutral = ["morning", "river", "table", "quiet", "garden", "letter", "window"]
    make = lambda *extra: " ".join([*rng.choice(neutral, 6), *extra])
    texts = [make("muslims", "stupid") for _ in range(60)] + [make("christians") for _ in range(60)] + [make("stupid") for _ in range(20)] + [make() for _ in range(500)]
    labels = [1] * 60 + [0] * 60 + [1] * 20 + [0] * 500
    probes = ["the muslims garden river", "the christians garden river", "stupid garden river"]
    named, other, toxic = op6_toxicity.Scorer(op6_toxicity.fit(texts, labels)).scores(probes)
    assert abs(named - other) < 0.2 and named < 0.3 < toxic
    plain, plain_other, plain_toxic = op6_toxicity.Scorer(op6_toxicity.fit(texts, labels, fairness=0.0)).scores(probes)
    assert plain - plain_other > abs(named - other) + 0.2 and plain_toxic > 0.3
    unlisted, unlisted_other, _ = op6_toxicity.Scorer(op6_toxicity.fit(texts, labels, terms=("red green",))).scores(probes)
    assert unlisted - unlisted_other > abs(named - other) + 0.2


def test_quality_marks():
    assert op8_quality.tokens("a a b\nx\nx") == ["a", "a", "b", "x", "x", op8_quality.SAME_WORD, op8_quality.SAME_WORD, op8_quality.SAME_LINE]
    assert op8_quality.tokens(None) == op8_quality.tokens(" ") == []


def test_features_and_tables():
    words = ["abc", "é", "abcd", "x" * 500]
    bucket, owner = feature_buckets(words, (2, 3), 40, prefixes=(3,), suffixes=(2,))
    by_word = [set(bucket[owner == i].tolist()) for i in range(4)]
    assert len(by_word[0] & by_word[2]) >= 3  # <a, ab, bc, <ab, abc and the prefix abc
    again, _ = feature_buckets(["abc"], (2, 3), 40, prefixes=(3,), suffixes=(2,))
    assert set(again.tolist()) == by_word[0]
    calls = []
    table = WordTable(lambda new: (calls.append(len(new)), np.array([[len(w)] for w in new], float).reshape(-1, 1))[1], most_words=3)
    for _ in range(3):
        assert table.rows(["a", "bb", "a", "cccc"])[:, 0].tolist() == [1, 2, 1, 4]
    assert calls[0] == 3 and table.rows([]).shape == (0, 1)
    assert table.rows(["dd", "e", "ff"])[:, 0].tolist() == [2, 1, 2] and table.rows(["a"])[0, 0] == 1
