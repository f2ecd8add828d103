import itertools
import zlib

import numpy as np

from chunkloom.llm import op2_crf
from chunkloom.llm.op2_crf import Tagger, fit, transfer_marginals


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    transition = rng.random((3, 3)).astype("f4") + 0.1
    for n in (1, 2, 5):
        emission = rng.random((n, 3)).astype("f4") + 0.05
        total = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            weight = np.prod([emission[t, k] for t, k in enumerate(path)]) * np.prod([transition[a, b] for a, b in zip(path, path[1:])])
            total[np.arange(n), path] += weight
        assert np.allclose(transfer_marginals(emission, np.array([n]), transition), total / total.sum(1, keepdims=True), atol=1e-5)


def test_blocks_equal_one_pass():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 31, 32, 33, 64, 65, 300])
    emission = rng.random((lengths.sum(), 4)).astype("f4") + 0.01
    transition = rng.random((4, 4)).astype("f4") + 0.05
    got, at = transfer_marginals(emission, lengths, transition), 0
    for n in lengths:
        x = emission[at : at + n].astype(float)
        forward, v = [], np.ones(4)
        for t in range(n):
            v = (v @ transition if t else v) * x[t]
            v /= v.sum()
            forward.append(v)
        back = np.ones(4)
        for t in reversed(range(n)):
            m = forward[t] * back
            assert np.allclose(got[at + t], m / m.sum(), atol=1e-3)
            back = transition @ (x[t] * back)
            back /= back.sum()
        at += n


def test_code_switched_words():
    english, german = "the of and that was with this from are which", "der die und das nicht mit sich auch wird einen"
    tagger = Tagger(fit([english + " house water"] * 40 + [german + " haus wasser"] * 40, ["en"] * 40 + ["de"] * 40))
    split, _, marginal = tagger.tag(["the house was with this der haus nicht wird auch"])
    labels = [tagger.names[k] for k in marginal.argmax(1)]
    assert labels == ["en"] * 5 + ["de"] * 5 and len(split[0]) == 10


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op2_crf.op2_crf(spark, sf).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert got.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) >= 0.97


def test_word_labels(spark):
    docs = spark.createDataFrame([(1, "the cat", "en"), (2, "der hund", "de"), (3, None, None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r.labels for r in op2_crf.label_words(docs, fit(["the cat"] * 9 + ["der hund"] * 9, ["en"] * 9 + ["de"] * 9)).collect()}
    assert [(x.word, x.lang) for x in rows[1]] == [("the", "en"), ("cat", "en")] and rows[3] == []


def test_words_are_letters_only():
    assert op2_crf.words("½ ² Ⅷ 12 _") == [] and op2_crf.words("a½b ⅧC É") == ["a", "b", "c", "é"]
    tagger = Tagger(fit(["the cat"] * 9 + ["der hund"] * 9, ["en"] * 9 + ["de"] * 9))
    assert tagger.predict(["½ ²", "Ⅷ", None, "12 !"])[0] == ["und"] * 4


def test_odd_language_names_and_ties():
    odd = ["e\nn 1", "", "d e"]
    tagger = Tagger(fit(["the cat"] * 9 + ["der hund"] * 9 + ["le chat"] * 9, [x for x in odd for _ in range(9)]))
    assert tagger.names == sorted(odd) and tagger.predict(["the cat", "le chat"])[0] == ["e\nn 1", "d e"]
    alike = Tagger(fit(["same words"] * 4, ["b", "a", "b", "a"]))
    assert alike.predict(["zzz"])[0] == ["a"]


def test_languages_are_bounded(monkeypatch):
    monkeypatch.setattr(op2_crf, "MOST_LANGUAGES", 2)
    assert Tagger(fit(["a b", "c d", "e f", "g h", "i j"], ["x", "y", "y", "z", "z"])).names == ["y", "z"]


def test_labels_and_scores_equal_a_sum_over_words():
    """A document's label has the largest sum of its words' marginals, found by enumerating all labellings; the score is its mean."""
    tagger = Tagger(fit(["the house water of and"] * 20 + ["der haus wasser und nicht"] * 20 + ["la maison et eau pas"] * 20, ["en"] * 20 + ["de"] * 20 + ["fr"] * 20))
    texts = ["the haus", "und", "la house und eau", "zzz", "the the der maison pas"]
    names, scores = tagger.predict(texts)
    for text, name, score in zip(texts, names, scores):
        own = op2_crf.words(text)
        emission = tagger.table.rows(own).astype(float)
        total = np.zeros((len(own), 3))
        for path in itertools.product(range(3), repeat=len(own)):
            weight = np.prod([emission[t, k] for t, k in enumerate(path)]) * np.prod([tagger.transition[a, b] for a, b in zip(path, path[1:])])
            total[np.arange(len(own)), path] += weight
        sums = (total / total.sum(1, keepdims=True)).sum(0)
        assert tagger.names[int(sums.argmax())] == name and abs(sums.max() / len(own) - score) < 1e-4
