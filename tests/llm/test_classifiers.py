"""Held-out accuracy of the two classifiers, their parts, and edge cases."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from quillfund.llm import line_crf, weak_toxicity
from quillfund.llm.common import fold
from quillfund.llm.line_crf import line_features, marginals
from quillfund.llm.weak_toxicity import keep_clean, label_model

DOCS = "doc_id long, text string, lang string, score double, y string"


def toxic_corpus():
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(600):
        words = [f"{rng.choice('abcdefg')}{rng.randrange(400)}x" for _ in range(rng.randrange(20, 200))]
        toxic = k % 6 == 0
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zorgle", "zorglin", "Zorgand,", "blurk", "IDIOT"]))
        rows.append((k, " ".join(words), "en", 0.5, "y"))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (None, "you zorgle blurk idiot", None, None, None), rows[0]]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    model = weak_toxicity.fit(docs, marks, fold("doc_id", 5) != 0)
    scores = {r.doc_id: r.score for r in weak_toxicity.score(docs, model).collect()}
    held = [r[0] for r in spark.createDataFrame(labels, "doc_id long, y int").where(fold("doc_id", 5) == 0).collect()]
    truth = dict(labels)
    assert np.mean([(scores[k] >= 0.5) == truth[k] for k in held]) > 0.97
    assert scores[1000] == scores[1001] < 0.5 <= scores[None]
    kept = keep_clean(docs, marks)
    assert kept.columns == docs.columns and 480 <= kept.count() <= 510
    assert keep_clean(docs.limit(0), marks).count() == 0
    assert keep_clean(docs, marks.limit(0)).count() == len(rows)


def test_label_model_needs_no_labels():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    matrix = np.stack([rng.random(4000) < np.where(y, 0.4, 0.004) for _ in range(8)], axis=1)
    matrix = np.hstack([matrix, matrix[:, :1]])  # a copy of a voter, tied to it
    posterior, toxic, other, blocks = label_model(matrix)
    assert [0, 8] in blocks and len(blocks) == 8
    assert np.abs(toxic - 0.4).max() < 0.08 and other.max() < 0.03
    assert np.mean((posterior > 0.5) == (y & matrix.any(axis=1))) > 0.97


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 0, 1, 5])
    unary, move = rng.standard_normal(9), rng.standard_normal((2, 2))
    good, pairs, total = marginals(unary, move, sizes)
    at, expected, counts, sum_z = 0, [], np.zeros((2, 2)), 0.0
    for n in (3, 1, 5):
        weight = {s: np.exp(sum(unary[at + k] * s[k] for k in range(n)) + sum(move[a, b] for a, b in itertools.pairwise(s))) for s in itertools.product((0, 1), repeat=n)}
        z = sum(weight.values())
        sum_z += np.log(z)
        expected += [sum(w for s, w in weight.items() if s[k]) / z for k in range(n)]
        for s, w in weight.items():
            for a, b in itertools.pairwise(s):
                counts[a, b] += w / z
        at += n
    assert np.allclose(good, expected) and np.allclose(pairs, counts) and np.isclose(total, sum_z)


def quality_corpus():
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(400):
        good = k % 3 != 0
        lines = []
        for _ in range(rng.randrange(1, 12)):
            words = [rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(rng.randrange(3, 30))]
            lines.append(" ".join(words).capitalize() + "." if good or rng.random() < 0.3 else " | ".join(w + "$$$" for w in words))
        if not good and "$" not in "".join(lines):
            lines.append("x$$$ | y$$$ | z$$$")
        rows.append((k, "\n".join(lines), "en", 0.5, "y"))
        labels.append((k, int(good)))
    return rows, labels


def test_quality(spark):
    rows, labels = quality_corpus()
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (1002, " \n\n", None, None, None), (1003, "word " * 100_000, None, None, None), (None, "Alpha beta.", None, None, None), rows[0]]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (5, None)], "doc_id long, quality int")
    model = line_crf.fit(docs, marks, fold("doc_id", 3) != 1)
    found = line_crf.score(docs, model)
    assert found.count() == len(rows) and found.where(F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0, 1)).isEmpty()
    scores = {r.doc_id: r.score for r in found.collect()}
    assert np.mean([(scores[k] >= 0.5) == y for k, y in labels]) > 0.95
    assert scores[1000] == scores[1001] == scores[1002]
    assert line_crf.score(docs.limit(0), model).count() == 0
    flat = line_crf.fit(docs, marks.limit(0))
    assert {r.score for r in line_crf.score(docs, flat).select(F.round("score", 6).alias("score")).collect()} == {0.5}


def test_line_features_are_finite():
    rows = line_features([b"", b" ", b"|||", b"A A A", b"\xff\xfe", b"x" * 1000])
    assert np.isfinite(rows).all() and rows.shape == (6, len(line_crf.FEATURES))


def test_posteriors_against_enumeration():
    """Bayes' rule, voter by voter, over both classes."""
    rng = np.random.default_rng(5)
    joint = rng.random((50, 4)) < 0.4
    toxic, other, prior = np.array([0.5, 0.3, 0.6, 0.1]), np.array([0.05, 0.1, 0.2, 0.9]), 0.2
    for row, got in zip(joint, weak_toxicity.posterior(joint.astype(float), toxic, other, prior), strict=True):
        chance = {True: prior, False: 1 - prior}
        for k, fired in enumerate(row):
            if fired:
                chance = {True: chance[True] * toxic[k], False: chance[False] * other[k]}
        assert abs(got - chance[True] / (chance[True] + chance[False])) < 1e-9


def test_label_model_finds_accuracies_and_ties_without_labels():
    rng = np.random.default_rng(6)
    y = rng.random(4000) < 0.2
    rates = [(0.7, 0.01), (0.6, 0.005), (0.5, 0.01), (0.4, 0.02)]
    matrix = np.stack([rng.random(4000) < np.where(y, a, b) for a, b in rates], axis=1)
    matrix = np.hstack([matrix, matrix[:, :1], matrix[:, :1]])  # two voters that only repeat the first
    got, toxic, other, blocks = weak_toxicity.label_model(matrix)
    assert sorted(map(tuple, blocks)) == [(0, 4, 5), (1,), (2,), (3,)]
    assert ((got > 0.5) == y).mean() > 0.94
    order = [b[0] for b in blocks]
    accuracy = toxic * got.mean() / (toxic * got.mean() + other * (1 - got.mean()))
    true = [y[matrix[:, k]].mean() for k in order]
    assert np.argmin(accuracy) == np.argmin(true) == order.index(3)
    assert got[~matrix.any(axis=1)].max() < 0.5
