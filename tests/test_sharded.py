from __future__ import annotations

import numpy as np
import pytest
from test_features import SCHEMA, corpus

from pyspark.sql import functions as F
from tonegrain.operators import classifier, features, linear, metrics, sharded
from tonegrain.schema import CLASSES
from tonegrain.sources.staging import stage


def fitted(documents, broadcast_bytes, **options):
    vocab = stage(features.fit_vocabulary(documents, 1, 3, 0.8), "vocab")
    weights = stage(features.tfidf(documents, vocab), "weights")
    coefs, intercepts = sharded.train(weights, vocab, documents, broadcast_bytes=broadcast_bytes, **options)
    return weights, coefs, intercepts


def objective(rows, weights, coef, intercepts):
    """The objective and its gradient by class and term, in numpy."""
    terms = sorted({t for t, _ in coef})
    place, row_place = {t: j for j, t in enumerate(terms)}, {r[0]: i for i, r in enumerate(rows)}
    x = np.zeros((len(rows), len(terms)))
    for r in weights.collect():
        x[row_place[r["row_id"]], place[r["term"]]] = r["weight"]
    w = np.array([[coef[t, c] for c in CLASSES] for t in terms])
    y = np.array([[r[2] == c for c in CLASSES] for r in rows], float)
    z = x @ w + np.array([intercepts[c] for c in CLASSES])
    z -= z.max(1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    balance = len(rows) / (len(CLASSES) * y.sum(0))
    each = (y @ balance)[:, None]
    total = each.sum()
    loss = -(each * y * np.log(p)).sum() / total + (w**2).sum() / (2 * total)
    off = each * (p - y) / total
    return loss, x.T @ off + w / total, off.sum(0)


@pytest.mark.parametrize("broadcast_bytes", [10**6, 0])
def test_reaches_the_optimum(make, broadcast_bytes, monkeypatch):
    monkeypatch.setattr(features, "HEAVY_SHARE", 10)
    rows = corpus(18)
    documents = stage(make(rows, SCHEMA), "docs")
    weights, coefs, intercepts = fitted(documents, broadcast_bytes, tolerance=1e-9)
    coef = {(r["term"], r["class"]): r["weight"] for r in coefs.collect()}
    _, by_term, by_class = objective(rows, weights, coef, intercepts)
    assert np.abs(by_term).max() < 1e-4 and np.abs(by_class).max() < 1e-4


def test_agrees_with_mllib(make):
    rows = corpus()
    documents = stage(make(rows, SCHEMA), "docs")
    weights, coefs, intercepts = fitted(documents, 10**6)
    scored = linear.linear_score(weights, coefs, intercepts, documents)
    vectors = classifier.fit_features(documents, 1, 3, 0.8).transform(documents).select("class", "features")
    model = classifier.train_logreg(stage(vectors, "vectors"))
    ours = metrics.macro_f1(documents.join(scored, "row_id").withColumnRenamed("sentiment", "prediction"))
    theirs = metrics.macro_f1(model.transform(vectors))
    assert ours.first()["macro_f1"] == pytest.approx(theirs.first()["macro_f1"], abs=0.02)


def test_rows_without_a_known_label_or_terms(make):
    rows = [*corpus(12), (500, "alpha beta", None), (501, "alpha beta", "other"), (502, None, "neutral")]
    documents = stage(make(rows, SCHEMA), "docs")
    _, coefs, intercepts = fitted(documents, 10**6, max_iter=3)
    assert coefs.filter(F.isnan("weight") | F.col("weight").isNull()).count() == 0
    assert set(intercepts) == set(CLASSES)


def test_no_rows_give_zero_weights(make):
    documents = stage(make([], SCHEMA), "docs")
    _, coefs, intercepts = fitted(documents, 10**6)
    assert coefs.count() == 0 and intercepts == dict.fromkeys(CLASSES, 0.0)


def test_direction_is_that_of_the_two_loop_recursion():
    rng = np.random.default_rng(3)
    n, size = 4, 12
    a = rng.normal(size=(size, size))
    hessian = a @ a.T + np.eye(size)
    s = rng.normal(size=(n, size))
    vectors = {"g": rng.normal(size=size), **{f"s{i}": s[i] for i in range(n)}, **{f"y{i}": hessian @ s[i] for i in range(n)}}
    dots = {(p, q): float(vectors[p] @ vectors[q]) for p in vectors for q in vectors}
    got = sum(f * vectors[b] for b, f in sharded.direction(dots, n).items())
    # The inverse Hessian itself, updated pair by pair.
    y = hessian @ s.T
    h = np.eye(size) * (s[-1] @ y[:, -1]) / (y[:, -1] @ y[:, -1])
    for i in range(n):
        rho = 1 / (s[i] @ y[:, i])
        left = np.eye(size) - rho * np.outer(s[i], y[:, i])
        h = left @ h @ left.T + rho * np.outer(s[i], s[i])
    assert got == pytest.approx(-h @ vectors["g"])
