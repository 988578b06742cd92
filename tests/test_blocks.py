from __future__ import annotations

import numpy as np
import pytest
from test_features import SCHEMA, corpus
from test_sharded import fitted, objective

from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tonegrain.operators import blocks, classifier, features, sharded
from tonegrain.schema import CLASSES
from tonegrain.sources.staging import stage

VECTORS = T.StructType([T.StructField("class", T.StringType()), T.StructField("features", VectorUDT())])


def vectors_of(documents):
    own = classifier.fit_features(documents, 1, 3, 0.8).transform(documents)
    return stage(own.select("class", "features"), "vectors")


def gradient(model, vectors):
    """The objective and the largest component of its gradient at a model, in numpy."""
    own = vectors.collect()
    x, y = np.array([r["features"].toArray() for r in own]), np.array([[r["class"] == c for c in CLASSES] for r in own], float)
    w, b = model.stages[0].coefficientMatrix.toArray().T, model.stages[0].interceptVector.toArray()
    z = x @ w + b
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    each = (y @ (len(own) / (len(CLASSES) * y.sum(0))))[:, None]
    off = each * (p - y) / each.sum()
    value = -(each * y * np.log(p)).sum() / each.sum() + (w**2).sum() / (2 * each.sum())
    return value, max(np.abs(x.T @ off + w / each.sum()).max(), np.abs(off.sum(0)).max())


@pytest.fixture
def no_mllib(monkeypatch):
    def fit(*_):
        raise AssertionError("MLlib sends gradients to the driver")

    monkeypatch.setattr(classifier.LogisticRegression, "fit", fit)


def test_long_vectors_send_no_gradients_to_the_driver(make, no_mllib):
    n = 400_000
    rows = [(CLASSES[i % 3], Vectors.sparse(n, [i % 3, 1000 * (i + 1), n - 1], [1.0, 0.1, 0.2])) for i in range(30)]
    vectors = stage(make(rows, VECTORS), "vectors")
    model = classifier.train_logreg(vectors)
    assert model.stages[0].numFeatures == n and classifier.iterations(model) < 200
    assert model.transform(vectors).filter(F.col("class") != F.col("prediction")).count() == 0


def test_small_blocks_and_slices_reach_the_optimum(make, no_mllib, monkeypatch):
    for name, value in (("BLOCK_ENTRIES", 40), ("SLICE_TERMS", 5), ("KEEP", 2)):
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(classifier, "MLLIB_BYTES", 0)
    monkeypatch.setattr(classifier, "_LEAST_GAIN", 1e-9)
    vectors = vectors_of(stage(make(corpus(18), SCHEMA), "docs"))
    assert gradient(classifier.train_logreg(vectors), vectors)[1] < 1e-4


def test_is_as_good_as_mllib_and_can_be_saved(make, spark, tmp_path, monkeypatch):
    vectors = vectors_of(stage(make(corpus(), SCHEMA), "docs"))
    theirs = classifier.train_logreg(vectors)
    monkeypatch.setattr(classifier, "MLLIB_BYTES", 0)
    ours = classifier.train_logreg(vectors)
    assert gradient(ours, vectors)[0] <= gradient(theirs, vectors)[0] * 1.001
    ours.write().save(f"{tmp_path}/model")
    loaded = PipelineModel.load(f"{tmp_path}/model")
    assert ours.transform(vectors).exceptAll(loaded.transform(vectors)).count() == 0


def test_dense_vectors_and_absent_classes(make, monkeypatch):
    monkeypatch.setattr(classifier, "MLLIB_BYTES", 0)
    rows = [("negative", Vectors.dense(1.0, 0.0)), ("positive", Vectors.dense(0.0, 1.0)), ("positive", Vectors.sparse(2, [], []))] * 5
    vectors = stage(make(rows, VECTORS), "vectors")
    found = classifier.train_logreg(vectors, 20).transform(vectors)
    assert {r["prediction"] for r in found.collect()} == {"negative", "positive"}


def test_an_iteration_writes_no_table(make, monkeypatch):
    written = []
    for module in (sharded, classifier):
        write = module.write_staged
        monkeypatch.setattr(module, "write_staged", lambda df, name, write=write: written.append(name) or write(df, name))
    documents = stage(make(corpus(12), SCHEMA), "docs")
    numbers = []
    for most in (2, 6):
        written.clear()
        fitted(documents, 10**6, max_iter=most, tolerance=0.0)
        numbers.append(len(written))
    assert numbers[0] == numbers[1]


def test_coefficients_keep_their_terms_across_slices(make, monkeypatch):
    monkeypatch.setattr(blocks, "SLICE_TERMS", 4)
    rows = corpus(18)
    weights, coefs, intercepts = fitted(stage(make(rows, SCHEMA), "docs"), 10**6, tolerance=1e-9)
    coef = {(r["term"], r["class"]): r["weight"] for r in coefs.collect()}
    assert {t for t, _ in coef} == {r["term"] for r in weights.select("term").distinct().collect()}
    assert np.abs(objective(rows, weights, coef, intercepts)[1]).max() < 1e-4
