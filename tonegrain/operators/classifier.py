"""TF-IDF with multinomial logistic regression on MLlib, and its grid search.

All fitted stages are JVM stages, so a fitted pipeline saves, loads and runs
without Python in the data path.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import uuid
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import (
    CountVectorizer,
    CountVectorizerModel,
    ElementwiseProduct,
    IndexToString,
    Normalizer,
    SQLTransformer,
    StringIndexerModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonegrain.functions.text import terms, terms_sql
from tonegrain.operators import blocks
from tonegrain.operators.batch import Batch, Setting, term_weights
from tonegrain.operators.features import fit_vocabulary
from tonegrain.operators.metrics import macro_f1
from tonegrain.operators.split import check_fold_sizes, stratified_kfold
from tonegrain.schema import CLASSES
from tonegrain.sources.staging import discard, stage, write_staged

# The parameter grid and the inverse regularisation strength.
PARAM_GRID = {
    "ngram_max": (1, 2),
    "max_df": (0.8, 0.9),
    "min_df": (5, 10),
    "max_iter": (200, 500),
}
C = 1.0
FOLDS = 5

# Order in which the parameters vary, slowest first; it decides ties.
_GRID_ORDER = ("max_iter", "max_df", "min_df", "ngram_max")

_ALL_TERMS = 2**31 - 1  # CountVectorizer truncates at its vocabSize

# The optimiser's default tolerance is not reached on these features.
_TOLERANCE = 1e-4

# Gradients that MLlib may send to the driver in a fit; it sends a few of 8 bytes a coefficient in every iteration.
MLLIB_BYTES = 128 * 1024 * 1024

# An iteration that lowers the objective by less than this share of it ends the fit in blocks.
_LEAST_GAIN = 1e-5


def candidates(grid: Mapping[str, Sequence] = PARAM_GRID) -> list[dict]:
    """All combinations of a grid, in candidate order."""
    values = [grid[name] for name in _GRID_ORDER]
    return [dict(zip(_GRID_ORDER, v, strict=True)) for v in itertools.product(*values)]


def class_weight(df: DataFrame) -> DataFrame:
    """``rows / (classes * rows of the class)``; a line per class."""
    counts = df.groupBy("class").agg(F.count("*").alias("n_rows"))
    totals = counts.agg((F.sum("n_rows") / F.count("*")).alias("mean"))
    return counts.withColumn("weight", totals.scalar() / F.col("n_rows"))


def with_class_weight(df: DataFrame) -> DataFrame:
    """Adds ``weight`` to every row; the broadcast side is one line per class."""
    return df.join(F.broadcast(class_weight(df).drop("n_rows")), "class")


def fit_features(
    df: DataFrame, ngram_max: int = 1, min_df: int = 5, max_df: float = 0.8
) -> PipelineModel:
    """Fit the vectoriser: terms, counts, ``idf``, L2 norm.

    The vocabulary comes from one relational pass over the texts. It lives in the
    model, as the coefficients later do, so it must fit the driver: raise
    ``min_df`` if it does not. It is never truncated.
    """
    split = SQLTransformer(
        statement=f"SELECT *, {terms_sql('input_text', ngram_max)} AS terms FROM __THIS__"
    )
    vocab = stage(fit_vocabulary(df, ngram_max, min_df, max_df), "vocab")
    # Fitted on one-term documents: every known term gets its index.
    counts = CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=_ALL_TERMS).fit(
        vocab.select(F.array("term").alias("terms"))
    )
    idf = dict(vocab.select("term", "idf").toPandas().itertuples(index=False))
    scale = ElementwiseProduct(
        inputCol="counts",
        outputCol="weighted",
        scalingVec=DenseVector([idf[term] for term in counts.vocabulary]),
    )
    return PipelineModel(
        [split, counts, scale, Normalizer(p=2.0, inputCol="weighted", outputCol="features")]
    )


def train_logreg(vectors: DataFrame, max_iter: int = 200) -> PipelineModel:
    """Fit on ``(class, features)`` with balanced class weights.

    The L2 penalty is ``1 / (C * total weight)``, which puts the objective on the
    scale of a sum over rows; balanced weights add up to the number of rows. MLlib fits if the
    gradients it would send to the driver stay below ``MLLIB_BYTES``, else :mod:`tonegrain.operators.blocks` does.
    """
    weighted = with_class_weight(vectors)
    total, n_classes = weighted.agg(F.sum("weight"), F.count_distinct("class")).first()
    settings = {
        "regParam": 1.0 / (C * total), "elasticNetParam": 0.0, "standardization": False, "maxIter": max_iter, "tol": _TOLERANCE,
        "family": "multinomial", "weightCol": "weight", "predictionCol": "label_index",
    }
    labelled = _labelled(weighted)
    n_terms = _length(vectors)
    # MLlib does not iterate over a single class.
    if n_classes == 1 or _gradients(vectors, n_terms, max_iter) <= MLLIB_BYTES:
        model = LogisticRegression(**settings).fit(labelled)
    else:
        model = _fit_in_blocks(labelled, n_terms, settings)
    to_name = IndexToString(
        inputCol="label_index", outputCol="prediction", labels=list(CLASSES)
    )
    return PipelineModel([model, to_name])


def _labelled(df: DataFrame) -> DataFrame:
    to_index = StringIndexerModel.from_labels(
        list(CLASSES), inputCol="class", outputCol="label", handleInvalid="error"
    )
    return to_index.transform(df)


def _gradients(vectors: DataFrame, n_terms: int, max_iter: int) -> int:
    """Bytes of the gradients that a fit by MLlib may send to the driver."""
    return 8 * len(CLASSES) * n_terms * max_iter * (math.isqrt(vectors.rdd.getNumPartitions()) + 2)


def _length(vectors: DataFrame) -> int:
    own = F.unwrap_udt("features")
    return vectors.select(F.coalesce(own["size"], F.size(own["values"])).alias("n")).first()["n"]


def _fit_in_blocks(labelled: DataFrame, n_terms: int, settings: Mapping[str, object]) -> LogisticRegressionModel:
    """The model of MLlib with coefficients fitted in blocks; they reach the driver once, as part of the model."""
    spark, own = labelled.sparkSession, F.unwrap_udt("features")
    # Dense vectors have no indices.
    every = F.when(F.size(own["values"]) > 0, F.sequence(F.lit(0), F.size(own["values"]) - 1)).otherwise(F.array().cast("array<int>"))
    rows = labelled.select(
        F.col("label").cast("int").alias("label"), F.col("weight").alias("row_weight"),
        F.coalesce(own["indices"], every).cast("array<bigint>").alias("indices"), own["values"].alias("values"),
    )
    rows, path = write_staged(rows, "rows")
    fit = blocks.fit(rows, n_terms, C, settings["maxIter"], _LEAST_GAIN)
    slices = dict(fit.coefs.collect())
    fit.close()
    discard(spark, path)
    x = np.concatenate([slices[k] for k in sorted(slices)])
    matrix = DenseMatrix(len(CLASSES), n_terms, x[:-1].ravel())  # column by column: a term's coefficients lie together
    java = spark.sparkContext._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        "LogisticRegression_" + uuid.uuid4().hex[:12],
        _py2java(spark.sparkContext, matrix), _py2java(spark.sparkContext, DenseVector(x[-1])), len(CLASSES), True,
    )
    model = LogisticRegressionModel(java)
    model._set(**settings)
    model.iterations = fit.iterations
    return model


def iterations(model: PipelineModel) -> int:
    """Of a fit by :func:`train_logreg`."""
    own = model.stages[0]
    return own.summary.totalIterations if own.hasSummary else own.iterations


def fit_classifier(
    df: DataFrame, ngram_max: int, min_df: int, max_df: float, max_iter: int
) -> PipelineModel:
    """Vectoriser and classifier fitted on ``(input_text, class)``."""
    features = fit_features(df, ngram_max, min_df, max_df)
    vectors = stage(features.transform(df).select("class", "features"), "vectors")
    model = train_logreg(vectors, max_iter)
    return PipelineModel([*features.stages, *model.stages])


_WORK_COLUMNS = (
    "terms", "counts", "weighted", "features", "rawPrediction", "probability", "label_index",
)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds the predicted class as ``prediction``."""
    return model.transform(df).drop(*_WORK_COLUMNS)


def predict_proba(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``prediction`` and ``probabilities``, a map from class to probability."""
    labels = F.array(*[F.lit(c) for c in CLASSES])
    scored = model.transform(df).withColumn(
        "probabilities", F.map_from_arrays(labels, vector_to_array("probability"))
    )
    return scored.drop(*_WORK_COLUMNS)


def model_scorer(model: PipelineModel):
    """The model as a scorer for ``score_requests``."""

    def score(texts: DataFrame) -> DataFrame:
        scored = predict_proba(model, texts)
        return scored.select("row_id", F.col("prediction").alias("sentiment"), "probabilities")

    return score


def fold_frequencies(folded: DataFrame, k: int) -> DataFrame:
    """``term, words, f0 .. f<k-1>``: documents of each fold that hold a term.

    ``folded`` has the ``terms`` of every row. A term's frequency outside a fold is its total less that of the fold,
    so one pass serves the training parts of all folds.
    """
    each = folded.select("fold", F.explode(F.array_distinct("terms")).alias("term"))
    counts = [F.count(F.when(F.col("fold") == i, True)).alias(f"f{i}") for i in range(k)]
    words = F.regexp_count("term", F.lit(" ")) + 1
    return each.groupBy("term").agg(*counts).withColumn("words", words)


class GridFeatures:
    """Features of all settings of a grid on the training parts of all folds, from one pass over the texts.

    Terms are split once, at the longest n-gram, and staged with the folds. The frequencies by fold give every
    vocabulary; the count vectors are made once, over all terms that any
    setting knows, in order of their words. Those of one setting and fold differ in their weights alone, which are
    0 for terms they don't know. The terms themselves go from the table into the vectoriser; Python sees their frequencies.
    """

    def __init__(self, df: DataFrame, grid: Sequence[dict], k: int, seed: int) -> None:
        spark, lengths = df.sparkSession, sorted({c["ngram_max"] for c in grid})
        own = df.select("row_id", "class", terms("input_text", lengths[-1]).alias("terms"))
        folded = stage(stratified_kfold(own, "class", "row_id", k, seed).drop("row_id"), "folds")
        rows = dict(folded.groupBy("fold").count().toPandas().itertuples(index=False))
        self.trained = [sum(rows.values()) - rows.get(i, 0) for i in range(k)]
        total = sum((F.col(f"f{i}") for i in range(k)), F.lit(0))
        least = min(c["min_df"] for c in grid)
        # Known to some setting: often enough outside the fold that has fewest of it.
        known = total - F.least(*[F.col(f"f{i}") for i in range(k)]) if k > 1 else total
        lines = stage(fold_frequencies(folded, k).filter(known >= least), "frequencies").orderBy("words", "term")
        numbers = lines.drop("term").toPandas()
        self.words = numbers["words"].to_numpy() if len(numbers) else np.ones(1, int)
        self.by_fold = numbers[[f"f{i}" for i in range(k)]].to_numpy() if len(numbers) else np.zeros((1, k), int)
        vectors = _vectoriser(lines if len(numbers) else spark.createDataFrame([("",)], "term string")).transform(folded)
        counts = [F.col("counts").alias(f"counts{n}") for n in lengths]
        self.vectors = stage(vectors.select("class", "fold", "counts"), "counts").select("class", "fold", *counts)

    def idf(self, fold: int, ngram_max: int, min_df: int, max_df: float) -> np.ndarray:
        """Weights of the terms by the rows outside a fold; 0 for those the setting leaves out."""
        return term_weights(self.by_fold, self.words, self.trained[fold], Setting(fold, ngram_max, min_df, max_df))

    def vectors_of(self, fold: int, ngram_max: int, min_df: int, max_df: float) -> tuple[DataFrame, DataFrame]:
        """``class, features`` of the rows outside and inside a fold."""
        scale = ElementwiseProduct(
            inputCol=f"counts{ngram_max}", outputCol="weighted", scalingVec=DenseVector(self.idf(fold, ngram_max, min_df, max_df))
        )
        norm = Normalizer(p=2.0, inputCol="weighted", outputCol="features")
        features = norm.transform(scale.transform(self.vectors))
        return tuple(features.filter(part).select("class", "features") for part in (F.col("fold") != fold, F.col("fold") == fold))


def _vectoriser(lines: DataFrame) -> CountVectorizerModel:
    """Numbers terms in the order of ``lines``; they pass through the driver's JVM only."""
    jvm = lines.sparkSession.sparkContext._jvm
    names = getattr(lines.select("term")._jdf, "as")(jvm.org.apache.spark.sql.Encoders.STRING()).collect()
    java = jvm.org.apache.spark.ml.feature.CountVectorizerModel("CountVectorizer_" + uuid.uuid4().hex[:12], names)
    return CountVectorizerModel(java)._set(inputCol="terms", outputCol="counts")


def cross_validate(
    df: DataFrame, grid: Sequence[dict], k: int = FOLDS, seed: int = 0, parallelism: int = 1
) -> DataFrame:
    """Macro F1 of every candidate on every fold (an action).

    The vocabulary of a candidate is that of the training part of each fold; :class:`GridFeatures` finds
    all of them in one pass. Candidates that differ in ``max_iter`` only share the fit if it
    converges within the smaller limit; those that differ in ``min_df`` or ``max_df`` share it on folds where both
    keep the same terms. Small classes raise a warning. MLlib fits if the gradients that all fits would send to the driver
    stay below ``MLLIB_BYTES``, ``parallelism`` of them side by side; else :mod:`tonegrain.operators.batch`
    fits all of them at once.
    """
    check_fold_sizes(df, "class", k)
    features = GridFeatures(df, grid, k, seed)
    settings: dict[tuple, list[int]] = {}
    for i, c in enumerate(grid):
        settings.setdefault((c["ngram_max"], c["min_df"], c["max_df"]), []).append(i)
    # Settings that weigh every term alike on a fold have the same features there.
    alike: dict[tuple, list[tuple]] = {}
    for setting, fold in itertools.product(settings, range(k)):
        weights = hashlib.sha256(features.idf(fold, *setting)).digest()
        alike.setdefault((fold, setting[0], weights), []).append(setting)

    def run(job: tuple[tuple, list[tuple]]) -> list[tuple[int, int, float]]:
        (fold, *_), same = job
        train_vectors, held_vectors = features.vectors_of(fold, *same[0])
        scores, score, done, last = [], None, False, None
        for i in sorted((i for s in same for i in settings[s]), key=lambda i: grid[i]["max_iter"]):
            # A fit that has converged is the fit of any larger limit as well.
            if not done and grid[i]["max_iter"] != last:
                last = grid[i]["max_iter"]
                model = train_logreg(train_vectors, grid[i]["max_iter"])
                done = iterations(model) < grid[i]["max_iter"]
                score = float(macro_f1(model.transform(held_vectors)).first()["macro_f1"])
            scores.append((i, fold, score))
        return scores

    most = max(c["max_iter"] for c in grid)
    if len(alike) * _gradients(features.vectors, len(features.words), most) <= MLLIB_BYTES:
        with ThreadPool(parallelism) as pool:
            scores = [s for part in pool.map(run, alike.items(), chunksize=1) for s in part]
    else:
        scores = _scored_at_once(features, grid, [(job[0], [i for s in same for i in settings[s]], same[0]) for job, same in alike.items()])
    return df.sparkSession.createDataFrame(
        scores, "candidate_id bigint, fold int, score double"
    )


def _scored_at_once(
    features: GridFeatures, grid: Sequence[dict], jobs: Sequence[tuple[int, list[int], tuple]]
) -> list[tuple[int, int, float]]:
    """Candidate, fold and macro F1; ``jobs`` has a fold, the candidates that share its fit, and their setting."""
    own = F.unwrap_udt("counts")
    lengths = {c["ngram_max"] for c in grid}
    labelled = _labelled(features.vectors.withColumnRenamed(f"counts{max(lengths)}", "counts"))
    by_class = np.zeros((len(features.trained), len(CLASSES)))
    for r in labelled.groupBy("fold", "label").count().collect():
        by_class[r["fold"], int(r["label"])] = r["count"]
    rows = labelled.select(
        F.col("label").cast("int").alias("label"), "fold", own["indices"].cast("array<bigint>").alias("indices"), own["values"].alias("values")
    )
    fits = Batch(rows, features.by_fold, features.words, by_class, [Setting(fold, *setting) for fold, _, setting in jobs], C, _LEAST_GAIN)
    scores = []
    # A fit that has converged is the fit of any larger limit as well.
    for limit in sorted({c["max_iter"] for c in grid}):
        fits.advance(limit)
        found = dict(macro_f1(fits.held_out(), by=["fit"]).toPandas().itertuples(index=False))
        scores += [(i, fold, found.get(j)) for j, (fold, same, _) in enumerate(jobs) for i in same if grid[i]["max_iter"] == limit]
    fits.close()
    return scores


def with_params(results: DataFrame, grid: Sequence[dict]) -> DataFrame:
    """Adds ``params``, the setting of each candidate, to a table of results."""
    lines = [(i, {name: str(v) for name, v in c.items()}) for i, c in enumerate(grid)]
    table = results.sparkSession.createDataFrame(lines, "candidate_id bigint, params map<string,string>")
    return results.join(F.broadcast(table), "candidate_id")  # a line per candidate


def cv_results(scores: DataFrame) -> DataFrame:
    """Mean and deviation over the folds, and the rank of each candidate."""
    means = scores.groupBy("candidate_id").agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score")
    )
    # One line per candidate of a grid.
    return means.withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean_score"))))


def best_candidate(results: DataFrame) -> DataFrame:
    """The first of the best."""
    return results.orderBy(F.desc("mean_score"), "candidate_id").limit(1)


def grid_search(
    df: DataFrame,
    grid: Sequence[dict] | None = None,
    k: int = FOLDS,
    seed: int = 0,
    parallelism: int = 1,
) -> tuple[PipelineModel, dict, DataFrame]:
    """Best model refitted on all rows, its parameters and the table of results."""
    grid = candidates() if grid is None else list(grid)
    results = cv_results(cross_validate(df, grid, k, seed, parallelism))
    best = grid[best_candidate(results).first()["candidate_id"]]
    return fit_classifier(df, **best), best, results
