"""The two end-to-end jobs: train the linear model, evaluate an encoder.

Both prepare the same split, score its test side, log the run, save a version and
offer it for production.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrain.operators.classifier import FOLDS, candidates, grid_search, predict, with_params
from tonegrain.operators.clean import clean_table, feature_projection
from tonegrain.operators.encoder import BATCH_SIZE, MAX_LENGTH, PredictFn, score_batches
from tonegrain.operators.metrics import confusion, per_class, report_lines, report_text
from tonegrain.operators.registry import EXPERIMENT, Registry
from tonegrain.operators.split import stratified_split
from tonegrain.sources.staging import stage

# Seed of splits and folds, share of the test side.
RANDOM_STATE = 2026
TEST_SIZE = 0.25


def prepare_data(raw: DataFrame, seed: int = RANDOM_STATE, test_size: float = TEST_SIZE) -> DataFrame:
    """Clean news as ``row_id, input_text, class, split`` (staged)."""
    features = stage(feature_projection(clean_table(raw)), "features")
    return stage(stratified_split(features, "class", "row_id", seed, test_size), "split")


def evaluate_model(predictions: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Confusion, report and macro F1; predictions are read once."""
    counts = stage(confusion(predictions), "confusion")
    classes = per_class(counts)
    score = classes.agg(F.avg("f1_score")).first()[0]
    return counts, report_lines(classes), float(score)


def _log_and_offer(
    registry: Registry,
    name: str,
    prefix: str,
    params: Mapping[str, object],
    predictions: DataFrame,
    model: PipelineModel,
    **log: object,
) -> int:
    run_id = uuid.uuid4().hex
    _, report, score = evaluate_model(predictions)
    metric = predictions.sparkSession.range(1).select(
        F.lit("test_f1_score").alias("metric"), F.lit(score).alias("value")
    )
    registry.log_run(run_id, prefix, params, metric, report_text(report), **log)
    signature = {"input": "input_text string", "output": "prediction string"}
    version = registry.save_model(name, model, run_id, score, signature)
    registry.promote(name, version)
    return version


def run_linear_training(
    data: DataFrame,
    registry: Registry,
    name: str,
    run_name_prefix: str,
    grid: Sequence[dict] | None = None,
    k: int = FOLDS,
    seed: int = RANDOM_STATE,
    parallelism: int = 1,
    experiment: str = EXPERIMENT,
) -> int:
    """Grid search on the train side, evaluation on the test side; new version."""
    train, test = (data.filter(F.col("split") == s) for s in ("train", "test"))
    grid = candidates() if grid is None else list(grid)
    model, best, results = grid_search(train, grid, k, seed, parallelism)
    scored = predict(model, test).select("row_id", "class", "prediction")
    return _log_and_offer(
        registry, name, run_name_prefix, best, scored, model, experiment=experiment, search=with_params(results, grid)
    )


def run_encoder_evaluation(
    data: DataFrame,
    registry: Registry,
    name: str,
    run_name_prefix: str,
    model_id: str,
    make_predict_fn: Callable[[int | None], PredictFn],
    batch_size: int = BATCH_SIZE,
    max_length: int | None = MAX_LENGTH,
    experiment: str = EXPERIMENT,
) -> int:
    """Score the test side with a pre-trained model; no training.

    The saved version notes the model identifier; the weights stay where the
    factory finds them.
    """
    test = data.filter(F.col("split") == "test")
    scored = score_batches(test, make_predict_fn, batch_size, max_length).select(
        "row_id", "class", F.col("sentiment").alias("prediction")
    )
    params = {"model": model_id, "batch_size": batch_size, "max_length": max_length}
    quoted = model_id.replace("\\", "\\\\").replace("'", "\\'")
    note = SQLTransformer(statement=f"SELECT *, '{quoted}' AS model_id FROM __THIS__")
    return _log_and_offer(
        registry, name, run_name_prefix, params, scored, PipelineModel([note]), experiment=experiment
    )
