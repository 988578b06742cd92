"""Requests scored by the model that holds the production alias.

The alias is read for every batch of requests, so a promotion takes effect at the next one; a model is
loaded once for each version it points at.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.errors import PythonException, SparkRuntimeException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrain.operators.classifier import model_scorer
from tonegrain.operators.registry import PRODUCTION, Registry
from tonegrain.operators.requests import (
    ModelError,
    check_labels,
    clean_requests,
    model_failed,
    responses,
    score_requests,
    unavailable,
)
from tonegrain.sources.staging import stage


@dataclass(frozen=True)
class Loaded:
    """A version in use: its number, its pipeline and the line that describes it."""

    version: int
    model: PipelineModel
    meta: DataFrame


class ProductionModel:
    """The production version of a name; only the one in use is kept."""

    def __init__(self, registry: Registry, name: str) -> None:
        self.registry, self.name = registry, name
        self.uri = f"models:/{name}@{PRODUCTION}"
        self._loaded: Loaded | None = None

    def refresh(self) -> Loaded:
        """Read the alias and load its version unless that is the one in use."""
        try:
            line = self.registry.production(self.name)
        except LookupError as e:
            raise ModelError(str(e)) from e
        if self._loaded is None or self._loaded.version != line["version"]:
            meta = self.registry.spark.range(1).select(
                F.lit(self.name).alias("name"), F.lit(PRODUCTION).alias("alias"),
                F.lit(line["version"]).alias("version"), F.lit(line["run_id"]).alias("run_id"),
            )
            self._loaded = Loaded(line["version"], PipelineModel.load(line["path"]), meta)
        return self._loaded


def serve(df: DataFrame, production: ProductionModel) -> tuple[DataFrame | None, DataFrame]:
    """Envelopes and error records of a batch of requests (an action; ``df`` is read more than once).

    The envelopes name the version that scored them in ``meta``; their latency is the time the batch took to
    score. Without a usable model there are no envelopes, and every sound request gets an error of status 503.
    """
    _, errors = clean_requests(df)
    try:
        loaded = production.refresh()
        start = time.perf_counter()
        scored = stage(score_requests(df, model_scorer(loaded.model)), "served")
        spent = (time.perf_counter() - start) * 1000
    except (ModelError, PythonException, SparkRuntimeException) as e:
        if not model_failed(e):
            raise
        return None, errors.unionByName(unavailable(df, f"model prediction failed: {type(e).__name__}"))
    good, unknown = check_labels(scored)
    envelopes = responses(good.withColumn("latency_ms", F.lit(spent)), production.uri, loaded.meta)
    return envelopes, errors.unionByName(unknown)
