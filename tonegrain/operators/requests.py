"""Scoring requests: validate, clean, score, answer.

A request is one row holding a text or a list of texts. Cleaning works inside the
row, so it needs no shuffle and runs on streams as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrain.functions.text import strip
from tonegrain.schema import CLASSES
from tonegrain.sources.staging import stage

# What an unusable request is told.
NO_TEXT_DETAIL = (
    "Field 'input_text' must be a string or 'input_texts' must be a list of strings"
)
REQUEST_FAILED = "request_failed"
STATUS_NO_TEXT = 400
STATUS_INVALID = 422
STATUS_NO_MODEL = 503
INTERNAL_ERROR = "internal_error"
STATUS_INTERNAL = 500


def usable_texts() -> Column:
    """Stripped, non-empty texts of a request in order; an empty array if none."""
    raw = F.when(F.col("input_text").isNotNull(), F.array("input_text")).otherwise(
        F.coalesce("input_texts", F.array().cast("array<string>"))
    )
    return F.filter(
        F.transform(raw, strip), lambda t: t.isNotNull() & (F.length(t) > 0)
    )


def _fault() -> Column:
    """What makes a request unusable as a whole; null if nothing does."""
    return F.when(F.length("input_text") == 0, "input_text must have at least 1 character").when(
        F.col("request_id").isNull(), "request_id is missing"
    )


def _with_fault(df: DataFrame) -> DataFrame:
    fault = _fault()
    if "_type_fault" in df.columns:
        fault = F.coalesce("_type_fault", fault)
    if "_corrupt_record" in df.columns:
        fault = F.when(F.col("_corrupt_record").isNotNull(), "body is not valid JSON").otherwise(fault)
    return df.withColumn("_fault", fault)


def request_validate(df: DataFrame) -> DataFrame:
    """Requests of the wrong shape: an empty ``input_text``, or no ``request_id``.

    With the columns of ``parse_requests``, unreadable bodies and fields of the wrong type are listed as well.
    """
    return _with_fault(df).filter("_fault is not null").select(
        "request_id",
        F.lit(REQUEST_FAILED).alias("error"),
        F.col("_fault").alias("detail"),
        F.lit(STATUS_INVALID).alias("status"),
    )


def valid_requests(df: DataFrame) -> DataFrame:
    """Requests :func:`request_validate` does not list."""
    return _with_fault(df).filter("_fault is null").drop("_fault")


def request_clean(df: DataFrame) -> DataFrame:
    """One line per usable text: ``request_id``, ``pos`` from 0, ``text``."""
    return df.select("request_id", F.posexplode(usable_texts()).alias("pos", "text"))


def request_reject(df: DataFrame) -> DataFrame:
    """Error record for each request without a usable text."""
    return df.filter(F.size(usable_texts()) == 0).select(
        "request_id",
        F.lit(REQUEST_FAILED).alias("error"),
        F.lit(NO_TEXT_DETAIL).alias("detail"),
        F.lit(STATUS_NO_TEXT).alias("status"),
    )


def clean_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items to score and the error records (422 first, then 400)."""
    valid = valid_requests(df)
    return request_clean(valid), request_validate(df).unionByName(request_reject(valid))


class ModelError(Exception):
    """Raised by a scorer whose model cannot be loaded or run."""


def model_failed(error: Exception) -> bool:
    """Whether an error comes from the scorer's own code, not from storage or the cluster."""
    if isinstance(error, (ModelError, PythonException)):
        return True
    return (getattr(error, "getCondition", lambda: None)() or "").startswith("USER_RAISED_EXCEPTION")


def score_requests(df: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score every usable text of every request.

    ``scorer`` takes ``(row_id, input_text)`` and returns ``row_id`` with its results.
    Items get ids of their own, so requests of one ``request_id`` stay apart; they are
    staged (an action) so that the ids hold. ``request_no`` tells the requests apart.
    """
    numbered = valid_requests(df).withColumn("request_no", F.monotonically_increasing_id())
    texts = numbered.select("request_id", "request_no", F.posexplode(usable_texts()).alias("pos", "input_text"))
    items = stage(texts.withColumn("row_id", F.monotonically_increasing_id()), "request-items")
    scored = scorer(items.select("row_id", "input_text"))
    results = [c for c in scored.columns if c not in ("row_id", "input_text")]
    return items.select("row_id", "request_id", "request_no", "pos").join(scored.select("row_id", *results), "row_id").select(
        "request_id", "request_no", "pos", *results
    )


def responses(scored: DataFrame, model_uri: str, meta: DataFrame | None = None) -> DataFrame:
    """One envelope per request, predictions in input order.

    The list is as long as the request's own list was. ``meta`` is the one-line
    result of ``production_meta``.
    """
    keys = _request_keys(scored)
    fields = [c for c in scored.columns if c not in (*keys, "latency_ms")]
    # Whole milliseconds; the slowest item speaks for the request.
    latency = F.round(F.max("latency_ms")) if "latency_ms" in scored.columns else F.lit(None)
    in_order = F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: a["pos"] - b["pos"])
    envelope = scored.groupBy(*keys).agg(in_order.alias("predictions"), latency.cast("int").alias("latency_ms"))
    envelope = envelope.withColumn("model_uri", F.lit(model_uri)).drop("request_no")
    if meta is not None:
        fields_map = F.map_from_entries(
            F.array(*[F.struct(F.lit(c), F.col(c).cast("string")) for c in meta.columns])
        )
        envelope = envelope.withColumn("meta", meta.select(fields_map.alias("m")).scalar())
    return envelope


def _request_keys(scored: DataFrame) -> list[str]:
    return [c for c in ("request_id", "request_no") if c in scored.columns]


def check_labels(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split scores by whether all labels of the request are known classes.

    A model that answers with another label fails the request as a whole.
    """
    known = F.coalesce(F.col("sentiment").isin(*CLASSES), F.lit(False))
    keys = _request_keys(scored)
    failed = scored.filter(~known).select(*keys).distinct()
    errors = failed.select(
        "request_id",
        F.lit(INTERNAL_ERROR).alias("error"),
        F.lit("the model answered with an unknown label").alias("detail"),
        F.lit(STATUS_INTERNAL).alias("status"),
    )
    return scored.join(failed, keys, "left_anti"), errors


def unavailable(df: DataFrame, reason: str) -> DataFrame:
    """Error records for a batch whose model could not be run."""
    items = valid_requests(df).filter(F.size(usable_texts()) > 0)
    return items.select(
        "request_id",
        F.lit(REQUEST_FAILED).alias("error"),
        F.lit(reason).alias("detail"),
        F.lit(STATUS_NO_MODEL).alias("status"),
    )
