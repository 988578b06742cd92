"""Relational scoring with a linear model held as a coefficient table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrain.operators.features import (
    BROADCAST_BYTES,
    fits_broadcast,
    lookup_terms,
    term_count,
)
from tonegrain.schema import CLASSES
from tonegrain.sources.staging import stage


def wide_coefficients(coefs: DataFrame) -> DataFrame:
    """``(term, class, weight)`` to one line per term, a column per class."""
    return coefs.groupBy("term").agg(
        *[F.sum(F.when(F.col("class") == c, F.col("weight"))).alias(f"w_{c}") for c in CLASSES]
    )


def scoring_table(vocab: DataFrame, coefs: DataFrame) -> DataFrame:
    """Vocabulary and weights in one table, so texts look each term up once.

    Stage it before scoring: every lookup reads its length.
    """
    return vocab.select("term", "df", "idf").join(wide_coefficients(coefs), "term")


def with_class_probabilities(df: DataFrame, logits: Mapping[str, Column]) -> DataFrame:
    """Softmax over the logits: ``probabilities`` and the likeliest ``sentiment``.

    Among equal probabilities the first class in label order wins.
    """
    df = df.withColumns({f"_z_{c}": z for c, z in logits.items()})
    top = F.greatest(*[F.col(f"_z_{c}") for c in logits])
    df = df.withColumn("_top", top).withColumns(
        {f"_e_{c}": F.exp(F.col(f"_z_{c}") - F.col("_top")) for c in logits}
    )
    total = sum((F.col(f"_e_{c}") for c in logits), F.lit(0.0))
    winner = F.coalesce(
        *[F.when(F.col(f"_z_{c}") == F.col("_top"), F.lit(c)) for c in logits]
    )
    pairs = [x for c in logits for x in (F.lit(c), F.col(f"_e_{c}") / total)]
    return df.withColumn("sentiment", winner).withColumn("probabilities", F.create_map(*pairs)).drop(
        "_top", *[f"_{p}_{c}" for p in "ze" for c in logits]
    )


def _sums_to_scores(
    sums: DataFrame, intercepts: Mapping[str, float], norm: Column
) -> DataFrame:
    """Scores of the sums; a document without a known term, whose sums are null, has the intercepts alone."""
    logits = {
        c: F.coalesce(F.col(f"_s_{c}") / norm, F.lit(0.0)) + F.lit(float(intercepts[c]))
        for c in CLASSES
    }
    scored = with_class_probabilities(sums, logits)
    return scored.select("row_id", "sentiment", "probabilities")


def linear_score(
    features: DataFrame,
    coefs: DataFrame,
    intercepts: Mapping[str, float],
    ids: DataFrame,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Predicted class and class probabilities from a TF-IDF table.

    ``ids`` holds the ``row_id`` of all documents, those without features
    included. The coefficients are staged in wide form.
    """
    table = stage(wide_coefficients(coefs), "coefs")
    if not fits_broadcast(table, broadcast_bytes):
        occurrences = features.groupBy("term").agg(F.count("*").alias("df"))
        table = stage(table.join(occurrences, "term"), "coefs")
    weighted = lookup_terms(features, table, broadcast_bytes)
    sums = weighted.groupBy("row_id").agg(
        *[F.sum(F.col("weight") * F.col(f"w_{c}")).alias(f"_s_{c}") for c in CLASSES]
    )
    return _sums_to_scores(ids.select("row_id").join(sums, "row_id", "left"), intercepts, F.lit(1.0))


def score_texts(
    df: DataFrame,
    table: DataFrame,
    intercepts: Mapping[str, float],
    ngram_max: int = 1,
    column: str = "input_text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """:func:`linear_score` straight from the texts, norm and dot product in one pass.

    ``table`` is a staged :func:`scoring_table`. Documents without a known term keep a line through
    the lookup, so the texts are read once.
    """
    counts = term_count(df, ngram_max, column, keep_empty=True)
    hits = lookup_terms(counts, table, broadcast_bytes, "left")
    w = F.col("tf") * F.col("idf")
    sums = hits.groupBy("row_id").agg(
        F.sqrt(F.sum(w * w)).alias("_norm"),
        *[F.sum(w * F.col(f"w_{c}")).alias(f"_s_{c}") for c in CLASSES],
    )
    return _sums_to_scores(sums, intercepts, F.col("_norm"))
