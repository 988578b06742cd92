"""Multinomial logistic regression whose coefficients are a table.

The objective is that of :mod:`tonegrain.operators.classifier`; vocabulary and coefficients are tables with a line
per term, and the optimiser of :mod:`tonegrain.operators.blocks` keeps its vectors in slices of the terms, so nothing
that grows with the vocabulary reaches the driver. The feature lines move twice in all: to the terms, whose numbers
they take, and to their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrain.operators import blocks
from tonegrain.operators.blocks import direction  # noqa: F401
from tonegrain.operators.classifier import C, with_class_weight
from tonegrain.operators.features import BROADCAST_BYTES, fits_broadcast, join_terms
from tonegrain.schema import CLASSES
from tonegrain.sources.staging import discard, stage, write_staged


def _numbered(vocab: DataFrame) -> tuple[DataFrame, str]:
    """``term, df, number``, numbers from 0 without a gap; staged, so every read finds the same ones."""
    lines = vocab.select("term", "df").rdd.zipWithIndex().map(lambda x: (x[0]["term"], x[0]["df"], x[1]))
    return write_staged(vocab.sparkSession.createDataFrame(lines, "term string, df bigint, number bigint"), "numbers")


def train(
    features: DataFrame,
    vocab: DataFrame,
    labels: DataFrame,
    max_iter: int = 200,
    tolerance: float = 1e-5,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> tuple[DataFrame, dict[str, float]]:
    """``(term, class, weight)`` and the intercepts, fitted with balanced class weights (an action).

    ``features`` is ``(row_id, term, weight)`` as :func:`features.tfidf` gives it, ``vocab`` the staged vocabulary and
    ``labels`` ``(row_id, class)`` with unique ids. Rows without features count with the intercepts alone; features of
    rows that have no label are left out, as are labels outside the known classes. Stops when an iteration lowers the
    objective by less than ``tolerance`` of it. Without rows all weights are 0.
    """
    spark = features.sparkSession
    label = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("class")) - 1
    known = labels.select("row_id", "class").filter(F.col("class").isin(*CLASSES))
    weighted = with_class_weight(known).select("row_id", label.cast("int").alias("label"), F.col("weight").alias("row_weight"))
    numbers, numbers_path = _numbered(vocab)
    lines = join_terms(features, numbers, fits_broadcast(numbers, broadcast_bytes))
    each = lines.groupBy("row_id").agg(F.collect_list(F.struct("number", "weight")).alias("entries"))
    own = {name: F.coalesce(F.col(f"entries.{field}"), F.array().cast(f"array<{kind}>")) for name, field, kind in (
        ("indices", "number", "bigint"), ("values", "weight", "double"))}
    rows = weighted.join(each, "row_id", "left").select("label", "row_weight", *[c.alias(n) for n, c in own.items()])
    rows, rows_path = write_staged(rows, "rows")
    n_terms = numbers.count()
    fit = blocks.fit(rows, n_terms, C, max_iter, tolerance)
    if fit is None:
        flat = numbers.select("number", F.array(*[F.lit(0.0) for _ in CLASSES]).alias("x"))
        intercepts = dict.fromkeys(CLASSES, 0.0)
    else:
        width = fit.width
        each = fit.coefs.flatMap(lambda s: [(s[0] * width + i, x.tolist()) for i, x in enumerate(s[1])])
        flat = spark.createDataFrame(each, "number bigint, x array<double>")
        own = fit.coefs.filter(lambda s: s[0] == n_terms // width).map(lambda s: s[1][n_terms % width].tolist()).first()
        intercepts = dict(zip(CLASSES, own, strict=True))
    by_class = F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in CLASSES]), "x")).alias("class", "weight")
    coefs = stage(numbers.join(flat, "number").select("term", by_class), "coefs")
    if fit is not None:
        fit.close()
    for path in (numbers_path, rows_path):
        discard(spark, path)
    return coefs, intercepts
