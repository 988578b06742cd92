"""Toxicity scores: FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased.
Features are the words, neighbouring pairs, and pairs with one and two words
between, hashed to ``2**BITS`` places and counted once per text. One task runs
FTRL-proximal (a learning rate per coordinate, L1 and L2) over the labelled sample.
L1 leaves a few thousand weights that are not zero, at most ``2**BITS``; they are
broadcast, and every task scores its texts with them.

The fit reads at most ``max_rows`` labelled rows, the ones of smallest id hash. It is
sequential, as learners on parts of so small a sample, averaged, found much less.

Defined results: a null text counts as empty; an empty text gets the score of the
bias; repeated rows get equal scores; label rows that repeat an id count once, as
toxic if any says so; null labels and null ids are not learnt from; without a
labelled row every score is 0. Other columns of the input are passed through or
ignored whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrain.llm.common import ALNUM, blob, ngram_hashes, sampled, word_hashes

BITS = 22
MAX_ROWS = 16_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 3.0, 1.0, 6.0, 1.0
#: Texts of a toxic row weigh this much in the fit, as they are the rarer kind.
TOXIC_WEIGHT = 2.0


@dataclass(frozen=True)
class Model:
    """Sparse weights: places in ascending order, their weights, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    trained: bool

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.index] = self.weight
        return out


def features(data: bytes) -> np.ndarray:
    """Distinct hashed places of a text, given as UTF-8."""
    words = word_hashes(data.lower().translate(ALNUM))
    hashes = [words] + [ngram_hashes(words, 2, step) for step in (1, 2, 3)]
    return np.unique(np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int32)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero weights and bias learnt from ``rows`` in the order given."""
    z = np.zeros(1 << BITS, np.float64)
    n = np.zeros(1 << BITS, np.float64)
    zb = nb = 0.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(ni)) / ALPHA + L2)

    for _ in range(epochs):
        for places, y in zip(rows, labels, strict=True):
            zi, ni = z[places], n[places]
            w = weights(zi, ni)
            bias = -zb / ((BETA + np.sqrt(nb)) / ALPHA)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = (p - y) * (TOXIC_WEIGHT if y else 1.0)
            z[places] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[places] = ni + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / ALPHA * bias
            nb += g * g
    kept = np.flatnonzero(np.abs(z) > L1)
    return kept, weights(z[kept], n[kept]), float(-zb / ((BETA + np.sqrt(nb)) / ALPHA))


def _learn(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["_order", "_id"], kind="stable")
    places, weight, bias = ftrl([features(t) for t in group["_text"]], group["_label"].to_numpy())
    return pd.DataFrame({"place": np.append(places, -1), "weight": np.append(weight, bias)})


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, usable: Column, max_rows: int) -> DataFrame:
    """At most ``max_rows`` usable label rows, those of smallest id hash, each with one text: of an id's texts that of smallest hash."""
    own = (
        labels.filter(F.col(target).isNotNull())
        .select(F.col("doc_id").alias("_id"), F.col(target).cast("int").alias("_label"))
        .filter(F.col("_id").isNotNull() & usable)
        .groupBy("_id").agg(F.max("_label").alias("_label"))
        .withColumn("_order", F.xxhash64("_id"))
    )
    # A share of the hashes first, so that the exact cut sees few rows.
    few = sampled(F.col("_order"), max_rows + max_rows // 10, own.count())
    order = F.pmod("_order", F.lit(1 << 40))
    chosen = own.filter(few).orderBy(order, "_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").alias("_id"), blob("text").alias("_text"))
    texts = texts.join(F.broadcast(chosen), "_id")  # bounded by max_rows
    # A task sends one text of an id, so an id of many rows is no load either.
    first = F.min_by("_text", F.struct(F.xxhash64("_text"), "_text"))
    return texts.groupBy("_id", "_label", "_order").agg(first.alias("_text"))


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_rows: int = MAX_ROWS) -> Model:
    """Fit on label rows ``(doc_id, toxic)``; ``usable`` is a condition on column ``_id``."""
    usable = F.lit(True) if usable is None else usable
    sample = labelled_sample(docs, labels, "toxic", usable, max_rows)
    fitted = sample.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_learn, "place long, weight double").toPandas()
    if fitted.empty:
        return Model(np.empty(0, np.int64), np.empty(0), 0.0, False)
    bias = float(fitted["weight"].iloc[-1])
    return Model(fitted["place"].to_numpy(np.int64)[:-1], fitted["weight"].to_numpy()[:-1], bias, True)


def score(text: Column, model: Model, df: DataFrame) -> Column:
    """Probability of the toxic label as a column expression over ``df``."""
    if not model.trained:
        return F.lit(0.0)
    shared = df.sparkSession.sparkContext.broadcast((model.index, model.weight, model.bias))

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index, weight, bias = shared.value
        dense = Model(index, weight, bias, True).dense()
        for texts in batches:
            logits = np.array([dense[features(t)].sum(dtype=np.float64) + bias for t in texts])
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(logits, -35, 35))))

    return toxic(blob(text))
